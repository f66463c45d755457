"""Running extremes along a chromosome without one task for each chromosome."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bases of one chunk of a chromosome; a window holds the rows of one chunk.
CHUNK = 1 << 20
#: Rows without a place go to so many chunks of their own, numbered from far below all others: nothing runs along them.
NOWHERE, BELOW = 1024, -(1 << 62)


def fresh(taken: Iterable[str], *stems: str) -> list[str]:
    """Column names that are not taken, one for each stem."""
    used, out = {c.lower() for c in taken}, []
    for name in stems:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        out.append(name)
    return out


@dataclass(frozen=True)
class Running:
    """The largest value on the rows before (backward: the least on the rows after; inclusive: and on the row itself)."""

    value: Column
    backward: bool = False
    inclusive: bool = False


def running(df: DataFrame, by: str, pos: str, order: list[Column], *, keep_chunk: str | None = None, **wanted: Running) -> DataFrame:
    """df with a column for each of `wanted`, along `order` (which begins with `pos`) within each `by`; and the chunk, if a name is given for it.

    Rows are windowed within chunks; what the other chunks add comes from one row a chunk, so that no task holds more
    than a chunk's rows, or a chromosome's chunks.  df is read twice, however many columns are wanted; the result is dealt by chunk,
    so windows within chunks that follow need no shuffle.  Rows without `by` or `pos` get null.
    """
    names = [*df.columns, *wanted]
    chunk, at, by_ = fresh(names, keep_chunk or "chunk", "chunk_at", "chunk_by")
    values, far = fresh([*names, chunk, at, by_], *(f"value_{k}" for k in wanted)), {}
    placed = F.col(by).isNotNull() & F.col(pos).isNotNull()
    nowhere = F.lit(BELOW) + F.pmod(F.monotonically_increasing_id(), F.lit(NOWHERE))
    cut = df.withColumn(chunk, F.when(placed, F.floor(F.col(pos) / CHUNK)).otherwise(nowhere))
    cut = cut.withColumns(dict(zip(values, (w.value for w in wanted.values()), strict=True)))
    pick = lambda w: F.min if w.backward else F.max
    chunks = cut.where(placed).groupBy(F.col(by).alias(by_), F.col(chunk).alias(at)).agg(*(pick(w)(v).alias(v) for v, w in zip(values, wanted.values(), strict=True)))
    outer = Window.partitionBy(by_).rowsBetween(Window.unboundedPreceding, -1)
    for v, (name, w) in zip(values, wanted.items(), strict=True):
        # a frame that grows is cheap, one that shrinks is not: so the least on the rows after runs along the order turned round
        far[name] = pick(w)(v).over(outer.orderBy(F.col(at).desc() if w.backward else F.col(at)))
    chunks = chunks.select(by_, at, *(c.alias(f"far_{i}") for i, c in enumerate(far.values())))
    here = Window.partitionBy(by, chunk)
    near = {}
    for v, (name, w) in zip(values, wanted.items(), strict=True):
        lines = [c.desc() for c in order] if w.backward else order
        near[name] = pick(w)(v).over(here.orderBy(*lines).rowsBetween(Window.unboundedPreceding, 0 if w.inclusive else -1))
    found = cut.withColumns(near).drop(*values).join(chunks, (F.col(by) == F.col(by_)) & (F.col(chunk) == F.col(at)), "left")
    for i, (name, w) in enumerate(wanted.items()):
        found = found.withColumn(name, F.when(placed, (F.least if w.backward else F.greatest)(F.col(name), F.col(f"far_{i}"))))
    return found.select(*(f"`{c}`" for c in df.columns), *([chunk] if keep_chunk else []), *wanted)
