"""Interval relations: overlap joins, semi and anti joins, nearest, merge, spans, unions."""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.operators.prefix import Running, fresh, running

#: Bin sizes grow eightfold a level, from BIN to past any chromosome: an interval takes two bins a level at most.
BIN, GROW, LEVELS = 1 << 10, 8, 8


def _level(start: Column, end: Column) -> Column:
    """The first level whose bins are longer than the interval."""
    level = F.lit(LEVELS - 1)
    for k in reversed(range(LEVELS - 1)):
        level = F.when(end - start < BIN * GROW**k, k).otherwise(level)
    return level


def _binned(df: DataFrame, start: str, end: str, levels: Column, key: str, bin_: str) -> DataFrame:
    """A row for each of `levels` and each of its bins that meets the interval."""
    size = lambda k: F.lit(float(BIN)) * F.pow(F.lit(float(GROW)), k)
    bins = lambda k: F.transform(F.sequence(F.floor(F.col(start) / size(k)), F.floor(F.col(end) / size(k))), lambda b: F.struct(k.alias("k"), b.alias("b")))
    each = df.withColumn(key, F.explode(F.flatten(F.transform(levels, bins))))
    return each.withColumns({bin_: F.col(f"{key}.b"), key: F.col(f"{key}.k")})


def _levels(df: DataFrame, own: str) -> list[int]:
    """The levels that occur: LEVELS at most."""
    return sorted(r[0] for r in df.select(own).distinct().collect())


def _sides(left: DataFrame, right: DataFrame, left_on: tuple[str, str, str], right_on: tuple[str, str, str], names: list[str], contained: bool = False):
    """Both sides of each of the two keyed joins, with names: level and bin of the left, level and bin of the right."""
    (lc, ls, le), (rc, rs, re_) = left_on, right_on
    own_l, key_l, bin_l, own_r, key_r, bin_r = names
    a = left.where((F.col(ls) <= F.col(le)) & F.col(lc).isNotNull()).withColumn(own_l, _level(F.col(ls), F.col(le)))
    b = right.where((F.col(rs) <= F.col(re_)) & F.col(rc).isNotNull()).withColumn(own_r, _level(F.col(rs), F.col(re_)))
    at = lambda levels, keep: F.filter(F.array(*(F.lit(k) for k in levels)).cast("array<int>"), keep)
    every_r = at(_levels(a, own_l), lambda k: k >= F.col(own_r))
    yield _binned(a, ls, le, F.array(F.col(own_l)), key_l, bin_l), _binned(b, rs, re_, every_r, key_r, bin_r)
    if not contained:  # a shorter interval holds no longer one
        every_l = at(_levels(b, own_r), lambda k: k > F.col(own_l))
        yield _binned(a, ls, le, every_l, key_l, bin_l), _binned(b, rs, re_, F.array(F.col(own_r)), key_r, bin_r)


def overlap_join(left: DataFrame, right: DataFrame, *, left_on: tuple[str, str, str] = ("chrom", "start", "end"), right_on: tuple[str, str, str] = ("chrom", "start", "end"), contained: bool = False) -> DataFrame:
    """Pairs of overlapping intervals, or with contained those whose left interval holds the right one.

    Both sides' columns must differ in name (rename first).  Each pair meets at the level of its longer interval, whose bins are longer than it:
    once where the left one is of that level and the right one of that or a lower one, and once where the right one is of a higher level.
    So two equi-joins on chromosome, level and bin, in each of which one side stands at its own level only, and the other at those above
    it that occur on the first; short intervals never meet at high levels.  A pair comes out in the bin of its later start.
    Null or reversed intervals meet nothing; repeated rows each make their pairs.
    """
    clash = {c.lower() for c in left.columns} & {c.lower() for c in right.columns}
    if clash:
        raise ValueError(f"both sides have {', '.join(sorted(clash))}")
    (lc, ls, le), (rc, rs, re_) = left_on, right_on
    names = fresh([*left.columns, *right.columns], "own_l", "level_l", "bin_l", "own_r", "level_r", "bin_r")
    _, key_l, bin_l, _, key_r, bin_r = names
    size = F.lit(float(BIN)) * F.pow(F.lit(float(GROW)), F.col(key_l))
    on = (F.col(lc) == F.col(rc)) & (F.col(key_l) == F.col(key_r)) & (F.col(bin_l) == F.col(bin_r))
    on &= (F.col(ls) <= F.col(re_)) & (F.col(le) >= F.col(rs)) & (F.col(bin_l) == F.floor(F.greatest(ls, rs) / size))
    if contained:
        on &= (F.col(ls) <= F.col(rs)) & (F.col(re_) <= F.col(le))
    pairs = [x.join(y, on).select(*(f"`{c}`" for c in [*left.columns, *right.columns])) for x, y in _sides(left, right, left_on, right_on, names, contained)]
    return functools.reduce(DataFrame.unionByName, pairs)


def points_in(points: DataFrame, intervals: DataFrame, *, chrom: str = "chrom", pos: str = "pos", on: tuple[str, str, str] = ("chrom", "start", "end"), how: str = "inner", key: list[str] | None = None) -> DataFrame:
    """Points within intervals: pairs (inner), or the points in any (left_semi) or none (left_anti).

    Semi and anti forms meet the merged intervals, of which at most one holds a point: whether one does
    is read off running maxima, without a join of pairs.
    """
    if how == "inner":
        (last,) = fresh([*points.columns, *intervals.columns], "last")
        same = points.withColumn(last, F.col(pos))
        return overlap_join(same, intervals, left_on=(chrom, pos, last), right_on=on).drop(last)
    if how not in ("left_semi", "left_anti"):
        raise ValueError(f"how is inner, left_semi or left_anti, not {how!r}")
    c, s, e = on
    rows, kind = _whole(points)
    both = points.select(F.col(chrom).alias("c"), F.col(pos).cast("long").alias("p"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("e"), rows)
    both = both.unionByName(intervals.select(F.col(c).alias("c"), F.col(s).cast("long").alias("p"), F.lit(0).alias("kind"), F.col(e).cast("long").alias("e"), F.lit(None).cast(kind).alias("row")))
    found = running(both, "c", "p", [F.col("p"), F.col("kind")], reach=Running(F.col("e")))
    inside = F.coalesce(F.col("reach") >= F.col("p"), F.lit(False))
    return found.where((F.col("kind") == 1) & (inside if how == "left_semi" else ~inside)).select("row.*")


def _whole(df: DataFrame) -> tuple[Column, T.DataType]:
    """All columns as one named row, and its type."""
    row = F.struct(*(F.col(f"`{x}`") for x in df.columns)).alias("row")
    return row, df.select(row).schema["row"].dataType


def nearest_distance(points: DataFrame, intervals: DataFrame, *, chrom: str = "chrom", pos: str = "pos", end: str | None = None, on: tuple[str, str, str] = ("chrom", "start", "end"), out: str = "distance") -> DataFrame:
    """points (or, with end, intervals) with the distance to the nearest interval of their chromosome; null without any.

    The nearest on the left is the furthest end among starts up to here, on the right the next start:
    two running extremes in place of pairs.
    """
    c, s, e = on
    rows, kind = _whole(points)
    last = F.col(end if end else pos).cast("long")
    nothing = F.lit(None).cast("long")
    # a point looks left from its end and right from it too: intervals that start up to its end may reach it
    mine = points.select(F.col(chrom).alias("c"), last.alias("p"), F.lit(1).alias("kind"), F.col(pos).cast("long").alias("s"), nothing.alias("e"), nothing.alias("n"), rows)
    theirs = intervals.select(F.col(c).alias("c"), F.col(s).cast("long").alias("p"), F.lit(0).alias("kind"), nothing.alias("s"), F.col(e).cast("long").alias("e"), F.col(s).cast("long").alias("n"), F.lit(None).cast(kind).alias("row"))
    both = running(mine.unionByName(theirs), "c", "p", [F.col("p"), F.col("kind")], reach=Running(F.col("e")), next=Running(F.col("n"), backward=True))
    left = F.when(F.col("reach").isNotNull(), F.greatest(F.lit(0).cast("long"), F.col("s") - F.col("reach")))
    right = F.col("next") - F.col("p")
    (name,) = fresh(points.columns, out)
    return both.where("kind = 1").select("row.*", F.least(left, right).alias(name))


def islands(intervals: DataFrame, *, on: tuple[str, str, str] = ("chrom", "start", "end")) -> DataFrame:
    """intervals with `island`: the start of the stretch of touching ones that each is of; null without a chromosome.

    A stretch that comes from earlier chunks is told by one row a chunk.
    """
    c, s, e = on
    order = [F.col(s), F.col(e)]
    reach, opens = fresh(intervals.columns, "reach", "opens")
    reached = running(intervals, c, s, order, **{reach: Running(F.col(e))})
    marked = reached.withColumn(opens, F.when(F.col(c).isNotNull() & (F.col(reach).isNull() | (F.col(s) > F.col(reach))), F.col(s)))
    (name,) = fresh(intervals.columns, "island")
    return running(marked, c, s, order, **{name: Running(F.col(opens), inclusive=True)}).drop(reach, opens)


def merge(intervals: DataFrame, *, on: tuple[str, str, str] = ("chrom", "start", "end")) -> DataFrame:
    """The union of the intervals of each chromosome: touching ones (next start <= end) become one, adjacent ones do not.

    Of each chunk the islands that begin in it, and what reaches into it from before, are put together first; the latter, one row a chunk,
    then joins the island that it is of.  Rows without chromosome, start or end are no interval.
    """
    c, s, e = on
    rows = intervals.select(F.col(c).alias("c"), F.col(s).cast("long").alias("s"), F.col(e).cast("long").alias("e")).where("c is not null and s is not null and e is not null")
    order = [F.col("s"), F.col("e")]
    reached = running(rows, "c", "s", order, keep_chunk="chunk", reach=Running(F.col("e")))
    marked = reached.withColumn("opens", F.when(F.col("reach").isNull() | (F.col("s") > F.col("reach")), F.col("s")))
    here = Window.partitionBy("c", "chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    pieces = marked.withColumn("island", F.max("opens").over(here)).groupBy("c", "chunk", "island").agg(F.max("e").alias("e"))
    last = pieces.groupBy(F.col("c").alias("c_"), F.col("chunk").alias("chunk_")).agg(F.max("island").alias("last"))
    before = Window.partitionBy("c_").orderBy("chunk_").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("c_", "chunk_", F.max("last").over(before).alias("carried"))
    whole = pieces.join(carried, (F.col("c") == F.col("c_")) & (F.col("chunk") == F.col("chunk_"))).withColumn("island", F.coalesce("island", "carried"))
    return whole.groupBy(F.col("c").alias(c), F.col("island").alias(s)).agg(F.max("e").alias(e))


def check_mergeable(intervals: DataFrame, *, on: tuple[str, str, str] = ("chrom", "start", "end")) -> DataFrame:
    """The rows that are no segment (unknown chromosome, or start not before end)."""
    from helixframe.functions.intervals import segment, valid_segment

    return intervals.where(~valid_segment(segment(*(F.col(x) for x in on))))


def union(a: DataFrame, b: DataFrame, **options) -> DataFrame:
    return merge(a.unionByName(b), **options)


def spans(intervals: DataFrame, *by: str, start: str = "start", end: str = "end") -> DataFrame:
    """Least start, largest end and number of segments of each group."""
    return intervals.groupBy(*by).agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n_segments"))


def gaps(table: DataFrame, chrom: str, kind: str) -> DataFrame:
    """Telomeres or the centromere of a gap table (chrom, chromStart, chromEnd, type; 0-based, half open) as closed segments.

    Telomeres come as their union.  A chromosome without exactly one centromere is an error when the rows are read.
    """
    if kind not in ("telomere", "centromere"):
        raise TypeError(f"kind is telomere or centromere, not {kind!r}")
    name = chrom if chrom.startswith("chr") else f"chr{chrom}"
    rows = table.where((F.col("chrom") == name) & (F.col("type") == kind))
    found = rows.select(F.regexp_replace("chrom", "^chr", "").alias("chrom"), (F.col("chromStart") + 1).cast("long").alias("start"), F.col("chromEnd").cast("long").alias("end"))
    if kind == "telomere":
        return merge(found)
    one = found.agg(F.count("*").alias("n"), F.first("chrom").alias("chrom"), F.first("start").alias("start"), F.first("end").alias("end"))
    fail = F.raise_error(F.format_string("%s has %d centromeres", F.lit(name), "n")).cast("string")
    return one.select(F.when(F.col("n") == 1, F.col("chrom")).otherwise(fail).alias("chrom"), "start", "end")


def out_of_order(rows: DataFrame, *, chrom: str = "chrom", pos: str = "pos") -> list[str]:
    """Where rows, as they lie in their files, are not sorted: a chromosome that comes twice, or a position after a greater one.

    An empty list: sorted by locus, in any order of the chromosomes.  Each task tells a few values of each stretch of one chromosome.
    """

    def look(batches):
        part, last, out = TaskContext.get().partitionId(), None, []
        for batch in batches:
            for c, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if c != last or not out:
                    out.append([part, len(out), c, p, p, True])
                    last = c
                elif p is not None and (out[-1][4] is None or p >= out[-1][4]):
                    out[-1][4] = p
                elif p is not None:
                    out[-1][5] = False
        names = ["part", "turn", "chrom", "first", "last", "sorted"]
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)

    picked = rows.select(F.col(chrom).cast("string"), F.col(pos).cast("long"))
    stretches = picked.mapInArrow(look, "part int, turn int, chrom string, first long, last long, sorted boolean").orderBy("part", "turn")
    seen, before, wrong = set(), None, []
    for r in stretches.toLocalIterator():
        if not r.sorted:
            wrong.append(f"positions of {r.chrom} decrease")
        if before is not None and before.chrom == r.chrom:
            if None not in (before.last, r.first) and r.first < before.last:
                wrong.append(f"positions of {r.chrom} decrease")
        elif r.chrom in seen:
            wrong.append(f"{r.chrom} comes again")
        seen.add(r.chrom)
        before = r
    return list(dict.fromkeys(wrong))


def locus(df: DataFrame, chrom: str, pos: int, *, chrom_col: str = "chrom", pos_col: str = "pos") -> DataFrame:
    """The rows of one locus.  A table written by sinks.tables.write_by_locus skips files by its statistics."""
    return df.where((F.col(chrom_col) == chrom) & (F.col(pos_col) == pos))


def has_chromosome(df: DataFrame, chrom: str, *, chrom_col: str = "chrom") -> bool:
    return not df.where(F.col(chrom_col) == chrom).isEmpty()


def in_gene(chrom: Column, pos: Column, gene_chrom: Column, start: Column, end: Column) -> Column:
    return (chrom.cast("string") == gene_chrom.cast("string")) & pos.between(start, end)
