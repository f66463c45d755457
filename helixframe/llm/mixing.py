"""Mixing sources to target weights by Sainte-Laguë apportionment.

Sources ordered by code point (null last) weigh WEIGHTS, repeating.  They share SHARE times all
words; a target stops at CAP times its source's size and the excess is shared again by weight.

Each source is dealt into shards of about SHARD_WORDS words.  The house of blocks of BLOCK words
goes to the shards by the highest quotients target / (2 s + 1): with a divisor d at which the
rounded target / d add up to the house, a shard's quota is its rounded target / d.  Shards that tie
for the last seats get them in a seeded order.  A source with a target under one block has no part in the house: its
quota is its target in words.  Within a shard the documents stand in a seeded order on a
line of words that closes to a ring; the blocks taken are as many consecutive ones, from a seeded
start, so a document's share is the overlap of two intervals and no block becomes a row.

Defined results: a null text has size 0 and takes nothing; a null source is a source of its own;
rows repeated with one id and size are interchangeable; no rows give no rows.  The same rows give
the same mix in any order and partitioning.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm.shared import stash

WEIGHTS, SHARE, CAP = (5, 2, 1), 1.5, 2.0
BLOCK, SHARD_WORDS, SEED = 128, 1 << 20, 17
#: Up to so many sources their table (a name and three numbers each) is broadcast; more are joined by shuffle.
BROADCAST_SOURCES = 50_000
_LADDER = 64


def words(text: Column) -> Column:
    """Number of runs of `[^\\x20\\x09-\\x0D]`; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with its global 0-based rank: ranks within range partitions plus what lies before them.

    The driver gets one row for each partition.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = stash(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "ranked")
    before, sums = 0, []
    for part, count in sorted(map(tuple, parts.groupBy("_part").count().collect())):
        sums.append((part, before))
        before += count
    offsets = spark.createDataFrame(sums, "_part int, _before long")
    here = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return parts.withColumn("_here", here).join(F.broadcast(offsets), "_part").withColumn(name, F.col("_here") + F.col("_before")).drop("_part", "_here", "_before")


def with_targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> tuple[DataFrame, float]:
    """sources(source, source_size) with target; and the sum of the targets.

    Each round caps what is above its limit and shares the rest by weight; the driver sees sums only.
    """
    turn = F.col("turn") % len(weights)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (turn + 1).cast("int"))
    table = ranked(sources, [F.col("source").asc_nulls_last()], "turn").withColumn("weight", weight)
    table = stash(table.withColumn("limit", F.col("source_size") * F.lit(cap)), "sources")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    whole, level, capped = total * share, 0.0, -1
    while True:
        above = F.col("weight") * F.lit(level) >= F.col("limit") if level else F.lit(False)
        n, fixed, free = table.agg(F.count_if(above), F.sum(F.when(above, F.col("limit")).otherwise(0.0)), F.sum(F.when(above, 0.0).otherwise(F.col("weight")))).first()
        if n == capped or not free:
            break
        capped, level = n, max(0.0, whole - fixed) / free
    return table.withColumn("target", F.least(F.col("limit"), F.col("weight") * F.lit(level))).select("source", "source_size", "target"), whole


def divisor(shards: DataFrame, votes: Column, seats: int, start: float) -> float:
    """d with sum(round(votes / d)) == seats, or, where ties forbid that, the least found with fewer."""
    lo, hi = start / 2, start * 2
    for _ in range(12):
        ladder = [lo * (hi / lo) ** (i / (_LADDER - 1)) for i in range(_LADDER)]
        sums = shards.agg(*(F.sum(F.floor(votes / F.lit(d) + 0.5)).alias(f"s{i}") for i, d in enumerate(ladder))).first()
        sums = [s or 0 for s in sums]
        if seats in sums:
            return ladder[sums.index(seats)]
        above = [d for d, s in zip(ladder, sums, strict=True) if s > seats]
        below = [d for d, s in zip(ladder, sums, strict=True) if s < seats]
        if not above or not below:
            lo, hi = (lo / 8, lo) if not above else (hi, hi * 8)
            continue
        lo, hi = max(above), min(below)
        if hi / lo < 1 + 1e-13:
            break
    return hi


def tied(shards: DataFrame, seats: int, seed: int) -> DataFrame:
    """last_source, last_shard, more (1): those of the tied shards that get one of the seats."""
    order = [F.xxhash64(F.lit(seed + 3), "source", "shard"), F.col("source").asc_nulls_last(), F.col("shard")]
    first = ranked(shards, order, "turn").where(F.col("turn") < seats)
    return stash(first.select(F.col("source").alias("last_source"), F.col("shard").alias("last_shard"), F.lit(1).alias("more")), "last-seats")


def mix(docs: DataFrame, *, doc_id: str = "doc_id", source: str = "source", text: str = "text", keep: list[str] | None = None, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, block: int = BLOCK, shard_words: int = SHARD_WORDS, seed: int = SEED) -> DataFrame:
    """Columns `keep` (in a struct `row`), size, source_size, target, taken, times, pieces.

    times: whole copies taken; pieces: from and to (in words, end exclusive) of what is taken once
    more.  taken adds them up.
    """
    keep = [doc_id] if keep is None else list(keep)
    row = F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row")
    sized = docs.select(row, F.col(f"`{doc_id}`").alias("id"), F.col(f"`{source}`").alias("source"), words(F.col(f"`{text}`")).alias("size"))
    light = stash(sized.select("id", "source", "size"), "sizes") if keep == [doc_id] else sized
    if light is not sized:
        sized = light.select(F.struct(F.col("id").alias(doc_id)).alias("row"), "id", "source", "size")
    per_source = light.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources, whole = with_targets(per_source, weights, share, cap)
    if sources.count() <= BROADCAST_SOURCES:
        sources = F.broadcast(sources)
    in_shard = F.pmod(F.xxhash64(F.lit(seed), "id", "size"), F.ceil(F.greatest(F.col("source_size"), F.lit(1)) / F.lit(shard_words)))
    join = lambda df: df.alias("d").join(sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).drop(F.col("s.source")).withColumn("shard", in_shard)
    votes = F.when(F.col("source_size") > 0, F.col("target") * F.col("shard_size") / F.col("source_size")).otherwise(0.0)
    shards = stash(join(light.select("id", "source", "size")).groupBy("source", "shard").agg(F.sum("size").alias("shard_size"), F.first("source_size").alias("source_size"), F.first("target").alias("target")), "shards")
    small = F.col("target") < block
    seats = math.floor((whole - (sources.agg(F.sum(F.when(small, F.col("target")))).first()[0] or 0.0)) / block + 0.5)
    house = F.when(small, 0.0).otherwise(votes)
    d = divisor(shards, house, seats, float(block)) if seats > 0 else float(block)
    seats_at = lambda d: F.floor(house / F.lit(d) + 0.5)
    left = seats - (shards.agg(F.sum(seats_at(d))).first()[0] or 0) if seats > 0 else 0
    last = tied(shards.where(seats_at(d * (1 - 1e-12)) > seats_at(d)), left, seed) if left > 0 else None
    ring = Window.partitionBy("source", "shard")
    line = ring.orderBy(F.xxhash64(F.lit(seed + 1), "id", "size"), "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    size, total = F.col("size"), F.col("shard_size")
    blocks = seats_at(d) if last is None else seats_at(d) + F.coalesce("more", F.lit(0))
    taken = F.least(F.when(small, F.floor(votes + 0.5)).otherwise(blocks * block), (total * F.lit(cap)).cast("long"))
    dealt = join(sized)
    if last is not None:
        dealt = dealt.join(last, F.col("d.source").eqNullSafe(F.col("last_source")) & (F.col("shard") == F.col("last_shard")), "left")
    out = (
        dealt
        .withColumns({"shard_size": F.sum("size").over(ring), "to": F.sum("size").over(line)})
        .withColumn("quota", taken)
        .withColumn("times", F.when(total > 0, F.expr("quota div shard_size")).otherwise(0))
        .withColumn("rest", F.col("quota") - F.col("times") * total)
        .withColumn("start", F.when(total > 0, F.pmod(F.xxhash64(F.lit(seed + 2), "source", "shard"), total)).otherwise(0))
        .withColumn("from", F.col("to") - size)
    )
    pieces = []
    for turn in (0, 1):  # the ring's interval as it lies, and what of it goes round
        lo, hi = F.col("start") - total * turn, F.col("start") + F.col("rest") - total * turn
        pieces.append(F.struct((F.greatest(lo, F.col("from")) - F.col("from")).alias("from"), (F.least(hi, F.col("to")) - F.col("from")).alias("to")))
    out = out.withColumn("pieces", F.array_sort(F.filter(F.array(*pieces), lambda p: p["to"] > p["from"])))
    once = F.aggregate("pieces", F.lit(0).cast("long"), lambda a, p: a + p["to"] - p["from"])
    return out.select("row", "size", "source_size", "target", (F.col("times") * size + once).alias("taken"), "times", "pieces")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, in docs' columns: a row for each whole copy and each piece that is taken.

    A piece's text is cut from the document at word borders, white space kept; n_chars follows it.
    """
    text = options.get("text", "text")
    mixed = mix(docs, keep=docs.columns, **options)
    body, size = F.col(f"row.`{text}`"), F.col("size")
    whole = F.struct(F.lit(0).cast("long").alias("from"), size.alias("to"))
    taken = F.concat(F.array_repeat(whole, F.col("times").cast("int")), F.col("pieces"))
    rows = mixed.where(size > 0).select("row", "size", F.explode(taken).alias("piece"))
    parts = F.split(F.regexp_replace(body, "^[\\x20\\x09-\\x0D]+", ""), "(?<=[\\x20\\x09-\\x0D])(?=[^\\x20\\x09-\\x0D])")
    cut = F.array_join(F.slice(parts, (F.col("piece.from") + 1).cast("int"), (F.col("piece.to") - F.col("piece.from")).cast("int")), "")
    rows = rows.withColumn("cut", F.when((F.col("piece.from") == 0) & (F.col("piece.to") == size), body).otherwise(cut))
    out = []
    for f in docs.schema.fields:
        c = F.col("cut") if f.name == text else F.char_length("cut").cast(f.dataType) if f.name == "n_chars" else F.col(f"row.`{f.name}`")
        out.append(c.alias(f.name))
    return rows.select(*out)
