"""Document fingerprints: bottom-k sketches of shingle hashes, in DataFrame functions only.

A sketch is the K least of the different hashes of a text's runs of N words (a shorter text's
only run is all of it; words are lower-cased).  Sketches of parts merge into that of the whole;
from sketches come resemblance, containment, and the number of different runs.

Defined results: null and empty texts, and texts without words, have the empty sketch; two empty sketches are
alike (1), an empty one and another are not (0).  For neighbours, rows stand by descending doc_id,
null last, rows of one id by their text's hash; rows of one id and text count as one, and each
gets its result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.llm.mixing import ranked
from helixframe.llm.shared import stash

K, N = 128, 5
_SPAN = float(1 << 63)


def words(text: Column) -> Column:
    """Lower-cased runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
    return F.array_remove(parts, "")


def sketch(text: Column, k: int = K, n: int = N) -> Column:
    """Ascending hashes of 63 bits."""
    each = F.transform(words(text), lambda w: F.xxhash64(w))
    size = lambda h: F.size(h)

    def runs(h: Column) -> Column:
        def run(x: Column, i: Column) -> Column:
            return F.shiftrightunsigned(F.xxhash64(x, *(F.get(h, i + j) for j in range(1, n))), 1)

        long = F.transform(F.slice(h, 1, F.greatest(size(h) - (n - 1), F.lit(0))), run)
        short = F.array(F.shiftrightunsigned(F.xxhash64(h), 1))
        return F.when(size(h) >= n, long).when(size(h) > 0, short).otherwise(F.array().cast("array<bigint>"))

    # the words' hashes are made once: the lambda of a one-element array names them
    made = F.transform(F.array(each), runs)
    return F.slice(F.sort_array(F.array_distinct(F.element_at(made, 1))), 1, k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of both parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity of the run sets."""
    both = merged(a, b, k)
    share = F.size(F.array_intersect(both, F.array_intersect(a, b))) / F.size(both)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(share)


def distinct_runs(a: Column, k: int = K) -> Column:
    """Estimated number of different runs; exact below k."""
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) * F.lit(_SPAN) / F.element_at(a, -1))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's runs that b has."""
    r = resemblance(a, b, k)
    shared = r * distinct_runs(merged(a, b, k), k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), shared / distinct_runs(a, k)))


def as_text(a: Column) -> Column:
    """16 hexadecimal digits for each hash."""
    return F.array_join(F.transform(a, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def with_next(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", k: int = K, n: int = N) -> DataFrame:
    """Each row's id, text and sketch with those of the next row: next_id, next_sketch, and head.

    head is as much of the next text's start as half of the row's own text is long.
    Ids and text hashes alone are ranked; texts move once, and at most half of each once more.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    key = F.unhex(F.md5(F.concat(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("-")), F.lit("|"), F.coalesce(F.md5(F.col(f"`{text}`").cast("binary")), F.lit("-"))).cast("binary")))
    rows = docs.select(key.alias("key"), F.col(f"`{doc_id}`").alias("id"), body.alias("text"))
    light = stash(rows.select("key", "id", F.char_length("text").alias("chars")).groupBy("key").agg(F.first("id").alias("id"), F.first("chars").alias("chars"), F.count("*").alias("times")), "keys")
    order = stash(ranked(light, [F.col("id").desc_nulls_last(), F.col("key")], "place"), "order")
    total = order.count()
    after = order.select((F.pmod(F.col("place") + 1, F.lit(max(total, 1)))).alias("place"), F.col("key").alias("for_key"), F.floor(F.col("chars") / 2).cast("int").alias("need"))
    around = stash(order.select("key", "place", "times").join(after, "place").select(F.col("key"), "for_key", "need", "times"), "around")
    held = rows.join(around, "key").select("key", "id", "text", "for_key", "need", "times")
    heads = held.select(F.col("for_key").alias("key"), F.col("id").alias("next_id"), F.left("text", F.col("need")).alias("head"), sketch(F.col("text"), k, n).alias("next_sketch"), "times")
    once = heads.where("times = 1").drop("times")
    if not order.where("times > 1").isEmpty():
        once = once.unionByName(heads.where("times > 1").drop("times").dropDuplicates(["key"]))
    return held.select("key", "id", "text").join(once, "key").select("id", "text", sketch(F.col("text"), k, n).alias("sketch"), "next_id", "head", "next_sketch")


def edited(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", k: int = K, n: int = N) -> DataFrame:
    """doc_id, n_chars, edited text's hash, both fingerprints, and likeness to the edited text and to the next document."""
    rows = with_next(docs, doc_id=doc_id, text=text, k=k, n=n)
    chars = F.char_length("text")
    changed = F.concat(F.left("text", (chars - F.floor(chars / 2)).cast("int")), F.col("head"))
    rows = rows.select("id", "next_id", "sketch", "next_sketch", chars.cast("long").alias("n_chars"), changed.alias("changed"))
    rows = rows.select("*", sketch(F.col("changed"), k, n).alias("changed_sketch"))
    return rows.select(
        F.col("id").alias("doc_id"),
        "n_chars",
        F.sha2(F.col("changed").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("changed_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("changed_sketch"), k).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
        distinct_runs(F.col("sketch"), k).alias("n_runs"),
        "next_id",
    )
