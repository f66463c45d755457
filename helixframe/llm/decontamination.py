"""Benchmark decontamination by winnowing.

A span of `WINDOW` words that a document shares with a benchmark item holds WINDOW - GRAM + 1
consecutive word grams; both sides keep the least of them (the rightmost on a tie), so both keep
the same one and meet on it.  A meeting is extended word by word to every window that covers it.
Words are compared by 64-bit hashes of their bytes.

Defined results: a null or empty text has no words and no hits; an item without words never occurs;
repeated documents each get their own row; repeated items count once; items of one text under
several ids all count; a null item_id is written as the empty string.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.llm import kernels as K
from helixframe.llm.shared import fresh, per_text, stash

WINDOW, GRAM = 8, 4
#: Most bytes of benchmark text that one broadcast index is made of; more benchmark text goes in blocks.
INDEX_BYTES = 32 << 20
#: Up to so many texts that blocks hit are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 200_000
_BITS = 22
_PAIRS = 1 << 18

FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("spans", T.ArrayType(T.LongType())),
    ]
)


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts and the number of words before each text."""
    buf, at = K.utf8(texts)
    buf = K.LOWER[buf]
    starts, ends, first = K.word_spans(buf, at, K.ALNUM)
    return K.hash_spans(buf, starts, ends), first


def winnow(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and values of the grams kept: of each window the least, rightmost on a tie."""
    grams = K.lines_up(words, GRAM)
    m = len(words) - WINDOW + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    best, where = grams[:m].copy(), np.arange(m)
    for j in range(1, WINDOW - GRAM + 1):
        less = grams[j : j + m] <= best
        best[less] = grams[j : j + m][less]
        where[less] = np.flatnonzero(less) + j
    kept = np.zeros(len(grams), bool)
    kept[where[K.within(first, len(words), WINDOW)]] = True
    at = np.flatnonzero(kept)
    return at, grams[at]


class _Set:
    """Sorted 64-bit keys with a bitmap in front, and the payload of each key."""

    def __init__(self, keys: np.ndarray, payload: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.keys, self.payload = keys[order], payload[order]
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[keys & np.uint64((1 << _BITS) - 1)] = True

    def pairs(self, at: np.ndarray, keys: np.ndarray):
        """(position, payload) of each meeting, some at a time."""
        maybe = self.seen[keys & np.uint64((1 << _BITS) - 1)]
        at, keys = at[maybe], keys[maybe]
        lo, hi = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        some = hi > lo
        at, lo, n = at[some], lo[some], (hi - lo)[some]
        upto = np.cumsum(n)
        i = 0
        while i < len(n):
            j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + _PAIRS, "right")))
            each = n[i:j]
            offset = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            yield np.repeat(at[i:j], each), self.payload[np.repeat(lo[i:j], each) + offset]
            i = j


class Index:
    """A block of benchmark items: winnowed grams of the long ones, whole texts of the short ones."""

    def __init__(self, item_ids: list[str], texts: pa.Array):
        words, first = tokens(texts)
        size = np.append(first[1:], len(words)) - first if len(first) > 1 else np.zeros(0, np.int64)
        size = size[: len(item_ids)]
        same: dict[bytes, int] = {}
        self.ids: list[list[str]] = []
        parts, begins, short = [], [0], {}
        for i, name in enumerate(item_ids):
            own = words[first[i] : first[i] + size[i]]
            if not len(own):
                continue
            k = same.setdefault(own.tobytes(), len(self.ids))
            if k < len(self.ids):
                self.ids[k].append(name)
                continue
            self.ids.append([name])
            if len(own) < WINDOW:
                short.setdefault(len(own), []).append((K.lines_up(own, len(own))[0], k))
                own = own[:0]
            parts.append(own)
            begins.append(begins[-1] + len(own))
        self.words = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        begins = np.array(begins)
        self.item = K.owner(begins, len(self.words)) if len(begins) > 1 else np.zeros(0, np.int64)
        at, grams = winnow(self.words, begins)
        self.grams = _Set(grams, at)
        self.short = {n: _Set(np.array([h for h, _ in v], np.uint64), np.array([k for _, k in v])) for n, v in short.items()}

    def search(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A +1/-1 trace of the hit words, and the (document, item text) pairs that occur."""
        total, doc, many = len(words), K.owner(first, len(words)), len(self.ids) + 1
        trace, met = np.zeros(total + 1, np.int64), [np.zeros(0, np.int64)]
        for p, q in self.grams.pairs(*winnow(words, first)):
            near = np.arange(GRAM - WINDOW, WINDOW)
            i, j = p[:, None] + near, q[:, None] + near
            ok = (i >= 0) & (i < total) & (j >= 0) & (j < len(self.words))
            i, j = np.where(ok, i, 0), np.where(ok, j, 0)
            ok &= (words[i] == self.words[j]) & (doc[i] == doc[p][:, None]) & (self.item[j] == self.item[q][:, None])
            for s in range(WINDOW - GRAM + 1):
                full = ok[:, s : s + WINDOW].all(axis=1)
                at = p[full] + near[s]
                np.add.at(trace, at, 1)
                np.add.at(trace, at + WINDOW, -1)
                met.append(np.unique(doc[at] * many + self.item[q[full]]))
        for n, keys in self.short.items():
            grams = K.lines_up(words, n)
            at = np.flatnonzero(K.within(first, total, n))
            for p, k in keys.pairs(at, grams[at]):
                np.add.at(trace, p, 1)
                np.add.at(trace, p + n, -1)
                met.append(np.unique(doc[p] * many + k))
        both = np.unique(np.concatenate(met))
        return trace, both // many, both % many


def blocks(benchmark: DataFrame, item_id: str, text: str, most: int = INDEX_BYTES):
    """The distinct items in blocks of at most `most` bytes of text (or one item), one at a time."""
    items = benchmark.select(F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("")).alias("id"), F.col(f"`{text}`").alias("text"))
    items = items.where("text is not null").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total * 2 // most)) if total > most else 1
    while True:
        block = F.pmod(F.xxhash64("id", "text"), F.lit(n)).alias("block")
        sizes = items.groupBy(block).agg(F.sum(F.octet_length("text")).alias("b"), F.count("*").alias("n")).collect()
        if all(r.b <= most or r.n == 1 for r in sizes):
            break
        n *= 2
    for r in sorted(sizes):
        yield items.where(block == r.block).toArrow()


def _pass(docs: DataFrame, index: Index, *, text: str, keep: list[str]) -> DataFrame:
    """Columns `keep` with n_words, and n_hit, items and spans by one index, which is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def make():
        held = shared.value

        def work(texts: pa.Array, _):
            words, first = tokens(texts)
            trace, docs_met, texts_met = held.search(words, first)
            items: list[list[str]] = [[] for _ in range(len(texts))]
            for d, k in zip(docs_met.tolist(), texts_met.tolist(), strict=True):
                items[d] += held.ids[k]
            hit = np.cumsum(trace)[:-1] > 0
            upto = np.concatenate([[0], np.cumsum(hit)])
            first = np.append(first[:-1], len(words))
            flips = np.diff(hit.astype(np.int8), prepend=0)
            inner = first[(first > 0) & (first < len(words))]
            both = inner[hit[inner] & hit[inner - 1]]
            begin = np.union1d(np.flatnonzero(flips == 1), both)
            end = np.union1d(np.append(np.flatnonzero(flips == -1), [len(words)] if len(hit) and hit[-1] else []), both)
            runs = np.searchsorted(begin, first)
            base = np.repeat(first[:-1], np.diff(runs))
            flat = np.stack([begin - base, end - base], axis=1).astype(np.int64).ravel()
            return [
                pa.array(np.diff(first)),
                pa.array(np.diff(upto[first])),
                pa.array([sorted(set(x)) for x in items], pa.list_(pa.string())),
                pa.ListArray.from_arrays(pa.array((runs * 2).astype(np.int32)), pa.array(flat)),
            ]

        return work

    return per_text(docs, make, FOUND, text=text, keep=keep)


def _union(spans: Column) -> Column:
    """Flat starts and ends of the union of lists of flat starts and ends."""
    both = lambda x: F.transform(F.sequence(F.lit(0), F.size(x) - 2, F.lit(2)), lambda i: F.struct(F.get(x, i).alias("a"), F.get(x, i + 1).alias("b")))
    empty = F.array().cast("array<bigint>")

    def add(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        wider = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.greatest(last, s["b"])))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1)) >= s["a"]), wider).otherwise(F.concat(done, F.array(s["a"], s["b"])))

    return F.aggregate(F.array_sort(F.flatten(F.transform(spans, both))), empty, add)


def find(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", keep: list[str] | None = None, index_bytes: int = INDEX_BYTES, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Columns `keep` of docs with n_words, n_hit, items (ids, sorted as strings), spans (starts and ends of hit runs, in words).

    A benchmark within `index_bytes` of text is one broadcast index, and docs take one narrow pass.  A larger one takes a pass for each block
    of it, one index at a time; a pass gives the texts that it hits, which are put together by text afterwards.
    """
    keep = ["doc_id"] if keep is None else list(keep)
    cut = blocks(benchmark, item_id, item_text, index_bytes)
    some = list(itertools.islice(cut, 2))
    index = lambda b: Index(b.column("id").to_pylist(), b.column("text"))
    if len(some) < 2:
        return _pass(docs, index(some[0]) if some else Index([], pa.array([], pa.string())), text=text, keep=keep)
    key = fresh(docs, "text_key")
    keyed = docs.withColumn(key, F.md5(F.col(f"`{text}`").cast("binary")))
    found = None
    for block in itertools.chain(some, cut):
        hits = _pass(keyed, index(block), text=text, keep=[key]).toDF("key", "n_words", "n_hit", "items", "spans").where("n_hit > 0")
        hits = stash(hits.select("key", "items", "spans").dropDuplicates(["key"]), "hits")
        found = hits if found is None else found.unionByName(hits)
    merged = found.groupBy("key").agg(F.flatten(F.collect_list("items")).alias("items"), _union(F.collect_list("spans")).alias("spans"))
    merged = stash(merged.select("key", F.array_sort(F.array_distinct("items")).alias("items"), "spans"), "hits")
    if merged.count() <= broadcast_rows:
        merged = F.broadcast(merged)
    base = _pass(keyed, Index([], pa.array([], pa.string())), text=text, keep=[*keep, key])
    words, hit, items, spans = base.columns[-4:]
    out = base.alias("d").join(merged.alias("h"), F.col(f"d.`{key}`") == F.col("h.key"), "left")
    n_hit = F.aggregate("h.spans", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("sign")), lambda s, x: F.struct((s["n"] + x * s["sign"]).alias("n"), (-s["sign"]).alias("sign")), lambda s: s["n"])
    return out.select(
        *(F.col(f"d.`{c}`") for c in [*keep, words]),
        F.coalesce(n_hit, F.lit(0)).cast("long").alias(hit),
        F.coalesce("h.items", F.array().cast("array<string>")).alias(items),
        F.coalesce("h.spans", F.array().cast("array<bigint>")).alias(spans),
    )


def contaminated(items, at_least: int = 2):
    """A document counts as contaminated from so many items on."""
    return F.size(items) >= at_least


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without those that hold a window of any item, in the same columns."""
    found = find(docs, benchmark, keep=docs.columns, **options)
    hit = F.col(f"`{found.columns[len(docs.columns) + 1]}`")
    return found.where(hit == 0).select(*(F.col(f"`{c}`") for c in docs.columns))
