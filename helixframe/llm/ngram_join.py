"""N-gram Jaccard join by MinHash banding.

A text's set holds its runs of N words (lower-cased; a shorter text's only run is all of it).
Texts whose sets have Jaccard similarity THRESHOLD or more are linked.  `banding` picks bands and rows
for RECALL at the threshold; rows are shuffled by band hash and every pair that is tried is verified on
the full sets (of 64-bit run hashes).

A bucket of texts that share a band hash is settled once all its texts are in one component.  Buckets of the same texts count as one.
First every text is tried against a few leaders, of those of its buckets the ones that it shares most buckets with.
Where that leaves a bucket in parts, its texts meet in tasks that index
their runs: one lookup of a text's runs gives its exact similarity to all texts of the index, and only what joins parts is given out.
So no partner is capped, no pair within a bucket becomes a row, and the components are those of all links among candidates.

Links are counted once components are known, as every link lies within one, by the same lookups.
A bucket or component that is larger than one task's index is cut into slices, each pair of which meets in a task of its own.

Defined results: copies of one text form one class whatever they hold; null and empty texts are in
classes of their own; a class's id is its least doc_id; a null doc_id is never a class id if
any member has another; repeated rows are copies; a row is linked to its copies, and to all rows of its class
whose texts have similarity THRESHOLD or more with its own; no rows give no rows; other columns, whatever
their names, play no part, and `one_of_each` keeps them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.llm import kernels as K
from helixframe.llm.decontamination import tokens
from helixframe.llm.shared import drop, fresh, packed, per_text, stash

N, THRESHOLD, RECALL, MOST_HASHES = 5, 0.8, 0.9999, 128
#: Ids of up to so many texts (24 bytes each) are broadcast to pick rows of documents; more go by shuffle.
BROADCAST_ROWS = 500_000
#: Bytes of runs that one task indexes: smaller groups share a task, larger ones are cut into slices of about so many.
TASK_BYTES = 4 << 20
#: Leaders that a text is tried against.
LEADERS = 2
#: Rounds of label propagation after which labels also jump to their labels' labels, for long chains.
PLAIN_ROUNDS = 4


def banding(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """Bands and rows: the most rows for which so many bands reach the recall within `most` hashes."""
    best = (most, 1)
    for rows in range(1, most + 1):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows)))
        if bands * rows > most:
            break
        best = (bands, rows)
    return best


def shingles(texts: pa.Array, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's word runs, and the number of runs before each text."""
    words, first = tokens(texts)
    first = np.append(first[:-1], len(words))
    size = np.diff(first)
    runs = np.where(size >= n, size - n + 1, np.minimum(size, 1))
    upto = np.concatenate([[0], np.cumsum(runs)])
    out = np.zeros(upto[-1], np.uint64)
    long = np.repeat(size >= n, runs)
    out[long] = K.lines_up(words, n)[K.within(first, len(words), n)]
    for k in range(1, n):
        rows = np.flatnonzero(size == k)
        if len(rows):
            h = np.full(len(rows), k, np.uint64)
            for j in range(k):
                h = K.mix(h * K._C2 ^ words[first[rows] + j])
            out[upto[rows]] = h
    return out, upto


def signatures(docs: DataFrame, *, text: str, keep: list[str], n: int, bands: int, rows: int, seed: int = 1) -> DataFrame:
    """keep and bands: a hash for each band, or null for a text without words."""

    def make():
        rng = np.random.default_rng(seed)
        odd = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        flip = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)

        def work(texts: pa.Array, _):
            runs, upto = shingles(texts, n)
            some = np.flatnonzero(np.diff(upto))
            keys = np.zeros((len(some), bands), np.uint64)
            for b in range(bands if len(some) else 0):
                h = np.full(len(some), b, np.uint64)
                for r in range(b * rows, (b + 1) * rows):
                    v = runs ^ flip[r]
                    v *= odd[r]
                    v ^= v >> np.uint64(32)
                    v *= odd[r]
                    h = K.mix(h * K._C1 ^ np.minimum.reduceat(v, upto[some]))
                keys[:, b] = h
            valid = np.zeros(len(texts) + 1, bool)
            valid[some] = True
            ends = np.concatenate([[0], np.cumsum(valid[:-1]) * bands]).astype(np.int32)
            flat = pa.array(keys.ravel().view(np.int64))
            offsets = pa.array(ends, mask=np.append(~valid[:-1], False))
            return [pa.ListArray.from_arrays(offsets, flat)]

        return work

    return per_text(docs, make, T.StructType([T.StructField("bands", T.ArrayType(T.LongType()))]), text=text, keep=keep)


def sets(docs: DataFrame, *, text: str, keep: list[str], n: int) -> DataFrame:
    """keep and runs: the distinct run hashes."""

    def make():
        def work(texts: pa.Array, _):
            runs, upto = shingles(texts, n)
            own = [np.unique(runs[a:b]).view(np.int64) for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int32)
            return [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(own) if own else np.zeros(0, np.int64)))]

        return work

    return per_text(docs, make, T.StructType([T.StructField("runs", T.ArrayType(T.LongType()))]), text=text, keep=keep)


def components(links: DataFrame, rows: int | None = None) -> DataFrame:
    """node, label of all nodes of links(a, b), of which there are `rows` at most: the least node of its component.

    Each round every node takes the least label among its neighbours', and after some rounds also its label's label.
    Both sides of each join are read from written tables, so that Spark can split what a hot node or label draws.
    """
    most = None if rows is None else 2 * rows
    both = links.where("a != b").select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e"))
    edges = stash(packed(both.select("e.u", "e.v").distinct(), most), "edges")
    labels = stash(packed(edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label")), most), "labels")
    turn = 0
    while True:
        met = packed(edges.join(labels.select(F.col("node").alias("v"), "label"), "v").select("u", "label"), most)
        around = met.groupBy("u").agg(F.min("label").alias("m"))
        nearer = labels.join(around, F.col("node") == F.col("u")).select("node", F.least("label", "m").alias("label"), F.col("label").alias("was"))
        before, labels = labels, stash(packed(nearer, most), "labels")
        if turn >= PLAIN_ROUNDS:
            near = labels
            jump = near.select(F.col("node").alias("to"), F.col("label").alias("next"))
            labels = stash(packed(near.join(jump, F.col("label") == F.col("to")).select("node", F.least("label", "next").alias("label"), "was"), most), "labels")
            drop(near)
        settled = labels.where("label != was").isEmpty()
        drop(before)
        if settled:
            drop(edges)
            return labels
        turn += 1


def joined_components(labels: DataFrame, links: DataFrame, rows: int | None = None) -> DataFrame:
    """node, label after more links(a, b): the components themselves are joined, as nodes of a smaller graph."""
    ends = links
    for c in "ab":
        name = labels.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label"))
        ends = ends.join(name, c, "left").withColumn(f"{c}_label", F.coalesce(f"{c}_label", c))
    ends = stash(packed(ends.select("a", "b", "a_label", "b_label"), rows), "ends")
    joined = components(ends.select(F.col("a_label").alias("a"), F.col("b_label").alias("b")), rows)
    over = joined.select(F.col("node").alias("label"), F.col("label").alias("over"))
    known = labels.select("node", "label").unionByName(ends.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("a_label").alias("label")), F.struct(F.col("b").alias("node"), F.col("b_label").alias("label")))).alias("e")).select("e.node", "e.label")).distinct()
    out = stash(known.join(over, "label", "left").select("node", F.coalesce("over", "label").alias("label")), "labels")
    drop(ends, joined)
    return out


def _index(runs: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All runs of the texts in order, the text that each is of, and each text's number of runs."""
    flat = np.asarray(runs.flatten())
    size = np.asarray(runs.value_lengths())
    owner = np.repeat(np.arange(len(size)), size)
    order = np.argsort(flat, kind="stable")
    return flat[order], owner[order], size


def _near(keys: np.ndarray, owners: np.ndarray, sizes: np.ndarray, mine: np.ndarray) -> np.ndarray:
    """The similarity of a text with the runs `mine` to each text of an index."""
    lo, hi = np.searchsorted(keys, mine, "left"), np.searchsorted(keys, mine, "right")
    n = hi - lo
    at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
    met = np.bincount(owners[at], minlength=len(sizes))
    return met / (len(mine) + sizes - met)


def _met(texts: DataFrame, group: str, most: int) -> DataFrame:
    """texts(group, node, runs, ...) with part, i, j, own: a task gets the rows of one (part, i, j).

    A group of up to TASK_BYTES of runs shares its part with other such groups.  A larger one is cut into slices by node;
    slices i and j meet in one task, where own says which of them a row is of.  A row goes to as many tasks as its group has slices.
    """
    size = F.sum(F.size("runs")) * 8
    sizes = stash(texts.groupBy(group).agg(size.alias("b")), "group-sizes")
    small = sizes.where(F.col("b") <= TASK_BYTES).agg(F.sum("b")).first()[0] or 0
    large = sizes.where(F.col("b") > TASK_BYTES).select(group, F.ceil(F.col("b") / TASK_BYTES).cast("int").alias("slices"))
    if large.count() <= most:
        large = F.broadcast(large)
    key = F.xxhash64(group)
    part = F.when(F.col("slices").isNull(), F.pmod(key, F.lit(max(1, -(-small // TASK_BYTES))))).otherwise(key)
    cut = texts.join(large, group, "left").withColumns({"part": part, "slices": F.coalesce("slices", F.lit(1))})
    cut = cut.withColumn("own", F.pmod(F.xxhash64(F.lit(1), "node"), F.col("slices")).cast("int"))
    dealt = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    return dealt.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("other", "slices")


def _numbers(values: pa.ChunkedArray) -> np.ndarray:
    """Equal values as equal numbers from 0."""
    return values.combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _lookups(table: pa.Table, group: str, threshold: float, index: np.ndarray, ask: np.ndarray):
    """(row, rows of the index that are similar to it and of its group, their likeness) of each row of ask."""
    groups, runs = _numbers(table.column(group)), table.column("runs").combine_chunks()
    indexed = _index(runs.take(pa.array(index)))
    for k in ask.tolist():
        near = _near(*indexed, np.asarray(runs[k].values))
        hits = np.flatnonzero((near >= threshold) & (groups[index] == groups[k]))
        yield k, index[hits], near[hits]


def _count(met: DataFrame, group: str, threshold: float) -> DataFrame:
    """node, linked of rows dealt by _met: of every text the copies of all texts of its group that are similar, itself among them."""

    def work(table: pa.Table) -> pa.Table:
        copies, linked = table.column("copies").to_numpy(), np.zeros(table.num_rows, np.int64)
        own, i, j = table.column("own").to_numpy(), table.column("i")[0].as_py(), table.column("j")[0].as_py()
        index = np.flatnonzero(own == i)
        for k, hits, _ in _lookups(table, group, threshold, index, np.flatnonzero(own == j)) if len(index) else ():
            linked[k] += copies[hits].sum()
            if i != j:
                linked[hits] += copies[k]
        return pa.table({"node": table.column("node"), "linked": pa.array(linked)})

    return met.groupBy("part", "i", "j").applyInArrow(lambda t: work(t), "node binary, linked long").groupBy("node").agg(F.sum("linked").alias("linked"))


def _joining(met: DataFrame, group: str, threshold: float) -> DataFrame:
    """a, b, likeness of rows dealt by _met, with labels: links within a group, such as still join labels in the task.

    Of each group all texts but those of its largest label are looked up.
    """

    def work(table: pa.Table) -> pa.Table:
        nodes, label = table.column("node"), _numbers(table.column("label"))
        root = np.arange(label.max() + 1)
        both, part, n = np.unique(_numbers(table.column(group)) * len(root) + label, return_inverse=True, return_counts=True)
        by = np.lexsort((n, both // len(root)))
        main = by[np.append(both[by][1:] // len(root) != both[by][:-1] // len(root), True)]
        out = []
        for k, hits, near in _lookups(table, group, threshold, np.arange(table.num_rows), np.flatnonzero(~np.isin(part, main))):
            while True:  # one hit for each component that is not the text's own yet
                more = root[label[hits]] != root[label[k]]
                hits, near = hits[more], near[more]
                if not len(hits):
                    break
                out.append((k, int(hits[0]), float(near[0])))
                root[root == root[label[hits[0]]]] = root[label[k]]
        a, b = (nodes.take(pa.array([r[c] for r in out], pa.int64())) for c in (0, 1))
        return pa.table({"a": a, "b": b, "likeness": pa.array([r[2] for r in out], pa.float64())})

    return met.groupBy("part", "i", "j").applyInArrow(lambda t: work(t), "a binary, b binary, likeness double")


def _pick(docs: DataFrame, few: DataFrame, on: list[str], how: str, most: int) -> DataFrame:
    """docs semi- or anti-joined to few on null-safe keys, which few has in the order of `on`."""
    if few.count() <= most:
        few = F.broadcast(few)
    keys = [fresh(docs, f"key_{i}") for i in range(len(on))]
    few = few.toDF(*keys)
    return docs.join(few, [F.col(f"`{c}`").eqNullSafe(F.col(k)) for c, k in zip(on, keys, strict=True)], how)


class Join:
    """The tables of one join: rows (id, node), nodes (node, id, copies), sets (node, turn, runs), labels (node, label) of the linked nodes."""

    def __init__(self, docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, most_hashes: int = MOST_HASHES, broadcast_rows: int = BROADCAST_ROWS):
        bands, rows = banding(threshold, recall, most_hashes)
        body = F.col(f"`{text}`")
        self.threshold, self.broadcast_rows = threshold, broadcast_rows
        keyed = docs.select(F.col(f"`{doc_id}`").alias("id"), node(body).alias("node"), body.alias("text"))
        self.rows = stash(signatures(keyed, text="text", keep=["id", "node"], n=n, bands=bands, rows=rows), "signatures")
        self.nodes = stash(self.rows.where("node is not null").groupBy("node").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.any_value("bands").alias("bands")), "nodes")
        bucket = F.xxhash64("band", "key").alias("bucket")
        every = self.nodes.select("node", F.posexplode("bands").alias("band", "key")).select(bucket, "node", turn(F.col("node")).alias("turn"))
        shared = every.groupBy("bucket").agg(F.count("*").alias("n"), F.min("turn").alias("leader"), F.bit_xor("turn").alias("mark"), F.bit_xor(F.xxhash64("turn")).alias("again")).where("n > 1")
        shared = shared.groupBy("n", "leader", "mark", "again").agg(F.min("bucket").alias("bucket"), F.count("*").alias("times"))
        shared = stash(shared.select("bucket", "leader", "times"), "buckets")
        self.members = stash(every.select("bucket", "node", "turn").join(shared, "bucket"), "members")
        needed = self.members.select("node").distinct().join(self.nodes, "node").select("id", "node")
        texts = _pick(keyed, needed, ["id", "node"], "left_semi", broadcast_rows)
        found = sets(texts, text="text", keep=["node"], n=n).dropDuplicates(["node"])
        self.sets = stash(found.select("node", turn(F.col("node")).alias("turn"), "runs"), "sets")
        drop(shared)
        self.labels = self._link()

    def _tried(self) -> DataFrame:
        """a, b, likeness of each text and its leaders: a leader's set goes to each pair, then pairs are dealt by text."""
        own = self.members.where("turn != leader").repartition("node").groupBy("node", "leader").agg(F.sum("times").alias("times"))
        best = F.slice(F.sort_array(F.collect_list(F.struct("times", "leader")), False), 1, LEADERS)
        pairs = own.groupBy("node").agg(best.alias("best")).select(F.col("node").alias("a"), F.explode("best.leader").alias("leader"))
        b = self.sets.select(F.col("turn").alias("leader"), F.col("node").alias("b"), F.col("runs").alias("b_runs"))
        a = self.sets.select(F.col("node").alias("a"), F.col("runs").alias("a_runs"))
        both = pairs.join(b, "leader").join(a, "a")
        met = F.size(F.array_intersect("a_runs", "b_runs"))
        return both.select("a", "b", (met / (F.size("a_runs") + F.size("b_runs") - met)).alias("likeness"))

    def _link(self) -> DataFrame:
        most = LEADERS * self.sets.count()
        links = stash(self._tried().where(F.col("likeness") >= self.threshold).select("a", "b"), "links")
        labels = components(links, most)
        drop(links)
        known = self.members.select("bucket", "node").join(labels.select("node", "label"), "node", "left")
        known = stash(known.select("bucket", "node", F.coalesce("label", "node").alias("label")), "known")
        part = F.xxhash64("label")
        open_ = stash(known.groupBy("bucket").agg(F.min(part).alias("first"), F.max(part).alias("last")).where("first != last").select("bucket"), "open")
        some = open_.count()
        if not some:
            drop(known, open_)
            return labels
        texts = known.join(F.broadcast(open_) if some <= self.broadcast_rows else open_, "bucket").join(self.sets, "node")
        texts = stash(texts.select("bucket", "node", "label", "runs"), "open-texts")
        drop(known, open_)
        found = stash(_joining(_met(texts, "bucket", self.broadcast_rows), "bucket", self.threshold), "found")
        drop(texts)
        wider = joined_components(labels, found.select("a", "b"), most)
        drop(found, labels)
        return wider

    def classes(self) -> DataFrame:
        """node, label (the class's least node), id (least of the text's copies), copies, class_id of every distinct non-empty text."""
        labelled = stash(self.labels.select("node", "label").join(self.nodes.select("node", "id"), "node"), "labelled")
        least = labelled.groupBy("label").agg(F.min("id").alias("class_id"))
        joined = labelled.join(stash(least, "classes"), "label").select("node", "label", "class_id")
        alone = self.nodes.select("node", "id", "copies").join(joined, "node", "left")
        return alone.select("node", F.coalesce("label", "node").alias("label"), "id", "copies", F.coalesce("class_id", "id").alias("class_id"))

    def linked(self) -> DataFrame:
        """node, linked: the rows (its own among them) whose texts are similar, of every text of a component."""
        texts = self.labels.select("node", "label").join(self.nodes.select("node", "copies"), "node").join(self.sets, "node")
        texts = stash(texts.select("node", "label", "copies", "runs"), "class-sets")
        out = stash(_count(_met(texts, "label", self.broadcast_rows), "label", self.threshold), "linked")
        drop(texts)
        return out

    def documents(self) -> DataFrame:
        """doc_id, class_id, n_links of every row.

        n_links counts all other rows that the row is linked to: copies of its text, and rows of its class
        whose texts have the similarity.
        """
        known = self.classes().join(self.linked(), "node", "left").select("node", "class_id", (F.coalesce("linked", "copies") - 1).alias("n_links"))
        drop(self.members, self.sets)
        out = self.rows.select("id", "node").alias("r").join(known.alias("c"), "node", "left")
        return out.select(F.col("r.id").alias("doc_id"), F.coalesce("class_id", "r.id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def node(text: Column) -> Column:
    """What copies of a text share: 16 bytes; null for null and empty texts."""
    return F.when(text != "", F.unhex(F.md5(text.cast("binary"))))


def turn(node: Column) -> Column:
    """The order by which a bucket's leader is its least text."""
    return F.xxhash64(node)


def one_of_each(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs without all rows of a class but the one of least id (and of rows repeated with it, one)."""
    found = Join(docs, doc_id=doc_id, text=text, **options)
    classes = found.classes()
    rows = found.rows.where("node is not null").groupBy("id", "node").agg(F.count("*").alias("times"))
    # a class's least id may stand on several texts, or be null: the text that comes first stays
    heads = classes.groupBy("label").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "node")).alias("head"))
    heads = heads.select(F.col("head.id").alias("head_id"), F.col("head.node").alias("head_node"))
    marked = rows.join(heads, F.col("id").eqNullSafe(F.col("head_id")) & (F.col("node") == F.col("head_node")), "left")
    marked = stash(marked.select("id", "node", F.col("head_node").isNotNull().alias("stays"), "times").where("not stays or times > 1"), "marked")
    drop(found.rows, found.nodes, found.members, found.sets, found.labels)
    key = fresh(docs, "id_of_row")
    body = fresh(docs, "node_of_row")
    keyed = docs.withColumns({key: F.col(f"`{doc_id}`"), body: node(F.col(f"`{text}`"))})
    gone, again = marked.select("id", "node"), marked.where("stays").select("id", "node")
    kept = _pick(keyed, gone, [key, body], "left_anti", found.broadcast_rows).drop(key, body)
    twice = _pick(keyed, again, [key, body], "left_semi", found.broadcast_rows).dropDuplicates([key, body]).drop(key, body)
    return kept.unionByName(twice)
