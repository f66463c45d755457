"""Token ids in binary files: frequency-ranked, byte-aligned variable-length codes with separate control bytes.

Texts become ids with the tokenizers library and an end id follows each document.  An id is
replaced by its rank in the corpus (0 is the most frequent), a rank takes 1 to 4 bytes, and a control
byte holds the sizes of four codes in two bits each (first code lowest).

A dataset is a folder.  `ranks/` has one file: the ids in rank order.  `ids/` has files in ascending doc_id
order (null first; documents of one id by their ids' codes), each a row of blocks:

    magic b"HXID", part u32, block u32, documents u32, codes u64, data bytes u64      (header)
    null flags u8 x documents, doc ids i64 x documents, ids of each document u32 x documents
    control bytes: each document's own, ceil(ids / 4); then the data bytes; then one 0x0A

All numbers are little-endian.  Spark's own writer and binary reader move the files, so any store will do.

Defined results: a null text is encoded as the empty one (its end id only); repeated rows are each
written; no rows give an empty folder that reads as no rows.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.llm import kernels as K
from helixframe.llm.shared import drop, kept, per_text, shared_path, stash, trim

TOKENIZER, END_ID = "word_bpe_49k.json", 2
_MAGIC, _HEAD = b"HXID", struct.Struct("<4sIIIQQ")
#: Data bytes after which a block ends, and encoded bytes that a file is to hold.
BLOCK_BYTES, FILE_BYTES = 4 << 20, 24 << 20


class Encoder:
    """The tokenizer, with each distinct piece of text encoded once.

    Where a word-level tokenizer cuts a text into pieces (letter runs, single digits, runs of other
    characters, the seven contractions) and encodes each alone, pieces found in one pass over
    code points are looked up by hash and only new ones go to the library, many to a call.
    How characters below LIMIT are normalised and cut is asked of the tokenizer itself; a text with any other
    character, or with a special token's opening, goes to the library whole.
    """

    LIMIT, SLOTS, MOST_IDS, TOGETHER = 0x300, 1 << 20, 8 << 20, 500
    SPACE, LETTER, DIGIT, OTHER, UNSAFE = range(5)

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.path, self.piece = path, Tokenizer.from_file(path)
        self.whole: Tokenizer | None = Tokenizer.from_file(path)
        self.piece.normalizer = normalizers.Sequence([])
        self.piece.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.kind, self.low = np.full(self.LIMIT + 1, self.UNSAFE, np.uint8), np.zeros(self.LIMIT + 1, np.uint16)
        size = self.whole.get_vocab_size()
        self.ends = np.zeros(size, bool)
        for token, k in self.whole.get_vocab().items():
            self.ends[k] = token.endswith("</w>")
        if self._by_pieces():
            for c in range(self.LIMIT):
                self._learn(chr(c))
        self.keys, self.off, self.len = np.zeros(self.SLOTS, np.uint64), np.zeros(self.SLOTS, np.int64), np.zeros(self.SLOTS, np.int32)
        self.store, self.used = np.zeros(self.MOST_IDS, np.uint32), 0
        self.whole = None  # a worker keeps it from the first text on that needs it

    def _whole(self):
        from tokenizers import Tokenizer

        if self.whole is None:
            self.whole = Tokenizer.from_file(self.path)
        return self.whole

    def _by_pieces(self) -> bool:
        """Whether the tokenizer cuts and encodes as described; else every text goes to it whole."""
        probe = "it's Ab12 ***x 'tis we'll they're!"
        want = ["it", "'s", "ab", "1", "2", "***", "x", "'t", "is", "we", "'ll", "they", "'re", "!"]
        try:
            cut = [x for x, _ in self.whole.pre_tokenizer.pre_tokenize_str(self.whole.normalizer.normalize_str(probe))]
        except AttributeError:
            return False
        return cut == want and self.whole.encode(probe, add_special_tokens=False).ids == self._ids([want])

    def _ids(self, groups: list[list[str]]) -> list[int]:
        return [i for e in self.piece.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False) for i in e.ids]

    def _learn(self, c: str) -> None:
        cut = lambda s: len(self.whole.pre_tokenizer.pre_tokenize_str(s))
        low = self.whole.normalizer.normalize_str(c)
        if len(low) != 1 or ord(low) >= self.LIMIT:
            return
        self.low[ord(c)] = ord(low)
        if not cut(low):
            self.kind[ord(c)] = self.SPACE
        elif cut(low + low) == 2:
            self.kind[ord(c)] = self.DIGIT
        else:
            self.kind[ord(c)] = self.LETTER if cut(low + "a") == 1 else self.OTHER

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        kind = self.kind[np.minimum(codes, self.LIMIT)]
        odd = np.zeros(len(texts), bool)
        odd[np.searchsorted(at, np.flatnonzero(kind == self.UNSAFE), "right") - 1] = True
        bar = np.flatnonzero((codes[:-1] == 60) & (codes[1:] == 124)) if len(codes) else np.zeros(0, np.int64)
        odd[np.searchsorted(at, bar, "right") - 1] = True
        if odd.any():
            kind = kind.copy()
            kind[np.repeat(odd, np.diff(at))] = self.SPACE
        flat, upto = self._pieces(self.low[np.minimum(codes, self.LIMIT)], kind, at)
        out = [flat[a:b] for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]
        if odd.any():
            rows = np.flatnonzero(odd).tolist()
            for i, e in zip(rows, self._whole().encode_batch_fast([texts[i] for i in rows], add_special_tokens=False), strict=True):
                out[i] = np.array(e.ids, np.uint32)
        return out

    def _pieces(self, low: np.ndarray, kind: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(low)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(at), np.int64)
        solid = kind != self.SPACE
        start = solid.copy()
        start[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == self.DIGIT)
        border = at[at < n]
        start[border] = solid[border]
        quote = np.flatnonzero(start & (low == 39))  # an apostrophe that opens a run
        if len(quote):
            stop = np.searchsorted(at, quote, "right")
            room = at[np.minimum(stop, len(at) - 1)] - quote
            a, b = low[np.minimum(quote + 1, n - 1)], low[np.minimum(quote + 2, n - 1)]
            two = (room >= 2) & np.isin(a, [ord(c) for c in "stmd"])
            three = (room >= 3) & (((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108))
            for hit, size in ((two, 2), (three, 3)):
                q = quote[hit]
                start[q + 1] = False
                after = q + size
                inside = after < at[stop[hit]]
                start[after[inside]] = solid[after[inside]]
        begin = np.flatnonzero(start)
        if not len(begin):
            return np.zeros(0, np.uint32), np.zeros(len(at), np.int64)
        stop = solid.copy()
        stop[:-1] &= start[1:] | ~solid[1:]
        stop[border[border > 0] - 1] = solid[border[border > 0] - 1]
        end = np.flatnonzero(stop) + 1
        keys = K.hash_spans(low.view(np.uint8), begin * 2, end * 2)
        off, size, store = self._find(keys, low, begin, end)
        upto = np.concatenate([[0], np.cumsum(size)])
        flat = store[np.repeat(off - upto[:-1], size) + np.arange(upto[-1])]
        return flat, upto[np.searchsorted(begin, at)]

    def _find(self, keys: np.ndarray, low: np.ndarray, begin: np.ndarray, end: np.ndarray):
        slot = (keys & np.uint64(self.SLOTS - 1)).astype(np.int64)
        off, size = self.off[slot], self.len[slot].astype(np.int64)
        miss = np.flatnonzero((self.keys[slot] != keys) | (size == 0))
        if not len(miss):
            return off, size, self.store
        new, first, back = np.unique(keys[miss], return_index=True, return_inverse=True)
        chars = low.tobytes()
        own = [chars[2 * b : 2 * e].decode("utf-16-le") for b, e in zip(begin[miss[first]].tolist(), end[miss[first]].tolist(), strict=True)]
        ids = np.array(self._ids([own[i : i + self.TOGETHER] for i in range(0, len(own), self.TOGETHER)]), np.uint32)
        last = np.flatnonzero(self.ends[ids]) + 1
        assert len(last) == len(new), "a piece did not end in an end-of-word token"
        new_size = np.diff(last, prepend=0)
        if self.used + len(ids) > len(self.store):
            keep_off, keep_size = off, size  # what this step found stays valid in the store it came from
            store = np.concatenate([self.store[: self.used], ids])
            base = self.used
            self.keys[:], self.len[:] = 0, 0
            self.store, self.used = np.zeros(max(self.MOST_IDS, len(ids)), np.uint32), 0
        else:
            keep_off, keep_size, store, base = off, size, self.store, self.used
        own_off = last - new_size
        put = (new & np.uint64(self.SLOTS - 1)).astype(np.int64)
        self.store[self.used : self.used + len(ids)] = ids
        self.keys[put], self.off[put], self.len[put] = new, self.used + own_off, new_size
        held = np.flatnonzero(self.keys[put] == new)  # of two new keys in one slot only one is held
        self.off[put[held]], self.len[put[held]] = self.used + own_off[held], new_size[held]
        self.used += len(ids)
        keep_off[miss], keep_size[miss] = base + own_off[back], new_size[back]
        return keep_off, keep_size, store


def encoder(path: str) -> Encoder:
    """One a process: what one task has encoded serves the next, until the process works for another operator."""
    found = kept.get("encoder")
    if not isinstance(found, Encoder) or found.path != path:
        found = kept["encoder"] = Encoder(path)
    return found


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def tokenize(docs: DataFrame, *, text: str = "text", keep: list[str] | None = None, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Columns `keep` with ids: unsigned 32-bit little-endian numbers, the end id last."""
    path = path or default_path()

    def make():
        own = encoder(path)

        def work(texts: pa.Array, _):
            got = own.encode([t or "" for t in texts.to_pylist()])
            return [K.binary_array([np.append(x, end_id).astype("<u4").tobytes() for x in got])]

        return work

    return per_text(docs, make, T.StructType([T.StructField("ids", T.BinaryType())]), text=text, keep=keep, uses="encoder")


def id_counts(tokens: DataFrame) -> DataFrame:
    """id, n over all of tokens: counted in each task, then added up; no more rows than the vocabulary."""

    def count(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            n = np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u4"), minlength=len(total))
            n[: len(total)] += total
            total = n
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], ["id", "n"])

    return tokens.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of 32-bit ranks."""
    size = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    code = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    code[: len(ranks)] = size - 1
    code = code.reshape(-1, 4)
    control = code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6
    each = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)
    return control.tobytes(), each[np.arange(4) < size[:, None]].tobytes()


#: The sizes of the four codes that each control byte stands for.
SIZES = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + np.uint8(1)


def unpack(control: np.ndarray, data: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The ranks of documents with `counts` codes each, by table lookup."""
    groups = -(-counts // 4)
    size = SIZES[control]
    spare = (groups * 4 - counts).astype(np.int64)
    last = np.cumsum(groups) - 1
    some = counts > 0
    size[last[some]] *= (np.arange(4) < (4 - spare[some])[:, None]).astype(np.uint8)
    size = size.ravel()
    size = size[size > 0]
    at = np.cumsum(size, dtype=np.int64) - size
    out = data[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        out[more] |= data[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def write(tokens: DataFrame, path: str, *, doc_id: str = "doc_id", file_bytes: int = FILE_BYTES) -> None:
    """Write tokens(doc_id, ids) as a dataset.  The driver gets the id counts (bounded by the vocabulary)."""
    spark = tokens.sparkSession
    counted = id_counts(tokens).toArrow()
    ids, n = counted.column("id").to_numpy(), counted.column("n").to_numpy()
    order = ids[np.lexsort((ids, -n))].astype(np.int64)
    rank = np.zeros(int(order.max()) + 1 if len(order) else 1, np.uint32)
    rank[order] = np.arange(len(order))
    shared = spark.sparkContext.broadcast(rank)
    _put(spark.createDataFrame([(order.astype("<u4").tobytes(),)], "block binary"), f"{path}/ranks")

    def encode(batches):
        own = shared.value
        for batch in batches:
            cut = [pack(own[np.frombuffer(x, "<u4")]) for x in batch.column(1).to_pylist()]
            n = pa.array([len(x) // 4 for x in batch.column(1).to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), n, K.binary_array([c for c, _ in cut]), K.binary_array([d for _, d in cut])], ["doc_id", "n", "control", "data"])

    coded = tokens.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), "ids").mapInArrow(encode, "doc_id long, n int, control binary, data binary")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(n.sum()) * 3 // 2 // file_bytes))
    first = F.col("doc_id").asc_nulls_first()
    ordered = coded.repartitionByRange(parts, first).sortWithinPartitions(first, "n", "data")

    def assemble(batches):
        number, held, size = 0, [], 0
        part = None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                part = row[0]
                held.append(row)
                size += len(row[4])
                if size >= BLOCK_BYTES:
                    yield pa.RecordBatch.from_arrays([K.binary_array([_block(part, number, held)])], ["block"])
                    number, held, size = number + 1, [], 0
        if held:
            yield pa.RecordBatch.from_arrays([K.binary_array([_block(part, number, held)])], ["block"])
        held.clear()
        trim()

    _put(ordered.select(F.spark_partition_id().alias("part"), "doc_id", "n", "control", "data").mapInArrow(assemble, "block binary"), f"{path}/ids")


def _block(part: int, number: int, rows: list[tuple]) -> bytes:
    ids = np.array([0 if r[1] is None else r[1] for r in rows], "<i8")
    null = np.array([r[1] is None for r in rows], np.uint8)
    n = np.array([r[2] for r in rows], "<u4")
    head = _HEAD.pack(_MAGIC, part, number, len(rows), int(n.sum()), sum(len(r[4]) for r in rows))
    return b"".join([head, null.tobytes(), ids.tobytes(), n.tobytes(), *(r[3] for r in rows), *(r[4] for r in rows)])


def _put(blocks: DataFrame, path: str) -> None:
    """Raw bytes by Spark's line writer, which adds the 0x0A."""
    blocks.select(F.col("block").cast("string").alias("value")).write.option("lineSep", "\n").text(path)


def _blocks(content: bytes):
    at = 0
    while at < len(content):
        magic, part, number, docs, codes, size = _HEAD.unpack_from(content, at)
        if magic != _MAGIC:
            raise ValueError("not a file of token ids")
        at += _HEAD.size
        null = np.frombuffer(content, np.uint8, docs, at)
        ids = np.frombuffer(content, "<i8", docs, at + docs)
        counts = np.frombuffer(content, "<u4", docs, at + 9 * docs).astype(np.int64)
        at += 13 * docs
        groups = int((-(-counts // 4)).sum())
        ranks = unpack(np.frombuffer(content, np.uint8, groups, at), np.frombuffer(content, np.uint8, size, at + groups), counts)
        at += groups + size + 1
        yield part, number, null, ids, counts, ranks


def ranks_of(spark: SparkSession, path: str) -> np.ndarray:
    """The ids in rank order."""
    content = b"".join(bytes(r[0]) for r in spark.read.format("binaryFile").load(f"{path}/ranks").where("length > 0").sort("path").select("content").collect())
    return np.frombuffer(content[:-1], "<u4")


def read(spark: SparkSession, path: str, *, with_ids: bool = True) -> DataFrame:
    """part, place (in the part), start (ids before it in the part), doc_id, n_tokens, ids_crc32 and, if asked, ids."""
    shared = spark.sparkContext.broadcast(ranks_of(spark, path))

    def decode(batches):
        order = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                place = start = 0
                for part, _, null, ids, counts, ranks in _blocks(batch.column(0)[i].as_buffer().to_pybytes()):
                    flat = order[ranks].astype("<u4")
                    upto = np.concatenate([[0], np.cumsum(counts)])
                    raw = memoryview(flat).cast("B")
                    own = [raw[4 * a : 4 * b] for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]
                    crc = pa.array([zlib.crc32(x) for x in own], pa.int64())
                    cols = [pa.array(np.full(len(ids), part, np.int32)), pa.array(np.arange(place, place + len(ids))), pa.array(start + upto[:-1]), pa.array(ids, mask=null.astype(bool)), pa.array(counts), crc]
                    if with_ids:
                        cols.append(K.binary_array([bytes(x) for x in own]))
                    yield pa.RecordBatch.from_arrays(cols, [f.name for f in schema.fields])
                    place, start = place + len(ids), start + int(upto[-1])
        trim()

    fields = "part int, place long, start long, doc_id long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    schema = T._parse_datatype_string(fields)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/ids").where("length > 0").select("content")
    return files.mapInArrow(decode, schema)


def with_starts(decoded: DataFrame) -> DataFrame:
    """start counted over all parts; the driver gets one row for each part."""
    spark = decoded.sparkSession
    held = stash(decoded, "decoded")
    total, offsets = 0, []
    for part, n in sorted(map(tuple, held.groupBy("part").agg(F.sum("n_tokens")).collect())):
        offsets.append((part, total))
        total += n
    before = spark.createDataFrame(offsets, "part int, before long")
    return held.join(F.broadcast(before), "part").withColumn("start", F.col("start") + F.col("before")).drop("before")


def encoded(docs: DataFrame, *, path: str | None = None, tokenizer: str | None = None, **columns) -> DataFrame:
    """Tokenize docs, write the dataset (to `path`, or a new folder in the shared one), and read it back: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    out = path or shared_path(spark, "token-ids")
    doc_id = columns.get("doc_id", "doc_id")
    tokens = stash(tokenize(docs, keep=[doc_id], text=columns.get("text", "text"), path=tokenizer), "ids")
    write(tokens, out, doc_id=doc_id)
    drop(tokens)
    return with_starts(read(spark, out, with_ids=False)).select("doc_id", "start", "n_tokens", "ids_crc32")
