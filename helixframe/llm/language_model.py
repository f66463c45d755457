"""Language-model scoring with a weighted backoff automaton.

Tokens are words between white space (A-Z lower-cased), then one end for each text.  The root's arcs carry
(c + 0.5) / (N + 0.5 (V + 1)).  Every shorter n-gram seen in training is a state; an arc from it carries
(c(state, word) + K p) / (c(state) + K), p being the weight where the failure arc leads, and the
failure arc itself K / (c(state) + K).  K = STRENGTH c(state) ** GROWTH stands for the number of different
words that follow the state (Heaps' law), as in Witten-Bell smoothing, but is known from c(state) alone.  So the words' weights out of each state add up to 1 (one unseen word
standing for all).  A traversal goes left to right and holds the state: the longest suffix that is one.

Counts come from all training rows, but no task holds the whole automaton.  Documents are packed in
blocks of BLOCK_BYTES of text.  A block asks for the n-grams that it holds, as sorted 64-bit hashes dealt by key range
together with its own training counts; a range adds up and answers each block in the block's own
order, so answers need no keys.  Then each block builds its part of the automaton, the states and arcs that its documents can reach, and
runs it over them.  The rows dealt are those of (block, range) that share a key, so never more than the blocks' different n-grams.

Defined results: a null text is empty (its end only); without training rows every token weighs 1 at
the root; repeated rows count and are scored as often as they stand; no rows give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from helixframe.llm import kernels as K
from helixframe.llm.shared import stash

#: n-gram order; pseudo-count of the failure arc for a state seen once, and how it grows with the state's count.
ORDER, STRENGTH, GROWTH = 2, 3.0, 0.8
BLOCK_BYTES, RANGE_KEYS = 14 << 20, 1 << 20
#: Tokens that one traversal takes of a long text.
LANE = 1024
_START, _END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)


def sequences(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, ends included, and where each text begins."""
    parts, sizes = [], []
    for lo, hi in K.steps(texts):
        buf, at = K.utf8(texts.slice(lo, hi - lo))
        buf = K.LOWER[buf]
        starts, ends, first = K.word_spans(buf, at, K.NOT_SPACE)
        words = K.hash_spans(buf, starts, ends)
        first = np.append(first[:-1], len(words))
        parts.append(np.insert(words, first[1:], _END))
        sizes.append(np.diff(first) + 1)
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    return np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])


def grams(tokens: np.ndarray, begin: np.ndarray, order: int) -> list[np.ndarray]:
    """Hashes of the n-grams that end at each token, for n from 1 to order; starts fill up the front."""
    out, before = [tokens], tokens
    for n in range(2, order + 1):
        before = np.concatenate([[_START], before[:-1]]) if len(before) else before
        before[begin[:-1]] = _START
        out.append(K.mix(out[-1] * K._C1 ^ K.mix(before + np.uint64(n))))
    return out


def pack_counts(n: np.ndarray) -> bytes:
    """One byte a count; those from 255 on follow, with their places."""
    big = np.flatnonzero(n >= 255)
    return np.int64(len(big)).tobytes() + big.astype(np.uint32).tobytes() + n[big].astype(np.int64).tobytes() + np.minimum(n, 255).astype(np.uint8).tobytes()


def unpack_counts(data: bytes) -> np.ndarray:
    many = int(np.frombuffer(data, np.int64, 1)[0])
    out = np.frombuffer(data, np.uint8, -1, 8 + 12 * many).astype(np.int64)
    out[np.frombuffer(data, np.uint32, many, 8)] = np.frombuffer(data, np.int64, many, 8 + 4 * many)
    return out


def pack_keys(keys: np.ndarray) -> bytes:
    """Differences of sorted keys, in as many bytes as the largest takes."""
    steps = np.diff(keys, prepend=np.uint64(0))
    width = max(1, -(-int(steps.max()).bit_length() // 8)) if len(steps) else 1
    return bytes([width]) + steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack_keys(data: bytes) -> np.ndarray:
    width = data[0]
    raw = np.frombuffer(data, np.uint8, -1, 1).reshape(-1, width)
    steps = np.zeros((len(raw), 8), np.uint8)
    steps[:, :width] = raw
    return np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64)


def _blocks(docs: DataFrame, keep: list[str], text: str, train: Column) -> DataFrame:
    """block, size (bytes of text), rows: keep, train and text of as many rows as make up BLOCK_BYTES, as an Arrow stream."""
    picked = docs.select(*(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)), F.coalesce(train, F.lit(False)).alias("train"), F.col(f"`{text}`").alias("text"))

    def pack(batches):
        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        options = pa.ipc.IpcWriteOptions(compression="zstd")

        def row():
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=options) as out:
                for x in held:
                    out.write_batch(x)
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([size]), K.binary_array([sink.getvalue().to_pybytes()])], ["block", "size", "rows"])

        for batch in batches:
            for lo, hi in K.steps(batch.column(batch.num_columns - 1)):
                part = batch.slice(lo, hi - lo)
                more = int(K.utf8(part.column(part.num_columns - 1))[1][-1])
                if held and size + more > BLOCK_BYTES:
                    yield row()
                    number, held, size = number + 1, [], 0
                held.append(part)
                size += more
        if held:
            yield row()

    return stash(picked.mapInArrow(pack, "block long, size long, rows binary"), "blocks")


def _opened(rows: bytes) -> pa.Table:
    return pa.ipc.open_stream(rows).read_all().combine_chunks()


def _ask(order: int, bits: int):
    def ask(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                table = _opened(batch.column(1)[i].as_buffer().to_pybytes())
                tokens, begin = sequences(table.column(table.num_columns - 1).combine_chunks())
                train = np.repeat(np.array(table.column(table.num_columns - 2).to_pylist(), bool), np.diff(begin))
                for n, keys in enumerate(grams(tokens, begin, order), 1):
                    every = distinct(keys)
                    own = np.sort(keys[train])
                    lo = np.searchsorted(own, every, "left")
                    counts = np.append(lo[1:], len(own)) - lo
                    edges = np.searchsorted(every >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64)) if bits else np.array([0, len(every)])
                    some = np.flatnonzero(np.diff(edges))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(some), n, np.int32)),
                            pa.array(some.astype(np.int32)),
                            pa.array([batch.column(0)[i].as_py()] * len(some), pa.int64()),
                            K.binary_array([pack_keys(every[edges[r] : edges[r + 1]]) for r in some]),
                            K.binary_array([pack_counts(counts[edges[r] : edges[r + 1]]) for r in some]),
                        ],
                        ["n", "range", "block", "keys", "counts"],
                    )

    return ask


def _answer(table: pa.Table) -> pa.Table:
    """The sums for one range of keys, for each block in the order of its keys; and, under a null block, of all."""
    keys = [unpack_keys(x) for x in table.column("keys").to_pylist()]
    counts = [unpack_counts(x) for x in table.column("counts").to_pylist()]
    ends = np.cumsum([0, *map(len, keys)])
    own, at = np.unique(np.concatenate(keys), return_inverse=True)
    sums = np.bincount(at, np.concatenate(counts), len(own)).astype(np.int64)
    total = sums[at]
    blocks = table.column("block").to_pylist()
    n, part = table.column("n")[0].as_py(), table.column("range")[0].as_py()
    size = len(blocks) + 1
    return pa.table(
        {
            "n": pa.array([n] * size, pa.int32()),
            "range": pa.array([part] * size, pa.int32()),
            "block": pa.array([*blocks, None], pa.int64()),
            "sums": K.binary_array([*(pack_counts(total[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)), None]),
            "tokens": pa.array([0] * len(blocks) + [int(sums.sum())], pa.int64()),
            "kinds": pa.array([0] * len(blocks) + [int((sums > 0).sum())], pa.int64()),
        }
    )


def distinct(hashes: np.ndarray) -> np.ndarray:
    """Sorted, each once."""
    out = np.sort(hashes)
    return out[np.append(True, out[1:] != out[:-1])] if len(out) else out


class Automaton:
    """States, weighted arcs and failure arcs for the n-grams that a block's documents hold.

    State 0 is the root, states 1 to order - 1 stand for as many starts, and each other state is a shorter n-gram seen in
    training.  `arc` holds state * words + word of every arc, in order, with its log10 weight and where it leads;
    the root has an arc for every word.  `fail` and `fail_weight` are the failure arcs.
    """

    def __init__(self, own: list[np.ndarray], begin: np.ndarray, keys: list[np.ndarray], sums: list[np.ndarray], tokens: int, kinds: int, strength: float, growth: float):
        """own: the n-grams that end at each token, by n; keys and sums: the different ones and their training counts."""
        order = len(own)
        self.order, self.words = order, max(1, len(keys[0]))
        root = np.log10((sums[0] + 0.5) / (tokens + 0.5 * (kinds + 1)))
        self.root, self.seen = root, sums[0]
        at = np.searchsorted(keys[0], _END)
        texts = int(sums[0][at]) if len(keys[0]) else 0  # how often training left the start
        place = [np.searchsorted(k, x) for k, x in zip(keys, own, strict=True)]
        self.word = place[0]
        # state numbers of the shorter n-grams, -1 for those that training lacks; counts[state] is how often training was in it
        number, counts, fail = [], [np.full(order, texts)], [np.maximum(np.arange(order) - 1, 0)]
        first = [np.zeros(len(k), np.int64) for k in keys]  # a token at which each n-gram ends
        for f, at_ in zip(first, place, strict=True):
            f[at_] = np.arange(len(at_))
        size = order
        for n in range(1, order):
            known = np.flatnonzero(sums[n - 1] > 0)
            mine = np.full(len(keys[n - 1]), -1, np.int64)
            mine[known] = size + np.arange(len(known))
            # the failure arc of an n-gram leads to its last n - 1 words; one that begins at a start has them all the same
            fail.append(number[-1][place[n - 2][first[n - 1][known]]] if n > 1 else np.zeros(len(known), np.int64))
            counts.append(sums[n - 1][known])
            number.append(mine)
            size += len(known)
        self.counts, self.fail = np.concatenate(counts), np.concatenate(fail)
        back = strength * np.maximum(self.counts, 1.0) ** growth
        self.fail_weight = np.log10(back / (self.counts + back))
        # arcs: an n-gram's leads from the state of its first n - 1 words to that of its last order - 1
        opens = np.zeros(len(own[0]), bool)
        opens[begin[:-1]] = True
        arc, weight, leads = [np.arange(len(keys[0]))], [root], [np.maximum(number[0], 0) if order > 1 else np.zeros(len(keys[0]), np.int64)]
        below = 10.0**root
        for n in range(2, order + 1):
            known = np.flatnonzero(sums[n - 1] > 0)
            end = first[n - 1][known]
            state = np.where(opens[end], n - 1, number[n - 2][place[n - 2][end - 1]])
            shorter = below[place[n - 2][end]]  # the word's weight where the failure arc leads
            value = (sums[n - 1][known] + back[state] * shorter) / (self.counts[state] + back[state])
            arc.append(state * self.words + place[0][end])
            weight.append(np.log10(value))
            leads.append(number[n - 1][known] if n < order else number[n - 2][place[n - 2][end]])
            below = np.zeros(len(keys[n - 1]))
            below[known] = value
        arc = np.concatenate(arc)
        by = np.argsort(arc, kind="stable")
        self.arc, self.weight, self.leads = arc[by], np.concatenate(weight)[by], np.concatenate(leads)[by]

    def run(self, begin: np.ndarray) -> np.ndarray:
        """The log10 weight of each token, by traversals from left to right, many at once.

        A text's traversal begins at its start.  A long text is cut into lanes: as a state spans order - 1 tokens, a lane
        that begins at the root so many tokens before its own is in the right state when it comes to these.
        """
        total = np.zeros(len(self.word))
        size = np.diff(begin)
        lane = max(LANE, self.order)
        lanes = -(-size // lane)
        first = np.repeat(begin[:-1], lanes)
        start = first + lane * (np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes))
        stop = np.minimum(start + lane, np.repeat(begin[1:], lanes))
        start = np.maximum(first, start - (self.order - 1))
        state = np.where(start == first, self.order - 1, 0)
        by = np.argsort(start - stop, kind="stable")  # longest first: those still running are always in front
        start, stop, state = start[by], stop[by], state[by]
        running = np.searchsorted(start - stop, -np.arange(1, (stop - start).max(initial=0) + 1), "right")
        for t, n in enumerate(running.tolist()):  # a lane comes later to the tokens that the next one begins with, so its weights stay
            at = start[:n] + t
            total[at] = self._step(state[:n], self.word[at])
        return total

    def _step(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Each traversal's log10 weight for its next word; `state` is moved on."""
        out, todo = np.zeros(len(state)), np.arange(len(state))
        while len(todo):
            key = state[todo] * self.words + word[todo]
            at = np.minimum(np.searchsorted(self.arc, key), len(self.arc) - 1)
            found = self.arc[at] == key
            done, at = todo[found], at[found]
            out[done] += self.weight[at]
            state[done] = self.leads[at]
            todo = todo[~found]
            out[todo] += self.fail_weight[state[todo]]
            state[todo] = self.fail[state[todo]]
        return out


def score(docs: DataFrame, train: Column, *, text: str = "text", keep: list[str] | None = None, order: int = ORDER, strength: float = STRENGTH, growth: float = GROWTH) -> DataFrame:
    """Columns `keep` with n_tokens, n_known, train_tokens, base_score, score; the model learns from rows where `train`."""
    keep = ["doc_id"] if keep is None else list(keep)
    blocks = _blocks(docs, keep, text, train)
    size = blocks.agg(F.sum("size")).first()[0] or 0
    bits = max(0, int(np.ceil(np.log2(max(1, size / 6 / RANGE_KEYS)))))
    asked = blocks.select("block", "rows").mapInArrow(_ask(order, bits), "n int, range int, block long, keys binary, counts binary")
    answers = stash(asked.groupBy("n", "range").applyInArrow(_answer, "n int, range int, block long, sums binary, tokens long, kinds long"), "answers")
    tokens, kinds = answers.where("block is null and n = 1").agg(F.sum("tokens"), F.sum("kinds")).first()
    tokens, kinds = tokens or 0, kinds or 0
    made = [("n_tokens", T.LongType()), ("n_known", T.LongType()), ("train_tokens", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType())]
    taken = {c.lower() for c in keep}
    fields = []
    for name, kind in made:
        while name.lower() in taken:
            name = f"_{name}"
        fields.append(T.StructField(name, kind))
    schema = T.StructType([*(docs.schema[c] for c in keep), *fields])
    arrow = to_arrow_schema(schema)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for rows in left.column("rows").to_pylist():
            table = _opened(rows)
            tokens_, begin = sequences(table.column(table.num_columns - 1).combine_chunks())
            own = grams(tokens_, begin, order)
            right = right.sort_by([("n", "ascending"), ("range", "ascending")])
            ns, sums = np.array(right.column("n").to_pylist()), right.column("sums").to_pylist()
            keys, totals = [], []
            for n, x in enumerate(own, 1):
                keys.append(distinct(x))
                totals.append(np.concatenate([unpack_counts(sums[i]) for i in np.flatnonzero(ns == n)]))
            model = Automaton(own, begin, keys, totals, tokens, kinds, strength, growth)
            seen, base, weight = model.seen[model.word], model.root[model.word], model.run(begin)
            sum_of = lambda x: np.add.reduceat(x, begin[:-1])
            n_docs = table.num_rows
            cols = [table.column(i) for i in range(len(keep))]
            cols += [pa.array(np.diff(begin)), pa.array(sum_of((seen > 0).astype(np.int64))), pa.array(np.full(n_docs, tokens)), pa.array(sum_of(base)), pa.array(sum_of(weight))]
            out.append(pa.Table.from_arrays([c.cast(f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow))
        return pa.concat_tables(out) if out else arrow.empty_table()

    answers = answers.where("block is not null").select("block", "n", "range", "sums")
    return blocks.select("block", "rows").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)
