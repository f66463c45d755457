"""Language identification by rank-order profiles.

A language's profile is the order of its PROFILE most frequent letter grams (1 to 3 letters, word
borders included) over all its training texts.  A text's own most frequent grams are compared to
each profile by out-of-place distance: how far each gram's rank differs, PROFILE for a gram that the
profile lacks, divided by the largest sum possible.  The least distance wins.

Defined results: a null text, a text without letters, or no training rows give `und`, score 0;
languages at the same distance are taken in the order of their names; ties of gram counts go by
code points; rows with null lang teach nothing; repeated rows teach as often as they stand.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.llm import kernels as K
from helixframe.llm.shared import per_text, trim

PROFILE, TEXT_GRAMS = 400, 300
#: More languages than this are taken as a column of something else; it bounds the broadcast profiles.
MOST_LANGUAGES = 10_000
#: A text farther than this from every profile is of none of the languages.  Measured with profiles of 3,000 documents
#: of sf0.1: the other 7,000 score 0.414 and more (a score is 1 - distance); 50 words of Polish, Finnish, Italian, Dutch, random letters
#: or base64 at most 0.36.  Shorter texts score higher, whatever they are: up to some 10 words, such pass at times.
FARTHEST = 0.62

GUESS = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("margin", T.DoubleType())])
_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def grams(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """Of each text the letter grams, as numbers (21 bits a letter, 1 for a word border)."""
    low = [(t or "").lower() for t in texts]
    codes = np.frombuffer("\n".join(["", *low, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([1, *(len(t) + 1 for t in low)])
    letter = letters()[codes]
    kept = letter.copy()
    kept[1:] |= letter[:-1]  # and the first border after a word
    kept[ends - 1] = True  # each text has borders of its own
    upto = np.concatenate([[0], np.cumsum(kept)])[ends]
    seq = np.where(letter, codes + 1, 1).astype(np.int64)[kept]
    out = []
    for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True):
        s = seq[a - 1 : b]
        one, two = s[1:-1], s[:-1] << 21 | s[1:]
        three = (two[:-1] << 21 | s[2:])[one > 1]
        out.append(np.concatenate([one[one > 1], two[(s[:-1] > 1) | (s[1:] > 1)], three]))
    return out, np.array([len(x) for x in out])


def profiles(docs: DataFrame, *, lang: str = "lang", text: str = "text", size: int = PROFILE) -> DataFrame:
    """lang, gram, place (from 0): each language's most frequent grams over all rows of docs.

    Counts are added up within each task and again after one shuffle; the first `size` are taken in two steps,
    so that a language's grams never meet in one task.
    """

    def count(batches):
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def rows():
            for name, (keys, n) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys), pa.string()), pa.array(keys), pa.array(n)], ["lang", "gram", "n"])

        for batch in batches:
            for lo, hi in K.steps(batch.column(1)):
                each, _ = grams(batch.column(1).slice(lo, hi - lo).to_pylist())
                by: dict[str, list[np.ndarray]] = {}
                for name, g in zip(batch.column(0).slice(lo, hi - lo).to_pylist(), each, strict=True):
                    by.setdefault(name, []).append(g)
                for name, parts in by.items():
                    keys, n = np.unique(np.concatenate(parts), return_counts=True)
                    if name in held:
                        keys, at = np.unique(np.concatenate([held[name][0], keys]), return_inverse=True)
                        n = np.bincount(at, np.concatenate([held[name][1], n])).astype(np.int64)
                    held[name] = (keys, n.astype(np.int64))
            if sum(len(k) for k, _ in held.values()) > 2_000_000:
                yield from rows()
                held.clear()
        yield from rows()
        trim()

    rows = docs.where(F.col(f"`{lang}`").isNotNull() & F.col(f"`{text}`").isNotNull()).select(F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text"))
    counts = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = [F.col("n").desc(), F.col("gram")]
    some = counts.withColumn("r", F.row_number().over(Window.partitionBy("lang", F.pmod(F.hash("gram"), F.lit(64))).orderBy(*order))).where(F.col("r") <= size)
    place = F.row_number().over(Window.partitionBy("lang").orderBy(*order)) - 1
    return some.withColumn("place", place).where(F.col("place") < size).select("lang", "gram", "place")


class Ranker:
    """Profiles as a table of places: one row a known gram, one column a language."""

    def __init__(self, langs: list[str], names: np.ndarray, keys: np.ndarray, places: np.ndarray, size: int):
        self.langs, self.size = langs, size
        self.keys, at = np.unique(keys, return_inverse=True)
        self.places = np.full((len(self.keys) + 1, len(langs)), -1, np.int32)
        self.places[at, names] = places

    def distances(self, own: np.ndarray, most: int = TEXT_GRAMS) -> np.ndarray:
        keys, n = np.unique(own, return_counts=True)
        top = keys[np.argsort(-n, kind="stable")[:most]]
        at = np.searchsorted(self.keys, top)
        at[self.keys[np.minimum(at, len(self.keys) - 1)] != top] = len(self.keys)
        place = self.places[at]
        out = np.abs(place - np.arange(len(top))[:, None])
        out[place < 0] = self.size
        return out.sum(axis=0) / (self.size * len(top))


def ranker(profile: DataFrame, size: int = PROFILE) -> Ranker:
    found = profile.limit(MOST_LANGUAGES * size + 1).toArrow()
    if found.num_rows > MOST_LANGUAGES * size:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    langs = sorted(set(found.column("lang").to_pylist()))
    index = {x: i for i, x in enumerate(langs)}
    names = np.array([index[x] for x in found.column("lang").to_pylist()], np.int64)
    return Ranker(langs, names, found.column("gram").to_numpy(), found.column("place").to_numpy(), size)


def identify(docs: DataFrame, profile: DataFrame, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` with lang_pred, score (1 - distance of the nearest profile) and margin (to the second)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(ranker(profile))

    def make():
        model = shared.value

        def work(texts: pa.Array, _):
            langs, scores, margins = [], [], []
            each, sizes = grams(texts.to_pylist())
            for own in each:
                if not len(own) or not model.langs:
                    langs.append("und")
                    scores.append(0.0)
                    margins.append(0.0)
                    continue
                d = model.distances(own)
                best = int(d.argmin())
                langs.append(model.langs[best])
                scores.append(1.0 - float(d[best]))
                margins.append(float(np.partition(d, 1)[1] - d[best]) if len(d) > 1 else 1.0)
            return [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(margins, pa.float64())]

        return work

    return per_text(docs, make, GUESS, text=text, keep=keep)


def rejected(lang_pred: Column, score: Column, farthest: float = FARTHEST) -> Column:
    """No letters, or farther than `farthest` from every language."""
    return (lang_pred == "und") | (score < 1 - farthest)
