"""Secret scans: patterns, and guess costs of values in credential contexts.

The patterns assign, access and hex give the base spans.  `guess` adds each value that stands where a credential is
named, whether a base span holds it or not, if guessing it would take 10 ** MIN_COST tries or more.  The cost
of a value is that of its cheapest segmentation, by dynamic programming, into common words (in any case, letters replaced or not),
dates, repeats, runs of neighbouring characters, keyboard walks, and brute force; it is the least over all segmentations, whatever the value's length.
A scheme (Bearer, Basic ...) may stand before the value; where a value is rejected the search goes on inside it.

Words are ranked by how often the documents have them outside of such values, so prose is cheap in the corpus's own languages.

Defined results: null and empty texts have no spans; spans are in code points, end exclusive; equal starts
are ordered as KINDS; repeated rows each get their own row, and count as often as they stand when words are ranked; no rows give no rows;
a result whose name is taken among the kept columns gets leading underscores.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.llm import kernels as K
from helixframe.llm.shared import per_text

KINDS = ("assign", "access", "hex", "guess")
MIN_COST = 10.0
#: Words that are ranked, and letters of the shortest and longest.
MOST_WORDS, SHORTEST, LONGEST = 20_000, 3, 24
#: Parts that words are dealt into to find the most frequent.
PARTS = 16

# The patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|auth(?:orization)?|bearer|(?:api|access|private|secret|account)[_-]?key)["'\])]?\s*(?:=>|:=|[:=]|\bis\b)\s*["'(\[]?(?:(?:bearer|basic|token|digest|negotiate|apikey)\s+["'(\[]?)?([^\s"'<>()\[\],;]{6,})""",
    re.IGNORECASE | re.ASCII,
)
_HINTS = ("pass", "pwd", "secret", "token", "credential", "auth", "bearer", "key")

# Common words of passwords, the most frequent first.
WORDS = """password admin user test guest root login welcome master qwerty letmein dragon monkey love shadow
sunshine princess football baseball iloveyou trustno hello freedom whatever superman batman michael jordan secret
access changeme default example sample dummy placeholder temp temporary abc pass word key token api client server
database system service account private public internal prod production dev stage staging local localhost
company office home work spring summer autumn winter january february march april may june july august
september october november december monday tuesday wednesday thursday friday saturday sunday apple orange banana
cookie coffee pepper ginger flower tiger eagle falcon london paris berlin madrid the and for you your none null
true false redacted hidden removed insert here enter value string""".split()
_LEET = str.maketrans("4310$57@!", "aeiosstai")

# The rows of a keyboard; a key's neighbours stand beside it and half a key off in the rows above and below.
_ROWS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
_PLACE = {c: (x + 0.5 * y, y) for y, row in enumerate(_ROWS) for x, c in enumerate(row)}


def _near(a: str, b: str) -> bool:
    p, q = _PLACE.get(a), _PLACE.get(b)
    return p is not None and q is not None and a != b and abs(p[1] - q[1]) <= 1 and abs(p[0] - q[0]) <= 1


_DATE = re.compile(r"(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d|(?:0[1-9]|1[0-2])([-/._]?)(?:0[1-9]|[12]\d|3[01])\3(?:19|20)\d\d")
_YEAR = re.compile(r"(?:19|20)\d\d")


class Dictionary:
    """Ranks of words from 1, the common words of passwords first."""

    def __init__(self, words: Iterable[str] = ()):
        self.rank = {w: i + 1 for i, w in enumerate(dict.fromkeys([*WORDS, *words]))}
        self.longest = max(map(len, self.rank))


def _runs(value: str, follows) -> list[int]:
    """For each place the end of the run that starts there, each character following the one before."""
    n = len(value)
    end = list(range(1, n + 1))
    for i in range(n - 2, -1, -1):
        if follows(value[i], value[i + 1]):
            end[i] = end[i + 1]
    return end


def _repeats(value: str) -> dict[int, list[tuple[int, int]]]:
    """For each place the units that are repeated there, and how often: of units that are repeats themselves the shortest only."""
    codes = np.frombuffer(value.encode("utf-32-le", "surrogatepass"), np.uint32)
    n, out, known = len(codes), {}, {}
    for u in range(1, n // 2 + 1):
        same = codes[:-u] == codes[u:]
        if np.count_nonzero(same) < u:
            continue
        stop = np.append(np.flatnonzero(~same), len(same))
        agree = stop[np.searchsorted(stop, np.arange(len(same)))] - np.arange(len(same))  # how long value[i:] agrees with itself u later
        own = agree >= u
        for d, (reach, of_d) in known.items():
            if u % d == 0:
                own &= ~(of_d[: len(own)] & (reach[: len(own)] + d >= agree + u))
        if own.any():
            known[u] = (agree, own)
            for i in np.flatnonzero(own).tolist():
                out.setdefault(i, []).append((u, int(agree[i]) // u + 1))
    return out


def _alphabet(value: str) -> int:
    """How many characters there are of the classes that the value has."""
    return max(10, 26 * bool(re.search("[a-z]", value)) + 26 * bool(re.search("[A-Z]", value)) + 10 * bool(re.search("[0-9]", value)) + 33 * bool(re.search("[^A-Za-z0-9]", value)))


def cost(value: str, words: Dictionary | None = None) -> float:
    """log10 of the tries of the cheapest segmentation."""
    return _costs(value, _alphabet(value), words or Dictionary())[0]


#: log10 of the tries: a keyboard walk's first key and each step of it; a year; a date; a word with letters replaced, or with capitals.
WALK, STEP, YEAR, DATE, REPLACED, CAPITALS = math.log10(47), 0.35, math.log10(200), math.log10(365 * 120), 0.5, 0.3


def word_cost(part: str, words: Dictionary) -> float:
    low, found = part.lower(), math.inf
    for form, more in ((low, 0.0), (low.translate(_LEET), REPLACED)):
        if rank := words.rank.get(form):
            found = min(found, math.log10(rank + 1) + more + CAPITALS * (part != low))
    return found


def _costs(value: str, alphabet: int, words: Dictionary) -> list[float]:
    """For each place the cost of the value from there on."""
    n, low = len(value), value.lower()
    if len(low) != n:  # a few capitals become two letters
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    brute = math.log10(alphabet)
    up, down = _runs(low, lambda a, b: ord(b) == ord(a) + 1), _runs(low, lambda a, b: ord(b) == ord(a) - 1)
    walk = _runs(low, _near)
    repeats = _repeats(value)
    logs = np.log10(np.arange(1, n + 2))
    best = np.append(np.full(n, math.inf), 0.0)
    going = np.full(n + 1, math.inf)  # the cost from a place within a walk that goes on there
    for i in range(n - 1, -1, -1):
        least = brute + best[i + 1]
        for j in range(i + SHORTEST, min(n, i + words.longest) + 1):
            least = min(least, word_cost(value[i:j], words) + best[j])
        if m := _DATE.match(value, i):
            least = min(least, DATE + best[m.end()])
        if m := _YEAR.match(value, i):
            least = min(least, YEAR + best[m.end()])
        for end in (up[i], down[i]):
            if end >= i + 3:
                least = min(least, 1.0 + (best[i + 3 : end + 1] + logs[2 : end - i]).min())
        if walk[i] >= i + 2:
            going[i] = STEP + min(best[i + 2], going[i + 1])
            if walk[i] >= i + 3:
                least = min(least, WALK + STEP + going[i + 1])
        for u, times in repeats.get(i, ()):
            unit = min(u * brute, word_cost(value[i : i + u], words))
            least = min(least, unit + (best[i + 2 * u : i + times * u + 1 : u] + logs[1:times]).min())
        best[i] = least
    return best.tolist()


def _held_cost(value: str, start: int, held: dict, words: Dictionary) -> float:
    """cost(value), where values that start inside an earlier one and end with it share its segmentation."""
    key = start + len(value), _alphabet(value)
    if key not in held:
        held[key] = start, _costs(value, key[1], words)
    first, costs = held[key]
    return costs[start - first]


def _values(text: str):
    """Start and end of each value in a credential context; send True to go on after it, else the search goes on inside it."""
    low = text.lower()
    if any(w in low for w in _HINTS):
        at = 0
        while m := CONTEXT.search(text, at):
            taken = yield m.start(1), m.start(1) + len(m.group(1).rstrip(".:!?"))
            at = m.end() if taken else m.start(1)


def guesses(text: str, words: Dictionary, min_cost: float = MIN_COST) -> tuple[list[tuple[int, int]], float]:
    """Start and end of each value of min_cost or more, and the largest cost of any value (0 without one)."""
    found, most, held = [], 0.0, {}
    values = _values(text)
    span = next(values, None)
    while span is not None:
        a, b = span
        own = _held_cost(text[a:b], a, held, words) if b - a >= 6 else 0.0
        most = max(most, own)
        if own >= min_cost:
            found.append(span)
        try:
            span = values.send(own >= min_cost)
        except StopIteration:
            break
    return found, most


def base_spans(text: str) -> list[tuple[str, int, int]]:
    low, found = text.lower(), []
    if any(w in low for w in ("passw", "secret", "token", "api")):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return found + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def spans(text: str, words: Dictionary | None = None, min_cost: float = MIN_COST) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind."""
    found = base_spans(text) + [("guess", a, b) for a, b in guesses(text, words or Dictionary(), min_cost)[0]]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def joined(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


FOUND = T.StructType([*(T.StructField(f"n_{k}", T.LongType()) for k in KINDS), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("max_cost", T.DoubleType())])


def learned_words(docs: DataFrame, *, text: str = "text", most: int = MOST_WORDS) -> list[str]:
    """The most frequent runs of SHORTEST to LONGEST letters a-z, lower-cased, over all texts without their values in credential contexts.

    Counted within each task, and again after a shuffle; the first of each of PARTS parts are taken before the first of all, so that
    the driver is sent PARTS times `most` words at the most.
    """
    letter = np.zeros(256, bool)
    letter[97:123] = True

    def count(batches):
        held: dict[bytes, int] = {}

        def rows():
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for lo, hi in K.steps(batch.column(0)):
                texts = [_without_values(t) for t in batch.column(0).slice(lo, hi - lo).to_pylist() if t]
                buf, at = K.utf8(pa.array(texts, pa.string()))
                buf = K.LOWER[buf]
                starts, ends, _ = K.word_spans(buf, at, letter)
                some = (ends - starts >= SHORTEST) & (ends - starts <= LONGEST)
                starts, ends = starts[some], ends[some]
                _, first, n = np.unique(K.hash_spans(buf, starts, ends), return_index=True, return_counts=True)
                raw = buf.tobytes()
                for a, b, c in zip(starts[first].tolist(), ends[first].tolist(), n.tolist(), strict=True):
                    held[raw[a:b]] = held.get(raw[a:b], 0) + c
            if len(held) > 500_000:
                yield from rows()
                held.clear()
        yield from rows()

    counts = docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    order = [F.desc("n"), F.col("word")]
    first = F.row_number().over(Window.partitionBy(F.pmod(F.hash("word"), F.lit(PARTS))).orderBy(*order))
    few = counts.withColumn("first", first).where(F.col("first") <= most)
    return [r.word for r in few.orderBy(*order).limit(most).collect()]


def _without_values(text: str) -> str:
    out, at = [], 0
    values = _values(text)
    span = next(values, None)
    while span is not None:
        if span[0] >= at:
            out += [text[at : span[0]], " "]
        at = max(at, span[1])
        try:
            span = values.send(False)
        except StopIteration:
            break
    return "".join([*out, text[at:]]) if out else text


def scan(docs: DataFrame, *, text: str = "text", keep: list[str] | None = None, min_cost: float = MIN_COST, words: Iterable[str] | None = None) -> DataFrame:
    """Columns `keep` with the number of spans of each kind, the hash of the base spans, all spans, and the largest cost of a value.

    words: by rank; without them they are learned from docs.
    """
    words = learned_words(docs, text=text) if words is None else list(words)
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def make():
        known = Dictionary(shared.value)

        def one(t: str):
            added, most = guesses(t, known, min_cost)
            base = sorted(base_spans(t), key=lambda s: (s[1], KINDS.index(s[0])))
            every = sorted(base + [("guess", a, b) for a, b in added], key=lambda s: (s[1], KINDS.index(s[0])))
            return every, hashlib.sha256(joined(base).encode()).hexdigest(), most

        def work(texts: pa.Array, _):
            each = [one(t or "") for t in texts.to_pylist()]
            counts = [pa.array([sum(s[0] == k for s in f) for f, _, _ in each], pa.int64()) for k in KINDS]
            return [*counts, pa.array([b for _, b, _ in each], pa.string()), pa.array([joined(f) for f, _, _ in each], pa.string()), pa.array([m for _, _, m in each], pa.float64())]

        return work

    return per_text(docs, make, FOUND, text=text, keep=keep)


def redact(docs: DataFrame, *, text: str = "text", mark: str = "[secret]", min_cost: float = MIN_COST, words: Iterable[str] | None = None) -> DataFrame:
    """docs with each stretch that spans cover replaced by `mark`; a null text stays null."""
    kept = [c for c in docs.columns if c != text]
    words = learned_words(docs, text=text) if words is None else list(words)
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def make():
        known = Dictionary(shared.value)

        def cut(t: str) -> str:
            out, at = [], 0
            for _, a, b in spans(t, known, min_cost):
                if a >= at:
                    out += [t[at:a], mark]
                at = max(at, b)
            return "".join([*out, t[at:]])

        def work(texts: pa.Array, _):
            return [pa.array([None if t is None else cut(t) for t in texts.to_pylist()], pa.string())]

        return work

    return per_text(docs, make, T.StructType([T.StructField(text, T.StringType())]), text=text, keep=kept).select(*(f"`{c}`" for c in docs.columns))
