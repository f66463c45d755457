"""Vectorised text kernels over Arrow string batches, shared by the corpus operators.

Texts are handled as UTF-8 bytes.  Every class of characters used here is decided by
ASCII bytes alone (all bytes of a non-ASCII character are 0x80 or more), so a 256-entry
table classifies a byte without decoding it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one vectorised step takes at most (a longer single text is one step).
STEP_BYTES = 1 << 20

_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: `[^\x20\x09-\x0D]`
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]`, for lower-cased text
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x + _GOLD
    x ^= x >> _S30
    x *= _C1
    x ^= x >> _S27
    x *= _C2
    x ^= x >> _S31
    return x


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the len(texts) + 1 offsets into them; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, ends, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buf = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, at - at[0]


def steps(texts: pa.Array, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most `most` bytes of text each, or one row."""
    _, at = utf8(texts)
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, side="right")) - 1)
        yield lo, min(hi, n)
        lo = hi


def word_spans(buf: np.ndarray, at: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each maximal run of bytes of `kind`, and the number of runs before each text.

    Runs never cross a text's border.
    """
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    inside = kind[buf]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edge = at[(at > 0) & (at < len(buf))]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, at, side="left")


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each span's bytes, read eight at a time."""
    padded = np.empty(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    padded[len(buf) :] = 0
    loads = np.ndarray((len(buf) + 1,), "<u8", padded, 0, (1,))
    size = ends - starts
    out = mix(size.astype(np.uint64) + np.uint64(seed * 2 + 1))
    todo, at, left = np.arange(len(starts)), starts, size
    while len(todo):
        part = loads[at]
        short = left < 8
        if short.any():
            keep = np.left_shift(np.uint64(1), (left[short] * 8).astype(np.uint64)) - np.uint64(1)
            part[short] &= keep
        out[todo] = mix(out[todo] * _C1 ^ part)
        more = left > 8
        if not more.any():
            break
        todo, at, left = todo[more], at[more] + 8, left[more] - 8
    return out


def lines_up(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive values, order kept; shorter input gives none."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    m = len(hashes) - n + 1
    out = np.full(m, n, np.uint64)
    for j in range(n):
        out = mix(out * _C2 ^ hashes[j : j + m])
    return out


def within(first: np.ndarray, total: int, n: int) -> np.ndarray:
    """Which of the total - n + 1 windows of n words lie in one text; first: words before each text."""
    ok = np.ones(max(0, total - n + 1), bool)
    inner = first[(first > 0) & (first < total)]
    for j in range(1, n):
        cut = inner - j
        ok[cut[(cut >= 0) & (cut < len(ok))]] = False
    return ok


def owner(first: np.ndarray, total: int) -> np.ndarray:
    """The text of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(np.append(first[:-1], total)))


def binary_array(blobs: list[bytes | None]) -> pa.Array:
    return pa.array(blobs, pa.binary())
