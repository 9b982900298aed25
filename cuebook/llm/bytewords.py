"""Word boundaries and word hashes of whole Arrow string columns, vectorised over UTF-8 bytes.

The word classes used here are byte classes: every separator is ASCII, so a UTF-8 sequence
is never cut. A column is walked in blocks of at most ``BLOCK`` bytes (a longer text is a
block of its own) and all temporaries are bounded by the block.

The hash of a word of at most ``LONG`` bytes is ``sum(T[b_i] * B**i) mod 2**64`` with a random table T,
taken from prefix sums, then mixed. Such a sum has collisions for any B once words are some hundred bytes long
(Thue-Morse words), so the hash of a longer word is a BLAKE2b digest. Equal words have equal hashes; two of a
million different words share one with a probability around 1e-8.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 19
SLICE = 512  # rows
LONG = 64  # bytes
_SPAN = 1 << 18  # bytes that one round of prefix sums covers
_MULT = np.uint64(0x9E3779B97F4A7C15 | 3)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

# The separators of the two word classes.
SPACE_BYTES = np.zeros(256, dtype=bool)
SPACE_BYTES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
NON_ALNUM_BYTES = np.zeros(256, dtype=bool)
NON_ALNUM_BYTES[0x00:0x30] = True
NON_ALNUM_BYTES[0x3A:0x61] = True
NON_ALNUM_BYTES[0x7B:0x80] = True
NON_ALNUM_BYTES[0x41:0x5B] = False  # A-Z count as a-z, which is what they are folded to


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    table = rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    power = np.empty(_SPAN + 1, dtype=np.uint64)
    power[0] = 1
    with np.errstate(over="ignore"):
        power[1:] = _MULT
        power = np.cumprod(power, dtype=np.uint64)
        inverse = np.empty_like(power)
        inverse[0] = 1
        inverse[1:] = np.uint64(pow(int(_MULT), -1, 2**64))
        inverse = np.cumprod(inverse, dtype=np.uint64)
    return table, table[_LOWER], power, inverse


_TABLE, _TABLE_LOWER, _POWER, _INVERSE = _tables()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, in place on a copy."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def blocks(texts: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) for runs of rows of about ``limit`` bytes.

    A null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    for first in range(0, len(texts), SLICE):  # only a slice of the batch is copied at a time
        part = texts.slice(first, SLICE).cast(pa.large_string()).fill_null("")
        n = len(part)
        _, offs, data = part.buffers()
        offsets = np.frombuffer(offs, dtype=np.int64)[part.offset:part.offset + n + 1]
        raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        lo = 0
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
            hi = min(hi, n)
            yield first + lo, first + hi, raw[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
            lo = hi


def words(raw: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, number of words before each row's first; one more at the end)."""
    inside = np.zeros(len(raw) + 1, dtype=bool)
    np.logical_not(separators[raw], out=inside[:-1])
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    rows = offsets[:-1][np.diff(offsets) > 0]
    begin[rows] = inside[rows]  # a row always starts anew
    starts = np.flatnonzero(begin)
    last = inside[:-1] & ~inside[1:]
    cuts = offsets[1:][np.diff(offsets) > 0] - 1
    last[cuts] = inside[cuts]
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each span; ``lower`` folds A-Z first."""
    table = _TABLE_LOWER if lower else _TABLE
    out = np.zeros(len(starts), dtype=np.uint64)
    long = np.flatnonzero(ends - starts > LONG)
    some = np.flatnonzero(ends - starts <= LONG) if len(long) else np.arange(len(starts))
    first, last = starts[some], ends[some]
    i, n = 0, len(some)
    with np.errstate(over="ignore"):
        while i < n:
            base = int(first[i])
            j = int(np.searchsorted(last, base + _SPAN, side="right")) if len(raw) > _SPAN else n
            part = raw[base:int(last[j - 1])]
            sums = np.zeros(len(part) + 1, dtype=np.uint64)
            np.cumsum(table[part] * _POWER[:len(part)], out=sums[1:])
            a, b = first[i:j] - base, last[i:j] - base
            out[some[i:j]] = (sums[b] - sums[a]) * _INVERSE[a]
            i = j
        out = mix(out)
    for k in long.tolist():
        span = raw[starts[k]:ends[k]]
        span = (_LOWER[span] if lower else span).tobytes()
        out[k] = int.from_bytes(hashlib.blake2b(span, digest_size=8).digest(), "little")
    return out


def grams(h: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each row, and where each row's begin (one more at the end).

    ``h`` are word hashes, ``rows`` the number of words before each row. A row of fewer words,
    but not none, has one shingle: its whole sequence."""
    count = np.diff(rows)
    n = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
    bounds = np.zeros(len(rows), dtype=np.int64)
    np.cumsum(n, out=bounds[1:])
    total = int(bounds[-1])
    at = np.arange(total) + np.repeat(rows[:-1] - bounds[:-1], n)
    stop = np.repeat(rows[1:], n)
    out = np.zeros(total, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            pos = at + i
            ok = pos < stop
            value = np.where(ok, h[np.minimum(pos, max(len(h) - 1, 0))] if len(h) else 0, np.uint64(0x5851F42D4C957F2D))
            out = mix(out * _MULT + value)
    return out, bounds


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct numbers of ``x``, sorted. (numpy's own goes through a hash table, which is slower.)"""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def counted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct numbers of ``x``, sorted, and how often each is there)."""
    x = np.sort(x)
    at = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, dtype=np.int64)
    return x[at], np.diff(np.append(at, len(x)))
