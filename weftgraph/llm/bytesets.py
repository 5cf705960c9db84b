"""Vectorised work on the bytes of a column of texts: words, their hashes, n-grams.

Everything is done with numpy over a few megabytes of text at a time, so that a batch of any size
takes bounded memory; only a single longer text is taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1_000_000

_rng = np.random.default_rng(20240229)
BYTE_CODES = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
GRAM_CODES = _rng.integers(1, 2**63, 16, dtype=np.uint64) | np.uint64(1)
STEP = np.uint64(0x9E3779B97F4A7C15)
BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))

#: Letters, digits and every byte of a character beyond ASCII are parts of words.
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
SOLID_BYTE = np.ones(256, bool)
SOLID_BYTE[[9, 10, 13, 32]] = False

def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (STEP, BACK):
        steps = np.full(n, base, np.uint64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every bit of a 64-bit value over all bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def as_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and the offsets of the texts in them. A null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    n = len(column)
    if not n:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(column: pa.Array | pa.ChunkedArray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) over the column."""
    raw, at = as_bytes(column)
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
        yield lo, hi, raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def spans(raw: np.ndarray, at: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end bytes of the maximal runs of member bytes, and each text's first run (one more at the end)."""
    if not len(raw):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(at), np.int64)
    inside = member[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True
    starts = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate(([False], inside[:-1]))))
    ends = np.flatnonzero(inside & (edge[1:] | ~np.concatenate((inside[1:], [False])))) + 1
    return starts, ends, np.searchsorted(starts, at)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes."""
    up, down = powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(BYTE_CODES[raw] * up[: len(raw)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def gram_hashes(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of consecutive words and each text's first one (one more at the end).

    A text of fewer than n words, but one at least, has a single gram of all its words.
    """
    count = np.diff(first)
    grams = np.where(count > 0, np.maximum(count - n + 1, 1), 0)
    begin = np.concatenate(([0], np.cumsum(grams)))
    out = np.empty(begin[-1], np.uint64)
    if not len(out):
        return out, begin
    if len(words) >= n:
        total = np.zeros(len(words) - n + 1, np.uint64)
        for k in range(n):
            total += words[k : len(words) - n + 1 + k] * GRAM_CODES[k]
        total = mix(total)
    else:
        total = np.empty(0, np.uint64)
    place = np.arange(len(out)) - np.repeat(begin[:-1], grams) + np.repeat(first[:-1], grams)
    whole = np.repeat(count >= n, grams)
    out[whole] = total[place[whole]]
    for d in np.flatnonzero((count > 0) & (count < n)):
        own = words[first[d] : first[d + 1]]
        out[begin[d]] = mix(np.array([(own * GRAM_CODES[: len(own)]).sum() + np.uint64(len(own))]))[0]
    return out, begin
