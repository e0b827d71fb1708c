"""Word shingles of whole texts, hashed a batch at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word in order, first word of each text and the total).

    Words are runs without ASCII white space, with A-Z lower-cased; null counts
    as empty.
    """
    filled = pc.fill_null(texts, "").cast(pa.large_string())
    n = len(filled)
    offsets = np.frombuffer(filled.buffers()[1], np.int64, n + 1, filled.offset * 8)
    if offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    data = _LOWER[np.frombuffer(filled.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]]
    offsets = offsets - offsets[0]
    blank = _BLANK[data]
    first = blank.copy()
    first[1:] = blank[:-1]
    first[0] = True
    first[offsets[:-1][offsets[:-1] < len(data)]] = True
    start = np.flatnonzero(first & ~blank)
    stops = np.flatnonzero(np.concatenate([blank | first, [True]]))
    end = stops[np.searchsorted(stops, start, side="right")] if len(start) else start
    hashes = np.zeros(len(start), np.uint64)
    live, at, left = np.arange(len(start)), start.copy(), end - start
    code = data.astype(np.uint64) + np.uint64(1)
    while len(live):
        h = (hashes[live] + code[at]) * _ODD
        hashes[live] = h ^ (h >> np.uint64(29))
        more = left > 1
        live, at, left = live[more], at[more] + 1, left[more] - 1
    return mixed(hashes), np.searchsorted(start, offsets)


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of each text's distinct shingles in order of value, bounds of each text).

    With fewer than ``size`` words the whole sequence is one shingle; a text
    without words has none.
    """
    words, bounds = word_hashes(texts)
    count = np.diff(bounds)
    made = np.where(count >= size, count - size + 1, (count > 0).astype(np.int64))
    ends = np.cumsum(made)
    first = np.repeat(bounds[:-1], made) + np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - made, made)
    span = np.repeat(np.minimum(count, size), made)
    out = span.astype(np.uint64)
    for k in range(size):
        live = span > k
        h = (out[live] + words[first[live] + k]) * _ODD
        out[live] = h ^ (h >> np.uint64(32))
    out = mixed(out)
    for start, end in zip((ends - made).tolist(), ends.tolist(), strict=True):
        out[start:end].sort()
    new = np.ones(len(out), bool)
    if len(out):
        owner = np.repeat(np.arange(len(made)), made)
        new[1:] = (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])
        sizes = np.bincount(owner[new], minlength=len(made))
    else:
        sizes = np.zeros(len(made), np.int64)
    return out[new], np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
