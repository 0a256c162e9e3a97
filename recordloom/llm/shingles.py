"""Words and word shingles of Arrow text columns as hashes, by whole arrays.

Texts are handled in chunks of about `CHUNK` bytes of whole documents, so memory is
bounded by that and by the longest document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 2 << 20
U = np.uint64
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
INVERSE = pow(BASE, -1, 1 << 64)
STEP = U(0xD6E8FEB86659FD93)

#: Bytes of words: all but ASCII white space.
UNSPACED = np.ones(256, bool)
UNSPACED[[9, 10, 11, 12, 13, 32]] = False
#: ASCII letters and digits, and all bytes of other characters.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True

_powers: dict[int, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(base: int, n: int) -> np.ndarray:
    if base not in _powers or len(_powers[base]) < n:
        x = np.full(max(n, CHUNK + 1), base, np.uint64)
        x[0] = 1
        grown = np.cumprod(x)
        if len(grown) > 4 * CHUNK:
            return grown  # of one very long text; not kept
        _powers[base] = grown
    return _powers[base]


def chunks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) for runs of whole texts of a string column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if not n:
        return
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(at, at[row] + CHUNK, "right")) - 1)
        yield row, raw[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def word_hashes(raw: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = UNSPACED) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, words of each text) in order."""
    docs = len(offsets) - 1
    inside = is_word[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < len(raw)]
    first[heads] = inside[heads]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.empty(0, np.uint64), np.zeros(docs, np.int64)
    with np.errstate(over="ignore"):
        part = (raw.astype(np.uint64) + U(1)) * inside
        part *= powers(BASE, len(raw))[: len(raw)]
        sums = np.add.reduceat(part, starts) * powers(INVERSE, len(raw))[starts]
        hashes = mix64(sums)
    counts = np.diff(np.searchsorted(starts, offsets))
    return hashes, counts


def shingle_hashes(words: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of `size` words, shingles of each text); a shorter text with words is one shingle."""
    with np.errstate(over="ignore"):
        n = np.maximum(counts - size + 1, (counts > 0).astype(np.int64))
        if not len(words):
            return np.empty(0, np.uint64), n
        begin = np.cumsum(counts) - counts
        doc = np.repeat(np.arange(len(counts)), n)
        index = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n) + begin[doc]
        short = np.flatnonzero((counts > 0) & (counts < size))
        padded = np.concatenate([words, np.zeros(size, np.uint64)])
        out = padded[index]
        for k in range(1, size):
            out = out * STEP + padded[index + k]
        at = (np.cumsum(n) - n)[short]
        for a, d in zip(at, short):  # few: texts of less than `size` words
            h = U(0)
            for w in words[begin[d] : begin[d] + counts[d]]:
                h = h * STEP + w
            out[a] = h + U(int(counts[d]))
        return mix64(out), n
