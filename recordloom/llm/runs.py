"""Periodic runs of words: maximal stretches that repeat themselves, from two Lyndon arrays.

A text is a string over the ordered alphabet of its words. For each suffix the next
smaller one is found from left to right with a stack; the number of symbols that two
suffixes share comes, where it can, from pairs matched before: along the stack (what k
shares with j and with i says what j shares with i), or from the last matched stretch, in
which every pair stands where an earlier pair did. Only symbols beyond that stretch are
compared, so each is compared about once. The longest Lyndon word of a place ends before its
next smaller suffix; under one of the two orders, that of the words or its reverse, the
first Lyndon root of every run is such a word, and one extension to the left completes
it. There are no suffix arrays or trees, and no hashes: words are numbered by a dictionary.

Before that, stretches are parted at words that occur once in them, by whole arrays: all
words of a run occur in it twice, so no run holds or passes such a word. What is left of
plain prose is little.

Defined cases: words are runs of anything but ASCII white space; a null, empty or blank
text has no words and no runs; very long texts are read whole, in time and memory in
proportion to them; every row is read on its own, so ties and repeated rows keep their own
results; with `planted`, a row without doc_id is left as it is; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST = 12
CHUNK = 2 << 20  # bytes of whole texts that are handled at once
SPACES = r"[\x20\x09-\x0D]+"


def next_smaller(w: list[int]) -> tuple[list[int], list[int]]:
    """(the next smaller suffix of each, symbols shared with it) of w, whose last symbol is smaller than all others and left out."""
    n = len(w) - 1
    after, shared = [n] * n, [0] * n
    before, common = [-1] * n, [0] * n  # the suffix below on the stack, and what is shared with it
    begin = end = shift = 0  # w[begin:end] == w[begin - shift : end - shift]
    for i in range(1, n):
        j, above, got = i - 1, -1, 0
        while j >= 0:
            if above >= 0 and common[above] != got:
                if common[above] < got:
                    got = common[above]
                    break
                after[j], shared[j] = i, got
                above, j = j, before[j]
                continue
            known = -1
            if i < end and j >= begin:
                x, y = i - shift, j - shift
                known = shared[y] if after[y] == x else common[x] if before[x] == y else -1
            if known >= 0 and i + known < end:
                got = known
            else:
                if known >= 0 and end - i > got:
                    got = end - i
                while w[j + got] == w[i + got]:
                    got += 1
                if i + got >= end:
                    begin, end, shift = i, i + got, i - j
            if w[j + got] < w[i + got]:
                break
            after[j], shared[j] = i, got
            above, j = j, before[j]
        before[i], common[i] = j, got if j >= 0 else 0
    return after, shared


def runs(codes: list[int], least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of `least` symbols and two periods or more, in order."""
    out = set()
    top = max(codes, default=0)
    for w in ([*codes, -1], [*(top - c for c in codes), -1]):
        after, right = next_smaller(w)
        for i, r in enumerate(right):
            p = after[i] - i
            if not r or 2 * p + r <= least:
                continue
            left = 0
            while left < p and left < i and w[i - left - 1] == w[i + p - left - 1]:
                left += 1
            if left < p <= left + r and left + p + r >= least:  # a whole period to the left: the root there has the run
                out.add((i - left, left + p + r, p))
    return sorted(out)


def stretches(codes: np.ndarray, docs: np.ndarray, least: int = LEAST) -> list[tuple[int, int]]:
    """(begin, end) of what may hold runs, given each word's code and text."""
    at, part = np.arange(len(codes)), docs.astype(np.int64)
    while len(at):
        key = part * (int(codes.max()) + 1) + codes[at]
        order = np.argsort(key, kind="stable")
        same = np.diff(key[order]) == 0
        twice = np.empty(len(at), bool)
        twice[order] = np.r_[same, False] | np.r_[False, same]
        cut = np.r_[True, (np.diff(at[twice]) > 1) | (np.diff(part[twice]) != 0)][: int(twice.sum())]
        number = np.cumsum(cut) - 1
        long = np.bincount(number, minlength=1)[number] >= least
        kept = at[twice][long]
        if len(kept) == len(at):
            heads = np.flatnonzero(np.r_[True, np.diff(part) != 0])
            return [(int(at[a]), int(at[b - 1]) + 1) for a, b in zip(heads, np.r_[heads[1:], len(at)])]
        at, part = kept, number[long]
    return []


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(all words, words of each text)."""
    lists = pc.split_pattern_regex(texts, pattern=SPACES)
    values = lists.flatten()
    full = pc.greater(pc.binary_length(values), 0).to_numpy(zero_copy_only=False)
    text = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    return values.filter(pa.array(full)), np.bincount(text[full], minlength=len(texts))


def chunks(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    sizes = np.cumsum(pc.binary_length(b.column("text")).to_numpy(zero_copy_only=False), dtype=np.int64)
    row = 0
    while row < b.num_rows:
        end = max(row + 1, int(np.searchsorted(sizes, (sizes[row - 1] if row else 0) + CHUNK, "right")))
        yield b.slice(row, end - row)
        row = end


RESULT = "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def scan(docs: DataFrame, least: int = LEAST, planted: bool = False) -> DataFrame:
    """One row for each document: its runs as numbers and digests, the longest one, and the text without repeats as a digest.

    `planted` makes a tenth of the documents, by the check sum of their ids, periodic from
    some word on. A narrow map: nothing is shuffled.
    """
    return _map(docs, least, planted, False)


def collapse(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, runs, text: the runs of each document and its words but those of runs after their first period."""
    return _map(docs, least, False, True)


def _map(docs: DataFrame, least: int, planted: bool, whole: bool) -> DataFrame:
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for b in chunks(batch):
                yield read(b)

    def read(b: pa.RecordBatch) -> pa.RecordBatch:
        values, n = words_of(b.column("text"))
        begin = np.cumsum(n) - n
        place = np.arange(len(values))
        if planted:
            for k, h in enumerate(b.column("sum").to_pylist()):
                if h is not None and h % 10 == 0 and n[k]:
                    g = h // 10
                    a = g % int(n[k])
                    p = 1 + (int(n[k]) - a) // (3 + g % 8)
                    place[begin[k] + a : begin[k] + n[k]] = begin[k] + a + np.arange(int(n[k]) - a) % p
        codes = pc.dictionary_encode(values).indices.to_numpy()[place] if len(values) else np.empty(0, np.int64)
        found: list[list] = [[] for _ in n]
        keep = np.ones(len(place), bool)
        doc = np.repeat(np.arange(len(n)), n)
        for s, e in stretches(codes, doc, least):
            k = int(doc[s])
            for start, length, period in runs(codes[s:e].tolist(), least):
                found[k].append((s + start - int(begin[k]), length, period))
                keep[s + start + period : s + start + length] = False
        offsets = np.r_[0, np.cumsum(np.bincount(doc[keep], minlength=len(n)))].astype(np.int32)
        kept = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), values.take(pa.array(place[keep]))), " ")
        if whole:
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            listed = pa.array([[{"start": s, "length": m, "period": p} for s, m, p in sorted(f)] for f in found], kind)
            return pa.RecordBatch.from_arrays([b.column("doc_id"), listed, kept], names=["doc_id", "runs", "text"])
        best = [min(f, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None)) for f in found]
        columns = [
            b.column("doc_id"), pa.array(n.astype(np.int64)), pa.array([len(f) for f in found], pa.int64()), *(pa.array([x[k] for x in best], pa.int64()) for k in range(3)),
            pa.array([None if x[0] is None else 1000 * x[1] // x[2] for x in best], pa.int64()),
            pa.array([_sha("".join(f"{s},{m},{p}\n" for s, m, p in sorted(f, key=lambda r: (r[0], r[2])))) for f in found]),
            pa.array([_sha(t) for t in kept.to_pylist()]),
        ]
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in RESULT.split(", ")])

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")).alias("sum"))
    return rows.mapInArrow(batches, "doc_id long, runs array<struct<start:long,length:long,period:long>>, text string" if whole else RESULT)
