"""Benchmark decontamination with BM25 over an inverted index of test items.

Every passage of every document is a query against the items. Items are kept in classes
of like length, and for each class a document is cut into windows of twice the longest
item, overlapping by half, so any copied item lies whole in a window not much longer. An
item is retrieved if its BM25 score reaches `share` of the score its own text would get.

As in block-max WAND, upper bounds decide what is scored: items lie in blocks; a term
has a maximum for each block, and the frequent terms of the index, which nearly any
passage holds, enter with the most that they can add up to for an item of the block. A
window is scored against a block only if its bound reaches the threshold. Bounds are
never below scores, so nothing above the threshold is lost. A retrieved item counts if
word n-grams of its question and of its answer are found in the document.

The index is built from whole items in blocks of at most `INDEX_ITEMS`, so what is sent
to executors is bounded; a larger benchmark takes more passes over the documents. Term
frequencies, mean length and window lengths are those of all items in every block.

Words are runs of letters and digits in lower case. Defined cases: null or empty texts
and items without words match nothing; very long texts are searched whole, as one chunk; repeated rows of documents or items give a row
each per distinct (doc_id, item_id); equal items are all retrieved; other columns are
ignored; empty tables give empty results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, packed
from .neardup import node
from .shingles import ALNUM, chunks, shingle_hashes, word_hashes

INDEX_ITEMS = 5_000
BLOCK = 8
#: Hits (32 bytes each) up to this number are broadcast to be taken out; more are joined.
BROADCAST_HITS = 500_000
#: Longest parts of each class of items, in words.
LENGTHS = (16, 24, 32, 48, 64, 96, 128)
#: Terms of more than this share of the parts are frequent.
FREQUENT = 0.05
K1, B = 1.2, 0.75
SHARE = 0.5
OVERLAP = 0.5
GRAM = 5
#: Longer items are indexed in parts of so many words.
PART = LENGTHS[-1]

RESULT = "doc_id long, item_id long, score double, score_share double, question_overlap double, answer_overlap double"
HITS = RESULT + ", node binary"


def halves(text: str) -> tuple[str, str]:
    """Question and answer: after the last inner question mark, else the last sentence, else the last quarter."""
    body = text.rstrip()
    for pattern in (r"\?(?=\s)", r"[.!?](?=\s)"):
        cuts = [m.end() for m in re.finditer(pattern, body)]
        cuts = [c for c in cuts if re.search(r"\w", body[:c]) and re.search(r"\w", body[c:])]
        if cuts:
            return body[: cuts[-1]], body[cuts[-1] :]
    spaces = [m.start() for m in re.finditer(r"\s+", body)]
    cut = spaces[3 * len(spaces) // 4] if spaces else len(body)
    return body[:cut], body[cut:]


def hashed(text: str) -> np.ndarray:
    raw = np.frombuffer(text.lower().encode(), np.uint8)
    return word_hashes(raw, np.array([0, len(raw)]), ALNUM)[0]


def grams(words: np.ndarray, size: int) -> np.ndarray:
    return np.unique(shingle_hashes(words, np.array([len(words)]), size)[0]) if len(words) >= size > 0 else np.empty(0, np.uint64)


def spread(at: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all entries of `keys` in a table whose key k has entries at[k]..at[k + 1], and which key each is of."""
    n = at[keys + 1] - at[keys]
    return np.repeat(at[keys] - (np.cumsum(n) - n), n) + np.arange(n.sum()), np.repeat(np.arange(len(keys)), n)


class LengthClass:
    """Postings of the parts of one class: shares of each part's own score, and block maxima."""

    def __init__(self, term: np.ndarray, part: np.ndarray, share: np.ndarray, parts: np.ndarray, stride: int, terms: int, frequent: np.ndarray):
        self.stride, self.parts = stride, parts
        local = np.searchsorted(parts, part)
        order = np.lexsort((local, term))
        self.term, self.local, self.share = term[order], local[order], share[order]
        self.at = np.searchsorted(self.term, np.arange(terms + 1))
        self.blocks = -(-len(parts) // BLOCK)
        often = frequent[self.term]
        sums = np.bincount(self.local[often], self.share[often], minlength=self.blocks * BLOCK)
        self.base = sums.reshape(self.blocks, BLOCK).max(axis=1)
        t, b, v = self.term[~often], self.local[~often] // BLOCK, self.share[~often]
        head = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (b[1:] != b[:-1])]) if len(t) else np.empty(0, np.int64)
        self.block_of = b[head]
        self.block_max = np.maximum.reduceat(v, head) if len(t) else v
        self.block_at = np.searchsorted(t[head], np.arange(terms + 1))

    def open(self, terms: np.ndarray, counts: np.ndarray, share: float) -> tuple[np.ndarray, ...]:
        """(text, first word, end, block) of the windows and blocks whose bound reaches `share`."""
        begin = np.cumsum(counts) - counts
        cells = -(-counts // self.stride)
        first = np.cumsum(cells) - cells
        text = np.repeat(np.arange(len(counts)), counts)
        cell = first[text] + (np.arange(len(terms)) - begin[text]) // self.stride
        hits = np.flatnonzero(terms >= 0)
        where, of = spread(self.block_at, terms[hits])
        n = int(cells.sum())
        sums = np.bincount(cell[hits[of]] * self.blocks + self.block_of[where], self.block_max[where], minlength=n * self.blocks).reshape(n, self.blocks)
        owner = np.repeat(np.arange(len(counts)), cells)
        same = np.flatnonzero(owner[1:] == owner[:-1])
        bound = sums + self.base
        bound[same] += sums[same + 1]
        w, block = np.nonzero(bound >= share - 1e-6)
        lo = begin[owner[w]] + (w - first[owner[w]]) * self.stride
        return owner[w], lo, np.minimum(lo + 2 * self.stride, begin[owner[w]] + counts[owner[w]]), block

    def retrieve(self, terms: np.ndarray, lo: np.ndarray, hi: np.ndarray, block: np.ndarray, share: float) -> Iterator[tuple[int, int, float]]:
        """(place in `lo`, part, score share) at or above `share`, for rows of open(); a window's terms count once."""
        if not len(lo):
            return
        head = np.flatnonzero(np.r_[True, (lo[1:] != lo[:-1])])
        window = np.repeat(np.arange(len(head)), np.diff(np.r_[head, len(lo)]))
        allowed = np.zeros((len(head), self.blocks), bool)
        allowed[window, block] = True
        n = hi[head] - lo[head]
        place = np.repeat(lo[head] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        key = np.repeat(np.arange(len(head)), n) * len(self.at) + terms[place]
        key = np.unique(key[terms[place] >= 0])
        where, of = spread(self.at, key % len(self.at))
        w, local = (key // len(self.at))[of], self.local[where]
        go = allowed[w, local // BLOCK]
        cell, back = np.unique(w[go] * len(self.parts) + local[go], return_inverse=True)
        score = np.bincount(back, self.share[where][go], minlength=len(cell))
        for k in np.flatnonzero(score >= share - 1e-9):
            yield int(head[cell[k] // len(self.parts)]), int(self.parts[cell[k] % len(self.parts)]), float(score[k])


def cut(words: np.ndarray) -> list[np.ndarray]:
    return [words[a : a + PART] for a in range(0, len(words), PART)]


class Statistics:
    """What BM25 takes from all parts of a benchmark: their number, mean length, longest of each class, and parts of each term."""

    def __init__(self, parts: int, mean: float, longest: dict[int, int], terms: np.ndarray, df: np.ndarray):
        self.parts, self.mean, self.longest, self.terms, self.df = parts, mean, longest, terms, df


def term_counts(items: DataFrame) -> DataFrame:
    """term, n: the parts of `items` that have each term."""

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            terms = [np.unique(p) for t in b.column("text").to_pylist() for p in cut(hashed(t))]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(terms or [np.empty(0, np.uint64)]).view(np.int64))], names=["term"])

    return items.select("text").mapInArrow(count, "term long").groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def part_lengths(items: DataFrame) -> list[tuple[int, int]]:
    """(length, parts of it): at most `PART` rows."""

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            n = [len(p) for t in b.column("text").to_pylist() for p in cut(hashed(t))]
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64())], names=["length"])

    return [tuple(r) for r in items.select("text").mapInArrow(count, "length long").groupBy("length").count().collect()]


class Index:
    """An inverted index of items with BM25 weights, by class of length; `of` are the statistics if `items` are a block of more."""

    def __init__(self, items: list[tuple[int | None, str]], of: Statistics | None = None):
        self.ids, self.owner = [], []
        self.checks: list[list[tuple[int, np.ndarray]]] = []
        parts: list[np.ndarray] = []
        for item_id, text in items:
            words = hashed(text)
            if not len(words):
                continue
            self.checks.append([(min(GRAM, len(w)), grams(w, min(GRAM, len(w)))) for w in map(hashed, halves(text))])
            for p in cut(words):
                parts.append(p)
                self.owner.append(len(self.ids))
            self.ids.append(item_id)
        self.classes: list[LengthClass] = []
        if not parts:
            return
        lengths = np.array([len(p) for p in parts])
        seen = [np.unique(p, return_counts=True) for p in parts]
        part = np.repeat(np.arange(len(parts)), [len(w) for w, _ in seen])
        tf = np.concatenate([n for _, n in seen])
        self.terms, term = np.unique(np.concatenate([w for w, _ in seen]), return_inverse=True)
        kind = np.searchsorted(LENGTHS, lengths)
        if of is None:
            of = Statistics(len(parts), lengths.mean(), {k: int(lengths[kind == k].max()) for k in np.unique(kind)}, self.terms, np.bincount(term))
        df = of.df[np.searchsorted(of.terms, self.terms)]
        idf = np.log1p((of.parts - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * lengths / of.mean)
        weight = idf[term] * tf * (K1 + 1) / (tf + norm[part])
        self.own = np.bincount(part, weight)
        for k in np.unique(kind):
            mine, of_class = np.flatnonzero(kind == k), kind[part] == k
            self.classes.append(LengthClass(term[of_class], part[of_class], (weight / self.own[part])[of_class], mine, of.longest[k], len(self.terms), df > FREQUENT * of.parts))
        self.bits = np.zeros(1 << 20, bool)
        self.bits[self.terms & np.uint64((1 << 20) - 1)] = True

    def term_of(self, words: np.ndarray) -> np.ndarray:
        """The number of each word's term, or -1; a bitmap settles most words that are none."""
        out = np.full(len(words), -1, np.int64)
        maybe = np.flatnonzero(self.bits[words & np.uint64((1 << 20) - 1)])
        at = np.searchsorted(self.terms, words[maybe])
        at[at == len(self.terms)] = 0
        hit = self.terms[at] == words[maybe]
        out[maybe[hit]] = at[hit]
        return out

    def search(self, words: np.ndarray, counts: np.ndarray, share: float, overlap: float) -> Iterator[tuple[int, int, float, float, float, float]]:
        """(text, item, score, share, question overlap, answer overlap) for a chunk of texts."""
        if not self.classes or not len(words):
            return
        terms = self.term_of(words)
        begin = np.cumsum(counts) - counts
        best: dict[tuple[int, int], tuple[float, int]] = {}
        for c in self.classes:
            text, lo, hi, block = c.open(terms, counts, share)
            for a, part, s in c.retrieve(terms, lo, hi, block, share):
                key = (int(text[a]), self.owner[part])
                if s > best.get(key, (0.0, 0))[0]:
                    best[key] = (s, part)
        have: dict[tuple[int, int], np.ndarray] = {}
        for (t, item), (s, part) in best.items():
            found = []
            for size, want in self.checks[item]:
                if (t, size) not in have:
                    have[t, size] = grams(words[begin[t] : begin[t] + counts[t]], size)
                found.append(float(np.isin(want, have[t, size]).mean()) if len(want) else 1.0)
            if min(found) >= overlap:
                yield t, item, s * float(self.own[part]), s, *found


def leaks(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, overlap: float = OVERLAP, most: int = INDEX_ITEMS) -> DataFrame:
    """(doc_id, item_id) with scores and overlaps, one row for each distinct pair."""
    best = F.max(F.struct("score_share", "score", "question_overlap", "answer_overlap")).alias("b")
    pairs = hits(docs, benchmark, share, overlap, most).groupBy("doc_id", "item_id").agg(best)
    return pairs.select("doc_id", "item_id", "b.score", "b.score_share", "b.question_overlap", "b.answer_overlap")


def hits(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, overlap: float = OVERLAP, most: int = INDEX_ITEMS) -> DataFrame:
    """A row for each document row and item found in it, with the text's digest."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    blocks = max(1, -(-items.count() // most))
    texts = docs.select(F.col("doc_id").cast("long"), F.lower(F.coalesce("text", F.lit(""))).alias("text"), node(F.col("text")).alias("node"))
    found = []
    if blocks > 1:
        lengths = part_lengths(items)
        n = sum(m for _, m in lengths)
        longest: dict[int, int] = {}
        for length, _ in sorted(lengths):
            longest[int(np.searchsorted(LENGTHS, length))] = length
        frequencies = materialise(term_counts(items), "terms")
    for k in range(blocks):
        rows, of = items, None
        if blocks > 1:
            rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
            mine = frequencies.join(term_counts(rows).select("term"), "term").toPandas()  # terms of the block's items: bounded as they are
            terms, df = mine["term"].to_numpy(np.int64).view(np.uint64), mine["n"].to_numpy(np.int64)
            order = np.argsort(terms)
            of = Statistics(n, sum(a * m for a, m in lengths) / max(1, n), longest, terms[order], df[order])
        index = spark.sparkContext.broadcast(Index(sorted(((r[0], r[1]) for r in rows.toLocalIterator()), key=str), of))

        def search(it: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            ix = index.value
            for b in it:
                ids, nodes = b.column("doc_id").to_pylist(), b.column("node")
                out = []
                for row, raw, offsets in chunks(b.column("text")):
                    words, counts = word_hashes(raw, offsets, ALNUM)
                    out += [(ids[row + t], ix.ids[i], *rest, nodes[row + t].as_py()) for t, i, *rest in ix.search(words, counts, share, overlap)]
                cols = list(zip(*out)) or [[]] * 7
                types = [pa.int64()] * 2 + [pa.float64()] * 4 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=[x.split()[0] for x in HITS.split(", ")])

        found.append(texts.mapInArrow(search, HITS))
    return reduce(DataFrame.unionByName, found)


def keep_clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Documents in whose text no item was found, with the columns of `docs`, whatever their names.

    Only ids and digests of hits are kept while searching; those few rows are then left
    out: up to `BROADCAST_HITS` are broadcast, so documents are not shuffled. An id need
    not be unique or there at all, so a row goes only with its own text.
    """
    found = hits(docs.select("doc_id", "text"), benchmark, **options).select(F.col("doc_id").alias("hit"), F.col("node").alias("hit_node")).distinct()
    found = materialise(found, "hits")
    rows = docs.select(packed(docs).alias("row"), F.col("doc_id").cast("long").alias("id"), node(F.col("text")).alias("node"))
    same = F.col("id").eqNullSafe(F.col("hit")) & (F.col("node") == F.col("hit_node"))
    few = found.count() <= BROADCAST_HITS
    return rows.join(F.broadcast(found) if few else found, same, "left_anti").select("row.*")
