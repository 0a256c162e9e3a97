"""Near-duplicate detection with improved consistent weighted sampling.

A text is the weighted set of its five-word shingles: count times inverse document
frequency. Consistent samples of it (0-bit form: the shingle, without its level) are
banded; texts that share a band are candidates, and a link is a candidate pair whose
weighted Jaccard similarity, computed from whole texts, reaches the threshold. With
`plain`, texts whose plain shingle sets reach it are linked as well, so that frequent
shingles, which weigh less, and repeated ones, which weigh more, cannot hide a copy: plain
samples of the distinct shingles are banded into the same buckets. Classes are the
connected components of links.

Weights. The frequency of a shingle is its share of all documents. Inverse frequency has a
ceiling: at or below `FLOOR` all shingles weigh 1; above it the weight falls with the
logarithm, to `LEAST` at the lowest. Only shingles above the floor need a number, and there
are at most (shingles of a mean document) / FLOOR of those, however many documents there
are: a bounded broadcast. Lossy counting names them: a block of documents reports the
shingles of at least FLOOR/4 of its documents, so none above the floor is missed. Those
named are then counted exactly, so weights do not depend on how rows are dealt.

Pairs. Exact copies are one node. In a bucket every node is compared with one hub, which
is linear. Where nodes of a bucket are not all in one class after that, those outside
its largest class meet a hub drawn from that class, in `HUBS` more rounds. What is still
apart is settled exactly, without comparing all that share a bucket: the texts of such
buckets are joined on the rarest of their shingles. Two sets of similarity t or more share
one of the shingles that remain if, from the most frequent on, shingles of less than t of
the set's weight are left out, and of the lesser set less than 2t / (1 + t), so no pair is lost; texts
that merely share a passage, of any number, differ in their rare shingles and do not meet. Where they meet,
parities of their shingles prove most pairs too unlike, those of many edited copies of one text
too, which are all somewhat alike. Pairs within a class are left out.

Defined cases: null and empty texts are copies of one another; texts without words are
linked by equality only, texts of one to four words are one shingle; very long texts are
sampled and compared whole; class_id is the smallest doc_id of the class (null if it has
none); repeated rows keep a row each; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column, materialise, packed, remove_table
from .shingles import U, chunks, mix64, shingle_hashes, word_hashes

SIZE = 5
THRESHOLD = 0.8
BANDS, ROWS = 20, 5
FLOOR, LEAST = 0.01, 0.5
HUBS = 2
PLAIN = True
BLOCK_SHINGLES = 1_000_000
LIGHT, HEAVY = 24, 8  # 64-bit words of the parities
HEAD = 16  # rarest shingles by which a pair's meetings are made one
TILE = 2048  # texts of a rare shingle that one task compares with as many others, about
CELLS = 1 << 13  # rows of the table of random variates, by the low bits of a shingle's hash
ID = U(0xFFFFFFFF)

_variates: dict[int, tuple[np.ndarray, ...]] = {}


def node(text: Column) -> Column:
    """128 bits that stand for a text."""
    return F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 32))


def sortable(x: np.ndarray) -> np.ndarray:
    """Float32 values as integers of the same order, in the upper half of 64 bits."""
    bits = x.astype(np.float32).view(np.uint32)
    return np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31)).astype(np.uint64) << U(32)


def variates(samples: int) -> tuple[np.ndarray, ...]:
    """r, ln c and beta of every (sample, cell), and the sort key that weight 1 gives; fixed by a seed."""
    if samples not in _variates:
        rng = np.random.Generator(np.random.PCG64(20101213))
        shape = (samples, CELLS)
        r = rng.gamma(2.0, 1.0, shape).astype(np.float32)
        ln_c = np.log(rng.gamma(2.0, 1.0, shape)).astype(np.float32)
        beta = rng.random(shape, np.float32)
        _variates.clear()
        _variates[samples] = (r, ln_c, beta, sortable(ln_c + r * beta - r))
    return _variates[samples]


def weighted(shingles: np.ndarray, counts: np.ndarray, heavy: np.ndarray, weight: np.ndarray):
    """Distinct shingles of each text in order of hash: (hash, weight, distinct of each text)."""
    doc = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((shingles, doc))
    s, d = shingles[order], doc[order]
    first = np.r_[True, (s[1:] != s[:-1]) | (d[1:] != d[:-1])] if len(s) else np.empty(0, bool)
    at = np.flatnonzero(first)
    w = np.diff(np.r_[at, len(s)]).astype(np.float64)
    s = s[at]
    if len(heavy) and len(s):
        where = np.minimum(np.searchsorted(heavy, s), len(heavy) - 1)
        w *= np.where(heavy[where] == s, weight[where], 1.0)
    return s, w, np.bincount(d[at], minlength=len(counts))


def band_hashes(shingles: np.ndarray, weights: np.ndarray, counts: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(texts with shingles, bands) hashes of the consistent weighted samples."""
    r, ln_c, beta, unit = variates(bands * rows)
    counts = counts[counts > 0]
    starts = np.cumsum(counts) - counts
    cell = (shingles & U(CELLS - 1)).astype(np.int64)
    ident = (shingles >> U(32)) & ID
    odd = np.flatnonzero(weights != 1.0)
    ln_w = np.log(weights[odd]).astype(np.float32)
    out = np.zeros((len(counts), bands), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(bands * rows):
            key = unit[k][cell]
            if len(odd):
                c = cell[odd]
                rr, b = r[k][c], beta[k][c]
                key[odd] = sortable(ln_c[k][c] - rr * (np.floor(ln_w / rr + b) - b) - rr)
            key |= ident
            got = np.minimum.reduceat(key, starts) & ID
            band = k // rows
            out[:, band] = mix64(out[:, band] * U(0x9E3779B97F4A7C15) + got + U(band + 1))
    return out


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("text", F.lit("")).alias("text"))


def heavy_shingles(docs: DataFrame, size: int = SIZE, floor: float = FLOOR, least: float = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(hashes in order, weights) of all shingles above the floor frequency."""
    slack = floor / 4

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_docs, n = [], 0, 0

        def report():
            keys, times = np.unique(np.concatenate(held), return_counts=True)
            often = times >= max(1, int(np.ceil(slack * n_docs)))
            return pa.RecordBatch.from_arrays([pa.array(keys[often].view(np.int64)), pa.array(times[often])], names=["shingle", "n"])

        for b in it:
            for _, raw, offsets in chunks(b.column("text")):
                s, m = shingle_hashes(*word_hashes(raw, offsets), size)
                doc = np.repeat(np.arange(len(m)), m)
                order = np.lexsort((s, doc))
                s, doc = s[order], doc[order]
                if len(s):
                    held.append(s[np.r_[True, (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])]])
                    n += len(held[-1])
                n_docs += len(m)
                if n >= BLOCK_SHINGLES:
                    yield report()
                    held, n_docs, n = [], 0, 0
        if held:
            yield report()

    total = docs.count()
    counted = _texts(docs).mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    named = counted.filter(F.col("n") >= (floor - slack) * total).filter(F.col("n") > 1).select("shingle").toPandas()  # bounded: see above
    keys = np.sort(named["shingle"].to_numpy(np.int64).view(np.uint64))
    if not len(keys):
        return keys, np.empty(0)
    table = docs.sparkSession.sparkContext.broadcast(keys)

    def recount(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(table.value), np.int64)
        for b in it:
            for _, raw, offsets in chunks(b.column("text")):
                s, m = shingle_hashes(*word_hashes(raw, offsets), size)
                at = np.minimum(np.searchsorted(table.value, s), len(table.value) - 1)
                hit = np.flatnonzero(table.value[at] == s)
                doc = np.repeat(np.arange(len(m)), m)[hit]
                n += np.bincount(np.unique(doc * len(n) + at[hit]) % len(n), minlength=len(n))
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(n)), pa.array(n[n > 0])], names=["nth", "n"])

    rows = _texts(docs).mapInArrow(recount, "nth long, n long").groupBy("nth").agg(F.sum("n").alias("n")).toPandas()
    share = np.zeros(len(keys))
    share[rows["nth"].to_numpy(np.int64)] = rows["n"].to_numpy(float) / max(1, total)
    often = share >= floor
    weight = np.clip(np.log(1 / np.minimum(share[often], 1.0)) / np.log(1 / floor), least, 1.0)
    return keys[often], weight


def signatures(docs: DataFrame, heavy, size: int, bands: int, rows: int, plain: bool) -> DataFrame:
    """node, bands: a row for each document with words, and with `plain` one of plain samples where weights are not all 1."""
    table = docs.sparkSession.sparkContext.broadcast(heavy)

    def sample(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            nodes = b.column("node")
            for row, raw, offsets in chunks(b.column("text")):
                s, w, n = weighted(*shingle_hashes(*word_hashes(raw, offsets), size), *table.value)
                got = band_hashes(s, w, n, bands, rows) if len(s) else np.zeros((0, bands), np.uint64)
                at = np.flatnonzero(n > 0)
                doc = np.repeat(np.arange(len(n)), n)
                uneven = np.bincount(doc[w != 1.0], minlength=len(n)) > 0
                if plain and uneven.any():  # for the others plain samples are the same ones
                    s = s[uneven[doc]]
                    got = np.concatenate([got, band_hashes(s, np.ones(len(s)), n[uneven], bands, rows)])
                    at = np.r_[at, np.flatnonzero(uneven)]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, got.size + 1, bands, dtype=np.int32)), pa.array(got.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([nodes.take(pa.array(at + row)), lists], names=["node", "bands"])

    rows_in = docs.select(node(F.col("text")).alias("node"), F.coalesce("text", F.lit("")).alias("text"))
    return rows_in.mapInArrow(sample, "node binary, bands array<long>")


def parities(shingles: np.ndarray, doc: np.ndarray, docs: int, words: int) -> np.ndarray:
    """(docs, words) 64-bit words: whether a cell has an odd number of the text's shingles. What two texts share cancels out."""
    odd = np.zeros((docs, words * 64), np.uint8)
    np.add.at(odd, (doc, ((shingles >> U(20)) % U(words * 64)).astype(np.int64)), np.uint8(1))
    return np.packbits(odd & 1, axis=1).view(np.uint64)


FEATURES = "node binary, shingles array<long>, weights array<float>, n long, weight double, bits array<long>"


def features(texts: DataFrame, heavy, size: int) -> DataFrame:
    """node; its distinct shingles in order of hash and their weights; their number and sum; parities of the light and the heavy ones."""
    table = texts.sparkSession.sparkContext.broadcast(heavy)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            nodes = b.column("node")
            for row, raw, offsets in chunks(b.column("text")):
                s, w, n = weighted(*shingle_hashes(*word_hashes(raw, offsets), size), *table.value)
                at = pa.array(np.r_[0, np.cumsum(n)].astype(np.int32))
                w = w.astype(np.float32)
                doc = np.repeat(np.arange(len(n)), n)
                light = ~np.isin(s, table.value[0])
                bits = np.hstack([parities(s[light], doc[light], len(n), LIGHT), parities(s[~light], doc[~light], len(n), HEAVY)])
                columns = [
                    nodes.slice(row, len(n)),
                    pa.ListArray.from_arrays(at, pa.array(s.view(np.int64))),
                    pa.ListArray.from_arrays(at, pa.array(w)),
                    pa.array(n.astype(np.int64)),
                    pa.array(np.bincount(doc, w, minlength=len(n)).astype(np.float64)),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * (LIGHT + HEAVY)), pa.array(bits.reshape(-1).view(np.int64))),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in FEATURES.split(", ")])

    return texts.select("node", "text").mapInArrow(batches, FEATURES)


def similarity(x: np.ndarray, y: np.ndarray, wx: np.ndarray, wy: np.ndarray, plain: bool) -> float:
    """Weighted Jaccard similarity of two weighted sets; with `plain` the plain one if that is larger."""
    both, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    low = float(np.minimum(wx[i], wy[j]).sum(dtype=np.float64))
    high = float(wx.sum(dtype=np.float64) + wy.sum(dtype=np.float64)) - low
    weighed = low / high if high else 0.0
    return max(weighed, len(both) / max(1, len(x) + len(y) - len(both))) if plain else weighed


def linked(pairs: DataFrame, feats: DataFrame, threshold: float, plain: bool) -> DataFrame:
    """The pairs (a, b) that are similar enough."""

    def verify(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            lists = {}
            for c in ("sa", "wa", "sb", "wb"):
                col = batch.column(c)
                lists[c] = col.values.to_numpy(), col.offsets.to_numpy()
            part = lambda c, k: lists[c][0][lists[c][1][k] : lists[c][1][k + 1]]
            keep = [k for k in range(batch.num_rows) if similarity(part("sa", k), part("sb", k), part("wa", k), part("wb", k), plain) >= threshold - 1e-6]
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    side = lambda x: feats.select(F.col("node").alias(x), F.col("shingles").alias(f"s{x}"), F.col("weights").alias(f"w{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "wa", "sb", "wb").mapInArrow(verify, "a binary, b binary")


def may_link(x: str, y: str, threshold: float) -> Column:
    """False only where numbers, weights or parities of two rows prove both similarities too low.

    J >= t bounds the weight that differs by (1 - t) / (1 + t) of both weights; each parity
    that differs is a shingle that does, of weight 1 at least, or LEAST if heavy.
    """
    low, most = threshold - 1e-4, (1 - threshold) / (1 + threshold) + 1e-4
    alike = lambda c: F.least(f"{x}.{c}", f"{y}.{c}") >= low * F.greatest(f"{x}.{c}", f"{y}.{c}")
    differ = [F.bit_count(F.col(f"{x}.b{k}").bitwiseXOR(F.col(f"{y}.b{k}"))) for k in range(LIGHT + HEAVY)]
    light, heavy = sum(differ[1:LIGHT], differ[0]), sum(differ[LIGHT + 1 :], differ[LIGHT])
    both = lambda c: most * (F.col(f"{x}.{c}") + F.col(f"{y}.{c}"))
    return (alike("n") & (light + heavy <= both("n"))) | (alike("weight") & (light + LEAST * heavy <= both("weight")))


def rare_pairs(apart: DataFrame, feats: DataFrame, threshold: float) -> DataFrame:
    """a, b: pairs of `apart` (node, root) in different classes that share one of their rarest shingles and may be similar.

    Of each text those shingles are left that begin, in order of falling frequency, what
    weighs `threshold` of it or more, by number or by weight. What two sets share is 2t / (1 + t)
    of the lesser one or more, so of that fewer are left. Frequencies are those among
    the texts given. The rarest shingle that a pair shares is left in both.
    """
    each = feats.join(apart, "node").select("node", "root", "n", "weight", F.explode(F.arrays_zip("shingles", "weights")).alias("s"))
    each = each.select("node", "root", "n", "weight", F.col("s.shingles").alias("shingle"), F.col("s.weights").alias("w"))
    shared = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1")
    ranked = each.join(shared, "shingle", "left").withColumn("texts", F.coalesce("texts", F.lit(1)))
    falling = Window.partitionBy("node").orderBy(F.desc("texts"), F.desc("shingle")).rowsBetween(Window.unboundedPreceding, 0)  # of one text
    weight, number = F.sum("w").over(falling), F.count(F.lit(1)).over(falling)
    low, most = threshold - 1e-4, 2 * threshold / (1 + threshold) - 1e-4
    left = lambda least: {"heavier": weight >= least * F.col("weight"), "more": number >= least * F.col("n")}
    marked = ranked.withColumns({"rare": left(low)["heavier"] | left(low)["more"], **left(most)})
    prefix = materialise(marked.filter("rare and texts > 1").select("shingle", "node", "root", "n", "weight", "texts", "heavier", "more"), "prefix")
    rarest = F.slice(F.sort_array(F.collect_list(F.struct("texts", "shingle")))["shingle"], 1, HEAD)  # from a part of one text
    heads = prefix.groupBy("node").agg(rarest.alias("head"))
    bits = feats.select("node", *[F.get("bits", F.lit(k)).alias(f"b{k}") for k in range(LIGHT + HEAVY)])
    # A shingle of many texts is dealt in tiles: a part of them on either side, each part with each.
    dealt = prefix.withColumn("parts", F.ceil(F.col("texts") / F.lit(TILE)).cast("long")).drop("texts").join(heads, "node").join(bits, "node")
    own, every = F.pmod(F.xxhash64("node"), "parts"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    of = {"x": dealt.filter("heavier or more"), "y": dealt.drop("heavier", "more")}
    sides = [of[name].withColumn(a, own).withColumn(b, every).drop("parts").alias(name) for name, a, b in (("x", "i", "j"), ("y", "j", "i"))]
    meet = (F.col("x.i") == F.col("y.i")) & (F.col("x.j") == F.col("y.j"))
    lesser = lambda c: F.struct(f"x.{c}", "x.node") < F.struct(f"y.{c}", "y.node")
    meet &= (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.root") != F.col("y.root"))
    meet &= (F.col("x.more") & lesser("n") | F.col("x.heavier") & lesser("weight")) & may_link("x", "y", threshold)
    # A pair with common shingles among its rarest meets at the rarest of those only; one without, wherever it can.
    common = F.filter("x.head", lambda s: F.array_contains("y.head", s))
    once = (F.size(common) == 0) | (F.col("x.shingle") == F.get(common, F.lit(0)))
    return sides[0].join(sides[1], meet & once).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: connected components by alternating large and small stars.

    Every step is a minimum per node, combined before its shuffle, and a join back to
    the edges; the table of edges is cut off in the shared folder after each round.
    """
    sums = lambda e: tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())

    def lowest(e: DataFrame) -> DataFrame:
        return e.groupBy("u").agg(F.min("v").alias("m"))

    edges = materialise(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = None
    while (now := sums(edges)) != seen and now[0]:
        seen = now
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = both.join(lowest(both), "u").filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        low = lowest(large)
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        before, edges = edges, materialise(small.filter("u <> v").select(F.col("u").alias("a"), F.col("v").alias("b")).distinct(), "links")
        remove_table(before)
    found = edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    out = materialise(found, "roots")
    remove_table(edges)
    return out


def with_class(nodes: DataFrame, roots: DataFrame, name: str = "node") -> DataFrame:
    renamed = roots.select(F.col("node").alias(name), F.col("root").alias("__root"))
    return nodes.join(renamed, name, "left").withColumn("root", F.coalesce("__root", name)).drop("__root")


def classes(docs: DataFrame, size: int = SIZE, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, plain: bool = PLAIN) -> DataFrame:
    """node, root: the class of every text that is linked to a different one."""
    heavy = heavy_shingles(docs, size)
    sampled = signatures(docs, heavy, size, bands, rows, plain)
    keys = sampled.select("node", F.posexplode("bands").alias("band", "hash")).select("node", F.xxhash64("band", "hash").alias("bucket")).distinct()
    keys = materialise(keys, "bands")
    hubs = keys.groupBy("bucket").agg(F.min("node").alias("hub"), F.max("node").alias("other")).filter("hub <> other").drop("other")
    members = materialise(keys.join(hubs, "bucket"), "members")  # of buckets with two texts or more
    remove_table(keys)

    wanted = members.select("node").distinct()
    first = docs.select("doc_id", node(F.col("text")).alias("node")).groupBy("node").agg(F.min("doc_id").alias("first"))
    chosen = wanted.join(first, "node").select(F.col("node").alias("wanted"), "first")
    full = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), node(F.col("text")).alias("node"))
    texts = full.join(chosen, (F.col("node") == F.col("wanted")) & F.col("doc_id").eqNullSafe(F.col("first"))).select("node", "text")
    feats = materialise(features(texts, heavy, size).dropDuplicates(["node"]), "features")

    stars = members.filter("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    roots = _merged(None, linked(stars, feats, threshold, plain))
    for k in range(HUBS + 1):
        apart = materialise(_apart(members, roots), "apart")
        settled = not apart.head(1)
        if k < HUBS and not settled:
            inside = apart.filter("root = top").groupBy("bucket").agg(F.max_by("node", F.xxhash64("node", F.lit(k))).alias("drawn"))
            met = apart.filter("root <> top").join(inside, "bucket").select(F.least("drawn", "node").alias("a"), F.greatest("drawn", "node").alias("b"))
            roots = _merged(roots, linked(met.distinct(), feats, threshold, plain))
        elif not settled:
            texts_apart = materialise(apart.select("node", "root").distinct(), "apart")
            roots = _merged(roots, linked(rare_pairs(texts_apart, feats, threshold), feats, threshold, plain))
            remove_table(texts_apart)
        remove_table(apart)
        if settled:
            break
    for table in (feats, members):
        remove_table(table)
    return roots


def _apart(members: DataFrame, roots: DataFrame) -> DataFrame:
    """bucket, node, root and top, the bucket's largest class, for buckets of two classes or more."""
    placed = with_class(members.select("bucket", "node"), roots)
    sizes = placed.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.groupBy("bucket").agg(F.max_by("root", F.struct("n", "root")).alias("top"), F.count(F.lit(1)).alias("k")).filter("k > 1").drop("k")
    return placed.join(largest, "bucket")


def _merged(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """The classes after some more links between nodes."""
    links = materialise(links, "links")
    if roots is None:
        out = components(links)
        remove_table(links)
        return out
    joins = with_class(with_class(links, roots, "a").withColumnRenamed("root", "ra"), roots, "b").select(F.col("ra").alias("a"), F.col("root").alias("b"))
    merged = components(joins.distinct())
    top = with_class(roots.withColumnRenamed("root", "r1"), merged, "r1").select("node", "root")
    out = materialise(top.union(merged.join(roots, "node", "left_anti")), "classes")
    for table in (links, roots, merged):
        remove_table(table)
    return out


def group(docs: DataFrame, **options) -> DataFrame:
    """doc_id, class_id, text_id: one row for each document; text_id tells exact copies."""
    roots = classes(docs, **options)
    narrow = with_class(docs.select(F.col("doc_id").cast("long"), node(F.col("text")).alias("node")), roots)
    ids = narrow.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_docs"))
    return narrow.join(ids, "root").select("doc_id", "class_id", "class_docs", F.hex("node").alias("text_id"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The document with the smallest doc_id (null last) of each class, with the columns of `docs`, whatever their names.

    Of rows equal in doc_id and text one stays, the first by the hash of its columns.
    """
    roots = classes(docs, **options)
    hashed = F.xxhash64(*[column(c) for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind])
    rows = docs.select(F.col("doc_id").alias("id"), node(F.col("text")).alias("node"), hashed.alias("nth"), packed(docs).alias("row"))
    narrow = with_class(rows.select("id", "node", "nth"), roots)
    best = narrow.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "node", "nth")).alias("b"))
    best = best.select(F.col("b.node").alias("kept"), F.col("b.id").alias("kept_id"), F.col("b.nth").alias("kept_nth"))
    same = (F.col("node") == F.col("kept")) & F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("nth") == F.col("kept_nth"))
    return rows.join(best, same).dropDuplicates(["node"]).select("row.*")
