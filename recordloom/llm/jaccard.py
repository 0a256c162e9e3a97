"""N-gram Jaccard join as a blocked sparse matrix product.

Rows of the matrix are documents, columns word n-grams, an entry says that the document
has the n-gram. The product of the matrix with its transpose holds, for two documents, the
size of their intersection. It is never formed: sizes alone bound what a pair must share, and
the columns are cut into blocks so that the bound shows before anything is multiplied.

Columns. Sets of sizes x and y with percent P or more in common differ in at most
(100 - P)(x + y) / (100 + P) n-grams. Sizes are classed so that linked sets are of one class
or of neighbours. A class with at most k differences cuts the columns, by hash, into k + 2
blocks; linked sets then agree wholly in two blocks, or in one if one that is empty is left out.
So each set names each of its blocks by a sum of hashes of the n-grams in it, and only sets
that share such a name go on; a passage that many documents share, without being most of
them, brings none of them together. No frequencies are needed, and no pair is lost.

Rows. Sets that share a name are a bucket. A unit of the product is a block of its sets
against another, of about `UNIT` n-grams and `UNIT_SETS` sets each (or one set). Overlap counts are summed over runs of columns, and after
each run pairs are discarded that cannot reach their bound with what is left of both sets.
First the units of each bucket are one set, the hub, against all: linear in the bucket. Where its
sets are not all in one component after that, those outside the largest component meet a
set drawn from it, in `HUBS` more rounds. Then those still outside meet all sets of the
bucket, block by block: exact for what is left, without a row for a pair; a unit yields a spanning forest of
the components that it links. Buckets with the same sets count once.

Before whole sets are read, pairs are held against a product of one bit: columns fall to
2,048 cells, and a cell whose parity differs holds an n-gram that only one of both sets
has. More such cells than the sizes allow, and the pair is out; rows without a pair left go.

Equal sets are one row of the matrix: copies cost nothing. N-grams are 64-bit hashes. Sets
are told apart by 64 bits, checked by 64 others: should two sets ever meet in the first, all
is done again under another seed.

Defined cases: ASCII letters lose their case, words are runs of anything but ASCII white
space; fewer words than n are one n-gram; a null, empty or blank text has an empty set,
is linked with nothing and is its own component; very long texts are read whole, and the
longest is a unit by itself; a null doc_id is no component's name unless it has no other (then null); repeated
rows keep a row each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, remove_table, tidy_shuffles
from .neardup import _apart, _merged, with_class
from .shingles import U, chunks, mix64, shingle_hashes, word_hashes

SIZE, PERCENT = 3, 90
HUBS = 2
UNIT, UNIT_SETS = 1 << 20, 1024  # n-grams and sets on either side of a unit, about
COLUMNS = 4096  # columns multiplied at once
WORDS = 32  # 64-bit words of a set's parities
SPAN = 3  # a class spans sizes of a ratio of (100 / percent) ** SPAN

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def sets(raw: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct n-grams of each text in order of hash, their number)."""
    grams, n = shingle_hashes(*word_hashes(LOWER[raw], offsets), size)
    doc = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((grams, doc))
    s, d = grams[order], doc[order]
    first = np.r_[True, (s[1:] != s[:-1]) | (d[1:] != d[:-1])] if len(s) else np.empty(0, bool)
    return s[first], np.bincount(d[first], minlength=len(n))


def sums(values: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """Sum of 64-bit values in each group, modulo 2**64; exact for groups of up to 2**31."""
    third = lambda shift: np.bincount(group, ((values >> U(shift)) & U(0x3FFFFF)).astype(np.float64), groups).astype(np.uint64) << U(shift)
    with np.errstate(over="ignore"):
        return third(0) + third(22) + third(44)


def class_of(n: np.ndarray, percent: int) -> np.ndarray:
    return np.floor(np.log(np.maximum(n, 1)) / (SPAN * np.log(100 / percent))).astype(np.int64)


def blocks_of(classes: np.ndarray, percent: int) -> np.ndarray:
    """Column blocks of a class; 0 where only equal sets can be linked."""
    largest = np.ceil((100 / percent) ** (SPAN * (classes + 1))) + 1  # no set of the class is larger
    differ = np.floor((100 - percent) * 2 * largest / (100 + percent)).astype(np.int64)
    return np.where(differ > 0, differ + 2, 0)


def names(grams: np.ndarray, n: np.ndarray, percent: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(names of blocks, set of each) over all sets: in the set's own class, and in the next if a linked set can be there."""
    own = class_of(n, percent)
    out, of = [], []
    with np.errstate(over="ignore"):
        hashed = mix64(grams ^ mix64(np.array([seed + 11], np.uint64))[0])
        for step in (0, 1):
            into = own + step
            m = blocks_of(into, percent)
            if step:
                m = np.where(class_of(np.ceil((n + 1) * 100 / percent), percent) >= into, m, 0)
            doc = np.repeat(np.arange(len(n)), n)
            live = m[doc] > 0
            doc, h = doc[live], hashed[live]
            start = np.cumsum(m) - m
            at = start[doc] + ((h >> U(33)) % m[doc].astype(np.uint64)).astype(np.int64)
            total = int(m.sum())
            held = sums(mix64(h), at, total)
            empty = np.bincount(at, minlength=total) == 0
            whose = np.repeat(np.arange(len(n)), m)
            nth = np.arange(total) - start[whose]
            gone = np.flatnonzero(empty)
            gone = gone[np.r_[True, np.diff(whose[gone]) != 0][: len(gone)]]  # the first empty block of each set
            keep = np.ones(total, bool)
            keep[gone] = False
            name = mix64(held + mix64(nth.astype(np.uint64) * U(0x9E3779B97F4A7C15) + into[whose].astype(np.uint64)))
            out.append(name[keep])
            of.append(whose[keep])
    return np.concatenate(out), np.concatenate(of)


def parities(grams: np.ndarray, n: np.ndarray) -> np.ndarray:
    """(sets, WORDS) 64-bit words: for each of their bits whether the set has an odd number of the n-grams that fall to it."""
    bits = WORDS * 64
    cell = ((grams >> U(17)) % U(bits)).astype(np.int64)
    ends, out = np.r_[0, np.cumsum(n)], []
    for k in range(0, len(n), 1024):
        part = n[k : k + 1024]
        doc = np.repeat(np.arange(len(part)), part)
        times = np.bincount(doc * bits + cell[ends[k] : ends[k + len(part)]], minlength=len(part) * bits)
        out.append(np.packbits((times & 1).astype(np.uint8).reshape(len(part), bits), axis=1).view(np.uint64))
    return np.concatenate(out) if out else np.empty((0, WORDS), np.uint64)


def lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(values.view(np.int64)))


ROWS = "doc_id long, digest long, node long, proof long, n long, names array<long>"


def incidence(docs: DataFrame, size: int, percent: int, seed: int) -> DataFrame:
    """One row for each document: its set's number, proof and size, and the names of its blocks."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for row, raw, offsets in chunks(b.column("text")):
                grams, n = sets(raw, offsets, size)
                doc = np.repeat(np.arange(len(n)), n)
                with np.errstate(over="ignore"):
                    one = sums(mix64(grams + U(2 * seed + 1)), doc, len(n)) + n.astype(np.uint64)
                    two = sums(mix64(grams ^ U(0xA5A5A5A5A5A5A5A5)), doc, len(n))
                found, of = names(grams, n, percent, seed)
                order = np.argsort(of, kind="stable")
                columns = [b.column("doc_id").slice(row, len(n)), b.column("digest").slice(row, len(n)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(n.astype(np.int64)), lists(found[order], np.bincount(of, minlength=len(n)))]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in ROWS.split(", ")])

    return texts_of(docs).mapInArrow(batches, ROWS)


def texts_of(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("digest"), text.alias("text"))


def rows_of(docs: DataFrame, chosen: DataFrame, size: int) -> DataFrame:
    """node, n, grams, parity of the sets chosen (node, id and d of a document that has it)."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for row, raw, offsets in chunks(b.column("text")):
                grams, n = sets(raw, offsets, size)
                seen = parities(grams, n)
                columns = [b.column("node").slice(row, len(n)), pa.array(n.astype(np.int64)), lists(grams, n), lists(seen.reshape(-1), np.full(len(n), WORDS))]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "n", "grams", "parity"])

    one = texts_of(docs).join(chosen, (F.col("digest") == F.col("d")) & F.col("doc_id").eqNullSafe(F.col("id"))).select("node", "text")
    return one.mapInArrow(batches, "node long, n long, grams array<long>, parity array<long>").dropDuplicates(["node"])


def overlaps(a: list[np.ndarray], b: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of the sets a and b share enough (a matrix of booleans); all n-grams of a set are different."""
    na, nb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    need = -(-percent * (na[:, None] + nb[None, :]) // (100 + percent))
    va, vb = np.concatenate(a), np.concatenate(b)
    columns = np.unique(va)
    if not len(columns):
        return np.zeros(need.shape, bool)
    at = np.minimum(np.searchsorted(columns, vb), len(columns) - 1)
    hit = columns[at] == vb
    row_a, row_b = np.repeat(np.arange(len(a)), na), np.repeat(np.arange(len(b)), nb)[hit]
    if len(a) == 1:
        return (np.bincount(row_b, minlength=len(b))[None, :] >= need) & (need > 0)
    col_a, col_b = np.searchsorted(columns, va), at[hit]
    shared = np.zeros(need.shape, np.float32)
    rest_a, rest_b = na.copy(), np.bincount(row_b, minlength=len(b))  # what is left of each set, of the other side's columns
    live_a, live_b = np.arange(len(a)), np.arange(len(b))
    order_a, order_b = np.argsort(col_a, kind="stable"), np.argsort(col_b, kind="stable")
    edges = np.arange(0, len(columns) + COLUMNS, COLUMNS)
    cut_a, cut_b = np.searchsorted(col_a[order_a], edges), np.searchsorted(col_b[order_b], edges)
    for k in range(len(edges) - 1):
        part_a, part_b = order_a[cut_a[k] : cut_a[k + 1]], order_b[cut_b[k] : cut_b[k + 1]]
        x, y = np.zeros((len(a), COLUMNS), np.float32), np.zeros((len(b), COLUMNS), np.float32)
        x[row_a[part_a], col_a[part_a] - edges[k]] = 1
        y[row_b[part_b], col_b[part_b] - edges[k]] = 1
        shared[np.ix_(live_a, live_b)] += x[live_a] @ y[live_b].T
        rest_a = rest_a - np.bincount(row_a[part_a], minlength=len(a))
        rest_b = rest_b - np.bincount(row_b[part_b], minlength=len(b))
        may = shared[np.ix_(live_a, live_b)] + np.minimum(rest_a[live_a][:, None], rest_b[live_b][None, :]) >= need[np.ix_(live_a, live_b)]
        live_a, live_b = live_a[may.any(axis=1)], live_b[may.any(axis=0)]
        if not len(live_a) or not len(live_b):
            break
    return (shared >= need) & (need > 0)


def forest(pairs: np.ndarray) -> np.ndarray:
    """Those of the pairs of numbers (distinct, n by 2) that join what those before them leave apart."""
    above: dict[int, int] = {}

    def root(x: int) -> int:
        while x in above:
            above[x] = above.get(above[x], above[x])
            x = above[x]
        return x

    keep = []
    for k, (x, y) in enumerate(pairs.tolist()):
        x, y = root(x), root(y)
        if x != y:
            above[x] = y
            keep.append(k)
    return pairs[keep]


def by_unit(units: DataFrame, columns: list[str], work, schema: str) -> DataFrame:
    """What `work` makes of the rows of each unit, a list of tuples: arrays to yield, in the schema's order."""
    names = [c.split()[0] for c in schema.split(", ")]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, unit, out, waiting = [], None, [], 0

        def done() -> list[pa.RecordBatch]:
            nonlocal out, waiting
            found = [np.concatenate(c) for c in zip(*out)]
            out, waiting = [], 0
            return [pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=names)] if found and len(found[0]) else []

        for b in it:
            parts = []
            for c in columns:
                column = b.column(c)
                if pa.types.is_list(column.type):
                    values, ends = column.values.to_numpy(), column.offsets.to_numpy()
                    parts.append([values[x:y].copy() for x, y in zip(ends[:-1], ends[1:])])
                else:
                    parts.append(column.to_pylist())
            for u, row in zip(b.column("unit").to_pylist(), zip(*parts)):
                if u != unit:
                    if held:
                        out.append(work(unit, held))
                        waiting += len(out[-1][0])
                        if waiting > 10_000:
                            yield from done()
                    held, unit = [], u
                held.append(row)
        if held:
            out.append(work(unit, held))
        yield from done()

    return units.select("unit", *columns).repartition("unit").sortWithinPartitions("unit").mapInArrow(batches, schema)


def sides(rows: list[tuple]) -> list[list[tuple]]:
    """The rows of either side, whose number comes first."""
    return [[r for r in rows if r[0] == k] for k in (0, 1)]


def product(units: DataFrame, percent: int) -> DataFrame:
    """a, b: links between components, from rows (unit, side, root, grams), a spanning forest for each unit."""

    def links(_, rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        one, two = sides(rows)
        if not one or not two:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        i, j = np.nonzero(overlaps([r[2] for r in one], [r[2] for r in two], percent))
        pairs = np.column_stack([np.array([r[1] for r in one], np.int64)[i], np.array([r[1] for r in two], np.int64)[j]])
        found = forest(np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0))
        return found[:, 0], found[:, 1]

    return by_unit(units, ["side", "root", "grams"], links, "a long, b long")


def may_link(x: str, y: str, percent: int) -> Column:
    """False only where sizes or parities prove that two sets are not linked: every bit that differs is an n-gram of one of them."""
    differ = sum(F.bit_count(F.get(f"{x}.parity", F.lit(k)).bitwiseXOR(F.get(f"{y}.parity", F.lit(k)))) for k in range(WORDS))
    m, n = F.col(f"{x}.n"), F.col(f"{y}.n")
    return (F.least(m, n) * 100 >= F.greatest(m, n) * percent) & (differ * (100 + percent) <= (m + n) * (100 - percent))


def survivors(units: DataFrame, percent: int) -> DataFrame:
    """unit, side, node, root of those rows of units that some row of the other side, of another component, may be linked to."""

    def alive(unit: int, rows: list[tuple]) -> tuple[np.ndarray, ...]:
        both = sides(rows)
        n, root = [[np.array([r[k] for r in s], np.int64) for s in both] for k in (3, 2)]
        live = np.zeros((len(both[0]), len(both[1])), bool)
        if live.size:
            a, b = (np.array([r[4] for r in s]).view(np.uint64) for s in both)
            differ = np.zeros(live.shape, np.int32)
            for k in range(WORDS):
                differ += np.bitwise_count(a[:, k][:, None] ^ b[:, k][None, :])
            x, y = n[0][:, None], n[1][None, :]
            live = (root[0][:, None] != root[1][None, :]) & (100 * np.minimum(x, y) >= percent * np.maximum(x, y)) & ((100 + percent) * differ <= (100 - percent) * (x + y))
        kept = [live.any(axis=1 - k) for k in (0, 1)]
        nodes = [np.array([r[1] for r in s], np.int64)[k] for s, k in zip(both, kept)]
        side = np.repeat(np.arange(2, dtype=np.int32), [len(x) for x in nodes])
        return np.full(len(side), unit, np.int64), side, np.concatenate(nodes), np.concatenate([r[k] for r, k in zip(root, kept)])

    return by_unit(units, ["side", "node", "root", "n", "parity"], alive, "unit long, side int, node long, root long")


def per_unit(which: Column) -> Column:
    """Blocks that the sets of a group make."""
    grams, rows = F.sum(F.when(which, F.col("n")).otherwise(0)), F.count_if(which)
    return F.greatest(F.lit(1), F.ceil(grams / F.lit(UNIT)), F.ceil(rows / F.lit(UNIT_SETS))).cast("long")


def stars(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """Units of one hub and up to a unit's worth of its sets, from pairs (hub, node) that may be linked."""
    seen = rows.select("node", "n", "parity")
    both = pairs.alias("p").join(seen.alias("x"), F.col("p.hub") == F.col("x.node")).join(seen.alias("y"), F.col("p.node") == F.col("y.node"))
    sized = materialise(both.filter(may_link("x", "y", percent)).select("p.hub", "p.node", "y.n"), "pairs")
    counts = sized.groupBy("hub").agg(per_unit(F.lit(True)).alias("units"))
    placed = sized.join(counts, "hub").withColumn("unit", F.xxhash64("hub", F.pmod(F.xxhash64("node"), "units")))
    heads = placed.select("unit", F.lit(0).alias("side"), F.col("hub").alias("node")).distinct()
    both = placed.select("unit", F.lit(1).alias("side"), "node").unionByName(heads)
    return both.join(rows.select("node", "grams"), "node").withColumn("root", F.col("node"))


def squares(apart: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """Units of blocks of what is outside of a bucket's largest component against blocks of the whole bucket.

    Parities, a few words a set, are compared first: whole sets come only where they leave a pair in doubt.
    """
    same = apart.groupBy("bucket").agg(F.bit_xor(F.xxhash64("node")).alias("h"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("g"), F.count(F.lit(1)).alias("k"))
    once = same.groupBy("h", "g", "k").agg(F.min("bucket").alias("bucket")).select("bucket")
    sized = apart.join(once, "bucket").join(rows.select("node", "n", "parity"), "node")
    counts = sized.groupBy("bucket").agg(per_unit(F.col("root") != F.col("top")).alias("across"), per_unit(F.lit(True)).alias("down"))
    placed = sized.join(counts, "bucket").withColumn("h", F.xxhash64("node"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    row = ["node", "root", "n", "parity"]
    a = placed.filter("root <> top").select("bucket", F.pmod("h", "across").alias("i"), every("down").alias("j"), F.lit(0).alias("side"), *row)
    b = placed.select("bucket", every("across").alias("i"), F.pmod("h", "down").alias("j"), F.lit(1).alias("side"), *row)
    units = a.unionByName(b).select(F.xxhash64("bucket", "i", "j").alias("unit"), "side", *row)
    left = materialise(survivors(units, percent), "units")
    return left.join(rows.select("node", "grams"), "node")


def narrow_rows(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The table of `incidence` under a seed by which no two different sets have one number."""
    seed = 0
    while True:
        table = materialise(incidence(docs, size, percent, seed), "sets")
        clash = table.groupBy("node").agg(F.min("proof").alias("x"), F.max("proof").alias("y"), F.min("n").alias("p"), F.max("n").alias("q")).filter("x <> y or p <> q")
        if not clash.head(1):
            return table
        remove_table(table)
        seed += 1


def components(docs: DataFrame, table: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """node, root of the sets of `table` that are linked to a different one."""
    keys = table.select("node", F.explode("names").alias("bucket"))
    several = keys.groupBy("bucket").agg(F.min("node").alias("hub"), F.max("node").alias("other")).filter("hub <> other").drop("other")
    members = materialise(keys.join(several, "bucket").distinct(), "members")

    first = table.groupBy("node").agg(F.min(F.struct("doc_id", "digest")).alias("first"))
    chosen = first.join(members.select("node").distinct(), "node").select("node", F.col("first.doc_id").alias("id"), F.col("first.digest").alias("d"))
    rows = materialise(rows_of(docs, chosen, size), "rows")

    pairs = members.filter("node <> hub").select("hub", "node").distinct()
    roots = _merged(None, product(stars(pairs, rows, percent), percent))
    for k in range(HUBS + 1):
        apart = materialise(_apart(members, roots), "apart")
        settled = not apart.head(1)
        if not settled and k < HUBS:
            inside = apart.filter("root = top").groupBy("bucket").agg(F.max_by("node", F.xxhash64("node", F.lit(k))).alias("hub"))
            met = apart.filter("root <> top").join(inside, "bucket").select("hub", "node").distinct()
            roots = _merged(roots, product(stars(met, rows, percent), percent))
        elif not settled:
            roots = _merged(roots, product(squares(apart, rows, percent), percent))
        remove_table(apart)
        if settled:
            break
    for t in (members, rows):
        remove_table(t)
    return roots


def join(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id: one row for each document."""
    with tidy_shuffles(docs.sparkSession):
        table = narrow_rows(docs, size, percent)
        roots = materialise(components(docs, table, size, percent), "components")
    narrow = with_class(table.select("doc_id", "node", "n"), roots)
    ids = narrow.groupBy("root").agg(F.min("doc_id").alias("least"))
    found = narrow.join(ids, "root")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))
