"""Operator 12 against all pairs."""

import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

from recordloom.llm import jaccard

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text, size=3):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def brute(rows, percent=90, size=3):
    """(doc_id, n, component) of every row, by all pairs of distinct sets."""
    sets = [grams(t, size) for _, t in rows]
    each = sorted(set(sets), key=sorted)
    parent = list(range(len(each)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in combinations(range(len(each)), 2):
        both = len(each[i] & each[j])
        if both and 100 * both >= percent * len(each[i] | each[j]):
            parent[find(i)] = find(j)
    root = {s: find(k) for k, s in enumerate(each)}
    least = defaultdict(lambda: None)
    for (i, _), s in zip(rows, sets):
        if i is not None and (least[root[s]] is None or i < least[root[s]]):
            least[root[s]] = i
    return Counter((i, len(s), least[root[s]] if s else i) for (i, _), s in zip(rows, sets))


def near_copies(seed=5):
    """Families of texts around the threshold, a passage that many share, and short texts."""
    rng = random.Random(seed)
    rows, passage = [], [f"p{i}" for i in range(60)]
    for g in range(50):
        base = [f"g{g}w{rng.randrange(400)}" for _ in range(rng.randint(12, 260))]
        for _ in range(rng.randint(1, 7)):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(50)}"
            if rng.random() < 0.3:
                w = w[: len(w) - rng.randrange(max(1, len(w) // 9))]
            rows.append(w + passage if g % 5 == 0 else w)
    rows += [passage + [f"own{k}"] * rng.randint(0, 3) for k in range(80)]
    rows += [[rng.choice("abc") for _ in range(rng.randint(0, 14))] for _ in range(80)]
    rng.shuffle(rows)
    return [(k, " ".join(w)) for k, w in enumerate(rows)]


def got(df):
    return Counter(map(tuple, df.select("doc_id", "n_shingles", "component_id").collect()))


@pytest.fixture(scope="module")
def copies(spark):
    rows = near_copies()
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(4).cache()


def test_same_components_as_all_pairs(copies):
    rows, docs = copies
    assert got(jaccard.join(docs)) == brute(rows)


def test_blocks_of_few_rows_and_columns_lose_nothing(copies, monkeypatch):
    """Units of a few sets, columns in many runs, and no round of hubs: all is left to the blocked product."""
    rows, docs = copies
    monkeypatch.setattr(jaccard, "HUBS", 0)
    monkeypatch.setattr(jaccard, "UNIT", 300)
    monkeypatch.setattr(jaccard, "COLUMNS", 16)
    assert got(jaccard.join(docs)) == brute(rows)


def test_other_sizes(copies):
    rows, docs = copies
    assert got(jaccard.join(docs, size=2, percent=80)) == brute(rows, 80, 2)


def test_linked_sets_share_a_name():
    """The bound on sizes: whatever two sets at the threshold differ in, one block of columns is the same."""
    rng = np.random.default_rng(4)
    for n in [*range(9, 60), 90, 200, 700, 3000]:
        base = rng.integers(0, 2**63, 2 * n + 4).astype(np.uint64)
        out = (100 * n - 90 * n) // 190
        for more in range(out + 1):  # x has n grams, y lacks `out` of them and has `more` others
            both = n - out
            if 100 * both < 90 * (n + more):
                continue
            x, y = np.sort(base[:n]), np.sort(np.r_[base[out:n], base[n : n + more]])
            name, of = jaccard.names(np.r_[x, y], np.array([len(x), len(y)]), 90, 0)
            assert set(x) == set(y) or set(name[of == 0]) & set(name[of == 1])


def test_overlaps_count_as_sets_do():
    rng = random.Random(2)
    for _ in range(50):
        sides = [[np.array(sorted(rng.sample(range(60), rng.randint(0, 40))), np.uint64) for _ in range(rng.randint(1, 9))] for _ in "ab"]
        want = [[bool(set(x) & set(y)) and 100 * len(set(x) & set(y)) >= 60 * len(set(x) | set(y)) for y in sides[1]] for x in sides[0]]
        assert jaccard.overlaps(*sides, 60).tolist() == want


def test_a_hot_group_near_the_threshold(spark):
    """Near copies that mostly do not link to one another come through the blocks."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for k in range(240):
        w = list(base)
        for at in rng.sample(range(120), rng.randint(0, 3)):
            w[at] = f"x{rng.randrange(2000)}"
        rows.append((k, " ".join(w)))
    assert got(jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_odd_rows(odd_docs, odd_rows, no_docs):
    assert got(jaccard.join(odd_docs)) == brute([r[:2] for r in odd_rows])
    assert jaccard.join(no_docs).count() == 0


def test_the_sample(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert got(jaccard.join(docs)) == brute([tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_sets_that_meet_in_64_bits_are_numbered_again(spark, monkeypatch):
    real, seeds = jaccard.incidence, []

    def once_alike(docs, size, percent, seed):
        from pyspark.sql import functions as F

        seeds.append(seed)
        out = real(docs, size, percent, seed)
        return out.withColumn("node", F.lit(1).cast("long")) if seed == 0 else out

    monkeypatch.setattr(jaccard, "incidence", once_alike)
    rows = [(1, "a b c d"), (2, "e f g h"), (3, "A b C d")]
    assert got(jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)
    assert seeds == [0, 1]
