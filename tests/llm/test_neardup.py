"""Operator 7 against all pairs."""

import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from recordloom.llm import neardup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(text or "")
    return [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []


def brute(rows, weight_of):
    """Components of links between distinct texts by weighted or plain Jaccard similarity."""
    texts = sorted({t or "" for _, t in rows})
    bags = [Counter(shingles(t)) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in combinations(range(len(texts)), 2):
        a, b = bags[i], bags[j]
        if not a or not b:
            continue
        both = set(a) & set(b)
        low = sum(min(a[s], b[s]) * weight_of(s) for s in both)
        high = sum(n * weight_of(s) for x in (a, b) for s, n in x.items()) - low
        if low >= 0.8 * high - 1e-9 or len(both) >= 0.8 * len(set(a) | set(b)) - 1e-9:
            parent[find(i)] = find(j)
    root = {t: find(k) for k, t in enumerate(texts)}
    ids = defaultdict(list)
    for i, t in rows:
        ids[root[t or ""]].append(i)
    lowest = {r: min((i for i in x if i is not None), default=None) for r, x in ids.items()}
    return Counter((i, lowest[root[t or ""]]) for i, t in rows)


def weights(rows):
    df = Counter(s for _, t in rows for s in set(shingles(t)))
    n = len(rows)
    return lambda s: 1.0 if df[s] < 0.01 * n or df[s] < 2 else float(np.clip(np.log(n / df[s]) / np.log(100), 0.5, 1))


def copies():
    rng = random.Random(5)
    rows = []
    passage = [f"p{i}" for i in range(60)]
    for g in range(60):
        base = [f"g{g}w{i}" for i in range(rng.randint(30, 200))]
        for _ in range(rng.randint(1, 6)):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = f"e{rng.random()}"
            if rng.random() < 0.3:
                w = passage + w
            rows.append((len(rows), " ".join(w)))
    chain = [f"c{i}" for i in range(120)]
    for k in range(40):  # each like the next, ends unlike
        chain[k * 3] = f"d{k}"
        rows.append((len(rows), "  ".join(chain)))
    return rows


def result(df):
    return Counter((r["doc_id"], r["class_id"]) for r in neardup.group(df).collect())


def test_classes_are_those_of_all_pairs(spark):
    rows = copies()
    assert result(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == brute(rows, weights(rows))


def test_rare_shingles_in_tiles(spark, monkeypatch):
    """Without rounds of hubs all that is apart meets on rare shingles, here in tiles of two texts."""
    monkeypatch.setattr(neardup, "HUBS", 0)
    monkeypatch.setattr(neardup, "TILE", 2)
    rng = random.Random(3)
    passage = [f"p{i}" for i in range(40)]
    rows = copies()[:120] + [(1000 + k, " ".join(passage[: rng.randint(20, 40)] + [f"own{k}"] * rng.randint(0, 3))) for k in range(40)]
    assert result(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == brute(rows, weights(rows))


def test_edited_copies_of_one_text_are_told_apart_where_they_meet(spark):
    """All of them are alike by 0.7 or so: few pairs may be left to compare, and none of those that are links is lost."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(395)]
    rows = []
    for k in range(150):
        w = list(base) + [f"end{k}"] * rng.randint(0, 30)
        for _ in range(rng.randint(4, 9)):
            w[rng.randrange(395)] = f"e{rng.randrange(2000)}"
        rows.append((k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    heavy = np.empty(0, np.uint64), np.empty(0)
    texts = df.select(neardup.node(F.col("text")).alias("node"), "text")
    feats = neardup.features(texts, heavy, 5).cache()
    pairs = neardup.rare_pairs(feats.select("node", F.col("node").alias("root")), feats, 0.8)
    found = {(bytes(r["a"]), bytes(r["b"])) for r in pairs.collect()}
    node = {r["text"]: bytes(r["node"]) for r in texts.collect()}
    bags = [(node[t], set(shingles(t)), Counter(shingles(t))) for _, t in rows]
    links = set()
    for (a, x, m), (b, y, n) in combinations(bags, 2):
        if len(x & y) >= 0.8 * len(x | y) or (m & n).total() >= 0.8 * (m | n).total():
            links.add((min(a, b), max(a, b)))
    assert links and links <= found and len(found) < 0.2 * 150 * 149 / 2


def test_recall_against_all_pairs(spark):
    """Every tenth document against all: whatever is alike by the stated rule is of one class."""
    df = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("doc_id < 4000")
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    bags, weight_of, holders = [Counter(shingles(t)) for _, t in rows], weights(rows), defaultdict(list)
    for k, bag in enumerate(bags):
        for s in bag:
            holders[s].append(k)
    total = [sum(n * weight_of(s) for s, n in b.items()) for b in bags]
    links = set()
    for i, (doc, _) in enumerate(rows):
        if doc % 10 == 0:
            shared, low = Counter(), Counter()
            for s, n in bags[i].items():
                for j in holders[s]:
                    shared[j] += 1
                    low[j] += min(n, bags[j][s]) * weight_of(s)
            links |= {(doc, rows[j][0]) for j, n in shared.items() if j != i and (low[j] >= 0.8 * (total[i] + total[j] - low[j]) or n >= 0.8 * (len(bags[i]) + len(bags[j]) - n))}
    found = {r["doc_id"]: r["class_id"] for r in neardup.group(df).collect()}
    lost = [(a, b) for a, b in links if found[a] != found[b]]
    assert len(links) > 50 and len(lost) <= 0.001 * len(links)


def test_real_documents(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    assert result(df) == brute(rows, weights(rows))
    kept = neardup.keep_one(df)
    assert kept.columns == df.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter({c: 1 for _, c in brute(rows, weights(rows))})


def test_odd_documents(spark, odd_docs, odd_rows, no_docs):
    rows = [(r[0], r[1]) for r in odd_rows]
    assert result(odd_docs) == brute(rows, weights(rows))
    kept = neardup.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    classes = {c for _, c in brute(rows, weights(rows))}
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(classes)
    assert neardup.group(no_docs).count() == 0 and neardup.keep_one(no_docs).count() == 0


def test_samples_collide_as_often_as_sets_are_alike():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 63, 4000).astype(np.uint64)
    for shared in (3600, 2000):
        b = np.r_[a[:shared], rng.integers(0, 1 << 63, 4000 - shared).astype(np.uint64)]
        want = shared / (8000 - shared)
        none = np.empty(0, np.uint64), np.empty(0)
        s, w, n = neardup.weighted(np.r_[a, b], np.array([4000, 4000]), *none)
        got = neardup.band_hashes(s, w, n, 100, 1)
        assert abs((got[0] == got[1]).mean() - want) < 0.15


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000, 1000 + i) for i in range(1, 200)] + [(2000 + i, 2001 + i) for i in range(50)]
    df = spark.createDataFrame(edges, "a long, b long")
    root = {r["node"]: r["root"] for r in neardup.components(df).collect()}
    parent = {x: x for e in edges for x in e}
    for _ in range(60):
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    assert root == {x: p for x, p in parent.items() if any(x in e and e[0] != e[1] for e in edges)}
