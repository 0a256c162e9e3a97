"""Operator 13 against runs by their definition."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from recordloom.llm import runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(w, least):
    """Every maximal stretch under its smallest period, by comparing words q apart for every q."""
    period = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i - s >= q and i - s + q >= least:
                period.setdefault((s, i - s + q), q)
            i += 1
    return sorted((s, n, q) for (s, n), q in period.items())


def planted(doc_id, w):
    if doc_id is None or not w:
        return w
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def expected(doc_id, text, least, plant):
    w = WORD.findall(text or "")
    w = planted(doc_id, w) if plant else w
    found = brute(w, least)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    digest = sha("".join(f"{s},{n},{q}\n" for s, n, q in sorted(found, key=lambda r: (r[0], r[2]))))
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(w), len(found), *top, digest, sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=60), st.integers(1, 14), st.integers(2, 13))
def test_runs_of_small_alphabets(w, repeats, least):
    for s in (w, w[: max(1, len(w) // 4)] * repeats + w):
        assert runs.runs(s, least) == brute(s, least)


def test_long_periodic_strings_take_linear_time():
    fib = [[0], [0, 1]]
    while len(fib[-1]) < 30_000:
        fib.append(fib[-1] + fib[-2])
    compared = 0

    class Counted(int):
        def __eq__(self, other):
            nonlocal compared
            compared += 1
            return int(self) == int(other)

        __hash__ = int.__hash__

    for w in ([1] * 20_000, [0, 1] * 10_000, fib[-1], list(range(300)) * 60, [bin(i).count("1") & 1 for i in range(20_000)]):
        compared = 0
        runs.next_smaller([*map(Counted, w), Counted(-1)])
        assert compared < 4 * len(w)


def test_stretches_keep_every_run():
    rng = random.Random(3)
    import numpy as np

    for _ in range(300):
        docs = [[rng.randrange(40) for _ in range(rng.randrange(1, 80))] for _ in range(4)]
        for d in docs:
            if rng.random() < 0.6:
                k = rng.randrange(len(d))
                d[k:k] = d[k : k + 4] * 5
        codes, of = np.concatenate(docs), np.repeat(range(4), list(map(len, docs)))
        got = Counter()
        for s, e in runs.stretches(codes, of, 12):
            got.update((int(of[s]), s + a, n, q) for a, n, q in runs.runs(codes[s:e].tolist(), 12))
        starts = np.r_[0, np.cumsum(list(map(len, docs)))]
        assert got == Counter((k, int(starts[k]) + s, n, q) for k, d in enumerate(docs) for s, n, q in brute(d, 12))


@pytest.mark.parametrize("plant", [False, True])
def test_scan_of_odd_rows(odd_docs, odd_rows, plant):
    got = Counter(map(tuple, runs.scan(odd_docs, planted=plant).collect()))
    assert got == Counter(expected(r[0], r[1], 12, plant) for r in odd_rows)


def test_scan_of_the_sample(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    assert Counter(map(tuple, runs.scan(docs, planted=True).collect())) == Counter(expected(i, t, 12, True) for i, t in rows)


def test_collapse_and_empty(spark, no_docs):
    rows = [(1, "so " + "tick tock " * 9 + "end"), (2, None), (3, "a\vb\fc")]
    got = {r["doc_id"]: r for r in runs.collapse(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["text"] == "so tick tock end" and [tuple(x) for x in got[1]["runs"]] == [(1, 18, 2)]
    assert got[2]["text"] == "" and got[3]["text"] == "a b c"
    assert runs.scan(no_docs).count() == 0 and runs.collapse(no_docs).count() == 0
