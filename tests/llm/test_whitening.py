"""Operator 11 against numpy on the driver."""

import math

import numpy as np
import pytest

from recordloom.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, n long, x string, whitened int"


def expected(rows, k):
    """Rows (vec_id, deviation, whitened by component) with the axes found from exact integers."""
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    d = max(len(v) for _, v in kept)
    x = [[math.floor(256 * float(np.float32(c))) for c in v] + [0] * (d - len(v)) for _, v in kept]
    fit = sorted(set(map(tuple, x)))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[n * a - s for a, s in zip(v, sums)] for v in fit], float) / n
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    out = []
    for (i, _), v in zip(kept, x):
        m = [n * a - s for a, s in zip(v, sums)]
        out.append((i, n, sum(c * c for c in m), (np.array(m) / n) @ u / np.sqrt(e)))
    return out, e / np.trace(centred.T @ centred / n)


def check(spark, rows, k=4):
    df = spark.createDataFrame([(i, v, 0, 1, "x", 2) for i, v in rows], SCHEMA).repartition(3)
    got = whitening.whiten(df, k).collect()
    want, share = expected(rows, k)
    key = lambda r: (r[0] is None, r[0], r[2])
    got = sorted(got, key=lambda r: key((r["vec_id"], 0, r["deviation"])))
    want = sorted(want, key=key)
    assert [(r["vec_id"], r["n"], r["deviation"], r["deviation_exact"]) for r in got] == [(i, n, q, str(q)) for i, n, q, _ in want]
    z, y = np.array([r["whitened"] for r in got]), np.array([w for *_, w in want])
    sign = np.sign((z * y).sum(axis=0))
    np.testing.assert_allclose(z, y * sign, atol=1e-7)
    for r in got:
        np.testing.assert_allclose(r["explained"], share, rtol=1e-8)
        assert r["identity_error"] < 1e-9
    return got


def vectors(n=300, d=7):
    rng = np.random.default_rng(11)
    x = rng.normal(0, 1, (n, d)) * np.arange(d, 0, -1) * 0.1 + rng.normal(0, 1, d)
    return [(k, [float(np.float32(c)) for c in v]) for k, v in enumerate(x)]


def test_like_numpy(spark):
    check(spark, vectors())


def test_copies_count_once_and_bad_rows_go(spark):
    rows = vectors(80)
    hot = [(1000 + k, rows[0][1]) for k in range(200)]  # most rows are one vector
    bad = [(1, None), (2, [None] * 7), (3, [float("nan")] * 7), (4, [float("inf")] * 7), (5, [float("-inf"), *rows[0][1][1:]])]
    more = [(None, rows[3][1]), (None, rows[3][1]), (7, rows[5][1])]
    got = check(spark, rows + hot + bad + more)
    assert len(got) == 80 + 200 + 3 and {r["n"] for r in got} == {80}


def test_short_vectors_get_zeros(spark):
    check(spark, vectors() + [(900, [0.5, 0.25]), (901, []), (902, [0.5, 0.25, 0.0])])


def test_fewer_vectors_than_dimensions(spark):
    rows = vectors(3)
    got = whitening.whiten(spark.createDataFrame([(i, v, 0, 1, "x", 2) for i, v in rows], SCHEMA)).collect()
    assert len(got) == 3 and all(r["identity_error"] < 1e-9 for r in got)
    assert all(r["whitened"][2:] == [None, None] and None not in r["whitened"][:2] for r in got)
    one = whitening.whiten(spark.createDataFrame([(i, rows[0][1], 0, 1, "x", 2) for i in range(4)], SCHEMA)).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["identity_error"]) for r in one] == [(1, 0, [None] * 4, None)] * 4


def test_large_entries_stay_exact(spark):
    rows = [(k, [float(2.0**40 * (k % 5 - 2)), float(k), float(2.0**60 * (k % 3))]) for k in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in whitening.whiten(df, 2).collect()}
    x = [[int(math.floor(min(256 * c, whitening.LONG - 1024))) for c in v] for _, v in rows]
    fit = set(map(tuple, x))
    sums = [sum(c) for c in zip(*fit)]
    for (i, _), v in zip(rows, x):
        q = sum((len(fit) * a - s) ** 2 for a, s in zip(v, sums))
        assert got[i]["deviation_exact"] == str(q) and got[i]["deviation"] is None


def test_empty(spark):
    for rows in ([], [(1, None, 0, 1, "x", 2)], [(1, [float("nan")], 0, 1, "x", 2)]):
        assert whitening.whiten(spark.createDataFrame(rows, SCHEMA)).count() == 0


def test_the_sample_and_its_query(spark, sf_dir):
    from recordloom.llm import queries

    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    check(spark, rows)
    got = queries.op11_whiten(spark, sf_dir).collect()
    assert len(got) == 4 * len(rows) and {r["component"] for r in got} == {1, 2, 3, 4}


@pytest.mark.parametrize("k", [1, 9])
def test_number_of_components(spark, k):
    check(spark, vectors(200, 5), min(k, 5))
