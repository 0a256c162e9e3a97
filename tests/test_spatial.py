"""Distances to rings and rings that overlap, against slow code of the test's own."""

import math
import random
from itertools import combinations

import numpy as np
import pytest

from recordloom.operators import spatial

RING = "id long, ring array<struct<x:double,y:double>>"


def rings(ax, ay, bx, by):
    return spatial.Rings.of(ax, ay), spatial.Rings.of(bx, by)


def inside(p, ring):
    hit = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        if (y1 > p[1]) != (y2 > p[1]) and p[0] < x1 + (x2 - x1) * (p[1] - y1) / (y2 - y1):
            hit = not hit
    return hit


def metres(p, q):
    a, b = math.radians(p[1]), math.radians(q[1])
    h = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(q[0] - p[0]) / 2) ** 2
    return 2 * 6371000.0 * math.asin(min(1, math.sqrt(h)))


def point(v):
    b, m = math.radians(v[1]), math.radians(v[0])
    return np.array([math.cos(b) * math.cos(m), math.cos(b) * math.sin(m), math.sin(b)])


def walked(p, ring, steps=4000):
    """The least distance to points along the great circles between corners."""
    best = math.inf
    for a, b in zip(ring, ring[1:] + ring[:1]):
        t = np.linspace(0, 1, steps)[:, None]
        way = point(a) * (1 - t) + point(b) * t
        way /= np.linalg.norm(way, axis=1, keepdims=True)
        best = min(best, 2 * 6371000.0 * math.asin(min(1, np.linalg.norm(way - point(p), axis=1).min() / 2)))
    return best


def test_distance_to_rings(spark):
    rng = random.Random(4)
    for lat, lng, size in ((19.05, 73.03, 0.05), (-64.0, 179.9, 0.3), (0.0, 0.0, 1.0)):
        rings = []
        for _ in range(60):
            cx, cy, n = lng + rng.uniform(-3, 3) * size, lat + rng.uniform(-3, 3) * size, rng.randint(3, 9)
            at = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
            rings.append([(cx + size * rng.uniform(0.2, 1) * math.cos(a), cy + size * rng.uniform(0.2, 1) * math.sin(a)) for a in at])
        rings[0] = [*rings[0], rings[0][0]]  # closed
        df = spark.createDataFrame(list(enumerate(rings)), RING)
        radius = 150_000 * size
        got = {r["id"]: r["distance_m"] for r in spatial.near(df, lat, lng, radius).collect()}
        for k, ring in enumerate(rings):
            want = 0.0 if inside((lng, lat), ring) else walked((lng, lat), ring)
            if abs(want - radius) > 10:
                assert (k in got) == (want <= radius)
            if k in got:
                assert got[k] == pytest.approx(want, rel=1e-4, abs=0.5)


def test_edges_count_where_centroids_do_not(spark):
    wide = [(73.0, 19.0), (73.4, 19.0), (73.4, 19.4), (73.0, 19.4)]  # its centroid is some 30 km away
    around = [(72.9, 18.9), (73.1, 18.9), (73.1, 19.1), (72.9, 19.1)]
    far = [(75.0, 19.0), (75.1, 19.0), (75.1, 19.1)]
    df = spark.createDataFrame([(1, wide), (2, around), (3, far), (4, None), (5, wide[:2])], RING)
    got = {r["id"]: r["distance_m"] for r in spatial.near(df, 18.99, 73.0, 2000).collect()}
    assert set(got) == {1, 2} and got[2] == 0 and got[1] == pytest.approx(metres((73.0, 18.99), (73.0, 19.0)), rel=1e-6)


def test_the_other_side_of_the_meridian(spark):
    east, west = [(179.98, 10.0), (179.99, 10.0), (179.99, 10.1)], [(-179.99, 10.0), (-179.98, 10.0), (-179.98, 10.1)]
    df = spark.createDataFrame([(1, east), (2, west)], RING)
    assert {r["id"] for r in spatial.near(df, 10.0, 179.985, 6000).collect()} == {1, 2}
    assert {r["id"] for r in spatial.near(df, 10.0, -179.985, 6000).collect()} == {1, 2}


def test_the_scan_gets_the_box(spark, tmp_path):
    df = spark.createDataFrame([(k, [(k / 10, 1.0), (k / 10 + 0.01, 1.0), (k / 10, 1.01)]) for k in range(50)], RING)
    spatial.with_box(df).write.parquet(str(tmp_path / "t"))
    found = spatial.near(spark.read.parquet(str(tmp_path / "t")), 1.0, 2.0, 500)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(y0), IsNotNull(y1), IsNotNull(x0), IsNotNull(x1), LessThanOrEqual(y0" in plan
    assert [r["id"] for r in found.collect()] == [20]


def star(rng, span=20, corners=(3, 8)):
    """A simple ring on whole numbers: corners by angle around a point."""
    while True:
        cx, cy, r = rng.randint(0, span), rng.randint(0, span), rng.randint(2, 9)
        p = {(cx + rng.randint(-r, r), cy + rng.randint(-r, r)) for _ in range(rng.randint(*corners))} - {(cx, cy)}
        by = {}
        for x, y in p:
            by.setdefault(round(math.atan2(y - cy, x - cx), 9), (x, y))
        ring = [by[a] for a in sorted(by)]
        gaps = np.diff([*sorted(by), min(by) + 2 * math.pi]) if by else [9]
        if len(ring) >= 3 and max(gaps) < math.pi - 1e-6:
            return ring


def halved(ring):
    """Triangles around the middle corner of a star ring, which is seen from all corners."""
    return [(ring[k], ring[(k + 1) % len(ring)]) for k in range(len(ring))]


def triangles_meet(s, t):
    """Whether the interiors of two triangles meet, by separating axes; whole numbers."""
    for one, other in ((s, t), (t, s)):
        for (x1, y1), (x2, y2) in zip(one, one[1:] + one[:1]):
            n = (y2 - y1, x1 - x2)
            a, b = [n[0] * x + n[1] * y for x, y in one], [n[0] * x + n[1] * y for x, y in other]
            if max(a) <= min(b) or max(b) <= min(a):
                return False
    return True


def test_rings_against_triangles():
    """Stars are unions of triangles; their interiors meet where those of two triangles do (or along the sides within)."""
    rng = random.Random(9)
    cases = []
    for _ in range(3000):
        made = []
        for _ in "ab":
            while True:
                cx, cy, r = rng.randint(0, 12), rng.randint(0, 12), rng.randint(1, 6)
                by = {}
                for _ in range(rng.randint(3, 8)):
                    x, y = cx + rng.randint(-r, r), cy + rng.randint(-r, r)
                    if (x, y) != (cx, cy):
                        by.setdefault(round(math.atan2(y - cy, x - cx), 9), (x, y))
                turn = sorted(by)
                if len(turn) >= 3 and max(np.diff([*turn, turn[0] + 2 * math.pi])) < math.pi - 1e-6:
                    ring = [by[a] for a in turn]
                    made.append((ring, [[(cx, cy), ring[k], ring[(k + 1) % len(ring)]] for k in range(len(ring))]))
                    break
        cases.append((made[0][0], made[1][0], any(triangles_meet(s, t) for s in made[0][1] for t in made[1][1])))
    sides = [[np.array([p[c] for p in case[s]], float) for case in cases] for s in (0, 1) for c in (0, 1)]
    assert spatial.interiors_meet(*rings(*sides)).tolist() == [c[2] for c in cases]
    turned = [c[::-1] for c in sides]  # corners the other way round, in another order
    assert spatial.interiors_meet(*rings(*turned)).tolist() == [c[2] for c in cases][::-1]
    assert 500 < sum(c[2] for c in cases) < 2500


def test_many_corners_and_small_batches(monkeypatch):
    circle = lambda n, r, x: (x + r * np.cos(np.linspace(0, 2 * np.pi, n, endpoint=False)), r * np.sin(np.linspace(0, 2 * np.pi, n, endpoint=False)))
    cases = [(circle(700, 5, 0), circle(500, 1, 0), True), (circle(700, 5, 0), circle(500, 1, 9), False), (circle(700, 5, 0), circle(3, 2, 6), True), (circle(64, 5, 0), circle(64, 5, 0), True)]
    for batch in (1 << 20, 64):
        monkeypatch.setattr(spatial, "BATCH", batch)
        got = spatial.interiors_meet(*rings([a[0] for a, _, _ in cases], [a[1] for a, _, _ in cases], [b[0] for _, b, _ in cases], [b[1] for _, b, _ in cases]))
        assert got.tolist() == [c[2] for c in cases]


def boxes(spark, rows):
    return spark.createDataFrame(rows, "id long, x0 double, y0 double, x1 double, y1 double")


def test_boxes_of_all_sizes_in_hot_cells(spark):
    """One box over the whole map, a third of all in one place: every pair once, whatever the tile."""
    rng = random.Random(1)
    rows = [(0, -10.0, -10.0, 2000.0, 2000.0)]
    for k in range(1, 500):
        x, y = (rng.uniform(0, 1000), rng.uniform(0, 1000)) if k % 3 else (500 + rng.random(), 500 + rng.random())
        rows.append((k, x, y, x + rng.choice([0.5, 3, 40, 300]), y + rng.choice([0.5, 3, 40, 300])))
    rows += [(1000, 5.0, 5.0, 5.0, 9.0), (1001, 0.0, 0.0, 10.0, 10.0), (1002, 10.0, 0.0, 20.0, 10.0)]
    want = sorted((min(a[0], b[0]), max(a[0], b[0])) for a, b in combinations(rows, 2) if a[1] < b[3] and b[1] < a[3] and a[2] < b[4] and b[2] < a[4])
    for tile in (7, 2048):
        got = spatial.box_pairs(boxes(spark, rows), tile=tile).select("a.id", "b.id").collect()
        assert sorted(map(tuple, got)) == want
    assert spatial.box_pairs(boxes(spark, [])).count() == 0


def test_no_task_has_more_than_its_share(spark):
    """Rows of a cell's tiles: with one box over all and a third of all boxes in one cell no tile has twice its part."""
    from pyspark.sql import functions as F

    n, tile = 6000, 500
    k = F.col("id")
    dense = k % 3 == 0
    x, y = F.when(dense, 500.0 + k / n / 10).otherwise(F.pmod(k * 7919, F.lit(1000)).cast("double")), F.when(dense, 500.0).otherwise(F.pmod(k * 104729, F.lit(1000)).cast("double"))
    df = spark.range(1, n).select("id", x.alias("x0"), y.alias("y0"), (x + 0.001).alias("x1"), (y + 0.001).alias("y1"))
    df = df.unionByName(boxes(spark, [(0, 0.0, 0.0, 1024.0, 1024.0)]))
    homes, visits = spatial.cell_rows(df)
    assert visits.groupBy("level", "cx", "cy").count().agg(F.max("count")).first()[0] > 10 * tile  # without tiles
    sides = spatial.box_pairs(df, tile=tile)._jdf.queryExecution().optimizedPlan().toString()
    assert "vs#" in sides and "hs#" in sides
    full = spatial.tiles(homes, visits, tile)
    counted = [spatial.dealt(rows, full, *names).groupBy("level", "cx", "cy", "i", "j").count().agg(F.max("count")).first()[0] for rows, names in ((homes, ("hs", "vs", "i", "j", "a")), (visits, ("vs", "hs", "j", "i", "b")))]
    assert max(counted) < 1.5 * tile


def test_equal_rings_are_one_class(spark):
    rng = random.Random(6)
    shapes = [star(rng) for _ in range(25)]
    rows = [(k, [(float(x), float(y)) for x, y in shapes[min(k % 40, 24)]]) for k in range(120)]
    df = spark.createDataFrame(rows + [(500, None), (501, [(0.0, 0.0), (1.0, 1.0)])], RING)
    found = [tuple(r) for r in spatial.overlap_classes(df).select("a", "b", "kind").collect()]
    first = {}
    for k, ring in rows:
        first.setdefault(tuple(ring), k)
    assert sorted((a, b) for a, b, kind in found if kind == "member") == sorted((first[tuple(r)], k) for k, r in rows if first[tuple(r)] != k)
    named = sorted((a, b) for a, b, kind in found if kind == "pair")
    tri = {k: np.array(r) for k, r in rows}
    reps = sorted(set(first.values()))
    meets = lambda a, b: bool(spatial.interiors_meet(*rings([tri[a][:, 0]], [tri[a][:, 1]], [tri[b][:, 0]], [tri[b][:, 1]]))[0])
    assert named == [(a, b) for a, b in combinations(reps, 2) if meets(a, b)]
    every = sorted(map(tuple, spatial.overlaps(df).collect()))
    assert every == [(a, b) for (a, _), (b, _) in combinations(rows, 2) if meets(a, b)]
