"""Parcels near a point, overlapping parcels, areas.

A ring is an array of (x, y) structs, longitude and latitude where distances are asked
for, closed or not; a ring of less than three corners is none. Rings do not cross the 180th
meridian (exchange formats cut them there).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import EARTH_METRES, haversine, polygon_bbox, ring_area
from ..sources.tables import materialise

DEGREE_METRES = 111_194.9  # of latitude on the sphere of haversine()
BOX = ["x0", "y0", "x1", "y1"]


def with_box(parcels: DataFrame, ring: str = "ring") -> DataFrame:
    """Parcels with the box of their ring in columns of its own, which scans of a stored table can filter by."""
    box = F.transform(F.array(polygon_bbox(F.col(ring))), lambda b: F.struct(*[F.get(b, F.lit(k)).alias(n) for k, n in enumerate(BOX)]))
    return parcels.select("*", F.inline(box))  # made once for all four


def _reach(lat: float, radius_m: float) -> tuple[float, float]:
    """Degrees of latitude and longitude that a circle spans on either side; 360 where it holds a pole."""
    dlat = radius_m / DEGREE_METRES * 1.001
    cos = max(math.cos(math.radians(min(90.0, abs(lat) + dlat))), 1e-9)
    return dlat, min(360.0, dlat / cos)


def near(parcels: DataFrame, lat: float, lng: float, radius_m: float = 5000.0, fallback: bool = False, ring: str = "ring") -> DataFrame:
    """Parcels of which some point lies within the radius, with distance_m: 0 for those that hold the point.

    Boxes come first: the columns of `with_box` where the table has them, so that the scan
    can use them, else computed. `fallback` measures to the centroid (lat, lng) instead;
    coordinates of 0 count as missing there.
    """
    dlat, dlng = _reach(lat, radius_m)
    if fallback:
        boxed = parcels.filter(F.col("lat").between(lat - dlat, lat + dlat) & (F.col("lat") != 0) & (F.col("lng") != 0))
        if dlng < 180:
            boxed = boxed.filter(F.abs(F.pmod(F.col("lng") - lng + 180, F.lit(360.0)) - 180) <= dlng)
        out = boxed.withColumn("distance_m", haversine(F.lit(lat), F.lit(lng), F.col("lat"), F.col("lng")))
        return out.filter(F.col("distance_m") <= radius_m)
    stored = set(BOX) <= set(parcels.columns)
    rows = parcels if stored else with_box(parcels, ring)
    meets = (F.col("y0") <= lat + dlat) & (F.col("y1") >= lat - dlat)
    if dlng < 180:  # a circle past the 180th meridian comes in on the other side
        turns = [t for t in (-360.0, 0.0, 360.0) if lng + dlng + t >= -180 and lng - dlng + t <= 180]
        meets &= reduce(Column.__or__, [(F.col("x0") <= lng + dlng + t) & (F.col("x1") >= lng - dlng + t) for t in turns])
    out = rows.filter(meets).filter(F.size(ring) >= 3).withColumn("distance_m", ring_distance(F.col(ring), lat, lng)).filter(F.col("distance_m") <= radius_m)
    return out if stored else out.drop(*BOX)


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _dot(a, b) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _cross(a, b) -> tuple[Column, Column, Column]:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def _turned(items: Column) -> Column:
    """The items with the first one last."""
    return F.concat(F.slice(items, 2, F.size(items) - 1), F.slice(items, 1, 1))


def in_ring(ring: Column, lat: float, lng: float) -> Column:
    """Whether a ray from the point crosses the ring an odd number of times."""
    def crossed(p: Column, q: Column) -> Column:
        return F.when(((p["y"] > lat) != (q["y"] > lat)) & (F.lit(lng) < p["x"] + (q["x"] - p["x"]) * (F.lit(lat) - p["y"]) / F.nullif(q["y"] - p["y"], F.lit(0.0))), 1).otherwise(0)

    return F.aggregate(F.zip_with(ring, _turned(ring), crossed), F.lit(0), lambda s, x: s + x) % 2 == 1


def ring_distance(ring: Column, lat: float, lng: float) -> Column:
    """Great-circle metres from a point to the nearest point of a ring's edges; 0 inside.

    Corners are unit vectors, taken from the point's own, so that small distances keep
    their digits: an edge is met at a right angle where its plane is nearest, if that is
    between its corners, else a corner is nearest.
    """
    phi, lam = math.radians(lat), math.radians(lng)
    here = (math.cos(phi) * math.cos(lam), math.cos(phi) * math.sin(lam), math.sin(phi))

    def corner(p: Column) -> Column:
        b, m = F.radians(p["y"].cast("double")), F.radians(p["x"].cast("double"))
        unit = (F.cos(b) * F.cos(m), F.cos(b) * F.sin(m), F.sin(b))
        return F.struct(F.array(*unit).alias("u"), F.array(*[c - F.lit(h) for c, h in zip(unit, here)]).alias("d"))

    def edge(a: Column, b: Column) -> Column:
        def met(n: Column) -> Column:
            along = _dot(_cross(n, a["u"]), a["d"]), _dot(_cross(b["u"], n), b["d"])  # of the way from each end, turned round
            length = F.sqrt(_dot(n, n))
            return F.when((length > 0) & (along[0] <= 0) & (along[1] <= 0), F.asin(F.least(F.lit(1.0), F.abs(_dot(n, a["d"])) / length)))

        side = [b["d"][k] - a["d"][k] for k in range(3)]
        return _let(F.array(*_cross([a["u"][k] for k in range(3)], side)), met)

    def nearest(corners: Column) -> Column:
        ends = F.array_min(F.transform(corners, lambda c: 2 * F.asin(F.least(F.lit(1.0), F.sqrt(_dot(c["d"], c["d"])) / 2))))
        return F.least(ends, F.array_min(F.zip_with(corners, _turned(corners), edge)))  # a null counts for neither

    return F.when(in_ring(ring, lat, lng), 0.0).otherwise(_let(F.transform(ring, corner), nearest) * EARTH_METRES)


# Rings that meet, decided for whole batches of pairs.

BATCH = 1 << 20  # numbers in an array at once


class Rings:
    """Corners of many rings, one after the other, with the place and number of each ring's."""

    def __init__(self, x: np.ndarray, y: np.ndarray, starts: np.ndarray, n: np.ndarray):
        self.x, self.y, self.starts, self.n = x, y, starts, n

    @classmethod
    def of(cls, xs, ys) -> Rings:
        n = np.array([len(x) for x in xs], int)
        flat = lambda parts: np.concatenate([np.asarray(p, float) for p in parts]) if len(n) else np.empty(0)
        return cls(flat(xs), flat(ys), np.cumsum(n) - n, n)

    @classmethod
    def read(cls, x: pa.ListArray, y: pa.ListArray) -> Rings:
        ends = x.offsets.to_numpy().astype(int)
        return cls(x.values.to_numpy(zero_copy_only=False), y.values.to_numpy(zero_copy_only=False), ends[:-1], np.diff(ends))

    def padded(self, which: np.ndarray, width: int) -> np.ndarray:
        """(rings, width, 2): corners, the first one again up to the width."""
        place = np.arange(width)[None, :]
        at = self.starts[which][:, None] + np.where(place < self.n[which][:, None], place, 0)
        return np.stack([self.x[at], self.y[at]], -1)


def _strictly_in(points: np.ndarray, ring: np.ndarray) -> np.ndarray:
    """(n, k): which of n times k points lie within ring n and not on its edges."""
    a, d = ring[:, None, :, :], (np.roll(ring, -1, axis=1) - ring)[:, None, :, :]
    w = points[:, :, None, :] - a
    cross = d[..., 0] * w[..., 1] - d[..., 1] * w[..., 0]
    along, length = (w * d).sum(-1), (d * d).sum(-1)
    scale = 1e-12 * (1 + length)
    on = (length > 0) & (np.abs(cross) <= scale) & (along >= -scale) & (along <= length + scale)
    below = w[..., 1] >= 0
    with np.errstate(divide="ignore", invalid="ignore"):
        hit = (below != (w[..., 1] - d[..., 1] >= 0)) & (w[..., 0] < d[..., 0] * w[..., 1] / d[..., 1])
    return (hit.sum(-1) % 2 == 1) & ~on.any(-1)


def _contacts(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(whether edges cross within both; whether they meet at all; the two places on a's edge where it is cut) of all edges of ring pairs."""
    p, q = a[:, :, None, :], b[:, None, :, :]
    d, e = (np.roll(a, -1, axis=1) - a)[:, :, None, :], (np.roll(b, -1, axis=1) - b)[:, None, :, :]
    w = q - p
    dd, ee = (d * d).sum(-1), (e * e).sum(-1)
    edges = (dd > 0) & (ee > 0)
    den = d[..., 0] * e[..., 1] - d[..., 1] * e[..., 0]
    level = np.abs(den) <= 1e-12 * np.sqrt(dd * ee)
    eps = 1e-12
    with np.errstate(divide="ignore", invalid="ignore"):
        t = (w[..., 0] * e[..., 1] - w[..., 1] * e[..., 0]) / den
        u = (w[..., 0] * d[..., 1] - w[..., 1] * d[..., 0]) / den
        s0 = (w * d).sum(-1) / dd
        s1 = ((w + e) * d).sum(-1) / dd
    line = edges & level & (np.abs(w[..., 0] * d[..., 1] - w[..., 1] * d[..., 0]) <= 1e-12 * (1 + dd + (w * w).sum(-1)))
    apart = edges & ~level
    cross = apart & (t > eps) & (t < 1 - eps) & (u > eps) & (u < 1 - eps)
    touch = apart & (t >= -eps) & (t <= 1 + eps) & (u >= -eps) & (u <= 1 + eps) | line & (np.minimum(s0, s1) <= 1 + eps) & (np.maximum(s0, s1) >= -eps)
    first = np.where(line, s0, np.where(touch, t, 0.0))
    second = np.where(line, s1, 0.0)
    cuts = np.clip(np.nan_to_num(np.stack([first, second], -1)), 0.0, 1.0) * touch[..., None]
    return cross, touch, cuts


def _piece_inside(a: np.ndarray, b: np.ndarray, touch: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Whether an edge of a that meets b has, between two cuts, a piece within b."""
    pair, edge = np.nonzero(touch.any(axis=2))
    out = np.zeros(len(a), bool)
    step = max(1, BATCH // (2 * b.shape[1] * b.shape[1]))
    for k in range(0, len(pair), step):
        i, j = pair[k : k + step], edge[k : k + step]
        t = np.sort(np.concatenate([cuts[i, j].reshape(len(i), -1), np.zeros((len(i), 1)), np.ones((len(i), 1))], axis=1), axis=1)
        middle, long = (t[:, 1:] + t[:, :-1]) / 2, np.diff(t, axis=1) > 1e-12
        start, side = a[i, j], np.roll(a, -1, axis=1)[i, j] - a[i, j]
        inside = _strictly_in(start[:, None, :] + middle[..., None] * side[:, None, :], b[i]) & long
        out[i[inside.any(axis=1)]] = True
    return out


def _core(ring: np.ndarray) -> np.ndarray:
    """(n, 1, 2): a point within each simple ring, half way up to its second lowest corner."""
    x, y = ring[..., 0], ring[..., 1]
    low = y.min(axis=1, keepdims=True)
    level = (low + np.where(y > low, y, np.inf).min(axis=1, keepdims=True)) / 2
    x2, y2 = np.roll(x, -1, axis=1), np.roll(y, -1, axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        at = np.where((y > level) != (y2 > level), x + (x2 - x) * (level - y) / (y2 - y), np.inf)
    at.sort(axis=1)
    return np.nan_to_num(np.stack([(at[:, :1] + at[:, 1:2]) / 2, level], -1), posinf=np.finfo(float).max / 4)


def _meet(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the interiors of padded rings meet: they do if edges cross, if one holds the other, or, where
    edges only touch, if an edge between its touches is within the other ring or the rings are the same."""
    cross, touch, cuts = _contacts(a, b)
    out = cross.any(axis=(1, 2))
    free = ~out & ~touch.any(axis=(1, 2))
    if free.any():
        out[free] = (_strictly_in(a[free][:, :1], b[free]) | _strictly_in(b[free][:, :1], a[free]))[:, 0]
    rest = np.flatnonzero(~out & ~free)
    if len(rest):
        x, y = a[rest], b[rest]
        _, back, over = _contacts(y, x)
        found = _piece_inside(x, y, touch[rest], cuts[rest]) | _piece_inside(y, x, back, over)
        out[rest] = found | _strictly_in(_core(x), y)[:, 0]
    return out


def interiors_meet(a: Rings, b: Rings) -> np.ndarray:
    """Whether pairs of simple rings share inner points; edges or corners that touch do not count.

    Pairs are dealt by the numbers of their corners, rounded up to powers of two, so
    arrays hold little padding, and handled so many at a time that arrays stay bounded.
    """
    width = lambda n: 1 << np.ceil(np.log2(np.maximum(n, 2))).astype(int)
    wa, wb = width(a.n), width(b.n)
    out = np.zeros(len(a.n), bool)
    for m, n in {(int(m), int(n)) for m, n in zip(wa, wb)}:
        which = np.flatnonzero((wa == m) & (wb == n) & (a.n >= 3) & (b.n >= 3))
        step = max(1, BATCH // (m * n))
        for k in range(0, len(which), step):
            part = which[k : k + step]
            out[part] = _meet(a.padded(part, m), b.padded(part, n))
    return out


def rings_that_meet(pairs: DataFrame) -> DataFrame:
    """a, b of pairs (a, b, ax, ay, bx, by) of rings whose interiors meet."""

    def keep(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            sides = [Rings.read(batch.column(f"{s}x"), batch.column(f"{s}y")) for s in "ab"]
            yield batch.select(["a", "b"]).filter(pa.array(interiors_meet(*sides)))

    return pairs.select("a", "b", "ax", "ay", "bx", "by").mapInArrow(keep, T.StructType([pairs.schema["a"], pairs.schema["b"]]))


# Boxes that meet, by a tree of cells.

TILE = 2048  # boxes of either side that one task compares at a time
DEPTH = 24  # of the tree


def _cells(level: Column, low: Column, high: Column, origin: float, width: float) -> Column:
    """Numbers of the level's cells that an interval covers."""
    at = lambda v: F.floor((v - F.lit(origin)) / F.lit(width) * F.pow(F.lit(2.0), level)).cast("long")
    return F.sequence(at(low), at(high))


def cell_rows(boxes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(homes, visits): rows (level, cx, cy, box) of a tree whose cells halve from level to level.

    A box's home is the level whose cells are just as large as it or larger, so it covers
    four at most and large ones stay near the top; it visits the cells of its own and all
    higher levels that are anyone's home.
    """
    bounds = boxes.agg(F.min("x0"), F.min("y0"), F.max("x1"), F.max("y1")).first()
    if bounds[0] is None:
        bounds = (0.0, 0.0, 1.0, 1.0)
    x, y = float(bounds[0]), float(bounds[1])
    width = max(float(bounds[2]) - x, float(bounds[3]) - y) or 1.0
    extent = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    home = F.least(F.lit(DEPTH), F.floor(F.log2(F.lit(width) / F.greatest(extent, F.lit(width / 2.0**DEPTH))))).cast("int")
    placed = boxes.withColumn("home", home)
    levels = sorted(r[0] for r in placed.select("home").distinct().collect())  # DEPTH + 1 at most

    def spread(rows: DataFrame) -> DataFrame:
        wide = rows.select("level", "home", *boxes.columns, F.explode(_cells(F.col("level"), F.col("x0"), F.col("x1"), x, width)).alias("cx"))
        tall = wide.select("*", F.explode(_cells(F.col("level"), F.col("y0"), F.col("y1"), y, width)).alias("cy"))
        corner = lambda v, o: (F.col(v) - F.lit(o)) / F.lit(width) * F.pow(F.lit(2.0), F.col("level"))
        return tall.select("level", "cx", "cy", corner("x0", x).alias("gx"), corner("y0", y).alias("gy"), F.struct("home", *boxes.columns).alias("box"))

    homes = spread(placed.withColumn("level", F.col("home")))
    higher = F.filter(F.array(*[F.lit(v) for v in levels]), lambda v: v <= F.col("home"))
    return homes, spread(placed.withColumn("level", F.explode(higher)))


CELL = ["level", "cx", "cy"]


def tiles(homes: DataFrame, visits: DataFrame, tile: int) -> DataFrame:
    """level, cx, cy, hs, vs: the cells with more than a tile's worth on either side, and the parts of both."""
    counts = homes.groupBy(*CELL).agg(F.count(F.lit(1)).alias("h")).join(visits.groupBy(*CELL).agg(F.count(F.lit(1)).alias("v")), CELL)
    parts = lambda n: F.ceil(F.col(n) / F.lit(tile)).cast("long")
    return counts.filter((F.col("h") > tile) | (F.col("v") > tile)).select(*CELL, parts("h").alias("hs"), parts("v").alias("vs"))


def dealt(rows: DataFrame, full: DataFrame, own: str, other: str, mine: str, theirs: str, name: str, id_: str = "id") -> DataFrame:
    """One side's rows, each in its own part and all parts of the other side."""
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(other, F.lit(1).cast("long")) - 1))
    part = F.pmod(F.xxhash64(f"box.{id_}"), F.coalesce(own, F.lit(1).cast("long")))
    tiled = rows.join(full, CELL, "left").withColumn(mine, part).withColumn(theirs, every)
    return tiled.select(*CELL, "i", "j", F.col("gx").alias(f"{name}x"), F.col("gy").alias(f"{name}y"), F.col("box").alias(name))


def box_pairs(boxes: DataFrame, id_: str = "id", tile: int = TILE) -> DataFrame:
    """a, b: structs of boxes (columns x0, y0, x1, y1 among others) that overlap, each pair once, the lower id first.

    Boxes at home in a cell meet those that visit it. A cell with more than a tile's
    worth on either side is parted into tiles, every part of one side with every part of the
    other, so no task has more however many boxes lie in one place or one box covers.
    A pair counts in the cell that holds the lower corner of what both cover.
    """
    homes, visits = cell_rows(boxes)
    full = tiles(homes, visits, tile)
    met = dealt(homes, full, "hs", "vs", "i", "j", "a", id_).join(dealt(visits, full, "vs", "hs", "j", "i", "b", id_), [*CELL, "i", "j"])
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    overlap = (a("x0") < b("x1")) & (b("x0") < a("x1")) & (a("y0") < b("y1")) & (b("y0") < a("y1"))
    here = (F.col("cx") == F.floor(F.greatest("ax", "bx"))) & (F.col("cy") == F.floor(F.greatest("ay", "by")))
    # Of one level both meet the other at home: one of the two is taken. Of two, the larger box is at home.
    once = (b("home") > a("home")) | (a(id_) < b(id_))
    found = met.filter(overlap & here & (a(id_) != b(id_)) & once)
    first = a(id_) < b(id_)
    return found.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("b"))


def ring_classes(parcels: DataFrame, id_: str = "id", ring: str = "ring") -> DataFrame:
    """id, first: parcels of one and the same ring and the lowest id among them; rings without an area are left out."""
    drawn = parcels.filter((F.size(ring) >= 3) & (ring_area(F.col(ring)) > 0)).select(F.col(id_).alias("id"), F.xxhash64(ring).alias("h"), F.col(ring).alias("ring"))
    least = drawn.groupBy("h", "ring").agg(F.min("id").alias("first")).select(F.col("h").alias("g"), F.col("ring").alias("same"), "first")
    return drawn.join(least, (F.col("h") == F.col("g")) & (F.col("ring") == F.col("same"))).select("id", "first")


def overlap_classes(parcels: DataFrame, id_: str = "id", ring: str = "ring", tile: int = TILE) -> DataFrame:
    """a, b, kind: of kind `pair` rings whose interiors meet, each named by its lowest id; of kind `member` a
    parcel and the first one of the same ring. Parcels that lie on one another to the corner are not expanded into pairs.

    Boxes meet first, without rings. A ring as large as its box is that box; two of those
    meet where their boxes do. Only for other pairs are rings joined and compared, in batches.
    """
    members = ring_classes(parcels, id_, ring)
    only = parcels.filter((F.size(ring) >= 3) & (ring_area(F.col(ring)) > 0)).select(F.col(id_).alias("id"), F.col(ring).alias("ring")).groupBy("ring").agg(F.min("id").alias("id"))
    sized = with_box(only).withColumn("boxed", (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")))
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    sized = materialise(sized.withColumn("boxed", F.col("boxed") & (ring_area(F.col("ring")) >= area * (1 - 1e-12))), "rings")
    pairs = materialise(box_pairs(sized.select("id", *BOX, "boxed"), tile=tile).select("a.id", "b.id", F.col("a.boxed") & F.col("b.boxed")).toDF("a", "b", "boxed"), "pairs")
    part = lambda c: F.transform("ring", lambda p: p[c].cast("double"))
    side = lambda s: sized.select(F.col("id").alias(s), part("x").alias(f"{s}x"), part("y").alias(f"{s}y"))
    others = pairs.filter("not boxed").join(side("a"), "a").join(side("b"), "b")
    met = pairs.filter("boxed").select("a", "b").unionByName(rings_that_meet(others)).withColumn("kind", F.lit("pair"))
    copies = members.filter("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"), F.lit("member").alias("kind"))
    return met.unionByName(copies)


def overlaps(parcels: DataFrame, id_: str = "id", ring: str = "ring", tile: int = TILE) -> DataFrame:
    """a, b (a < b) of all parcels whose interiors meet, copies expanded: as many rows as there are pairs."""
    found, members = overlap_classes(parcels, id_, ring, tile), ring_classes(parcels, id_, ring)
    one, two = members.select(F.col("first").alias("a"), F.col("id").alias("p")), members.select(F.col("first").alias("b"), F.col("id").alias("q"))
    between = found.filter("kind = 'pair'").join(one, "a").join(two, "b").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))
    several = found.filter("kind = 'member'").select(F.col("a").alias("first")).distinct()
    inside = several.join(one.withColumnRenamed("a", "first"), "first").join(two.withColumnRenamed("b", "first"), "first").filter("p < q").select(F.col("p").alias("a"), F.col("q").alias("b"))
    return between.unionByName(inside)


def area_mismatch(parcels: DataFrame, declared: Column, square_metres_per_unit: float, tolerance: float = 0.05) -> DataFrame:
    """Parcels whose ring and declared area differ (an extension: named in documents, not in code)."""
    measured = ring_area(F.col("ring")) * square_metres_per_unit
    return parcels.withColumn("measured", measured).filter(F.abs(F.col("measured") - declared) > tolerance * declared)
