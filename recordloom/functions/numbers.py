"""Numbers from text, scores and geometry of boxes and points, Column to Column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocabulary as V
from .text import first_of, normalize_digits, strip

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)$"
EARTH_METRES = 6_371_000.0


def guarded(c: Column) -> Column:
    """A double where the text is a plain decimal number, else null."""
    return F.when(c.rlike(NUMBER), c.try_cast("double"))


def lenient_number(c: Column) -> Column:
    """All but digits, points and minus dropped, then read; 'Rs. 15' reads .15 like the original."""
    return guarded(F.regexp_replace(normalize_digits(c, compat=False), r"[^0-9.\-]", ""))


def currency_number(c: Column) -> Column:
    """The rupee sign, commas and white space dropped, then read whole: units give null."""
    return guarded(F.regexp_replace(normalize_digits(c, compat=False), r"(?U)[₹,\s]", ""))


def first_number(c: Column) -> Column:
    """The first unsigned number in the text."""
    found = F.regexp_extract(F.coalesce(c, F.lit("")), r"([0-9]+(?:\.[0-9]+)?)", 1)
    return F.when(found != "", found.cast("double"))


def square_metres(value: Column, unit: Column) -> Column:
    """Value in square metres by its unit; null for an unknown one."""
    factors = F.create_map(*[F.lit(x) for pair in V.SQUARE_METRES.items() for x in pair])
    return value * factors[F.lower(strip(unit))]


def confidence_category(score: Column) -> Column:
    return first_of([(score >= floor, F.lit(name)) for name, floor in V.CONFIDENCE_FLOORS], F.lit("UNCERTAIN"))


def badge(score: Column) -> Column:
    return F.when(score >= 0.80, "HIGH").when(score >= 0.60, "MEDIUM").otherwise("LOW")


def field_score(confidence: Column, adjustment: Column | None = None) -> Column:
    """Null or negative counts as 0; the learned adjustment is added; held to 0..1."""
    base = F.when(confidence >= 0, confidence).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), base + (F.lit(0.0) if adjustment is None else F.coalesce(adjustment, F.lit(0.0)))))


def normalize_bbox(box: Column, width: Column, height: Column) -> Column:
    """Pixel box to the 0..1000 grid, clamped, corners in order; null for a bad box or page."""
    side = lambda i, size: F.greatest(F.lit(0), F.least(F.lit(1000), F.bround(F.get(box, F.lit(i)) / size * 1000).cast("int")))
    x0, y0, x1, y1 = side(0, width), side(1, height), side(2, width), side(3, height)
    out = F.array(F.least(x0, x1), F.least(y0, y1), F.greatest(x0, x1), F.greatest(y0, y1))
    return F.when((F.size(box) == 4) & (width > 0) & (height > 0), out)


def denormalize_bbox(box: Column, width: Column, height: Column) -> Column:
    side = lambda i, size: F.get(box, F.lit(i)) * size / 1000.0
    return F.when((F.size(box) == 4) & (width > 0) & (height > 0), F.array(side(0, width), side(1, height), side(2, width), side(3, height)))


def polygon_bbox(points: Column) -> Column:
    """Array of (x, y) structs to [min x, min y, max x, max y]."""
    box = lambda r: F.array(F.array_min(r["x"]), F.array_min(r["y"]), F.array_max(r["x"]), F.array_max(r["y"]))
    return F.transform(F.array(points), box)[0]


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Metres on a sphere of 6,371 km."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return 2 * EARTH_METRES * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def ring_area(ring: Column) -> Column:
    """Shoelace area of an array of (x, y) structs."""
    def shoelace(r: Column) -> Column:
        after = F.concat(F.slice(r, 2, F.size(r) - 1), F.slice(r, 1, 1))
        return F.when(F.size(r) >= 3, F.abs(F.aggregate(F.zip_with(r, after, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]), F.lit(0.0), lambda s, c: s + c)) / 2)

    return F.transform(F.array(ring), shoelace)[0]  # within it the ring is there once, however it is made


def anomaly_score(raw: Column) -> Column:
    """An isolation forest's decision value to 0..1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 - 1.25 * raw))


def anomaly_level(score: Column) -> Column:
    return F.when(score < 0.4, "LOW").when(score < 0.7, "MEDIUM").otherwise("HIGH")


def total(columns: list[Column]) -> Column:
    return reduce(Column.__add__, columns)
