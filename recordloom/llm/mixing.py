"""Mixing sources to target weights along a training curriculum.

Every source has a weight and a schedule, a piecewise linear multiplier of that
weight over training time 0..1. The integral of weight times schedule is the
source's claim on the budget; claims beyond `max_repeat` passes over a source are
reshared. A source's cumulative token demand is its target times the normalised
integral of its schedule, so the training position of a document is found by
inverting that integral at the document's place in the source.

Defined cases: a null text has size 0; very long texts count whole; null sources form one
source, ordered last; rows equal in doc_id and text are interchangeable and each is mixed
on its own; an empty table gives an empty result; other columns are ignored, or with
`carry` come along in one value, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bucket_count, bucket_of, let, packed, row_key, text_or_empty, word_count

#: Weights by rank of the source in code point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: Knots (time, multiplier) for the sources of each weight: late, level, early.
SCHEDULES = (
    ((0.0, 0.5), (1.0, 1.5)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)),
)


def segments(knots: Sequence[tuple[float, float]]) -> list[tuple[float, float, float, float, float, float]]:
    """(start, length, multiplier at start, at end, area before, area) of each piece."""
    out, before = [], 0.0
    for (t0, m0), (t1, m1) in zip(knots, knots[1:]):
        area = (t1 - t0) * (m0 + m1) / 2
        out.append((t0, t1 - t0, m0, m1, before, area))
        before += area
    if before <= 0 or any(m < 0 for _, m in knots):
        raise ValueError("a schedule needs multipliers >= 0 and a positive integral")
    return out


def integral(knots: Sequence[tuple[float, float]]) -> float:
    return sum(s[5] for s in segments(knots))


def invert(share: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """The time by which `share` of the schedule's integral has passed."""
    parts = F.array(*[
        F.struct(*[F.lit(float(x)).alias(n) for n, x in zip(("t", "dt", "m0", "m1", "before", "area"), s)])
        for s in segments(knots)
    ])
    total = integral(knots)

    def within(s: Column, v: Column) -> Column:
        slope = (s["m1"] - s["m0"]) / s["dt"]
        root = F.sqrt(F.greatest(s["m0"] * s["m0"] + 2 * slope * v, F.lit(0.0)))
        return s["t"] + F.least(F.coalesce(F.try_divide(2 * v, s["m0"] + root), F.lit(0.0)), s["dt"])

    return let(
        F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * total,
        lambda area: let(
            F.coalesce(
                F.get(F.filter(parts, lambda s: (area < s["before"] + s["area"]) & (s["area"] > 0)), F.lit(0)),
                F.try_element_at(F.filter(parts, lambda s: s["area"] > 0), F.lit(-1)),
            ),
            lambda s: within(s, area - s["before"]),
        ),
    )


def targets(sizes: DataFrame, weights, schedules, share: float, max_repeat: float) -> DataFrame:
    """Water-filling over the table of sources: (__src, __null, source_size) -> target, kind.

    A source is full if max_repeat * size is at most weight * level; the level is
    what remains after the full ones, by weight. One row for each source.
    """
    rank = F.row_number().over(Window.orderBy("__null", "__src")) - 1
    kinds = len(weights)
    claims = F.array(*[F.lit(w * integral(schedules[i % len(schedules)])) for i, w in enumerate(weights)])
    ranked = sizes.withColumn("__kind", (rank % kinds).cast("int"))
    claimed = ranked.select(
        "*", F.element_at(claims, F.col("__kind") + 1).alias("__w"), (F.col("source_size") * max_repeat).alias("__cap")
    )
    full_first = Window.orderBy(F.col("__cap") / F.col("__w"), "__null", "__src")
    everything = Window.partitionBy()
    level = claimed.select(
        "*",
        (F.sum("source_size").over(everything) * share).alias("__all"),
        F.coalesce(F.sum("__cap").over(full_first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("__filled"),
        F.sum("__w").over(full_first.rowsBetween(0, Window.unboundedFollowing)).alias("__rest"),
    ).withColumn("__level", (F.col("__all") - F.col("__filled")) / F.col("__rest"))
    open_level = F.when(F.col("__cap") > F.col("__w") * F.col("__level"), F.col("__level"))
    return level.withColumn("__final", F.first(open_level, ignorenulls=True).over(full_first.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).select(
        "__src",
        "__null",
        "__kind",
        "source_size",
        F.least(F.col("__cap"), F.coalesce(F.col("__w") * F.col("__final"), F.col("__cap"))).alias("target"),
    )


def mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    schedules: Sequence = SCHEDULES,
    share: float = 1.5,
    max_repeat: float = 2.0,
    cut: bool = True,
    carry: bool = False,
    buckets: int | None = None,
    seed: int = 17,
) -> DataFrame:
    """One row for each document: sizes, its source's target, what is taken, where.

    Documents of a source are put in a keyed random order. All are taken as often
    as the target fills the source whole; what is left goes to the first ones.
    With `cut` the last copy stops at the target's word; else it is taken whole if
    its middle lies below the target. `positions` has a training time in 0..1 for
    each copy. With `carry` the whole row comes along as `row`.

    The order is by key. Keys in order fall into `buckets`, as many as the rows ask for,
    so running sums need only the total of each (source, bucket), and a source of any
    size is dealt over all its buckets.
    """
    buckets = buckets or bucket_count(docs.count())
    text = text_or_empty()
    key = row_key(F.col("doc_id"), F.lit(seed), F.md5(text.cast("binary")))
    own = [F.col("doc_id"), *([packed(docs).alias("row")] if carry else [])]
    sized = docs.select(
        *own,
        F.coalesce(F.col("source"), F.lit("")).alias("__src"),
        F.col("source").isNull().alias("__null"),
        word_count(text).alias("size"),
        key.alias("__h"),
    ).withColumn("__bucket", bucket_of(F.col("__h"), buckets))
    source = ["__src", "__null"]
    totals = sized.groupBy(*source, "__bucket").agg(F.sum("size").alias("__total"))
    along = Window.partitionBy(*source).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("__before", F.coalesce(F.sum("__total").over(along), F.lit(0)))
    goal = targets(totals.groupBy(*source).agg(F.sum("__total").alias("source_size")), weights, schedules, share, max_repeat)
    plan = offsets.join(goal, source).drop("__total")

    place = Window.partitionBy(*source, "__bucket").orderBy("__h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("__before") + F.coalesce(F.sum("size").over(place), F.lit(0))
    placed = sized.join(plan, [*source, "__bucket"]).withColumn("__start", start)

    budget = F.round(F.col("target")).cast("long")
    whole = F.coalesce(F.expr("try_divide(cast(round(target) as bigint), source_size)"), F.lit(0.0))
    counted = placed.withColumn("__budget", budget).withColumn("__passes", F.floor(whole).cast("long"))
    left = F.col("__budget") - F.col("__passes") * F.col("source_size")
    rest = F.greatest(F.lit(0), F.least(F.col("size"), left - F.col("__start")))
    if not cut:
        rest = F.when(F.col("__start") * 2 + F.col("size") <= left * 2, F.col("size")).otherwise(0)
    taken = counted.withColumn("__rest", rest.cast("long")).withColumn("taken", F.col("size") * F.col("__passes") + F.col("__rest"))
    copies = taken.withColumn("copies", (F.when(F.col("size") > 0, F.col("__passes")).otherwise(0) + (F.col("__rest") > 0).cast("long")).cast("int"))
    middle = lambda i: (F.col("source_size") * i + F.col("__start") + F.col("size") / 2) / F.col("__budget")
    at = F.transform(F.when(F.col("copies") > 0, F.sequence(F.lit(0), F.col("copies") - 1)).otherwise(F.array().cast("array<int>")), middle)
    inverted = None
    for k in range(len(weights)):
        knots = schedules[k % len(schedules)]
        by_kind = F.transform(at, lambda u: invert(u, knots))
        inverted = F.when(F.col("__kind") == k, by_kind) if inverted is None else inverted.when(F.col("__kind") == k, by_kind)
    return copies.select(
        *(["doc_id", "row"] if carry else ["doc_id"]),
        "size",
        F.col("source_size"),
        F.col("target").cast("double").alias("target"),
        "taken",
        "copies",
        inverted.alias("positions"),
    )


def placed(docs: DataFrame, **options) -> DataFrame:
    """One row for each document, range-sorted by the first of its training positions; those never taken come last.

    `positions` has a position for each copy.
    """
    mixed = mix(docs, **options)
    return mixed.orderBy(F.get("positions", F.lit(0)).asc_nulls_last(), "doc_id", "size")


def training_order(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: whole documents, each as often as taken, range-sorted by position.

    Returns the columns of `docs` and nothing else.
    """
    mixed = mix(docs, cut=False, carry=True, **options)
    copies = mixed.select("row", F.explode("positions").alias("at"))
    return copies.orderBy("at", "row.doc_id").select("row.*")
