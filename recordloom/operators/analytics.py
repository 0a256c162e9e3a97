"""Filters, counts and rankings behind lists and dashboards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLOSED = ["COMPLETED", "VERIFICATION_REQUIRED", "FAILED"]


def optional_filters(df: DataFrame, **wanted: str | None) -> DataFrame:
    """Rows that agree with every argument given, case aside; null and '' ask for nothing."""
    asked = [F.lower(F.col(c)) == v.lower() for c, v in wanted.items() if v]
    return df.filter(reduce(Column.__and__, asked)) if asked else df


def search(df: DataFrame, text: str, *columns: str) -> DataFrame:
    """Rows with the text, case aside, in any of the columns; blank finds all."""
    if not text.strip():
        return df
    return df.filter(reduce(Column.__or__, [F.contains(F.lower(F.col(c).cast("string")), F.lit(text.strip().lower())) for c in columns]))


def facet(df: DataFrame, column: str, value: str) -> DataFrame:
    return df.filter(F.coalesce(F.lower(F.col(column)), F.lit("")) == value.lower())


def status_class(status: Column) -> Column:
    return F.when(status.isin(CLOSED), status).otherwise("PROCESSING")


def share(n: Column, total: Column) -> Column:
    return F.coalesce(F.try_divide(n * 100.0, total), F.lit(0.0))


def status_kpis(df: DataFrame, status: str = "status") -> DataFrame:
    """Counts of the four classes and whole percentages, one row, in one pass."""
    kind = status_class(F.col(status))
    names = [*CLOSED, "PROCESSING"]
    agg = df.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(kind == c).alias(c.lower()) for c in names])
    return agg.select("*", *[F.floor(F.col(c.lower()) * 100 / F.greatest("total", F.lit(1)) + 0.5).alias(f"{c.lower()}_pct") for c in names])


def group_counts(df: DataFrame, *columns: str) -> DataFrame:
    """dimension, value, n for each column, from one pass with grouping sets; null groups are left out."""
    which = F.expr("grouping_id(" + ", ".join(columns) + ")")
    ids = {c: sum(1 << (len(columns) - 1 - j) for j in range(len(columns)) if j != i) for i, c in enumerate(columns)}
    sets = df.groupingSets([[F.col(c)] for c in columns], *[F.col(c) for c in columns]).agg(F.count(F.lit(1)).alias("n"), which.alias("g"))
    name = reduce(lambda w, c: w.when(F.col("g") == ids[c], c), columns[1:], F.when(F.col("g") == ids[columns[0]], columns[0]))
    return sets.select(name.alias("dimension"), F.coalesce(*[F.col(c).cast("string") for c in columns]).alias("value"), "n").filter("value is not null")


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.col(column).alias("value")).filter("value <> ''").distinct().orderBy("value")


def coverage(df: DataFrame, *columns: str) -> DataFrame:
    """Share of rows with a value, in percent to one place, for each column."""
    total = F.count(F.lit(1))
    return df.agg(*[F.bround(share(F.count(c), total), 1).alias(c) for c in columns])


def top_frequent(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).filter(F.col(column).isNotNull()).orderBy(F.desc("n"), column).limit(k)


def language_split(df: DataFrame, column: str = "language") -> DataFrame:
    hi, en = F.col(column) == "hi", F.col(column) == "en"
    return df.agg(F.count_if(hi).alias("hi"), F.count_if(en).alias("en"), F.count_if(F.coalesce(~hi & ~en, F.lit(True))).alias("other"))


def centroid(df: DataFrame, lat: str, lng: str) -> DataFrame:
    """Mean of coordinates that are neither null nor 0."""
    return df.agg(F.avg(F.nullif(F.col(lat), F.lit(0.0))).alias(lat), F.avg(F.nullif(F.col(lng), F.lit(0.0))).alias(lng))


def suggestions(df: DataFrame, text: str, sources: dict[str, int], k: int = 8) -> DataFrame:
    """Values with the text: for each column in turn so many, distinct, k in all."""
    parts = []
    for i, (c, n) in enumerate(sources.items()):
        hit = df.select(F.col(c).alias("value")).filter(F.contains(F.lower("value"), F.lit(text.lower()))).distinct()
        parts.append(hit.orderBy("value").limit(n).select("value", F.lit(i).alias("source")))
    merged = reduce(DataFrame.unionByName, parts).groupBy("value").agg(F.min("source").alias("source"))
    return merged.orderBy("source", "value").limit(k)


def best_match(df: DataFrame, column: str, text: str, *order: str) -> DataFrame:
    """One row: equal, else beginning with, else containing the text."""
    low, q = F.lower(F.col(column)), text.lower()
    rank = F.when(low == q, 0).when(low.startswith(q), 1).when(F.contains(low, F.lit(q)), 2)
    return df.withColumn("match_rank", rank).filter("match_rank is not null").orderBy("match_rank", *order).limit(1)


def share_totals(df: DataFrame, record: str, part: str, tolerance: float = 0.01) -> DataFrame:
    """Records whose shares do not sum to 100 (an extension: named in documents, not in code)."""
    return df.groupBy(record).agg(F.sum(part).alias("total")).filter(F.abs(F.col("total") - 100) > tolerance)
