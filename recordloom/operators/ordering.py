"""First, last, latest and ranked rows. Order is always a column, never the order of arrival."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: list, *order: str) -> DataFrame:
    """The row that comes first for each key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")


def last_per_key(df: DataFrame, keys: list, *order: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order]))
    return df.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")


def last_values(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """The last value of each key, combined before the shuffle."""
    return df.groupBy(*keys).agg(F.max_by(value, order).alias(value))


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(k)


def page(df: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    """Rows of one page of a list, from page 1 on, with their rank; only the rows up to its end are sorted out and ranked."""
    top = top_k(df, number * size, *order)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))  # number * size rows
    return ranked.filter(F.col("rank") > (number - 1) * size)


def latest_versions(snapshots: DataFrame, n: int = 20) -> DataFrame:
    return snapshots.orderBy(F.desc("version")).limit(n)


def latest_version(snapshots: DataFrame, deployed_only: bool = False) -> DataFrame:
    rows = snapshots.filter("deployed") if deployed_only else snapshots
    return rows.orderBy(F.desc("version")).limit(1)


def next_version(snapshots: DataFrame) -> DataFrame:
    return snapshots.agg((F.coalesce(F.max("version"), F.lit(0)) + 1).alias("version"))


def change_intervals(events: DataFrame, key: str, at: str) -> DataFrame:
    """Seconds since the key's last event (an extension: named in documents, not in code)."""
    before = F.lag(at).over(Window.partitionBy(key).orderBy(at))
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return events.withColumn("seconds", (micros(F.col(at)) - micros(before)) / 1_000_000)
