"""Sharding by a keyed permutation of the global row numbers.

A balanced Feistel network permutes the numbers below a power of four; walking its
cycle until the value is below n gives a permutation of 0..n-1 without any table.
Position p belongs to shard p mod k at slot p div k, so shard sizes differ by one
row at most, and either direction can be computed from the numbers alone.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import beside, bucket_count, bucket_of, packed, row_key, text_or_empty

ROUNDS = 6


def _mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Feistel:
    """A permutation of 0..n-1 fixed by (n, key), and its inverse."""

    def __init__(self, n: int, key: int, rounds: int = ROUNDS):
        if not 0 <= n <= 1 << 62:
            raise ValueError("n must lie in 0..2**62")
        self.n = n
        self.half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
        self.mask = np.uint64((1 << int(self.half)) - 1)
        seeds = np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        self.keys = _mix64(seeds + np.uint64(key & (1 << 64) - 1))

    def _once(self, x: np.ndarray, inverse: bool) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for k in self.keys[::-1] if inverse else self.keys:
            if inverse:
                left, right = right ^ (_mix64(left + k) & self.mask), left
            else:
                left, right = right, left ^ (_mix64(right + k) & self.mask)
        return left << self.half | right

    def _walk(self, values, inverse: bool) -> np.ndarray:
        x = np.asarray(values, dtype=np.uint64)
        if x.size and int(x.max()) >= self.n:
            raise ValueError("a number is not below n")
        with np.errstate(over="ignore"):
            x = self._once(x, inverse)
            while (out := np.flatnonzero(x >= np.uint64(self.n))).size:
                x[out] = self._once(x[out], inverse)
        return x.astype(np.int64)

    def forward(self, rows) -> np.ndarray:
        return self._walk(rows, False)

    def backward(self, positions) -> np.ndarray:
        return self._walk(positions, True)


def permuted(row: Column, n: int, key: int) -> Column:
    """Position of each row number under the keyed permutation, in Arrow batches."""

    @F.pandas_udf("long")
    def forward(rows: pd.Series) -> pd.Series:
        return pd.Series(Feistel(n, key).forward(rows.to_numpy()))

    return forward(row)


def numbered(df: DataFrame, by: Sequence[Column], name: str, buckets: int | None = None) -> DataFrame:
    """The rows as one column, `row`, and gapless global row numbers from 0 that depend on the rows alone.

    Rows are ordered by a key of `by`; keys in order fall into buckets, and a bucket starts
    where the counts of those before it end. Only the counts, a row for each bucket, meet
    in one task, and there are as many buckets as the rows ask for. `by` should tell rows
    apart: rows equal in it share a bucket, which is streamed through a sort, and are
    interchangeable.
    """
    buckets = buckets or bucket_count(df.count())
    dealt = df.select(packed(df).alias("row"), row_key(*by).alias("key")).withColumn("bucket", bucket_of(F.col("key"), buckets))
    counts = dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("bucket", F.coalesce(before, F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("bucket").orderBy("key"))
    bounded = F.broadcast(starts)  # one row of 12 bytes for `BUCKET_ROWS` rows
    return dealt.join(bounded, "bucket").select("row", (F.col("start") + within - 1).alias(name))


def shard(docs: DataFrame, shards: int = 8, key: int = 2024, carry: bool = False) -> DataFrame:
    """Shard and slot of every row under the law `rows`.

    Returns doc_id, size (UTF-8 bytes and 1), text_crc32, shard, slot, row_number and, with
    `carry`, the other columns of `docs`; those of a name that is taken get "docs_" before
    it. A null text counts as empty and a very long one whole; a null doc_id is a value
    like any other; equal rows get different slots; an empty table gives an empty result.
    """
    binary = text_or_empty().cast("binary")
    own = [F.octet_length(binary).cast("long").alias("bytes"), F.crc32(binary).alias("crc"), F.md5(binary).alias("digest")]
    rows = docs.select(F.col("doc_id").alias("id"), *own, *([packed(docs).alias("doc")] if carry else []))
    n = docs.count()
    placed = numbered(rows, [F.col("id"), F.col("digest")], "row_number").withColumn("at", permuted(F.col("row_number"), n, key))
    added = ["doc_id", "size", "text_crc32", "shard", "slot", "row_number"]
    others = [c for c in docs.columns if c != "doc_id"] if carry else []
    return placed.select(
        F.col("row.id").alias("doc_id"),
        *[F.col("row.doc")[c].alias(n) for c, n in zip(others, beside(others, added))],
        (F.col("row.bytes") + 1).alias("size"),
        F.col("row.crc").alias("text_crc32"),
        (F.col("at") % shards).cast("int").alias("shard"),
        F.expr(f"at div {int(shards)}").alias("slot"),
        "row_number",
    )


def row_of(n: int, key: int, shards: int, shard_no: int, slot: int) -> int:
    """The row number at a slot of a shard: a reader can find any row without the data."""
    return int(Feistel(n, key).backward([slot * shards + shard_no])[0])
