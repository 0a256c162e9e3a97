"""Documents as they come: micro-batches through the same functions as batch jobs.

Redelivery is harmless. A batch is written under its own number, which a second run
replaces, and names the documents that it brought even where it found nothing in them; a
document's rows are those of its newest version, none if that has none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery, StreamingQueryListener

from ..operators import extraction, rules

Transform = Callable[[DataFrame], DataFrame]


def read_uploads(spark: SparkSession, path: str, schema: str | T.StructType, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", True).parquet(path)


def _keys(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def newest(batch: DataFrame, key: str | Sequence[str], order: str | None) -> DataFrame:
    """One row of each key: the highest by `order` (null lowest; of equals one by all columns), any without an order."""
    keys = _keys(key)
    if order is None:
        return batch.dropDuplicates(keys)
    rest = [c for c in batch.columns if c not in keys]
    plain = F.xxhash64(*[c for c, kind in batch.dtypes if "map<" not in kind and "variant" not in kind])
    top = batch.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.col(order).isNotNull(), F.col(order), plain)).alias("__row"))
    return top.select(*[F.col(c) if c in keys else F.col(f"__row.{c}") for c in batch.columns])


def upsert(path: str, transform: Transform, key: str | Sequence[str] = "document_id", order: str | None = None) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: the rows of the batch's documents, and the documents themselves with their version, as partition batch_id of two tables.

    Both are replaced if the batch runs again. The documents come last, so a batch counts
    once all of its rows are there. Of several versions in a batch the newest by `order` is taken.
    """
    keys = _keys(key)

    def put(df: DataFrame, batch_id: int, table: str) -> None:
        df.write.mode("overwrite").parquet(f"{path}/{table}/batch_id={batch_id}")  # with its schema, if there are no rows

    def write(batch: DataFrame, batch_id: int) -> None:
        one = newest(batch, keys, order).persist()
        put(transform(one), batch_id, "rows")
        version = F.col(order) if order else F.lit(0)
        put(one.select(*keys, version.alias("version")), batch_id, "documents")
        one.unpersist()

    return write


def _batches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).withColumn("batch_id", F.col("batch_id").cast("long"))


def versions(spark: SparkSession, path: str, key: str | Sequence[str] = "document_id") -> DataFrame:
    """key, batch_id of the newest version of each document; of equal versions the last batch's."""
    rank = F.struct(F.col("version").isNotNull(), "version", "batch_id")
    return _batches(spark, f"{path}/documents").groupBy(*_keys(key)).agg(F.max_by("batch_id", rank).alias("batch_id"))


def current(spark: SparkSession, path: str, key: str | Sequence[str] = "document_id") -> DataFrame:
    """The rows of each document's newest version: none for a document that has none now."""
    return _batches(spark, f"{path}/rows").join(versions(spark, path, key), [*_keys(key), "batch_id"], "left_semi")


def run(
    source: DataFrame, target: str, checkpoint: str, transform: Transform, once: bool = False, key: str | Sequence[str] = "document_id", order: str | None = None, name: str | None = None, mode: str = "append"
) -> StreamingQuery:
    writer = source.writeStream.foreachBatch(upsert(target, transform, key, order)).outputMode(mode).option("checkpointLocation", checkpoint)
    writer = writer.queryName(name) if name else writer
    return writer.trigger(availableNow=True).start() if once else writer.start()


def extract_stage(batch: DataFrame) -> DataFrame:
    return extraction.key_values(batch)


def validate_stage(as_of) -> Transform:
    return lambda batch: rules.validate(batch, as_of).drop("plots")


def stage_cached(inputs: DataFrame, cache: DataFrame, transform: Transform, columns: list[str], key: str = "document_id") -> DataFrame:
    """A stage's rows: cached ones where document and input hash agree, else computed."""
    hashed = inputs.withColumn("input_hash", F.sha2(F.to_json(F.struct(*columns)), 256))
    todo = hashed.join(cache.select(key, "input_hash").distinct(), [key, "input_hash"], "left_anti")
    fresh = transform(todo).join(todo.select(key, "input_hash"), key)
    kept = cache.join(hashed.select(key, "input_hash"), [key, "input_hash"], "left_semi")
    return kept.unionByName(fresh)


# Stages, each a query of its own.


def run_stages(spark: SparkSession, source: DataFrame, base: str, stages: list[tuple[str, Transform]], key: str = "document_id", order: str | None = None, prefix: str = "") -> None:
    """Run what is there through all stages, each a streaming query with its own checkpoint and tables below `base`.

    A stage reads the rows that the one before it wrote, so one that fails takes up its own
    work when run again, and those before it have nothing to do. All stages but the
    last give a row for each document. A batch that was written twice is read twice, which the next upsert settles.
    """
    rows = source
    for name, transform in stages:
        run(rows, f"{base}/{name}", f"{base}/{name}-checkpoint", transform, once=True, key=key, order=order, name=f"{prefix}{name}").awaitTermination()
        schema = spark.read.parquet(f"{base}/{name}/rows").drop("batch_id").schema
        rows = read_uploads(spark, f"{base}/{name}/rows", schema, 1 << 30)


def stage_status(spark: SparkSession, base: str, stages: list[str], progress: DataFrame | None = None, key: str = "document_id") -> DataFrame:
    """key, stage, batch_id, at: the last stage that each document's newest version has come through, and when that batch ended by the progress table."""
    parts = [versions(spark, f"{base}/{name}", key).select(key, F.struct(F.lit(i).alias("nth"), F.lit(name).alias("stage"), "batch_id").alias("s")) for i, name in enumerate(stages)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    last = every.groupBy(key).agg(F.max("s").alias("s")).select(key, "s.stage", "s.batch_id")
    if progress is None:
        return last
    ended = progress.groupBy(F.col("name").alias("stage"), "batch_id").agg(F.max("at").alias("at"))
    return last.join(ended, ["stage", "batch_id"], "left").select(key, "stage", "batch_id", "at")


PROGRESS = "name string, query_id string, run_id string, batch_id long, input_rows long, at timestamp, millis long"


class ProgressTable(StreamingQueryListener):
    """Appends a row for each batch of the queries named to a table in shared storage."""

    def __init__(self, spark: SparkSession, path: str, names: list[str] | None = None, prefix: str = ""):
        self.spark, self.path, self.names, self.prefix = spark, path, names, prefix

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        name = (p.name or "").removeprefix(self.prefix)
        if self.names is None or p.name and p.name.startswith(self.prefix) and name in self.names:
            at = pd.Timestamp(p.timestamp).to_pydatetime()
            row = [(name, str(p.id), str(p.runId), p.batchId, p.numInputRows, at, p.batchDuration)]
            self.spark.createDataFrame(row, PROGRESS).coalesce(1).write.mode("append").parquet(self.path)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def read(self) -> DataFrame:
        return self.spark.read.schema(PROGRESS).parquet(self.path)


def progress(query: StreamingQuery) -> list[dict]:
    return [{"batch_id": p["batchId"], "rows": p["numInputRows"]} for p in query.recentProgress]


# Counters that trigger learning.


class Trigger(StatefulProcessor):
    """Counts the samples of a key; at each `least` of them a trigger, and one for the rest when none came for `patience` ms."""

    def __init__(self, least: int, patience: int | None):
        self.least, self.patience = least, patience

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("count", "waiting long, triggers long, timer long")

    def _now(self) -> tuple[int, int, int]:
        return tuple(self.state.get()) if self.state.exists() else (0, 0, 0)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        waiting, triggers, timer = self._now()
        waiting += sum(len(r) for r in rows)
        due, waiting = divmod(waiting, self.least)
        if self.patience:
            if timer:
                self.handle.deleteTimer(timer)
            timer = timerValues.getCurrentProcessingTimeInMs() + self.patience if waiting else 0
            if timer:
                self.handle.registerTimer(timer)
        self.state.update((waiting, triggers + due, timer))
        if due:
            yield pd.DataFrame({"key": [key[0]] * due, "nth": range(triggers + 1, triggers + due + 1), "samples": [self.least] * due})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        waiting, triggers, _ = self._now()
        if waiting:
            self.state.update((0, triggers + 1, 0))
            yield pd.DataFrame({"key": [key[0]], "nth": [triggers + 1], "samples": [waiting]})

    def close(self) -> None:
        pass


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def corrections_due(samples: DataFrame, key: str, least: int, patience: int | None = None) -> DataFrame:
    """key, nth, samples: a row each time that a key of a stream of unused samples has `least` more of them.

    The count is kept for each key, so no batch reads the samples before it, and triggers are
    the same however the stream is cut into batches or started again.
    """
    samples.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    schema = T.StructType([T.StructField("key", samples.schema[key].dataType), T.StructField("nth", T.LongType()), T.StructField("samples", T.LongType())])
    processor = Trigger(least, patience)
    return samples.select(key).groupBy(key).transformWithStateInPandas(processor, schema, "Append", "ProcessingTime" if patience else "None")


# Event time.


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by window and type with late rows dropped (an extension: the original has no windows). Run with mode update or append:
    the state of a window goes once it is `late` past its end."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def deduplicated(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
