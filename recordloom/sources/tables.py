"""Reading and writing of tables, files and exchange formats."""

from __future__ import annotations

import tempfile
import time
import uuid
from abc import ABC, abstractmethod
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.verification import registry_match
from ..schemas import SCHEMAS


def read_table(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """A Parquet table, with missing columns as nulls where the name is a known one."""
    df = spark.read.option("mergeSchema", name is not None).parquet(path)
    if name is None:
        return df
    return df.select(*[F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(SCHEMAS[name]).fields])


def by_key(df: DataFrame, key: str, value) -> DataFrame:
    return df.filter(F.col(key) == F.lit(value)).limit(1)


def read_objects(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, length, content and its SHA-256 of every file below a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.withColumn("file_hash", F.sha2("content", 256))


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of records whose `entities` have keys that vary."""
    schema = "id string, state string, document_type string, language string, script string, entities map<string,string>, text string"
    return spark.read.schema(schema).json(path, multiLine=True)


def entity_rows(records: DataFrame) -> DataFrame:
    return records.select("id", F.explode("entities").alias("field_name", "field_value"))


GEOMETRY = "struct<type:string, coordinates:array<array<array<double>>>>"


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """A FeatureCollection as rows: properties (a map), ring of the outer boundary; none for an empty file."""
    schema = f"type string, features array<struct<type:string, properties:map<string,string>, geometry:{GEOMETRY}>>"
    one = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("features").alias("f"))
    ring = F.transform(F.get("f.geometry.coordinates", F.lit(0)), lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))
    return one.select("f.properties", ring.alias("ring"))


def feature(properties: list[str], ring: str = "ring"):
    """A row as a GeoJSON feature; a null ring is a null geometry."""
    outline = F.array(F.transform(ring, lambda p: F.array(p["x"], p["y"])))
    shape = F.when(F.col(ring).isNotNull(), F.struct(F.lit("Polygon").alias("type"), outline.alias("coordinates")))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), shape.alias("geometry"), F.struct(*properties).alias("properties")), {"ignoreNullFields": "false"})


def write_features(df: DataFrame, path: str, properties: list[str], ring: str = "ring") -> None:
    """Newline-delimited GeoJSON features: it can be written and read in parts of any number."""
    df.select(feature(properties, ring).alias("value")).write.text(path)


def feature_collection(df: DataFrame, properties: list[str], order: str, limit: int = 5000, ring: str = "ring") -> DataFrame:
    """One row `value` with a FeatureCollection of at most `limit` features, lowest `order` first."""
    rows = df.orderBy(order).limit(min(limit, 5000)).select(F.struct(F.col(order).alias("o"), feature(properties, ring).alias("f")).alias("s"))
    listed = F.sort_array(F.collect_list("s"))["f"]
    return rows.agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(listed, ","), F.lit("]}")).alias("value"))


EXPORT = ["document_id", "filename", "status", "language", "file_size", "created_at"]


def write_csv(docs: DataFrame, path: str) -> None:
    """A folder of CSV parts, each with a header; six columns, quotes doubled; language defaults to auto, size to 0."""
    rows = docs.select("document_id", F.col("original_filename").alias("filename"), "status", F.coalesce("detected_language", F.lit("auto")).alias("language"), F.coalesce("file_size", F.lit(0)).alias("file_size"), "created_at")
    rows.write.csv(path, header=True, quote='"', escape='"', quoteAll=True)


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def remove(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def wait_for(there, seconds: float = 60.0) -> None:
    """Until `there()` holds, or so many seconds have gone."""
    end = time.monotonic() + seconds
    while not there() and time.monotonic() < end:
        time.sleep(0.1)


def uri(path: str) -> str:
    """A path of Hadoop's as the URI that pyarrow's file systems take."""
    return path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path


def seed(spark: SparkSession, path: str, rows: DataFrame) -> bool:
    """Write rows only where the table is missing or empty."""
    if exists(spark, path) and spark.read.schema(rows.schema).parquet(path).limit(1).count():
        return False
    rows.write.mode("overwrite").parquet(path)
    return True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where the session names none and has no executors on other machines (tests, a
    laptop) is a local one made.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master.partition("[")[0] not in ("local", "local-cluster"):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        base = "file://" + tempfile.mkdtemp(prefix="recordloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def materialise(df: DataFrame, what: str) -> DataFrame:
    """What is used several times, written once to the shared folder, which outlives executors."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Registry(ABC):
    """A land registry that can be looked up."""

    keys: list[str]

    @abstractmethod
    def records(self, spark: SparkSession) -> DataFrame: ...

    def lookup(self, extracted: DataFrame) -> DataFrame:
        return registry_match(extracted, self.records(extracted.sparkSession), self.keys)


class TableRegistry(Registry):
    """A registry in a Parquet table."""

    keys = ["survey_number", "khasra_number", "khata_number", "plot_number", "registration_number", "village", "district"]

    def __init__(self, path: str):
        self.path = path

    def records(self, spark: SparkSession) -> DataFrame:
        return read_table(spark, self.path, "land_records_reference")


REGISTRIES: dict[str, type[Registry]] = {"table": TableRegistry}


def write_objects(objects: DataFrame, folder: str) -> DataFrame:
    """Write (key, content) rows as files below a folder that executors share; key and bytes of each.

    A file is written under a name of its own and renamed, so a task may run again.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pa.fs.FileSystem.from_uri(folder)
        for b in batches:
            sizes = []
            for key, content in zip(b.column("key").to_pylist(), b.column("content").to_pylist()):
                target = f"{path}/{key}"
                fs.create_dir(target.rpartition("/")[0], recursive=True)
                part = f"{target}.{uuid.uuid4().hex}"
                with fs.open_output_stream(part, compression=None) as f:
                    f.write(content)
                try:
                    fs.move(part, target)
                except OSError:  # left by an earlier attempt
                    fs.delete_file(target)
                    fs.move(part, target)
                sizes.append(len(content))
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(sizes, pa.int64())], names=["key", "bytes"])

    return objects.select("key", "content").mapInArrow(write, "key string, bytes long")
