"""A registry of records by district as a data source of Spark's.

    spark.dataSource.register(RegistrySource)
    spark.read.format("registry").option("path", folder).load().filter("district = 'Pune'")

The folder holds Parquet files below district=<name>, as `write_registry` leaves them. Each file is
a partition; filters on the district leave only its files to be read, all other
filters are Spark's. Files are listed on the driver, by name only.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition

FIELDS = ["ref_id", "survey_number", "khasra_number", "khata_number", "plot_number", "registration_number", "owner_name", "village", "area"]
#: The folder's name of rows without a district.
NONE = "__HIVE_DEFAULT_PARTITION__"


def write_registry(records: DataFrame, path: str) -> None:
    """Records by district, one folder for each."""
    records.select(*[c for c in FIELDS if c in records.columns], "district").write.partitionBy("district").parquet(path)


class DistrictFile(InputPartition):
    def __init__(self, path: str, district: str | None):
        super().__init__(path)
        self.path, self.district = path, district


class RegistryReader(DataSourceReader):
    def __init__(self, folder: str, schema: T.StructType):
        self.folder, self.schema = folder, schema
        self.asked: list[set] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes the filters that name districts; gives back all others."""
        for f in filters:
            if isinstance(f, (EqualTo, EqualNullSafe)) and f.attribute == ("district",):
                self.asked.append({f.value})
            elif isinstance(f, In) and f.attribute == ("district",):
                self.asked.append(set(f.value))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        import pyarrow.fs

        fs, path = pyarrow.fs.FileSystem.from_uri(self.folder)
        found = []
        for info in fs.get_file_info(pyarrow.fs.FileSelector(path, recursive=True)):
            parent, _, name = info.path.rpartition("/")
            key, _, value = parent.rpartition("/")[2].partition("=")
            if info.type == pyarrow.fs.FileType.File and name.endswith(".parquet") and key == "district":
                district = None if value == NONE else unquote(value)
                if all(district in asked for asked in self.asked):
                    found.append(DistrictFile(info.path, district))
        return found

    def read(self, partition: DistrictFile) -> Iterator:
        import pyarrow as pa
        import pyarrow.fs
        import pyarrow.parquet as pq

        if partition is None:  # no district was left
            return
        fs, _ = pyarrow.fs.FileSystem.from_uri(self.folder)
        with fs.open_input_file(partition.path) as f:
            file = pq.ParquetFile(f)
            has = set(file.schema_arrow.names)
            for b in file.iter_batches(columns=[n for n in self.schema.names if n in has]):
                named = dict(zip(b.schema.names, b.columns))
                named["district"] = pa.array([partition.district] * b.num_rows, pa.string())
                yield pa.RecordBatch.from_arrays([named[n].cast(pa.string()) if n in named else pa.nulls(b.num_rows, pa.string()) for n in self.schema.names], names=self.schema.names)


class RegistrySource(DataSource):
    """format("registry"): records of a folder by district."""

    @classmethod
    def name(cls) -> str:
        return "registry"

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(n, T.StringType()) for n in [*FIELDS, "district"]])  # as in schemas

    def reader(self, schema: T.StructType) -> RegistryReader:
        return RegistryReader(self.options["path"], schema)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """The registry in a folder, filters on districts left to the source."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RegistrySource)
    return spark.read.format("registry").option("path", path).load()
