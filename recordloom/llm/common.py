"""What several of the training-data operators share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import materialise, remove, scratch  # noqa: F401  (operators take them from here)

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def put_in_place(fs, tmp: str, path: str) -> None:
    """Rename a finished file of pyarrow's file system `fs`; what an earlier attempt of the task left there goes, as it holds the same."""
    try:
        fs.move(tmp, path)
    except OSError:
        fs.delete_file(path)
        fs.move(tmp, path)


def remove_table(df: DataFrame) -> None:
    """Delete the files that `df` is read from, once nothing else reads them."""
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        remove(df.sparkSession, path)


@contextmanager
def tidy_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within it, Spark removes an execution's shuffle files when the execution ends."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def column(name: str) -> Column:
    """The column of that very name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(df: DataFrame) -> Column:
    """All columns of a row as one value, so that no name of theirs meets one of an operator's own."""
    return F.struct(*[column(c) for c in df.columns])


def beside(names: list[str], added: list[str]) -> list[str]:
    """Names for the columns `names` next to `added` ones: those that clash, in any case, get "docs_" before them."""
    out, taken = [], {a.lower() for a in added}
    for n in names:
        kept = n
        while kept.lower() in taken or kept != n and kept.lower() in {x.lower() for x in names}:
            kept = f"docs_{kept}"
        taken.add(kept.lower())
        out.append(kept)
    return out


#: Rows that share a bucket of hashes, and the least number of buckets.
BUCKET_ROWS, LEAST_BUCKETS = 1 << 16, 512


def bucket_count(rows: int) -> int:
    """Buckets for a table of so many rows: in proportion, so that no task grows with the table."""
    return max(LEAST_BUCKETS, -(-rows // BUCKET_ROWS))


def row_key(*parts: Column) -> Column:
    """32 hexadecimal digits that stand for the parts; SQL elsewhere computes the same."""
    return F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]).cast("binary"))


def bucket_of(key: Column, buckets: int) -> Column:
    """Bucket of a row_key; buckets in order hold keys in order."""
    return F.shiftrightunsigned(F.conv(F.substring(key, 1, 8), 16, 10).cast("long") * buckets, 32).cast("int")


def let(value: Column, body) -> Column:
    """Evaluate `value` once and use it in `body`, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def words(text: Column) -> Column:
    """The words of a text as an array; empty for a text without any."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")
