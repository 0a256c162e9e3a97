"""Inserts, updates and deletes as rewrites of immutable tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UPDATABLE = ["field_name", "field_value", "data_type", "canonical_key", "confidence", "validation_status", "normalized_value", "validated"]


def replace_documents(table: DataFrame, new: DataFrame, key: str = "document_id") -> DataFrame:
    """Rows of the documents in `new` give way to it, so running twice changes nothing."""
    return table.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def update(table: DataFrame, changes: DataFrame, key: str = "id", columns: list[str] = UPDATABLE) -> DataFrame:
    """Non-null values of `changes` (one row for each key) take the place of old ones."""
    on = [c for c in columns if c in table.columns and c in changes.columns]
    new = changes.select(key, *[F.col(c).alias(f"__{c}") for c in on])
    return table.join(new, key, "left").select(*[F.coalesce(f"__{c}", c).alias(c) if c in on else F.col(c) for c in table.columns])


def before_images(table: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """Training samples of changed values: what was there and what came."""
    new = changes.select(key, F.col("field_value").alias("corrected_value"))
    joined = table.join(new, key).filter(~F.col("field_value").eqNullSafe(F.col("corrected_value")))
    return joined.select("document_id", key, "field_name", "canonical_key", F.col("field_value").alias("original_value"), "corrected_value", F.lit("value_correction").alias("correction_type"))


def manual_fields(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"confidence": F.coalesce("confidence", F.lit(1.0)), "extraction_method": F.lit("manual"), "validation_status": F.lit("valid")})


def delete(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key).distinct(), key, "left_anti")


def cascade(keys: DataFrame, key: str, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """What is left of a table and those that hang on it, by name, once the rows of some keys go from all of them."""
    gone = keys.select(key).distinct()
    return {name: t.join(gone, key, "left_anti") for name, t in tables.items()}


def audit(actor: str, action: str, rows: DataFrame, resource: str, key: str) -> DataFrame:
    """Rows for an append-only log."""
    return rows.select(F.lit(actor).alias("username"), F.lit(action).alias("action"), F.lit(resource).alias("resource_type"), F.col(key).cast("string").alias("resource_id"))


def set_status(docs: DataFrame, changes: DataFrame, key: str = "document_id") -> DataFrame:
    return update(docs, changes, key, ["status"])
