"""Corrections gathered into versioned patterns, and their use.

Patterns are rows: part, key and a value, or the sorted fields of a document type. A cycle
learns from new samples, folds what it learned into the deployed version's patterns and
deploys the result if it does no worse on samples set aside.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip
from ..sources.tables import exists

RETRAIN_AT, LEARN_AT = 10, 3


def due(samples: DataFrame, least: int = RETRAIN_AT) -> DataFrame:
    return samples.agg(F.count_if(~F.col("used_in_training")).alias("unused")).withColumn("due", F.col("unused") >= least)


def new_samples(candidates: DataFrame, samples: DataFrame) -> DataFrame:
    """Fields of verified documents, sure and valid, that were not sampled yet."""
    good = F.col("document_status").isin("COMPLETED", "VERIFIED") & (F.coalesce("confidence", F.lit(0.0)) >= 0.70) & ~F.coalesce("validation_status", F.lit("")).isin("invalid", "mismatch")
    return candidates.filter(good).join(samples, ["document_id", "field_name"], "left_anti")


def in_training(key: Column, seed: int = 0, percent: int = 80) -> Column:
    """A split that the key and the seed decide."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(100)) < percent


def correction_rates(samples: DataFrame) -> DataFrame:
    """field_name, total, corrected, accuracy and, from two samples with a correction on, the penalty."""
    corrected = F.count_if(F.col("correction_type") == "value_correction")
    by = samples.groupBy("field_name").agg(F.count(F.lit(1)).alias("total"), corrected.alias("corrected"))
    rate = F.col("corrected") / F.col("total")
    return by.withColumn("accuracy", 1 - rate).withColumn("penalty", F.when((F.col("corrected") > 0) & (F.col("total") >= 2), -0.30 * rate))


def correction_map(samples: DataFrame) -> DataFrame:
    """Last correction of each (field_name, original_value)."""
    rows = samples.filter(F.col("correction_type") == "value_correction").withColumn("original_value", F.trim("original_value"))
    return rows.groupBy("field_name", "original_value").agg(F.max_by("corrected_value", "seq").alias("corrected_value"))


def label_map(samples: DataFrame) -> DataFrame:
    rows = samples.filter(F.col("canonical_key").isNotNull()).withColumn("label", F.lower(F.trim("field_name")))
    return rows.groupBy("label").agg(F.max_by("canonical_key", "seq").alias("canonical_key"))


def fields_of_types(samples: DataFrame) -> DataFrame:
    """Sorted field names seen for each document type."""
    known = samples.filter(F.coalesce("document_type", F.lit("Unknown")) != "Unknown")
    return known.groupBy("document_type").agg(F.array_sort(F.collect_set("field_name")).alias("fields"))


def accuracy(samples: DataFrame, rates: DataFrame, corrections: DataFrame, labels: DataFrame, types: DataFrame) -> DataFrame:
    """One row: mean credit of the samples under the patterns; 0.5 without any."""
    low = samples.withColumn("label", F.lower(F.trim("field_name"))).withColumn("original_value", F.trim("original_value"))
    c = corrections.withColumnRenamed("corrected_value", "learned_value")
    k = labels.withColumnRenamed("canonical_key", "learned_key")
    t = types.select("document_type", F.explode("fields").alias("field_name"), F.lit(True).alias("known_field"))
    joined = (
        low.join(rates.select("field_name", "penalty"), "field_name", "left").join(c, ["field_name", "original_value"], "left")
        .join(k, "label", "left").join(t, ["document_type", "field_name"], "left")
    )
    sure = F.coalesce("ocr_confidence", F.lit(0.85)) + F.coalesce("penalty", F.lit(0.0)) >= 0.5
    credit = (
        F.when(F.col("correction_type") == "auto_verified", F.when(sure, 1.0).otherwise(0.0))
        .when(F.col("correction_type") == "value_correction", F.when(F.col("learned_value") == F.col("corrected_value"), 1.0).when(F.col("learned_key") == F.col("canonical_key"), 0.5).otherwise(0.0))
        .when(F.col("correction_type") == "field_added", F.when(F.col("known_field"), 1.0).otherwise(0.0)).otherwise(0.5)
    )
    return joined.agg(F.coalesce(F.avg(credit), F.lit(0.5)).alias("accuracy"))


def apply_learned(fields: DataFrame, corrections: DataFrame, labels: DataFrame, rates: DataFrame) -> DataFrame:
    """Fields with learned values, keys and penalties; pattern tables are joined, small ones broadcast by their size."""
    c = corrections.select("field_name", F.col("original_value").alias("__v"), F.col("corrected_value").alias("__c"))
    k = labels.select("label", F.col("canonical_key").alias("__k"))
    out = fields.withColumn("__v", F.trim("field_value")).withColumn("label", F.lower(F.trim("field_name")))
    out = out.join(c, ["field_name", "__v"], "left").join(k, "label", "left").join(rates.select("field_name", "penalty"), "field_name", "left")
    confidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence") + F.coalesce("penalty", F.lit(0.0))))
    return out.withColumns({"field_value": F.coalesce("__c", "field_value"), "canonical_key": F.coalesce("__k", "canonical_key"), "confidence": confidence}).drop("__v", "__c", "__k", "label", "penalty")


def deploy(snapshots: DataFrame, accuracy_before: float, accuracy_after: float, samples: int, patterns: str) -> DataFrame:
    """Snapshots with a new version; deployed if no worse or the first, and then the latest one is not."""
    spark = snapshots.sparkSession
    last = snapshots.agg(F.max("version")).first()[0]
    go = last is None or accuracy_after >= accuracy_before
    kept = snapshots.withColumn("deployed", F.col("deployed") & ~(F.lit(go) & (F.col("version") == F.lit(last)))) if last is not None else snapshots
    row = [((last or 0) + 1, samples, patterns, accuracy_before, accuracy_after, accuracy_after - accuracy_before, go)]
    names = ["version", "training_samples_count", "patterns", "accuracy_before", "accuracy_after", "improvement_delta", "deployed"]
    return kept.unionByName(spark.createDataFrame(row, kept.select(*names).schema))


def snapshot_sizes(snapshots: DataFrame) -> DataFrame:
    """Entries in each part of a snapshot's JSON; 0 where it has none."""
    size = lambda p: F.coalesce(F.size(F.map_keys(F.from_json(F.get_json_object("patterns", f"$.{p}"), "map<string,string>"))), F.lit(0))
    return snapshots.select("version", *[size(p).alias(p) for p in ("ocr_corrections", "label_mappings", "confidence_adjustments")])


PATTERNS = "part string, key string, value string, fields array<string>"
SNAPSHOTS = "training_samples_count long, test_samples_count long, accuracy_before double, accuracy_after double, improvement_delta double, accepted boolean"
LONGEST = 200  # characters of a correction that is worth keeping


def learn(samples: DataFrame) -> DataFrame:
    """part, key, value, fields from samples: of equal labels and corrections the last by seq, rates of these samples alone."""
    def rows(df: DataFrame, part: str, key: Column, value: Column | None = None, fields: Column | None = None) -> DataFrame:
        listed = F.lit(None).cast("array<string>") if fields is None else fields
        return df.select(F.lit(part).alias("part"), key.alias("key"), (F.lit(None) if value is None else value).cast("string").alias("value"), listed.alias("fields"))

    changed = (F.col("correction_type") == "value_correction") & (F.col("original_value") != "") & (F.col("corrected_value") != "") & (F.col("original_value") != F.col("corrected_value"))
    old, new = strip(F.col("original_value")), strip(F.col("corrected_value"))
    corrected = samples.filter(changed).select("seq", F.concat("field_name", F.lit("::"), old).alias("key"), old.alias("old"), new.alias("new"))
    corrected = corrected.filter((F.length("old") < LONGEST) & (F.length("new") < LONGEST)).groupBy("key").agg(F.max_by("new", "seq").alias("new"))
    labels = samples.filter((F.col("canonical_key") != "") & (F.col("field_name") != "")).groupBy(F.lower(strip(F.col("field_name"))).alias("key")).agg(F.max_by("canonical_key", "seq").alias("value"))
    known = samples.filter((F.col("document_type") != "") & (F.col("document_type") != "Unknown"))
    types = known.groupBy("document_type").agg(F.array_sort(F.collect_set("field_name")).alias("fields"))  # names of fields: few
    rate = F.col("corrections") / F.col("total")
    counts = samples.groupBy("field_name").agg(F.count(F.lit(1)).alias("total"), F.count_if(changed).alias("corrections"))
    penalty = F.when((F.col("corrections") > 0) & (F.col("total") >= 2), -0.30 * rate).otherwise(0.0)
    counts = counts.withColumns({"accuracy": F.bround(1.0 - rate, 4), "penalty": F.bround(penalty, 4)})
    parts = [
        rows(labels, "label_mappings", F.col("key"), F.col("value")),
        rows(corrected, "ocr_corrections", F.col("key"), F.col("new")),
        rows(types, "doctype_fields", F.col("document_type"), None, F.col("fields")),
        rows(counts, "confidence_adjustments", F.col("field_name"), F.col("penalty")),
        rows(counts, "field_accuracy_rates", F.col("field_name"), F.col("accuracy")),
        rows(counts, "correction_counts", F.col("field_name"), F.to_json(F.struct("total", "corrections", "accuracy"))),
    ]
    return reduce(DataFrame.unionByName, parts)


def fold(patterns: DataFrame, learned: DataFrame) -> DataFrame:
    """Patterns with what was learned: the last value of a key stays, fields of a type are united, all other keys are kept."""
    new = learned.select("part", "key", F.col("value").alias("__value"), F.col("fields").alias("__fields"))
    both = patterns.join(new, ["part", "key"], "full_outer")
    none = F.array().cast("array<string>")
    united = F.array_sort(F.array_union(F.coalesce("fields", none), F.coalesce("__fields", none)))
    return both.select("part", "key", F.coalesce("__value", "value").alias("value"), F.when(F.col("part") == "doctype_fields", united).alias("fields"))


def measure(samples: DataFrame, patterns: DataFrame) -> DataFrame:
    """One row, accuracy: mean credit of the samples under patterns; 0.5 without any.

    A correction that the patterns foresee counts whole, half if only its label is known; a verified
    field counts if its penalty leaves it at half or more, an added one if its type is known to have it.
    """
    part = lambda name, *columns: patterns.filter(F.col("part") == name).select(*columns)
    corrections = part("ocr_corrections", F.col("key").alias("ckey"), F.col("value").alias("foreseen"))
    labels = part("label_mappings", F.col("key").alias("label"), F.col("value").alias("learned_key"))
    penalties = part("confidence_adjustments", F.col("key").alias("field_name"), F.col("value").cast("double").alias("penalty"))
    types = part("doctype_fields", F.col("key").alias("document_type"), F.explode("fields").alias("field_name"), F.lit(True).alias("known_field"))
    each = samples.withColumns({"ckey": F.concat("field_name", F.lit("::"), F.coalesce("original_value", F.lit(""))), "label": F.lower(strip(F.col("field_name")))})
    joined = each.join(corrections, "ckey", "left").join(labels, "label", "left").join(penalties, "field_name", "left").join(types, ["document_type", "field_name"], "left")
    sure = F.coalesce(F.nullif("ocr_confidence", F.lit(0.0)), F.lit(0.85)) + F.coalesce("penalty", F.lit(0.0)) >= 0.5
    kind = F.col("correction_type")
    credit = (
        F.when(kind == "auto_verified", F.when(sure, 1.0).otherwise(0.0))
        .when(kind == "value_correction", F.when(F.col("foreseen").eqNullSafe(F.col("corrected_value")), 1.0).when(F.col("learned_key") == F.col("canonical_key"), 0.5).otherwise(0.0))
        .when(kind == "field_added", F.when(F.col("known_field"), 1.0).otherwise(0.0)).otherwise(0.5)
    )
    return joined.agg(F.coalesce(F.avg(credit), F.lit(0.5)).alias("accuracy"))


def snapshots_of(spark: SparkSession, path: str) -> DataFrame:
    """version, counts, accuracies, accepted, deployed: of the accepted versions the last is the deployed one."""
    if not exists(spark, f"{path}/snapshots"):
        return spark.createDataFrame([], f"version long, {SNAPSHOTS}, deployed boolean")
    rows = spark.read.parquet(f"{path}/snapshots").withColumn("version", F.col("version").cast("long"))
    top = rows.filter("accepted").agg(F.max("version").alias("top"))  # one row
    return rows.join(F.broadcast(top)).withColumn("deployed", F.col("version").eqNullSafe(F.col("top"))).drop("top")


def patterns_of(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """part, key, value, fields of a version, of the deployed one if none is named; no rows where there is none."""
    if version is None:
        top = snapshots_of(spark, path).filter("deployed").select("version").first()
        version = top["version"] if top else None
    if version is None:
        return spark.createDataFrame([], PATTERNS)
    return spark.read.parquet(f"{path}/patterns/version={version}")


def cycle(spark: SparkSession, path: str, samples: DataFrame, train: Column, least: int = LEARN_AT) -> int | None:
    """Learn from samples that were not used, under the next version; the version, or None for less than `least` samples.

    `train` says which samples are learned from, the others measure (the last one by seq if there
    are no others). Patterns are written before the version's snapshot, which makes it
    count; a cycle that failed in between is done over.
    """
    unused = samples.filter(~F.col("used_in_training"))
    n, learned_from, last = unused.agg(F.count(F.lit(1)), F.count_if(train), F.max("seq")).first()
    if n < least:
        return None
    taken = train if learned_from else F.lit(True)
    aside = ~F.coalesce(taken, F.lit(False)) if 0 < learned_from < n else F.col("seq") == last
    done = snapshots_of(spark, path).agg(F.max("version")).first()[0]
    version = (done or 0) + 1
    before = patterns_of(spark, path)
    fold(before, learn(unused.filter(taken))).write.mode("overwrite").parquet(f"{path}/patterns/version={version}")
    scores = [measure(unused.filter(aside), p).first()[0] for p in (before, patterns_of(spark, path, version))]
    row = [(learned_from or n, unused.filter(aside).count(), *scores, scores[1] - scores[0], version == 1 or scores[1] >= scores[0])]
    spark.createDataFrame(row, SNAPSHOTS).coalesce(1).write.mode("overwrite").parquet(f"{path}/snapshots/version={version}")
    return version
