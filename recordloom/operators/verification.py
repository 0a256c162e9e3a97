"""Extracted values against a reference registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import vocabulary as V
from ..functions.text import compare_form, strip

IDENTIFIERS = ["survey_number", "khasra_number", "khata_number", "plot_number", "registration_number"]
VERIFIABLE = [*IDENTIFIERS, "mutation_number", "owner_name", "father_name", "village", "tehsil", "district", "state", "area"]


def lookup(extracted: DataFrame, reference: DataFrame, identifiers: list[str] = IDENTIFIERS, extra: list[str] = ()) -> DataFrame:
    """document_id, ref_id: the reference row that agrees on every identifier given; of several the lowest id.

    Which identifiers a document gives is its mask. For each mask that occurs, the
    reference is reduced to the lowest id of every set of those values, and a document meets
    just that row: as many rows as documents, however common a value is. None given, no match.
    """
    keys = [*identifiers, *extra]
    bit = [1 << i for i in range(len(keys))]
    wide = extracted.select("document_id", *[F.nullif(strip(F.col(c)), F.lit("")).alias(c) for c in keys])
    mask = sum((F.when(F.col(c).isNotNull(), F.lit(b)).otherwise(0) for c, b in zip(keys, bit)), F.lit(0))
    said = F.array(*[F.coalesce(c, F.lit("")) for c in keys])
    asked = wide.select("document_id", mask.alias("mask"), said.alias("said")).filter("mask > 0")
    masks = [r["mask"] for r in asked.select("mask").distinct().collect()]  # kinds of documents: 2 to the number of keys at most
    held = F.array(*[F.col(c).cast("string") for c in keys])
    has = sum((F.when(F.col(c).isNotNull(), F.lit(b)).otherwise(0) for c, b in zip(keys, bit)), F.lit(0))
    every = reference.select("ref_id", held.alias("held"), has.alias("has"), F.explode(F.array(*[F.lit(m) for m in masks]).cast("array<int>")).alias("mask"))
    used = F.array(*[F.when(F.col("mask").bitwiseAND(F.lit(b)) != 0, F.get("held", F.lit(i))).otherwise(F.lit("")) for i, b in enumerate(bit)])
    known = every.filter(F.col("has").bitwiseAND(F.col("mask")) == F.col("mask")).groupBy("mask", used.alias("said")).agg(F.min("ref_id").alias("ref_id"))
    return asked.join(known, ["mask", "said"]).select("document_id", "ref_id")


def parcel_of(extracted: DataFrame, parcels: DataFrame, identifiers: list[str] = IDENTIFIERS, extra: list[str] = ()) -> DataFrame:
    """document_id, ref_id, matched (the identifiers given), ring: a document's parcel, among those that have a geometry."""
    drawn = parcels.filter(F.size("ring") >= 3)
    keys = [*identifiers, *extra]
    given = F.filter(F.array(*[F.when(F.nullif(strip(F.col(c)), F.lit("")).isNotNull(), c) for c in keys]), lambda x: x.isNotNull())
    found = lookup(extracted, drawn, identifiers, extra).join(extracted.select("document_id", given.alias("matched")), "document_id")
    return found.join(drawn.select("ref_id", "ring"), "ref_id").select("document_id", "ref_id", "matched", "ring")


def registry_match(extracted: DataFrame, registry: DataFrame, keys: list[str]) -> DataFrame:
    """document_id, ref_id, match_score (identifiers given over 3, 1 at most), status."""
    given = sum((F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in keys), F.lit(0))
    out = extracted.select("document_id", given.alias("n")).join(lookup(extracted, registry, keys), "document_id", "left")
    score = F.when(F.col("ref_id").isNotNull(), F.least(F.lit(1.0), F.col("n") / 3)).otherwise(0.0)
    return out.select("document_id", "ref_id", F.bround(score, 2).alias("match_score"), F.when(F.col("ref_id").isNull(), "NOT_FOUND").otherwise("MATCHED").alias("status"))


def compare(fields: DataFrame, matches: DataFrame, reference: DataFrame, keys: list[str] = VERIFIABLE, compat: bool = True) -> DataFrame:
    """Fields (document_id, seq, canonical_key, field_value) with reference_value and verification status."""
    long = reference.unpivot("ref_id", [F.col(c).cast("string").alias(c) for c in keys], "canonical_key", "reference_value").withColumn("canonical_key", F.upper("canonical_key"))
    placed = fields.join(matches, "document_id", "left").join(long, ["ref_id", "canonical_key"], "left")
    known = F.col("canonical_key").isin([k.upper() for k in keys])
    same = compare_form(F.col("field_value"), compat) == compare_form(F.col("reference_value"), False)
    status = F.when(~F.coalesce(known, F.lit(False)), "NOT_VERIFIABLE").when(F.col("reference_value").isNull(), "NOT_FOUND").when(same, "MATCH").otherwise("MISMATCH")
    return placed.select("document_id", "seq", "canonical_key", "field_value", "reference_value", status.alias("status"), F.col("ref_id").isNotNull().alias("has_reference"))


def overall(compared: DataFrame) -> DataFrame:
    """document_id, counts by status and the overall verdict."""
    n = {s: F.count_if(F.col("status") == s).alias(s.lower()) for s in ("MATCH", "MISMATCH", "NOT_FOUND", "NOT_VERIFIABLE")}
    counts = compared.groupBy("document_id").agg(*n.values(), F.bool_or("has_reference").alias("has_reference"))
    verdict = (
        F.when(~F.col("has_reference"), "NOT_FOUND").when(F.col("mismatch") > 0, "MISMATCH_DETECTED").when((F.col("match") > 0) & (F.col("not_found") == 0), "VERIFIED")
        .when(F.col("match") > 0, "PARTIALLY_VERIFIED").when(F.col("not_found") > 0, "UNVERIFIED").otherwise("NOT_VERIFIABLE")
    )
    return counts.withColumn("overall", verdict)


def enrich(fields: DataFrame, validity: DataFrame, scores: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Fields with what three reports say of their names; of equal names the last report stays."""
    def last(df: DataFrame, value: str) -> DataFrame:
        return df.groupBy("document_id", "field_name").agg(F.max_by(value, "seq").alias(value))

    on = ["document_id", "field_name"]
    out = fields.join(last(validity, "is_valid"), on, "left").join(last(scores, "score"), on, "left").join(last(verdicts, "status"), on, "left")
    valid = F.coalesce("is_valid", F.lit(True))
    status = F.when(~valid, "invalid").when(F.col("status") == "MISMATCH", "mismatch").when(F.coalesce("score", F.lit(1.0)) < 0.6, "review_needed").otherwise("valid")
    return out.withColumn("is_valid", valid).withColumn("validation_status", status)


def first_unseen(fields: DataFrame, legacy: DataFrame) -> DataFrame:
    """All fields, and of the older extractor the first of each type that fields lack."""
    rank = F.row_number().over(Window.partitionBy("document_id", "canonical_key").orderBy("seq"))
    one = legacy.withColumn("__r", rank).filter("__r = 1").drop("__r")
    return fields.unionByName(one.join(fields.select("document_id", "canonical_key").distinct(), ["document_id", "canonical_key"], "left_anti"))


def flag_fields(fields: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Each anomaly of a document marks the first unmarked field whose name has one of the words, in order.

    Greedy by nature. The k-th anomaly takes the k-th field in the order (word, seq) as
    the texts of anomalies are not looked at, so ranks say the same as the loop.
    """
    rank = F.least(*[F.when(F.contains(F.lower("field_name"), F.lit(w)), F.lit(i)) for i, w in enumerate(V.ANOMALY_WORDS)], F.lit(99))
    ranked = fields.withColumn("__w", rank).withColumn("__k", F.when(F.col("__w") < 99, F.row_number().over(Window.partitionBy("document_id").orderBy("__w", "seq"))))
    texts = anomalies.withColumn("__k", F.row_number().over(Window.partitionBy("document_id").orderBy("seq"))).select("document_id", "__k", F.col("anomaly").alias("anomaly_reason"))
    return ranked.join(texts, ["document_id", "__k"], "left").withColumn("anomaly_flag", F.col("anomaly_reason").isNotNull()).drop("__w", "__k")


def link_results(validation: DataFrame, results: DataFrame) -> DataFrame:
    """Validation rows with the id of the document's last result of that name."""
    ids = results.groupBy("document_id", "field_name").agg(F.max_by("result_id", "seq").alias("field_result_id"))
    return validation.join(ids, ["document_id", "field_name"], "left")


def visible_to(rows: DataFrame, users: DataFrame, username: str, roles: list[str]) -> DataFrame:
    """The rows if the user is active and has one of the roles, else none."""
    granted = users.filter((F.col("username") == username) & F.col("is_active") & F.col("role").isin(roles)).select(F.lit(1).alias("__granted")).limit(1)
    return rows.withColumn("__granted", F.lit(1)).join(granted, "__granted", "left_semi").drop("__granted")


def visible(rows: DataFrame, users: DataFrame, grants: DataFrame) -> DataFrame:
    """username and the rows that each active user may see: those of resources granted to the user's role. `rows` and `grants` (role, resource) name resources."""
    may = users.filter("is_active").join(grants.select("role", "resource").distinct(), "role").select("username", "resource").distinct()
    return rows.join(may, "resource")
