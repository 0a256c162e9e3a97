"""Confidence reports, page aggregates and routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import confidence_category, field_score


def confidence_report(fields: DataFrame, adjustments: DataFrame | None = None, added_by: list[str] | None = None) -> DataFrame:
    """document_id, overall, category, counts by category and the names of low fields in order.

    `adjustments` (field_name, adjustment) is what was learned; it is joined by name. Scores are
    summed as decimals, so the mean, and a category at its floor, do not depend on the order of rows.
    With `added_by`, columns that give the rows of a document an order, they are summed as doubles in it.
    """
    if adjustments is not None:
        fields = fields.join(adjustments, "field_name", "left")
    else:
        fields = fields.withColumn("adjustment", F.lit(0.0))
    scored = fields.withColumn("score", field_score(F.col("confidence"), F.col("adjustment"))).withColumn("class", confidence_category(F.col("score")))
    low = F.sort_array(F.collect_list(F.when(F.col("class").isin("LOW", "UNCERTAIN"), F.struct("seq", "field_name"))))
    counts = [F.count_if(F.col("class") == c).alias(f"n_{c.lower()}") for c in ("HIGH", "MEDIUM", "LOW", "UNCERTAIN")]
    if added_by:
        so_far = Window.partitionBy("document_id").orderBy(*added_by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        scored = scored.withColumn("so_far", F.sum("score").over(so_far))
        total = F.max_by("so_far", F.struct(*added_by))
    else:
        total = F.sum(F.col("score").cast("decimal(20,18)")).cast("double")
    mean = total / F.count("score")
    out = scored.groupBy("document_id").agg(mean.alias("overall"), *counts, low.alias("low"))
    return out.withColumn("category", confidence_category(F.col("overall"))).withColumn("flagged", F.col("low.field_name")).drop("low")


def page_summaries(blocks: DataFrame) -> DataFrame:
    """document_id, page, text of non-blank blocks in order, mean of confidences above 0, engines."""
    shown = F.when(F.trim("text") != "", F.struct("block", "text"))
    mean = F.coalesce(F.avg(F.when(F.col("confidence") > 0, F.col("confidence"))), F.lit(0.0))
    agg = blocks.groupBy("document_id", "page").agg(
        F.sort_array(F.collect_list(shown)).alias("t"), mean.alias("avg_confidence"), F.array_join(F.array_sort(F.collect_set("engine")), ", ").alias("engines")
    )
    return agg.withColumn("text", F.array_join(F.col("t.text"), "\n")).drop("t")


def document_confidence(blocks: DataFrame) -> DataFrame:
    """Mean of page means, and mean of all blocks: the two differ where pages do."""
    pages = page_summaries(blocks).groupBy("document_id").agg(F.avg("avg_confidence").alias("by_page"))
    flat = blocks.groupBy("document_id").agg(F.avg(F.when(F.col("confidence") > 0, F.col("confidence"))).alias("by_block"))
    return pages.join(flat, "document_id")


def route(anomalous: Column, ml_flag: Column, category: Column, mismatch: Column, duplicate: Column) -> Column:
    """VERIFICATION_REQUIRED where anything speaks for it, else COMPLETED."""
    review = anomalous | ml_flag | category.isin("LOW", "UNCERTAIN") | mismatch | duplicate
    return F.when(F.coalesce(review, F.lit(False)), "VERIFICATION_REQUIRED").otherwise("COMPLETED")


def low_blocks(pages: DataFrame, threshold: float = 0.65, engines: str = "paddle|tesseract", whole: bool = False) -> DataFrame:
    """Blocks that may be handwriting: of an OCR engine, below the threshold, two characters or more."""
    engine = lambda b: b["engine"].rlike(f"^(?:{engines})$" if whole else engines)
    keep = lambda b: engine(b) & (F.coalesce(b["confidence"], F.lit(1.0)) < threshold) & (F.length(F.trim(b["text"])) >= 2)
    return pages.select("document_id", "page", F.inline(F.filter("blocks", keep)))


def majority(votes: DataFrame) -> DataFrame:
    """Winning script of page votes by document; confidence min(share * 0.85 + 0.15, 0.97)."""
    counts = votes.groupBy("document_id", "script").agg(F.count(F.lit(1)).alias("n"))
    top = counts.groupBy("document_id").agg(F.max_by("script", F.struct("n", "script")).alias("script"), F.max("n").alias("n"), F.sum("n").alias("total"))
    return top.select("document_id", "script", F.least(F.col("n") / F.col("total") * 0.85 + 0.15, F.lit(0.97)).alias("confidence"))
