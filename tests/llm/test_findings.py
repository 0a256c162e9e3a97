"""Cases in which an operator once did less than its whole job."""

from collections import Counter

from recordloom.llm import decontamination


def test_clean_rows_stay_beside_contaminated_ones_of_their_id(spark, sf_dir):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    item = bench.filter("item_id = 2").first()["text"]
    rows = [(None, item), (None, "clean without an id"), (None, None), (7, "before " + item), (7, "clean with the same id"), (7, "clean with the same id"), (8, item)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS node", "2 AS item_id")
    kept = decontamination.keep_clean(df, bench)
    assert kept.columns == df.columns
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter([rows[1], rows[2], rows[4], rows[5]])
