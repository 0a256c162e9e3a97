"""op1_mix_sources has a row for each document, range-sorted by training position, with the positions of all its copies."""

from collections import Counter

from recordloom.llm import mixing, queries


def test_query_is_in_order(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = Counter((r["doc_id"], r["taken"], ",".join(f"{p:.9f}" for p in r["positions"])) for r in mixing.mix(docs).collect())
    rows = queries.op1_mix_sources(spark, sf_dir).collect()
    assert Counter((r["doc_id"], r["taken"], r["positions"]) for r in rows) == want
    assert {len(r["positions"].split(",")) for r in rows if r["positions"]} == {1, 2}
    at = [float(r["positions"].split(",")[0] or 2) for r in rows]
    assert at == sorted(at) and at[-1] == 2
