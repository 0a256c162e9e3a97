"""Columns of the caller's with names that operators use inside, and the joined way of taking hits out."""

from collections import Counter

from pyspark.sql import functions as F

from recordloom.llm import decontamination, jaccard, runs, tokens, warc, whitening

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
NAMES = ["payload", "holder", "digest", "node", "proof", "names", "n", "grams", "unit", "side", "root", "sum", "runs", "x", "row", "shard", "slot", "part", "ids", "sequence", "key", "hit", "hit_node", "id", "first"]


def clashing(df):
    """The same rows with a column of each of the names."""
    return df.select("*", *[F.lit(k).alias(c) for k, c in enumerate(NAMES) if c not in df.columns])


def same(a, b):
    return Counter(map(str, a.collect())) == Counter(map(str, b.collect()))


def test_warc(spark, sf_dir, tmp_path):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    plain, other = (warc.round_trip(df, f"file://{tmp_path}/{k}").select(columns) for k, df in enumerate((pages, clashing(pages))))
    assert same(plain, other)


def test_tokens(spark, odd_docs, tmp_path):
    plain, other = (tokens.materialised(df, VOCABULARY, f"file://{tmp_path}/{k}", length=64) for k, df in enumerate((odd_docs.select("doc_id", "text"), clashing(odd_docs))))
    assert same(plain, other)


def test_narrow_operators(spark, odd_docs, sf_dir):
    assert same(runs.scan(odd_docs.select("doc_id", "text"), planted=True), runs.scan(clashing(odd_docs), planted=True))
    assert same(jaccard.join(odd_docs.select("doc_id", "text")), jaccard.join(clashing(odd_docs)))
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").limit(60)
    rows = [whitening.whiten(df).select("vec_id", "n", "deviation").collect() for df in (vectors.select("vec_id", "embedding"), clashing(vectors))]
    assert Counter(rows[0]) == Counter(rows[1])


def test_hits_are_taken_out_by_a_join_as_by_a_broadcast(spark, odd_docs, sf_dir, monkeypatch):
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    leaked = benchmark.limit(3).select(F.col("item_id").alias("doc_id"), F.concat(F.lit("before "), "text", F.lit(" after")).alias("text"))
    docs = clashing(odd_docs.select("doc_id", "text").unionByName(leaked.withColumn("doc_id", F.col("doc_id").cast("long"))).unionByName(leaked.select(F.lit(None).cast("long").alias("doc_id"), "text")))
    kept = decontamination.keep_clean(docs, benchmark)
    assert kept.columns == docs.columns and kept.count() == odd_docs.count()
    monkeypatch.setattr(decontamination, "BROADCAST_HITS", 0)
    assert same(kept, decontamination.keep_clean(docs, benchmark))
