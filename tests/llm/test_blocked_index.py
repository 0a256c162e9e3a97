"""Scores of op3_decontaminate do not depend on how a benchmark is split into blocks."""

import pytest

from recordloom.llm import decontamination


def test_blocks_score_as_one_index(spark, sf_dir):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    got = [{(r["doc_id"], r["item_id"]): (r["score"], r["score_share"]) for r in decontamination.leaks(docs, bench, share=0.2, overlap=0.0, most=most).collect()} for most in (5_000, 60)]
    assert got[0] and got[0].keys() == got[1].keys()
    assert all(got[1][k] == pytest.approx(v) for k, v in got[0].items())
