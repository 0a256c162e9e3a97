"""The stages of corpus_pipeline.py, each on its predecessor's rows."""

import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from recordloom.llm import neardup, quality, sharding

from .test_native import counts, fill

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before, texts = docs.columns, docs, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / str(k))
        stage(spark, before, sf_dir).write.parquet(path)
        out = spark.read.parquet(path)
        rows, had = out.collect(), before.collect()
        if k < 4:
            assert out.columns == columns
            assert set(map(str, rows)) <= set(map(str, had))
        ids = Counter(r["doc_id"] for r in rows)
        if name == "quality rules":
            want = {r["doc_id"] for r in had if not ((c := counts(r["text"]))[0] < 20 or 100 * c[4] > 30 * c[0])}
            assert set(ids) == want and max(ids.values()) == 1
            assert ids == Counter(r["doc_id"] for r in quality.judge(before).filter("kept").collect())
        elif name == "MinHash near-dedup":
            assert ids == Counter({r["class_id"]: 1 for r in neardup.group(before).collect()})
            assert len({r["text"] for r in rows}) == len(rows)
        elif name == "benchmark decontamination":
            items = [" ".join(re.findall(r"[^\W_]+", r["text"].lower())) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            lost = {r["doc_id"]: " ".join(re.findall(r"[^\W_]+", r["text"].lower())) for r in had if r["doc_id"] not in ids}
            assert lost and all(any(i in t for i in items) for t in lost.values())
            assert not any(i in " ".join(re.findall(r"[^\W_]+", r["text"].lower())) for r in rows for i in items)
        elif name == "mixing sources":
            size = {r["doc_id"]: len(WORD.findall(r["text"])) for r in had}
            sizes, taken, longest = Counter(), Counter(), Counter()
            for r in had:
                sizes[r["source"]] += size[r["doc_id"]]
                longest[r["source"]] = max(longest[r["source"]], size[r["doc_id"]])
            for r in rows:
                taken[r["source"]] += size[r["doc_id"]]
            want = fill(sizes)
            assert max(ids.values()) <= 2 and all(abs(taken[s] - want[s]) <= longest[s] for s in sizes)
        else:
            assert len(rows) == len(had) and Counter(r["doc_id"] for r in had) == ids
            shards = Counter(r["shard"] for r in rows)
            assert set(shards) == set(range(8)) and max(shards.values()) - min(shards.values()) <= 1
            assert {(r["shard"], r["slot"]) for r in rows} == {(s, i) for s, n in shards.items() for i in range(n)}
            assert all(r["text_crc32"] == zlib.crc32(r["text"].encode()) for r in rows)
        before = out


def test_empty(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


CLASHES = ["size", "shard", "slot", "row_number", "text_crc32", "__start", "__bucket", "__key", "__hit", "__node", "__bad", "__salt", "__src", "row", "host", "key", "id", "Failed", "a.b", "docs_size"]


def test_odd_documents_and_clashing_names(spark, sf_dir, odd_docs):
    """Nulls in any column, empty and very long texts, ties, repeated rows, names that the stages use themselves."""
    wide = odd_docs.select("doc_id", "text", "lang", "source", "n_chars", *[F.concat(F.lit(f"{n} "), F.col("doc_id").cast("string")).alias(n) for n in CLASHES])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, wide, sf_dir)
        rows, had = out.collect(), wide.collect()
        if name != "sharding":
            assert out.columns == wide.columns
            assert set(map(str, rows)) <= set(map(str, had))
        else:
            kept = ["doc_id", *(("docs_" if c in ("shard", "slot", "row_number", "text_crc32") else "docs_docs_" if c == "size" else "") + c for c in wide.columns[1:])]
            assert out.columns == [*kept, "size", "text_crc32", "shard", "slot", "row_number"]
            assert Counter(tuple(r)[: len(kept)] for r in rows) == Counter(map(tuple, had))


def test_a_column_is_lost_nowhere_when_names_differ_in_case(spark, odd_docs):
    out = sharding.shard(odd_docs.select("doc_id", "text", F.lit(1).alias("SIZE")), carry=True)
    assert out.columns == ["doc_id", "text", "docs_SIZE", "size", "text_crc32", "shard", "slot", "row_number"]
