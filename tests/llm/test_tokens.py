"""Operator 10 by exact round trip."""

from collections import Counter, defaultdict

import numpy as np

from recordloom.llm import tokens
from recordloom.llm.secrets import encoder

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def test_round_trip(spark, odd_docs, odd_rows, no_docs, tmp_path):
    folder = f"file://{tmp_path}/a"
    got = tokens.materialised(odd_docs, VOCABULARY, folder, length=64, shard_bytes=64 * 200, buckets=7).collect()
    enc, reader = encoder(VOCABULARY), tokens.Reader(folder)
    n = reader.format["sequences"]
    assert sorted(r["slot"] for r in got) == list(range(n)) and len({r["shard"] for r in got}) > 3
    records = reader.read(0, n + 5)
    assert len(records) == n
    texts, now = defaultdict(list), {}
    first = [records[reader.slot_of(s)] for s in range(n)]  # sequences in order of their numbers
    for rec in first:
        if rec["part"] == 0:
            now = []
            texts[int(rec["doc_id"])].append(now)
        assert len(now) == rec["part"] * 64 and (rec["ids"][rec["used"] :] == tokens.END).all()
        now.extend(rec["ids"][: rec["used"]].tolist())
    want = Counter((tokens.NO_ID if r[0] is None else r[0], r[1] or "") for r in odd_rows)
    read = Counter()
    for i, runs in texts.items():
        for ids in runs:
            assert ids[-1] == tokens.END
            read[i, enc.decode(ids[:-1])] += 1
    assert read == want
    for a, k in ((0, 7), (n - 3, 9), (n // 2, 40)):
        assert (reader.read(a, k) == records[a : a + k]).all()
    again = tokens.materialised(odd_docs.repartition(5), VOCABULARY, f"file://{tmp_path}/b", length=64, shard_bytes=64 * 200, buckets=900)
    assert again.count() == n and (tokens.Reader(f"file://{tmp_path}/b").read(0, n) == records).all()
    assert tokens.materialised(no_docs, VOCABULARY, f"file://{tmp_path}/c").count() == 0


def test_real_documents(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = tokens.materialised(docs, VOCABULARY, f"file://{tmp_path}/d").collect()
    enc, counts = encoder(VOCABULARY), Counter()
    for r in got:
        counts[r["doc_id"]] += r["n_tokens"]
    assert counts == Counter({r["doc_id"]: len(enc.encode_ordinary(r["text"])) + 1 for r in docs.collect()})
    slots = np.array([r["slot"] for r in sorted(got, key=lambda r: (r["doc_id"], r["part"]))])
    assert abs(np.corrcoef(np.arange(len(slots)), slots)[0, 1]) < 0.2
