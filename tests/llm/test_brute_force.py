"""Whole results of op3_decontaminate and op10_token_shards against brute force."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from recordloom.llm import decontamination, queries, sharding, tokens
from recordloom.llm.secrets import encoder


def brute_leaks(docs, items, share, overlap):
    """Every window of every document against every item."""
    items = [(i, t, decontamination.hashed(t)) for i, t in items if len(decontamination.hashed(t))]
    assert all(len(w) <= decontamination.PART for _, _, w in items)
    df = Counter(w for *_, d in items for w in set(d.tolist()))
    mean = np.mean([len(d) for *_, d in items])
    kind = [int(np.searchsorted(decontamination.LENGTHS, len(d))) for *_, d in items]
    stride = {k: max(len(d) for (*_, d), x in zip(items, kind) if x == k) for k in set(kind)}
    weights, own = [], []
    for *_, d in items:
        tf = Counter(d.tolist())
        weights.append({w: np.log1p((len(items) - df[w] + 0.5) / (df[w] + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(d) / mean)) for w, n in tf.items()})
        own.append(sum(weights[-1].values()))
    checks = [[(min(5, len(w)), set(decontamination.grams(w, min(5, len(w))).tolist())) for w in map(decontamination.hashed, decontamination.halves(t))] for _, t, _ in items]
    out = {}
    for doc_id, text in docs:
        words = decontamination.hashed(text or "").tolist()
        for k, (item_id, *_) in enumerate(items):
            size = stride[kind[k]]
            windows = [set(words[a : a + 2 * size]) for a in range(0, len(words), size)]
            best = max((sum(weights[k].get(w, 0.0) for w in s) / own[k] for s in windows), default=0.0)
            if best >= share - 1e-9:
                have = [set(decontamination.grams(np.array(words, np.uint64), n).tolist()) for n, _ in checks[k]]
                found = [len(want & h) / len(want) if want else 1.0 for (_, want), h in zip(checks[k], have)]
                if min(found) >= overlap:
                    out[doc_id, item_id] = (best, *found)
    return out


@pytest.mark.parametrize("share,overlap", [(decontamination.SHARE, decontamination.OVERLAP), (0.3, 0.0)])
def test_leaks_are_those_of_brute_force(spark, sf_dir, share, overlap):
    docs, bench = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "benchmark"))
    want = brute_leaks([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in bench.collect()], share, overlap)
    for most in (5_000, 7):
        got = {(r["doc_id"], r["item_id"]): (r["score_share"], r["question_overlap"], r["answer_overlap"]) for r in decontamination.leaks(docs, bench, share, overlap, most).collect()}
        assert want and got.keys() == want.keys()
        assert all(got[k] == pytest.approx(v) for k, v in want.items())


def test_token_shards_are_those_of_brute_force(spark, sf_dir):
    docs = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    enc = encoder(queries.VOCABULARY)
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    sequences = []
    for doc_id, text in sorted(docs, key=lambda d: (md5(f"{d[0]}:{md5(d[1])}"), d[0])):
        ids = np.array([*enc.encode_ordinary(text), tokens.END], tokens.dtype_of(tokens.END + 1))
        sequences += [(doc_id, k, ids[a : a + tokens.LENGTH]) for k, a in enumerate(range(0, len(ids), tokens.LENGTH))]
    slots = sharding.Feistel(len(sequences), tokens.KEY).forward(np.arange(len(sequences)))
    want = {(int(s), d, k, len(x), hashlib.sha1(x.tobytes()).hexdigest()) for s, (d, k, x) in zip(slots, sequences)}
    rows = queries.op10_token_shards(spark, sf_dir).collect()
    assert {(r["slot"], r["doc_id"], r["part"], r["n_tokens"], r["ids_sha1"]) for r in rows} == want and len(rows) == len(sequences)
