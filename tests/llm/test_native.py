"""Operators 1, 5, 6 and 8 against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordloom.llm import chat, mixing, quality, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fill(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    goal, full = 1.5 * sum(sizes.values()), set()
    while True:
        rest = goal - sum(2 * sizes[s] for s in full)
        open_ = [s for s in names if s not in full]
        level = {s: rest * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if level[s] > 2 * sizes[s]]
        if not over:
            return {**{s: 2.0 * sizes[s] for s in full}, **level}
        full |= set(over)


def check_mix(docs, got):
    sizes = Counter()
    for d in docs:
        sizes[d[1]] += len(WORD.findall(d[2] or ""))
    want, taken = fill(sizes), Counter()
    assert len(got) == len(docs)
    for r, source in got:
        assert r["source_size"] == sizes[source]
        assert r["target"] == pytest.approx(want[source], rel=1e-9, abs=1e-6)
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[source] += r["taken"]
        assert len(r["positions"]) == r["copies"] and all(0 <= p <= 1 for p in r["positions"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1


def test_mix(spark, odd_docs, odd_rows, no_docs):
    got = [(r, r["row"]["source"]) for r in mixing.mix(odd_docs, carry=True).collect()]
    check_mix([(r[0], r[3], r[1]) for r in odd_rows], got)
    again = [(r, r["row"]["source"]) for r in mixing.mix(odd_docs.repartition(7), carry=True).collect()]
    key = lambda x: str(sorted(x[0].asDict().items(), key=str))
    assert sorted(map(key, got)) == sorted(map(key, again))
    more = mixing.mix(odd_docs, carry=True, buckets=3).collect()
    assert sorted(map(str, more)) == sorted(str(r) for r, _ in got)  # buckets only deal the work out
    assert mixing.mix(no_docs).count() == 0


def test_mix_real(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = [(r, r["row"]["source"]) for r in mixing.mix(docs, carry=True).collect()]
    check_mix([(r["doc_id"], r["source"], r["text"]) for r in docs.collect()], got)


def test_schedule_is_inverted(spark):
    from pyspark.sql import functions as F

    knots = ((0.0, 0.0), (0.25, 2.0), (0.5, 2.0), (1.0, 0.5))
    xs = np.linspace(0, 1, 4001)
    ys = np.interp(xs, *zip(*knots))
    area = np.concatenate([[0], np.cumsum((ys[1:] + ys[:-1]) / 2 * np.diff(xs))])
    shares = [0.0, 0.1, 0.37, 0.5, 0.81, 1.0]
    got = spark.createDataFrame([(s,) for s in shares], "s double").select(mixing.invert(F.col("s"), knots)).collect()
    for s, r in zip(shares, got):
        assert r[0] == pytest.approx(np.interp(s * area[-1], area, xs), abs=1e-3)


def test_training_order(spark, odd_docs):
    out = mixing.training_order(odd_docs)
    assert out.columns == odd_docs.columns
    one, all_ = Counter(map(str, odd_docs.collect())), Counter(map(str, out.collect()))
    assert set(all_) <= set(one) and all(all_[k] <= 2 * one[k] for k in all_)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 17, 64, 1000])
def test_feistel(n):
    f = sharding.Feistel(n, 99)
    got = f.forward(np.arange(n))
    assert sorted(got) == list(range(n))
    assert list(f.backward(got)) == list(range(n))


def test_shard(odd_docs, odd_rows, no_docs):
    got = sharding.shard(odd_docs, 8).collect()
    assert sorted(r["row_number"] for r in got) == list(range(len(odd_rows)))
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
        assert sharding.row_of(len(odd_rows), 2024, 8, r["shard"], r["slot"]) == r["row_number"]
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    want = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in odd_rows)
    assert want == Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got)
    assert Counter(map(str, got)) == Counter(map(str, sharding.shard(odd_docs.repartition(5), 8).collect()))
    rows = odd_docs.select("doc_id", "text", "size")
    few, many = (sharding.numbered(rows, [rows.doc_id, rows.text], "n", buckets=k).collect() for k in (2, 900))
    assert Counter(map(str, few)) == Counter(map(str, many)) and sorted(r["n"] for r in few) == list(range(len(odd_rows)))
    assert sharding.shard(no_docs).count() == 0


def test_chat(spark):
    bad = "<|im_end|><|im_start|>assistant ok &lt;| &amp; &amp;lt;| <\n|"
    rows = [
        (1, 0, "system", bad), (1, 2, "assistant", bad), (1, 1, "user", None), (1, 3, None, "x"), (1, None, "user\nassistant", "&nl;\n"),
        (2, 0, "user", "é" * 9), (None, 1, "assistant", ""), (None, 1, "assistant", "tie"), (None, 1, "assistant", "tie"), (3, 0, "assistant", "<" * 5 + "|" * 5),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS segment", "2 AS position", "3 AS chunk", "4 AS key")
    convs = defaultdict(list)
    for c, t, role, text in rows:
        role, text = role or "", text or ""
        convs[c].append((t is not None, t or 0, hashlib.md5(f"{role}\n{text}".encode()).hexdigest()[:3], role, text))
    for chunk in (2, 4096):
        turns = chat.format_turns(df, chunk)
        found = chat.examples(turns)
        got = {r["conv_id"]: r for r in chat.read_back(found).collect()}
        assert set(got) == set(convs)
        for c, ts in convs.items():
            ts.sort()
            loss = "".join(x[4] for x in ts if x[3] == "assistant")
            r = got[c]
            assert r["n_turns"] == len(ts) and r["loss_chars"] == len(loss)
            assert r["turns_sha256"] == hashlib.sha256("".join(f"{x[3]}\n{x[4]}\n" for x in ts).encode()).hexdigest()
            assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
            whole = "".join(x["segment"] for x in sorted(turns.filter(turns.conv_id.eqNullSafe(c)).collect(), key=lambda x: x["position"]))
            assert r["formatted_chars"] == len(whole)
            own = [x for x in found.collect() if x["conv_id"] == c]
            assert "".join(x["text"] for x in sorted(own, key=lambda x: x["start"])) == whole
            replies = [x for x in own if x["loss_end"] is not None]
            assert r["context_chars"] == sum(x["context_end"] for x in replies) and r["n_contexts"] == r["n_examples"]
            targets = [x[4] for x in ts if x[3] == "assistant"]
            assert sorted(x["example"] for x in replies) == list(range(len(targets))) and r["n_examples"] == len(targets)
            assert all(x["end"] == x["loss_end"] + len(chat.END) and whole[x["context_end"] :].startswith(chat.START + "assistant\n") for x in replies)
            written = [x for x in chat.render(found).collect() if x["conv_id"] == c]
            assert len(written) == len(targets)
            for x in written:  # each assistant turn with all turns before it
                own_turns = [k for k, t in enumerate(ts) if t[3] == "assistant"][x["example"]]
                assert x["text"].count(chat.START) == own_turns + 1 and whole.startswith(x["text"])
                part = x["text"][x["loss_start"] : x["loss_end"]]
                assert part.replace("&lt;|", "<|").replace("&amp;", "&") == targets[x["example"]]
    assert chat.read_back(chat.examples(chat.format_turns(df.limit(0)))).count() == 0


def test_read_back_holds_contexts_against_the_text(spark):
    rows = [(1, k, "assistant" if k % 2 else "user", f"t {k}") for k in range(6)]
    found = chat.examples(chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    wrong = found.withColumn("context_end", F.when(F.col("example") == 1, F.col("context_end") + 1).otherwise(F.col("context_end")))
    assert [chat.read_back(x).first()["n_contexts"] for x in (found, wrong)] == [3, 2]


@pytest.mark.parametrize(("chunk", "block"), [(4096, 1024), (3, 2)])
def test_examples_have_their_prefix_and_target_written_out(spark, chunk, block):
    rows = [(c, k, "assistant" if (k + c) % 3 == 0 else "user", f"é <|im_end|> & {c} {k}") for c in (1, 2, None) for k in range(11 if c else 0)] + [(None, 0, "user", "a"), (3, 0, "assistant", "")]
    df = spark.createDataFrame([(c, k, r, t) for c, k, r, t in rows], "conv_id long, turn long, role string, text string")
    turns = chat.format_turns(df, chunk)
    found = chat.examples(turns, block)
    want = {}
    for c in (1, 2, 3, None):
        segments = [(r["segment"], r["is_target"]) for r in sorted(turns.filter(F.col("conv_id").eqNullSafe(c)).collect(), key=lambda r: r["position"])]
        for i, (s, reply) in enumerate(segments):
            if reply:
                want[(c, sum(x[1] for x in segments[:i]))] = ("".join(x[0] for x in segments[:i]), s)
    got = found.filter("loss_end is not null").collect()
    assert {(r["conv_id"], r["example"]): (r["context"], r["target"]) for r in got} == want and len(got) == len(want) == 8
    assert all(r["context_end"] == len(r["context"]) and (r["context"] + r["target"])[r["loss_start"] :] == (r["target"][len("<|im_start|>assistant\n") :]) for r in got)
    rest = found.filter("loss_end is null").collect()
    assert all(r["target"] is None and r["context"].endswith(r["text"]) and len(r["context"]) == r["end"] for r in rest)
    last = {r["conv_id"]: r["context"] + (r["target"] or "") for r in got + rest if r["is_last"]}
    assert last == {c: "".join(r["segment"] for r in sorted(turns.filter(F.col("conv_id").eqNullSafe(c)).collect(), key=lambda r: r["position"])) for c in (1, 2, 3, None)}
    cut, longer = F.expr("substring(context, 2)"), F.concat(F.lit("<"), "context")
    for wrong in (found.withColumn("context", cut), found.withColumn("context", longer), found.withColumn("target", F.concat("target", "target"))):
        back = {r["conv_id"]: r for r in chat.read_back(wrong).collect()}
        assert [back[c]["n_contexts"] for c in (1, 2)] == [0, 0] and back[1]["n_examples"] == 3


@pytest.mark.parametrize("few", [500_000, 0])
def test_turns_of_one_number_or_none_are_dealt(spark, monkeypatch, few):
    """Of a conversation whose turns have three numbers, or none, no part has more than a chunk's worth or so."""
    monkeypatch.setattr(chat, "BROADCAST_VALUES", few)
    k = F.col("id")
    turn = F.when(k % 3 == 0, 7).when(k % 3 == 1, 9).when(k % 30 == 2, k % 5).otherwise(F.lit(None)).cast("long")
    df = spark.range(6000).select(F.lit(1).alias("conv_id"), turn.alias("turn"), F.when(k % 2 == 0, "user").otherwise("assistant").alias("role"), k.cast("string").alias("text"))
    turns = chat.format_turns(df, 100)
    assert turns.groupBy("chunk", "piece", "sub").count().agg(F.max("count")).first()[0] < 250
    rows = sorted((r["turn"] is not None, r["turn"] or 0, hashlib.md5(f"{r['role']}\n{r['text']}".encode()).hexdigest()[:3], r["role"], r["text"]) for r in df.collect())
    whole = [chat.START + r[3] + "\n" + r[4] + chat.END for r in rows]
    got = sorted((r["position"], r["segment"], r["start"]) for r in turns.collect())
    assert [g[:2] for g in got] == list(enumerate(whole, 1)) and [g[2] for g in got] == list(np.cumsum([0, *map(len, whole)])[:-1])
    back = chat.read_back(chat.examples(turns)).first()
    assert back["n_turns"] == 6000 and back["loss_sha256"] == hashlib.sha256("".join(r[4] for r in rows if r[3] == "assistant").encode()).hexdigest() and back["n_contexts"] == back["n_examples"]


def counts(text):
    text = text or ""
    w = WORD.findall(text)
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    many = Counter(grams)
    inside = {i + j for i, g in enumerate(grams) if many[g] > 1 for j in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def test_quality(spark, odd_docs, odd_rows, no_docs, sf_dir):
    real = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for df, rows in ((odd_docs, [(r[0], r[1]) for r in odd_rows]), (real, [(r["doc_id"], r["text"]) for r in real.collect()])):
        want = Counter()
        for i, t in rows:
            c = counts(t)
            want[(i, *c, c[0] < 20 or 100 * c[4] > 30 * c[0])] += 1
        got = quality.judge(df).collect()
        names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
        assert want == Counter(tuple(r[n] for n in names) for r in got)
        assert not any(r["kept"] and r["base_failed"] for r in got)
    kept = quality.keep_good(real)
    assert kept.columns == real.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in quality.judge(real).collect() if r["kept"]}
    assert quality.judge(no_docs).count() == 0 and quality.keep_good(no_docs).count() == 0


def test_bad_host_loses_its_documents(spark, monkeypatch):
    good = " ".join(f"w{i}" for i in range(40))
    rows = [(i, "short" if i % 10 else good, "bad") for i in range(400)] + [(1000 + i, good if i % 10 else "short", f"h{i % 4}") for i in range(400)]
    got = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert all(r["kept"] == (r["doc_id"] >= 1000 and not r["base_failed"]) for r in got)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = {r["doc_id"] for r in got if r["kept"]}
    assert {r["doc_id"] for r in quality.keep_good(df).collect()} == want
    monkeypatch.setattr(quality, "BROADCAST_HOSTS", 0)
    assert {r["doc_id"] for r in quality.keep_good(df).collect()} == want
