"""Cases in which a query once differed from its SQL or did less than its whole job."""

from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from recordloom import vocabulary as V
from recordloom.functions import text
from recordloom.operators import duplicates, extraction, scoring, similarity
from recordloom.plans.queries import QUERIES

from .test_operators import joined_rows


def test_overall_confidence_does_not_depend_on_the_order_of_rows(spark):
    rows = [(i, k, f"f{k}", c * 9) for i, given in enumerate(sorted(set(permutations([0.04, 0.01, 0.09, 0.02, 0.02, 0.02])))) for k, c in enumerate(given)]
    df = spark.createDataFrame(rows, "document_id long, seq int, field_name string, confidence double").coalesce(1)
    assert {(r["overall"], r["category"]) for r in scoring.confidence_report(df).collect()} == {(0.3, "LOW")}


def test_routing_adds_scores_in_the_order_of_the_files(spark, tmp_path):
    """A mean at the floor of MEDIUM is there or below it by the order of its scores, and the SQL adds them as they come."""
    orders = sorted(set(permutations([0.01, 0.04, 0.08, 0.08, 0.09, 0.1])))
    (tmp_path / "lineitem.parquet").mkdir()
    for name, places in (("a", (0, 1, 2)), ("b", (3, 4, 5))):
        rows = [(k, p + 1, given[p]) for p in places for k, given in enumerate(orders)]
        li = pa.table({"l_orderkey": [r[0] for r in rows], "l_linenumber": pa.array([r[1] for r in rows], pa.int32()), "l_discount": [r[2] for r in rows]})
        pq.write_table(li, tmp_path / "lineitem.parquet" / f"{name}.parquet")
    done = [k for k, given in enumerate(orders) if all(k % m for m in (17, 29, 31, 37))]
    high = [k for k in done if sum_in_order([c * 9 for c in orders[k]]) / 6 >= 0.60]
    assert 0 < len(high) < len(done)
    assert {r["status"]: r["n"] for r in QUERIES["routing"](spark, str(tmp_path)).collect()} == {"COMPLETED": len(high), "VERIFICATION_REQUIRED": len(orders) - len(high)}


def sum_in_order(scores):
    out = 0.0
    for x in scores:  # sum() makes up for what is rounded off
        out += x
    return out


def test_first_fields_are_first_in_the_files_among_equal_line_numbers(spark, tmp_path):
    (tmp_path / "lineitem.parquet").mkdir()
    for name, rows, least in (("a", 50, 0), ("b", 20_000, 1000)):  # the larger file is read first
        n = np.arange(rows)
        li = pa.table({"l_orderkey": n % 50, "l_linenumber": np.ones(rows, np.int32), "l_partkey": n + least, "l_returnflag": ["R"] * rows})
        pq.write_table(li, tmp_path / "lineitem.parquet" / f"{name}.parquet")
    assert {(r["l_orderkey"], r["l_partkey"]) for r in QUERIES["first_fields"](spark, str(tmp_path)).collect()} == {(k, k) for k in range(50)}


def test_equal_counts_with_latin(spark, tmp_path):
    df = spark.createDataFrame([("गाव abc",), ("गाव abcd",), ("गाव ab",)], "c string")
    rows = lambda **options: [r["a"]["code"] for r in df.coalesce(1).select(text.dominant_language(F.col("c"), **options).alias("a")).collect()]
    assert rows(latin_first=True) == ["en", "en", "mr"] and rows() == ["mr", "en", "mr"]
    spark.createDataFrame([(9, "a" * 14), (1, "गाव abc"), (2, "गाव ab")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["language_a"] for r in QUERIES["script_counts"](spark, str(tmp_path)).collect()}
    assert got[1] == "en" and got[2] == "mr"


def test_names_meet_only_within_the_distance_and_are_never_broadcast(spark):
    """Numbers of few digits share what is left after deletions with most others."""
    df = spark.range(1000).select("id", F.format_string("Customer#%05d", F.col("id")).alias("name"))
    found = similarity.names_within(df, "name", 1)
    rows = found.collect()
    apart = [(a, b) for a in range(1000) for b in range(a + 1, 1000) if sum(x != y for x, y in zip(f"{a:05d}", f"{b:05d}")) == 1]
    assert {(r["a"], r["b"]) for r in rows} == set(apart) and {r["distance"] for r in rows} == {1}
    two = similarity.names_within(df, "name", 2)
    n = two.count()
    plan = two._jdf.queryExecution()
    two.collect()
    assert max(joined_rows(plan.executedPlan())) < 4 * n
    assert plan.executedPlan().toString().count("BroadcastHashJoin") == 0


def test_pairs_of_names_are_made_once(spark):
    """Names of one length that differ in fewer places than they may meet in one way of many; only others are made distinct."""
    df = spark.range(1000).select("id", F.format_string("Customer#%05d", F.col("id")).alias("name"))
    for names in (df, df.union(spark.createDataFrame([(-1, "Z")], "id long, name string"))):  # all begin alike, or not
        found = similarity.names_within(names, "name", 2)
        plan = found._jdf.queryExecution()
        n = found.count()
        apart = [sum(x != y for x, y in zip(f"{a:03d}", f"{b:03d}")) for a in range(1000) for b in range(a + 1, 1000)]
        assert n > sum(d <= 2 for d in apart)
        rows = found.collect()
        assert len(rows) == n == len({(r["a"], r["b"]) for r in rows}) and sum(joined_rows(plan.executedPlan())) < 1.5 * n


def test_all_links_between_different_documents_are_listed(spark):
    rng = np.random.default_rng(6)
    keys = ["k1", "k2", "k3", "k4", "k5"]
    rows = [(i, *[None if rng.random() < 0.2 else str(rng.integers(0, 3)) for _ in keys]) for i in range(60)] + [(100 + i, "1", "1", "1", "1", "1") for i in range(4)]
    df = spark.createDataFrame(rows, "document_id long, k1 string, k2 string, k3 string, k4 string, k5 string")
    first = {}
    for r in rows:
        first.setdefault(r[1:], r[0])
    want = set()
    for a in rows:
        for b in rows:
            same = [k for k, x, y in zip(keys, a[1:], b[1:]) if x is not None and x == y]
            if a[0] != b[0] and len(same) >= 3 and first[b[1:]] == b[0] and (first[a[1:]] == a[0] or a[1:] == b[1:]):
                want.add((a[0], b[0], "member" if a[1:] == b[1:] else "group", len(same), ",".join(same), len(same) / sum(x is not None for x in a[1:])))
    got = [(r["document_id"], r["duplicate_id"], r["kind"], r["matched"], ",".join(r["matched_keys"]), r["similarity"]) for r in duplicates.content_pairs(df, keys, 3).collect()]
    assert len(got) == len(want) and set(got) == want


def test_documents_of_a_block_are_linked_with_each_other(spark, tmp_path):
    """Three parts that agree on all but the name: each with each, not with the first only."""
    spark.createDataFrame([(k, "b", "t", 1, f"n{k}") for k in range(3)], "p_partkey long, p_brand string, p_type string, p_size int, p_name string").write.parquet(str(tmp_path / "part.parquet"))
    got = {(r["document_id"], r["duplicate_id"]) for r in QUERIES["content_duplicates"](spark, str(tmp_path)).collect()}
    assert got == {(a, b) for a in range(3) for b in range(3) if a != b}
    report = {(r["document_id"], r["duplicate_id"], r["reason"]) for r in QUERIES["duplicate_report"](spark, str(tmp_path)).collect()}
    assert (2, 1, "field_content") in report and (1, 0, "file_content") in report and len(report) == 6


def test_arrays_of_fields_are_worked_out_once(spark):
    """No filter by an array's size, which would hold all of its patterns a second time."""
    docs = spark.createDataFrame([(1, "Survey No: 5/A\n| A b | C d |\n|---|---|\n| x | y |", "en"), (2, None, "hi")], "document_id long, text string, language string")
    for found in (extraction.entities(docs), extraction.key_values(docs), extraction.table_fields(docs)):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "size(" not in "".join(line for line in plan.splitlines() if "Filter " in line) and found.count() > 0


def test_cosines_of_tiles_are_those_of_rows(spark, monkeypatch):
    monkeypatch.setattr(similarity, "ASKED_ROWS", 3)
    monkeypatch.setattr(similarity, "INDEX_ROWS", 4)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=5)]) for i in range(20)] + [(20, [0.0] * 5), (21, None), (22, [1.0, None, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, embedding array<float>")
    got = {(r["a"], r["b"]): r["cosine"] for r in similarity.cosines(df.filter("id % 5 = 0"), df).collect()}
    pairs = df.filter("id % 5 = 0").select(F.col("id").alias("a"), F.col("embedding").alias("x")).crossJoin(df.select(F.col("id").alias("b"), F.col("embedding").alias("y")))
    want = {(r["a"], r["b"]): r["c"] for r in pairs.select("a", "b", text.cosine(F.col("x"), F.col("y")).alias("c")).collect()}
    assert got.keys() == want.keys() and all((want[k] is None) == (got[k] is None) and (want[k] is None or abs(got[k] - want[k]) < 1e-12) for k in want)


def test_white_space_at_the_ends_is_that_of_unicode(spark):
    df = spark.createDataFrame([(i, chr(i)) for i in range(1, 0x10000) if not 0xD800 <= i < 0xE000], "id long, m string")
    both = df.select("id", *[(text.strip(x) == F.regexp_replace(x, r"(?U)^\s+|\s+$", "")).alias(n) for n, x in (("a", F.col("m")), ("b", F.concat("m", F.lit(" a\n b"), "m", F.lit("\n"))))])
    assert both.filter("not (a and b) or a is null or b is null").count() == 0


def test_matches_are_found_once_and_keys_are_not_written_out_in_a_stage(spark):
    """Each pattern searches a text once, and what its match holds is what the pattern's groups held."""
    said = ["Owner: Ram\nArea  –  5 acre  \n\nगाव : क\nOwner Name\n  Sita \n", "a:\n:b\nc::d\n=\n", "Name\n\n\nx: y = z\r\nq - \u2028 r", "", None, "Ab: \nCd\nEf"]
    docs = spark.createDataFrame(list(enumerate(said)), "document_id long, text string")
    for _, pattern, c in extraction.STRATEGIES:
        one = docs.select(extraction._matches(F.coalesce("text", F.lit("")), pattern, c).alias("m")).collect()
        for g, n in ((1, "l"), (2, "v"), (0, "s")):
            want = docs.select(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(pattern), F.lit(g)).alias("w")).collect()
            assert [[x[n] for x in r["m"]] for r in one] == [r["w"] for r in want]
    found = extraction.key_values(docs)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == len(extraction.STRATEGIES) and found.count() > 5


def test_labels_and_values_are_cleaned_as_by_patterns_that_try_every_character(spark):
    df = spark.createDataFrame([(i, chr(i)) for i in range(1, 0x10000) if not 0xD800 <= i < 0xE000], "id long, m string")
    m = F.col("m")
    for x in (m, F.concat(m, F.lit(" 12."), m, F.lit(" a \n:b"), m, F.lit("\n")), F.concat(F.lit("1) "), m, F.lit("2. x"), m, m), F.concat(F.lit("3."), m)):
        bare = F.regexp_replace(text.strip(x), r"(?U)[\s:：\-–—.]+$", "")
        label = text.strip(F.regexp_replace(bare, r"^\d+[.)]\s*", ""))
        value = text.strip(F.regexp_replace(text.strip(x), r"(?U)\s+", " "))
        assert df.filter((text.clean_label(x) != label) | (text.clean_value(x) != value) | text.clean_label(x).isNull()).count() == 0


def test_keys_of_labels_are_those_of_all_conditions_in_order(spark):
    words = [w for _, ws in V.CANONICAL for w in ws]
    labels = sorted({x for w in words for x in (w, f"the {w} x", w[:-1], w[1:], w[:4], "q" + w)} | {"", "a", "मूळ\nगाव"})
    df = spark.createDataFrame([(x,) for x in labels] + [(None,)], "low string")
    low = F.col("low")
    exact = [(low.isin(ws), F.lit(key)) for key, ws in V.CANONICAL]
    inside = [(text.any_of(low, long), F.lit(key)) for key, ws in V.CANONICAL if (long := [w for w in ws if len(w) >= 4])]
    want = text.first_of(exact + inside, F.lit(None).cast("string"))
    assert df.filter(~extraction._canonical(low).eqNullSafe(want)).collect() == [] and df.filter(extraction._canonical(low).isNotNull()).count() > len(words)


def test_documents_are_dealt_over_all_tasks_and_gone_through_once(spark):
    """Short texts are not joined to few tasks by their bytes; fields of text and tables come without a shuffle of fields."""
    table = "\n| Brand | Item  Type |Owner.|\n|---|:--|\n| A | b | 12 | z |\n|| | c |\n| Brand | x y | d |\n"
    said = ["Brand: x" + table, table, "Item Type: 1\nOWNER = q" + table, "a | b | c\n1 | 2 | 3", "Owner: Ram", "", None, "|Age|age |AGE|\n|x|y|z|\n|u|v|w|"]
    docs = spark.createDataFrame(list(enumerate(said)), "document_id long, text string").coalesce(1)
    assert extraction.dealt(docs, "text").rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    both = extraction.document_fields(docs)
    assert sorted(map(tuple, both.collect())) == sorted(map(tuple, extraction.with_table_fields(extraction.key_values(docs), extraction.table_fields(docs)).collect()))
    plan = both._jdf.queryExecution().optimizedPlan().toString()
    assert both.count() > 8 and plan.count("regexp_extract_all") == len(extraction.STRATEGIES) and plan.count("Repartition") == 1 and "Join" not in plan
