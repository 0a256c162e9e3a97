"""Operators on small hand-made inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordloom.operators import anomaly, changes, duplicates, extraction, learning, rules, scoring, spatial, verification


def test_key_values(spark):
    said = "1. Owner Name: Ram\nowner name: again\nSub-Registrar: X\nमालिक : राम\npage: 3\nVillage\n  Rampur"
    got = {r["field_name"]: r for r in extraction.key_values(spark.createDataFrame([("d", said), ("e", None)], "document_id string, text string")).collect()}
    assert got["Owner Name"]["field_value"] == "Ram" and got["Owner Name"]["canonical_key"] == "OWNER_NAME" and got["Owner Name"]["data_type"] == "person"
    assert got["Village"]["field_value"] == "Rampur" and got["Village"]["confidence"] == 0.78
    assert got["Sub"]["field_value"] == "Registrar: X" and got["मालिक"]["field_value"] == "राम" and "page" not in got


@pytest.mark.parametrize("label,key", [("owner", "OWNER_NAME"), ("previous owner", "PREVIOUS_OWNER"), ("the owner of it", "OWNER_NAME"), ("witness 3", None), ("खसरा संख्या", "KHASRA_NUMBER"), ("colour", None)])
def test_canonical(spark, label, key):
    assert spark.range(1).select(extraction.canonical_key(F.lit(label))).first()[0] == key


def test_types_and_classes(spark):
    rows = [("Owner", "x", "person"), ("Deed date", "x", "date"), ("Size", "12.5 acre", "area"), ("Size", "Rs. 5", "currency"), ("Plot no", "12", "identifier"), ("Count", "12", "integer"), ("Count", "1.2", "decimal"), ("Made", "1/2/2020", "date"), ("Kind", "y", "string")]
    df = spark.createDataFrame(rows, "l string, v string, want string").select(extraction.data_type(F.col("l"), F.col("v")).alias("got"), "want")
    assert all(r["got"] == r["want"] for r in df.collect())
    one = spark.range(1).select(extraction.classify(F.lit("SALE DEED of the seller")).alias("c"), extraction.classify(F.lit("short")).alias("d")).first()
    assert one["c"]["document_type"] == "Sale Deed" and one["c"]["score"] == pytest.approx(0.5 + 2 / 14 * 0.5) and one["d"]["document_type"] == "Unknown"


def test_entities(spark):
    rows = [
        ("en", "en", "Survey No: 12/A\nVillage: Rampur Tehsil: Sadar\nOwner Name: Ram Kumar\nArea 2.5 hectare\nRegistration Date: 05/03/2020"),
        ("hi", "hi", "खसरा संख्या: 45/2\nग्राम: रामपुर\nजिला: लखनऊ"), ("mr", "mr", "गट क्रमांक: 12/3\nफेरफार क्रमांक: 77"), ("ta", "ta", "புல எண்: 12/3\nமாவட்டம்: சென்னை"), ("bn", "bn", "থানা: ক খ\nদাগ নং: ৪৫"),
    ]
    got = {}
    for r in extraction.entities(spark.createDataFrame(rows, "document_id string, language string, text string")).collect():
        got[r["document_id"], r["entity_type"]] = r["value"]
    assert got["en", "SURVEY_NUMBER"] == "12/A" and got["en", "VILLAGE"] == "Rampur" and got["en", "OWNER_NAME"] == "Ram Kumar" and got["en", "AREA"] == "2.5" and got["en", "DATE"] == "05/03/2020"
    assert got["hi", "SURVEY_NUMBER"] == "45/2" and got["hi", "DISTRICT"].startswith("लखनऊ") and got["mr", "MUTATION_NUMBER"] == "77" and got["mr", "SURVEY_NUMBER"] == "12/3"
    assert ("ta", "DISTRICT") not in got and ("ta", "TEHSIL") in got and got["bn", "SURVEY_NUMBER"] == "৪৫"


def test_tables_and_blocks(spark):
    t = "| Name | Plot Size | No |\n|---|---|---|\n| Ram |  | 5 |\n| Sita | 12 m | x |"
    rows = extraction.table_fields(spark.createDataFrame([("d", t)], "document_id string, text string")).collect()
    assert {(r["row"], r["field_name"], r["field_value"]) for r in rows} == {(0, "Name", "Ram"), (1, "Name", "Sita"), (1, "Plot Size", "12 m")}
    pages = spark.createDataFrame([("d", 1, [("Owner: Ram", 0.99, [0.0]), ("none", 0.5, None), (None, None, None)]), ("d", 2, None)], "document_id string, page int, blocks array<struct<text:string,confidence:double,bbox:array<double>>>")
    one = extraction.block_fields(pages).collect()
    assert len(one) == 1 and one[0]["confidence"] == 0.95 and one[0]["page_number"] == 1
    assert spark.range(1).select(extraction.owner_count(F.lit("A & B and C; "))).first()[0] == 3


CASES = [
    ({"area": "none"}, "RULE_AREA_SANITY", "HIGH"), ({"area": "0"}, "RULE_AREA_SANITY", "CRITICAL"), ({"area": "60000 ha"}, "RULE_AREA_SANITY", "MEDIUM"), ({"area": "-5"}, None, None),
    ({"registration_date": "01-01-2030"}, "RULE_DATE_SANITY", "HIGH"), ({"date": "1 Jan 2030"}, "RULE_DATE_SANITY", "HIGH"), ({"date": "soon"}, None, None),
    ({"owner_name": "A ", "co_owner_name": "a"}, "RULE_OWNER_DUPLICATE", "HIGH"), ({"survey_number": "12#"}, "RULE_SURVEY_FORMAT", "MEDIUM"),
    ({"state": "MH", "survey_number": "1"}, "RULE_MH_712", "HIGH"), ({"state": "Maharashtra", "khata_number": "1"}, "RULE_MH_712", "HIGH"),
    ({"state": "UP"}, "RULE_UP_KHATAUNI", "HIGH"), ({"state": "UP", "khasra_number": "1", "unique_code": "12"}, "RULE_UP_KHATAUNI", "MEDIUM"), ({"state": "UP", "khasra_number": "1", "fasli_year": "2020"}, "RULE_UP_KHATAUNI", "LOW"),
    ({"state": "UP", "khasra_number": "1", "fasli_year": "1430 - 1431"}, None, None), ({"state": "MP"}, "RULE_MP_KHASRA", "HIGH"), ({"state": "TN"}, "RULE_TN_PATTA", "HIGH"),
    ({"state": "TN", "pul_en": "1", "land_classification": "desert"}, "RULE_TN_PATTA", "LOW"), ({"state": "TS", "khata_number": "1"}, "RULE_AP_TS_ADANGAL", "HIGH"), ({"state": "AP", "survey_number": "1"}, "RULE_AP_TS_ADANGAL", "MEDIUM"),
    ({"state": "KA"}, "RULE_KA_BHOOMI", "HIGH"), ({"state": "WB"}, "RULE_WB_BANGLARBHUMI", "HIGH"), ({"state": "WB", "dag_number": "1"}, None, None), ({}, None, None),
]


def test_rules(spark):
    names = ["id", *rules.COLUMNS]
    df = spark.createDataFrame([(i, *[c.get(n) for n in rules.COLUMNS]) for i, (c, _, _) in enumerate(CASES)], ", ".join(f"{n} {'int' if n == 'id' else 'string'}" for n in names))
    got = {r["id"]: r for r in rules.validate(df, F.lit("2024-01-01").cast("date")).collect()}
    for i, (_, rule, severity) in enumerate(CASES):
        assert [(f["rule_id"], f["severity"]) for f in got[i]["failures"]] == ([(rule, severity)] if rule else []), CASES[i]
    sums = spark.createDataFrame([(1, "10", [("4",), ("5.9",)]), (2, "10", [("4",), ("5",)]), (3, "10", [("x",)]), (4, "10", [])], "id int, total_area string, plots array<struct<area:string>>")
    assert {r["id"]: r["is_valid"] for r in rules.validate(sums, F.lit("2024-01-01").cast("date")).collect()} == {1: True, 2: False, 3: True, 4: True}


def test_k_of_n_is_that_of_all_pairs(spark):
    rng = np.random.default_rng(4)
    rows = [(i, *[None if rng.random() < 0.2 else str(rng.integers(0, 3)) for _ in range(5)]) for i in range(60)] + [(100 + i, "1", "1", "1", "1", "1") for i in range(4)]
    df = spark.createDataFrame(rows, "document_id long, k1 string, k2 string, k3 string, k4 string, k5 string")
    keys = ["k1", "k2", "k3", "k4", "k5"]
    links, members = duplicates.content_duplicates(df, keys, 3), duplicates.groups(df, keys)
    group = {r["document_id"]: r["group_id"] for r in members.collect()}
    got = {(r["document_id"], r["duplicate_id"]): (r["kind"], r["matched"], r["similarity"]) for r in links.collect()}
    want = {}
    for a in rows:
        for b in rows:
            n = sum(x is not None and x == y for x, y in zip(a[1:], b[1:]))
            if a[0] != b[0] and n >= 3:
                want[a[0], b[0]] = (n, n / sum(x is not None for x in a[1:]))
    for (a, b), found in got.items():  # groups with the first of a block and members, each as in the comparison of all pairs
        assert found[1:] == want[a, b] and found[0] == ("group" if group[a] == a and group[a] != group[b] else "member")
    block = {}
    for g, subset, first in duplicates.blocks(df, keys, 3).collect():
        block.setdefault(g, set()).add((subset, first))
        assert g == first or (g, first) in got
    for a, b in want:  # and nothing is lost: groups of duplicates share a block
        assert block[group[a]] & block[group[b]] if group[a] != group[b] else all((x, group[x]) in got for x in (a, b) if x != group[x])
    listed = {(r["document_id"], r["duplicate_id"]): (len(r["matched_keys"]), r["similarity"]) for r in duplicates.duplicates_of(df, df, keys).collect()}
    assert listed == want


def test_joins_grow_with_rows(spark):
    """Ten times the rows make ten times the rows of joins, though one value is shared by half or all of them."""
    made = {"blocks": [], "lookup": []}
    for n in (300, 3000):
        k = F.col("id")
        values = spark.range(n).select(k.alias("document_id"), F.lit("x").alias("a"), F.lit("y").alias("b"), (k % 2).cast("string").alias("c"), k.cast("string").alias("d"))
        made["blocks"].append(duplicates.content_duplicates(values, ["a", "b", "c", "d"], 3).count())
        docs = spark.range(n).select(k.alias("document_id"), F.when(k % 2 == 0, k.cast("string")).alias("survey_number"), (k % 3).cast("string").alias("khata_number"))
        ref = spark.range(n).select(k.alias("ref_id"), k.cast("string").alias("survey_number"), (k % 3).cast("string").alias("khata_number"))
        found = verification.lookup(docs, ref, ["survey_number", "khata_number"])
        assert {(r[0], r[1]) for r in found.collect()} == {(i, i if i % 2 == 0 else i % 3) for i in range(n)}
        plan = found._jdf.queryExecution()
        found.collect()
        made["lookup"].append(max(int(m) for m in joined_rows(plan.executedPlan())) if joined_rows(plan.executedPlan()) else n)
    assert made["blocks"][1] <= 10.2 * made["blocks"][0] and made["lookup"][1] <= 10.2 * made["lookup"][0]


def joined_rows(plan):
    """Output rows that the joins of an executed plan counted."""
    out, todo = [], [plan]
    while todo:
        p = todo.pop()
        if "Join" in p.nodeName() and p.metrics().contains("numOutputRows"):
            out.append(p.metrics().apply("numOutputRows").value())
        if p.nodeName().startswith("AdaptiveSparkPlan"):
            todo.append(p.executedPlan())
        if p.nodeName().endswith("QueryStage"):
            todo.append(p.plan())
        children = p.children()
        todo += [children.apply(i) for i in range(children.size())]
    return out


SAMPLE = "document_id long, seq long, field_name string, correction_type string, original_value string, corrected_value string, canonical_key string, document_type string, ocr_confidence double, used_in_training boolean"


def test_learning_cycles_build_on_one_another(spark, tmp_path):
    path = str(tmp_path / "learned")
    row = lambda k, field, kind, old=None, new=None, key=None, doc=None, sure=0.9, used=False: (k, k, field, kind, old, new, key, doc, sure, used)
    fix = lambda k, new, field="Owner": row(k, field, "value_correction", "Rarn", new, "OWNER_NAME", "Deed")
    run = lambda rows: learning.cycle(spark, path, spark.createDataFrame(rows, SAMPLE), F.col("seq") % 4 != 0)
    assert run([fix(1, "Ram"), fix(2, "Ram")]) is None  # too few
    assert run([fix(1, "Ram"), fix(2, "Ram"), fix(3, "Ram"), fix(4, "Ram"), row(5, "x", "auto_verified", used=True)]) == 1
    assert run([row(6, " Village ", "field_added", key="VILLAGE", doc="Deed"), row(7, "Area", "auto_verified", doc="Map"), row(8, "Village", "field_deleted"), row(9, "Owner", "auto_verified")]) == 2
    worse = [fix(10, "Rama"), fix(11, "Rama"), fix(12, "Ram"), fix(13, "Rama")]  # what is set aside speaks for the older correction
    assert run(worse) == 3
    assert run([row(14, "Area", "auto_verified", doc="Deed"), row(15, "Area", "auto_verified"), row(16, "Area", "auto_verified", sure=0.0)]) == 4
    versions = {r["version"]: (r["accuracy_before"], r["accuracy_after"], r["accepted"], r["deployed"]) for r in learning.snapshots_of(spark, path).collect()}
    assert versions == {1: (0.0, 1.0, True, False), 2: (0.5, 0.5, True, False), 3: (1.0, 0.5, False, False), 4: (1.0, 1.0, True, True)}
    held = {(r["part"], r["key"]): r["value"] or r["fields"] for r in learning.patterns_of(spark, path).collect()}
    assert held["ocr_corrections", "Owner::Rarn"] == "Ram"  # of version 1, past the refused version 3
    assert held["label_mappings", "village"] == "VILLAGE" and held["label_mappings", "owner"] == "OWNER_NAME"
    assert held["doctype_fields", "Deed"] == [" Village ", "Area", "Owner"] and held["doctype_fields", "Map"] == ["Area"]
    assert held["confidence_adjustments", "Owner"] == "0.0" and held["field_accuracy_rates", "Area"] == "1.0"
    refused = {(r["part"], r["key"]): r["value"] for r in learning.patterns_of(spark, path, 3).collect()}
    assert refused["ocr_corrections", "Owner::Rarn"] == "Rama" and refused["confidence_adjustments", "Owner"] == "-0.3"


def test_a_cycle_that_broke_off_is_done_over(spark, tmp_path):
    path = str(tmp_path / "learned")
    spark.createDataFrame([("label_mappings", "stale", "X", None)], learning.PATTERNS).write.parquet(f"{path}/patterns/version=1")
    assert learning.patterns_of(spark, path).count() == 0  # no snapshot, no version
    rows = [(k, k, "Owner", "auto_verified", None, None, "OWNER_NAME", None, 0.9, False) for k in range(5)]
    assert learning.cycle(spark, path, spark.createDataFrame(rows, SAMPLE), F.lit(True)) == 1
    assert {r["key"] for r in learning.patterns_of(spark, path).collect()} == {"owner", "Owner"}


def test_lookup_and_flags(spark):
    docs = spark.createDataFrame([(1, "5", None), (2, " 5 ", "k"), (3, None, None), (4, "9", "k")], "document_id long, survey_number string, khata_number string")
    ref = spark.createDataFrame([(10, "5", "k"), (11, "5", "z"), (12, "9", "q")], "ref_id long, survey_number string, khata_number string")
    assert {(r[0], r[1]) for r in verification.lookup(docs, ref, ["survey_number", "khata_number"]).collect()} == {(1, 10), (2, 10)}
    assert verification.lookup(docs.filter("document_id = 3"), ref, ["survey_number", "khata_number"]).count() == 0
    fields = spark.createDataFrame([(1, 0, "owner"), (1, 1, "plot_area"), (1, 2, "date")], "document_id long, seq int, field_name string")
    notes = spark.createDataFrame([(1, 0, "first"), (1, 1, "second")], "document_id long, seq int, anomaly string")
    assert {r["field_name"]: r["anomaly_reason"] for r in verification.flag_fields(fields, notes).collect()} == {"plot_area": "first", "date": "second", "owner": None}


SQUARE = np.array([(0, 0), (4, 0), (4, 4), (0, 4)], float)


@pytest.mark.parametrize("other,meets", [
    (SQUARE + 2, True), (SQUARE + [4, 0], False), (SQUARE + [4, 4], False), (SQUARE + 9, False), (SQUARE, True), (SQUARE / 4 + 1, True), (SQUARE * [1, 0.5], True),
    (np.array([(-1, 1), (5, 1), (5, 2), (-1, 2)], float), True), (np.array([(0, 4), (4, 4), (2, 6)], float), False), (np.array([(2, 2), (6, 2), (6, 3)], float), True),
])
def test_polygons(other, meets):
    a, b = [[r[:, 0] for r in (SQUARE, other)], [r[:, 1] for r in (SQUARE, other)]], [[r[:, 0] for r in (other, SQUARE)], [r[:, 1] for r in (other, SQUARE)]]
    assert spatial.interiors_meet(spatial.Rings.of(*a), spatial.Rings.of(*b)).tolist() == [meets, meets]


def test_overlaps_and_near(spark):
    ring = lambda p: [(float(x), float(y)) for x, y in p]
    df = spark.createDataFrame([(1, ring(SQUARE)), (2, ring(SQUARE + 3)), (3, ring(SQUARE + [4, 0])), (4, None), (5, ring(SQUARE * 40 - 50))], "id long, ring array<struct<x:double,y:double>>")
    assert {tuple(r) for r in spatial.overlaps(df).collect()} == {(1, 2), (2, 3), (1, 5), (2, 5), (3, 5)}
    pts = spark.createDataFrame([(1, 10.0, 20.0), (2, 10.01, 20.0), (3, 0.0, 20.0), (4, None, None), (5, 10.0, 179.99)], "id long, lat double, lng double")
    assert {r["id"] for r in spatial.near(pts, 10.0, 20.0, 2000, fallback=True).collect()} == {1, 2}
    assert {r["id"] for r in spatial.near(pts, 10.0, -179.99, 5000, fallback=True).collect()} == {5}


def test_forest(spark):
    forest = anomaly.fit(anomaly.training_rows())
    rows = [("2.5", "2", None), ("50000", "80", "in the future 2099"), ("-3", "0", None), (None, None, None), ("bad", "NaN", "x")]
    got = anomaly.score(spark.createDataFrame(rows, "area string, number_of_owners string, registration_date string"), forest).collect()
    assert got[0]["anomaly_level"] == "LOW" and not got[0]["anomaly_flag"]
    assert got[1]["anomaly_flag"] and got[2]["f_area"] == -1.0 and all(0 <= r["anomaly_score"] <= 1 for r in got)
    with pytest.raises(ValueError):
        anomaly.fit(np.zeros((5, 6)))


def test_reports_and_learning(spark):
    f = spark.createDataFrame([("d", 0, "a", 0.9), ("d", 1, "b", 0.2), ("d", 2, "c", None)], "document_id string, seq int, field_name string, confidence double")
    r = scoring.confidence_report(f).first()
    assert r["overall"] == pytest.approx(1.1 / 3) and r["category"] == "LOW" and r["flagged"] == ["b", "c"] and r["n_high"] == 1
    s = spark.createDataFrame(
        [("d", 0, "f", "x", "y", "value_correction", "K", "T", 0.9, False), ("d", 1, "f", "x", "z", "value_correction", None, "T", 0.9, False), ("e", 2, "g", None, None, "auto_verified", None, "Unknown", 0.4, True)],
        "document_id string, seq int, field_name string, original_value string, corrected_value string, correction_type string, canonical_key string, document_type string, ocr_confidence double, used_in_training boolean",
    )
    rates, maps, labels, types = learning.correction_rates(s), learning.correction_map(s), learning.label_map(s), learning.fields_of_types(s)
    assert rates.filter("field_name = 'f'").first()["penalty"] == pytest.approx(-0.3) and maps.first()["corrected_value"] == "z"
    assert learning.accuracy(s, rates, maps, labels, types).first()[0] == pytest.approx((0.5 + 1 + 0) / 3)
    assert learning.due(s, 2).first()["due"]
    none = spark.createDataFrame([], "version int, training_samples_count int, patterns string, accuracy_before double, accuracy_after double, improvement_delta double, deployed boolean")
    one = learning.deploy(none, 0.9, 0.5, 3, "{}")
    two = learning.deploy(learning.deploy(one, 0.5, 0.4, 3, "{}"), 0.4, 0.6, 3, "{}")
    assert [(r["version"], r["deployed"]) for r in two.orderBy("version").collect()] == [(1, True), (2, False), (3, True)]


def test_changes(spark):
    t = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id int, field_value string, field_name string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "id int, field_value string")
    assert {tuple(r) for r in changes.update(t, new).collect()} == {(1, "a", "x"), (2, "c", "y")}
    assert {tuple(r) for r in changes.replace_documents(t, t.filter("id = 1").withColumn("field_value", F.lit("n")), "id").collect()} == {(1, "n", "x"), (2, "b", "y")}
    assert changes.delete(t, new, "id").count() == 1
