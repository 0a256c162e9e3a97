"""Entities over pages, the page store, lists of fields and what hangs on them."""

import json

from pyspark.sql import functions as F

from recordloom.operators import changes, extraction, ordering, verification

PAGES = "document_id string, page int, language string, blocks array<struct<text:string,bbox:array<double>,confidence:double,engine:string>>"


def block(text, box=None, confidence=0.9, engine="paddle"):
    return (text, box, confidence, engine)


def found(spark, rows):
    got = extraction.page_entities(spark.createDataFrame(rows, PAGES)).collect()
    return {(r["document_id"], r["entity_type"]): (r["value"], r["page"], r["bbox"], r["language"]) for r in got}


def test_blocks_in_order_then_the_page(spark):
    box = [10.0, 20.0, 100.0, 30.0]
    rows = [
        ("a", 2, "en", [block("Survey No.: 9", [1.0]), block("District: Nashik")]),
        ("a", 1, "en", [block("Survey No.: 245/A", box), block("Village: Wagholi", box), block("Plot No:"), block("77")]),
    ]
    assert found(spark, rows) == {
        ("a", "SURVEY_NUMBER"): ("245/A", 1, box, "en"), ("a", "VILLAGE"): ("Wagholi", 1, box, "en"), ("a", "DISTRICT"): ("Nashik", 2, None, "en"),
        ("a", "PLOT_NUMBER"): ("77", 1, None, "en"),  # over two lines: found on the page only
    }


def test_language_is_that_of_all_pages(spark):
    rows = [
        ("en", 1, "en", [block("Khata No. 5")]), ("en", 2, "en", [block("खसरा संख्या: 12")]), ("auto", 1, "auto", [block("খতিয়ান নং: 7 দাগ")]), ("none", 1, None, [block("Khata No. 5")]),
        ("kept", 1, "ta", [block("Khata No. 5")]), ("short", 1, "", [block("x")]),
    ]
    got = found(spark, rows)
    assert {k[0]: v[3] for k, v in got.items()} == {"en": "hi", "auto": "bn", "none": "en", "kept": "ta"}
    assert got["en", "SURVEY_NUMBER"][:2] == ("12", 2) and got["en", "KHATA_NUMBER"][:2] == ("5", 1)


def test_broken_pages(spark):
    rows = [("a", 1, "en", None), ("b", 1, "en", []), ("c", 1, "en", [None, block(None), block(" \n")]), ("d", None, "en", [block("Survey No: 1"), None])]
    assert found(spark, rows) == {("d", "SURVEY_NUMBER"): ("1", 1, None, "en")}
    assert found(spark, []) == {}


def test_page_store(spark):
    rows = [("a", None, "en", [block("x", None, 0.5), block(None, None, 0.0, None), block("y", None, None), None]), ("b", 2, None, []), ("c", 3, "en", [block(" ", None, 0.0)]), ("d", 4, "en", None)]
    got = {r["document_id"]: r for r in extraction.page_store(spark.createDataFrame(rows, PAGES)).collect()}
    assert (got["a"]["page_number"], got["a"]["raw_text"], got["a"]["ocr_confidence"], got["a"]["ocr_engine"]) == (1, "x\ny", 0.5, "paddle, unknown")
    assert (got["b"]["raw_text"], got["b"]["ocr_confidence"], got["b"]["ocr_engine"]) == (None, 0.0, None)
    assert got["c"]["raw_text"] is None and got["d"]["blocks"] is None
    assert [b and b.get("text") for b in json.loads(got["a"]["blocks"])] == ["x", None, "y", None]


def test_serialized(spark):
    rows = spark.createDataFrame([("r", "d", 'a "b"', None, 0.5)], "id string, document_id string, field_name string, field_value string, confidence double").withColumn("created_at", F.lit("2024-05-01 10:00:00").cast("timestamp_ntz"))
    got = json.loads(extraction.serialized(rows).first()["value"])
    assert list(got) == list(extraction.SERIALIZED) and len(got) == 21
    assert {k: v for k, v in got.items() if v is not None} == {"id": "r", "document_id": "d", "field_name": 'a "b"', "data_type": "string", "confidence": 0.5, "validation_status": "pending", "created_at": "2024-05-01T10:00:00"}


def test_pages_of_a_list(spark):
    df = spark.createDataFrame([(k, k % 3) for k in range(25)], "id int, g int")
    order = [F.desc("g"), F.col("id")]
    whole = [r["id"] for r in df.orderBy(*order).collect()]
    for n in (1, 2, 3, 4):
        got = ordering.page(df, n, 10, *order).orderBy("rank").collect()
        assert [(r["id"], r["rank"]) for r in got] == [(i, k + 1) for k, i in enumerate(whole)][10 * (n - 1) : 10 * n]
    assert [r["version"] for r in ordering.latest_versions(df.select(F.col("id").alias("version")), 3).collect()] == [24, 23, 22]


def test_cascade_and_visible(spark):
    docs = spark.createDataFrame([("a",), ("b",)], "document_id string")
    fields = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "document_id string, n int")
    left = changes.cascade(docs.filter("document_id = 'a'"), "document_id", {"documents": docs, "fields": fields})
    assert [r[0] for r in left["documents"].collect()] == ["b"] and sorted(r["n"] for r in left["fields"].collect()) == [3, 4]
    users = spark.createDataFrame([("u", "admin", True), ("v", "admin", False), ("w", "clerk", True)], "username string, role string, is_active boolean")
    grants = spark.createDataFrame([("admin", "x"), ("admin", "x"), ("clerk", "y")], "role string, resource string")
    rows = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3), ("z", 4)], "resource string, n int")
    assert sorted((r["username"], r["n"]) for r in verification.visible(rows, users, grants).collect()) == [("u", 1), ("u", 2), ("w", 3)]
