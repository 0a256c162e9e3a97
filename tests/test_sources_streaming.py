"""Round trips of sources and sinks, and streams run to their end."""

import json

from pyspark.sql import functions as F

from recordloom.operators import extraction
from recordloom.sources import registry, tables
from recordloom.streaming import documents as streaming


def test_geojson(spark, tmp_path):
    df = spark.createDataFrame([(1, "A", [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)]), (2, None, None)], "id int, village string, ring array<struct<x:double,y:double>>")
    whole = json.loads(tables.feature_collection(df, ["id", "village"], "id").first()[0])
    assert [f["properties"] for f in whole["features"]] == [{"id": 1, "village": "A"}, {"id": 2, "village": None}] and whole["features"][1]["geometry"] is None
    (tmp_path / "a.json").write_text(json.dumps(whole))
    back = tables.read_geojson(spark, str(tmp_path / "a.json")).collect()
    assert back[0]["properties"]["village"] == "A" and back[0]["ring"][1]["x"] == 1.0
    tables.write_features(df, str(tmp_path / "lines"), ["id"])
    assert spark.read.json(str(tmp_path / "lines")).count() == 2


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.bin").write_bytes(b"abc")
    assert tables.read_objects(spark, str(tmp_path / "in")).first()["file_hash"] == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    (tmp_path / "truth.json").write_text(json.dumps([{"id": "1", "state": "MH", "entities": {"AREA": 2.5, "VILLAGE": "X"}}, {"id": "2", "entities": {"KHATA": "9"}}]))
    rows = tables.entity_rows(tables.read_ground_truth(spark, str(tmp_path / "truth.json"))).collect()
    assert {tuple(r) for r in rows} == {("1", "AREA", "2.5"), ("1", "VILLAGE", "X"), ("2", "KHATA", "9")}
    docs = spark.createDataFrame([("d", 'a"b.pdf', "COMPLETED", None, None, "2024")], "document_id string, original_filename string, status string, detected_language string, file_size int, created_at string")
    tables.write_csv(docs, str(tmp_path / "csv"))
    lines = [x for p in (tmp_path / "csv").glob("*.csv") for x in p.read_text().splitlines()[1:]]  # a part may hold its header only
    assert lines == ['"d","a""b.pdf","COMPLETED","auto","0","2024"']


def test_registry_and_seed(spark, tmp_path):
    path = str(tmp_path / "reg")
    rows = spark.createDataFrame([("r1", "5", "V")], "ref_id string, survey_number string, village string")
    assert tables.seed(spark, path, rows) and not tables.seed(spark, path, rows)
    asked = spark.createDataFrame([("d", "5", None, None, None, None, "V", None)], "document_id string, survey_number string, khasra_number string, khata_number string, plot_number string, registration_number string, village string, district string")
    got = tables.REGISTRIES["table"](path).lookup(asked).first()
    assert (got["ref_id"], got["match_score"], got["status"]) == ("r1", 0.67, "MATCHED")


def test_stream_of_documents(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    schema = "document_id string, text string"
    spark.createDataFrame([("a", "Owner: Ram"), ("b", "Area: 5 acre")], schema).write.parquet(src)
    for _ in range(2):
        streaming.run(streaming.read_uploads(spark, src, schema), out, ck, streaming.extract_stage, once=True).awaitTermination()
        spark.createDataFrame([("a", "Owner: Sita")], schema).write.mode("append").parquet(src)
    got = {(r["document_id"], r["field_value"]) for r in streaming.current(spark, out).collect()}
    assert got == {("a", "Sita"), ("b", "5 acre")}


def test_stage_cache(spark):
    docs = spark.createDataFrame([("a", "Owner: Ram"), ("b", "Area: 5")], "document_id string, text string")
    old = extraction.key_values(docs.filter("document_id = 'a'")).withColumn("input_hash", F.sha2(F.to_json(F.struct(F.lit("Owner: Ram").alias("text"))), 256)).withColumn("field_value", F.lit("cached"))
    got = streaming.stage_cached(docs, old, extraction.key_values, ["text"]).collect()
    assert {(r["document_id"], r["field_value"]) for r in got} == {("a", "cached"), ("b", "5")}


def test_write_objects(spark, tmp_path):
    df = spark.createDataFrame([("a/x.bin", b"12"), ("y.bin", b"")], "key string, content binary")
    assert {tuple(r) for r in tables.write_objects(df, f"file://{tmp_path}/store").collect()} == {("a/x.bin", 2), ("y.bin", 0)}
    assert (tmp_path / "store/a/x.bin").read_bytes() == b"12" and sorted(p.name for p in (tmp_path / "store").rglob("*")) == ["a", "x.bin", "y.bin"]


DOCS = "document_id string, text string, version int"


def through(spark, base, rows, order="version", schema=DOCS):
    """One more upload, and the stream run until it has been read."""
    if rows:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{base}/src")
    source = streaming.read_uploads(spark, f"{base}/src", schema, 1000)
    streaming.run(source, f"{base}/out", f"{base}/ck", streaming.extract_stage, once=True, order=order).awaitTermination()
    return {(r["document_id"], r["field_value"]) for r in streaming.current(spark, f"{base}/out").collect()}


def test_a_document_that_comes_without_fields_loses_its_old_ones(spark, tmp_path):
    assert through(spark, tmp_path, [("a", "Owner: Ram", 1), ("b", "Owner: Bo", 1)]) == {("a", "Ram"), ("b", "Bo")}
    assert through(spark, tmp_path, [("a", "", 2)]) == {("b", "Bo")}
    assert through(spark, tmp_path, [("a", "Owner: Again", 3), ("b", None, 2)]) == {("a", "Again")}


def test_the_later_version_stays_whenever_it_comes(spark, tmp_path):
    assert through(spark, tmp_path, [("a", "Owner: Old", 1), ("a", "Owner: New", 5), ("a", "Owner: Mid", 3), ("b", "Owner: None", None)]) == {("a", "New"), ("b", "None")}
    assert through(spark, tmp_path, [("a", "Owner: Late", 4), ("b", "Owner: First", 0)]) == {("a", "New"), ("b", "First")}
    assert through(spark, tmp_path, [("a", "Owner: Same", 5)]) == {("a", "Same"), ("b", "First")}


def test_without_an_order_the_last_batch_stays(spark, tmp_path):
    through(spark, tmp_path, [("a", "Owner: One", 9)], None)
    assert through(spark, tmp_path, [("a", "Owner: Two", 1)], None) == {("a", "Two")}


def test_a_batch_that_runs_again_after_a_crash(spark, tmp_path):
    through(spark, tmp_path, [("a", "Owner: Ram", 1)])
    want = through(spark, tmp_path, [("a", "Owner: Sita", 2), ("c", "Owner: Cy", 1)])
    for name in ("1", ".1.crc"):
        (tmp_path / "ck" / "commits" / name).unlink()
    before = spark.read.parquet(str(tmp_path / "out" / "rows")).count()
    assert through(spark, tmp_path, []) == want == {("a", "Sita"), ("c", "Cy")}
    assert spark.read.parquet(str(tmp_path / "out" / "rows")).count() == before


def test_a_failed_middle_stage_resumes_alone(spark, tmp_path):
    import pytest

    src, base, broken = str(tmp_path / "src"), str(tmp_path / "stages"), [True]
    spark.createDataFrame([("a", "Owner: Ram", 1), ("b", "Owner: Bo", 1)], DOCS).write.parquet(src)

    def middle(batch):
        if broken[0]:
            raise ValueError("stage is down")
        return batch.withColumn("text", F.upper("text"))

    stages = [("one", lambda b: b), ("two", middle), ("three", streaming.extract_stage)]
    listener = streaming.ProgressTable(spark, str(tmp_path / "seen"), ["one", "two", "three"])
    spark.streams.addListener(listener)
    try:
        with pytest.raises(Exception, match="stage is down"):
            streaming.run_stages(spark, streaming.read_uploads(spark, src, DOCS), base, stages)
        first = streaming.stage_status(spark, base, ["one"]).collect()
        assert {(r["document_id"], r["stage"]) for r in first} == {("a", "one"), ("b", "one")}
        broken[0] = False
        streaming.run_stages(spark, streaming.read_uploads(spark, src, DOCS), base, stages)
        tables.wait_for(lambda: tables.exists(spark, listener.path) and listener.read().filter("name = 'three'").head(1))
    finally:
        spark.streams.removeListener(listener)
    got = {(r["document_id"], r["field_value"]) for r in streaming.current(spark, f"{base}/three").collect()}
    assert got == {("a", "RAM"), ("b", "BO")}
    done = listener.read().filter("input_rows > 0").groupBy("name").agg(F.count(F.lit(1)).alias("batches"), F.sum("input_rows").alias("rows"))
    assert {tuple(r) for r in done.collect()} == {("one", 1, 2), ("two", 1, 2), ("three", 1, 2)}  # the first stage did its work once
    status = streaming.stage_status(spark, base, ["one", "two", "three"], listener.read()).collect()
    assert {(r["document_id"], r["stage"], r["at"] is not None) for r in status} == {("a", "three", True), ("b", "three", True)}


def test_triggers_are_the_same_however_the_stream_is_cut(spark, tmp_path):
    keys = [("x" if k % 3 else "y",) for k in range(50)] + [(None,)] * 4
    got = []
    for cuts in ([0, 54], [0, 4, 17, 18, 54]):
        base = tmp_path / str(len(cuts))
        for a, b in zip(cuts, cuts[1:]):
            spark.createDataFrame(keys[a:b], "key string").write.mode("append").parquet(f"{base}/src")
            due = streaming.corrections_due(streaming.read_uploads(spark, f"{base}/src", "key string"), "key", 4)
            due.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/ck").trigger(availableNow=True).start().awaitTermination()
        got.append({tuple(r) for r in spark.read.parquet(f"{base}/out").collect()})
    assert got[0] == got[1] == {("x", k, 4) for k in range(1, 9)} | {("y", k, 4) for k in range(1, 5)} | {(None, 1, 4)}


def test_a_timer_triggers_for_the_rest(spark, tmp_path):
    spark.createDataFrame([("x",)] * 6, "key string").write.parquet(str(tmp_path / "src"))
    due = streaming.corrections_due(streaming.read_uploads(spark, str(tmp_path / "src"), "key string"), "key", 4, patience=1500)
    query = due.writeStream.format("memory").queryName("due_rows").option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="500 milliseconds").start()
    tables.wait_for(lambda: spark.table("due_rows").count() >= 2, 90)
    query.stop()
    assert {tuple(r) for r in spark.table("due_rows").collect()} == {("x", 1, 4), ("x", 2, 2)}


def test_registry_source_reads_the_districts_asked_for(spark, tmp_path):
    path = f"file://{tmp_path}/reg"
    k = F.col("id")
    rows = spark.range(60).select(k.cast("string").alias("ref_id"), k.cast("string").alias("survey_number"), F.when(k % 5 != 4, F.concat(F.lit("New/D "), (k % 5).cast("string"))).alias("district"), F.lit("x").alias("village"))
    registry.write_registry(rows.coalesce(1), path)
    reg = registry.read_registry(spark, path)
    assert {tuple(r) for r in reg.select("ref_id", "survey_number", "district", "village", "owner_name").collect()} == {(*r, None) for r in rows.select("ref_id", "survey_number", "district", "village").collect()}
    one = reg.filter("district = 'New/D 1' and survey_number = '6'")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan registry" in plan and "New/D 1" not in plan and "survey_number" in plan  # the source took the filter
    assert one.rdd.getNumPartitions() == 1 and [r["ref_id"] for r in one.collect()] == ["6"]
    assert reg.filter(F.col("district").isin("New/D 1", "New/D 2")).count() == 24
    assert reg.filter("district is null").count() == 12 and reg.filter("district = 'no'").count() == 0
    assert reg.filter("district > 'New/D 2'").count() == 12  # not the source's: Spark's own


def test_batches_without_any_rows(spark, tmp_path):
    assert through(spark, tmp_path, [("a", "", 1), ("b", None, 1)]) == set()
    assert through(spark, tmp_path, [("a", "Owner: Ram", 2)]) == {("a", "Ram")}
    assert through(spark, tmp_path, [("a", " ", 3)]) == set()
    assert streaming.versions(spark, f"{tmp_path}/out").count() == 2
