"""Fields from text: documents in, long rows of fields out."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocabulary as V
from ..functions.text import any_of, clean_label, clean_value, detect_language, detect_script, first_of, is_valid_key, is_valid_label, is_valid_value, key_form, strip
from .ordering import first_per_key

#: name, pattern and confidence of the ways to find label and value, in order.
STRATEGIES = [
    ("inline", rf"(?dm)^(.+?)\s*{V.SEPARATORS}\s*(.+)$", 0.88),
    ("indic", rf"(?dm)^([ऀ-ॿ\s]{{3,40}})\s*{V.SEPARATORS}\s*(.+)$", 0.85),
    ("two lines", r"(?dm)^([A-Za-zऀ-ॿ][A-Za-zऀ-ॿ\s.'/]{2,50})\s*[:：]?\s*$\n\s*(.{1,200})$", 0.78),
]


def dealt(docs: DataFrame, *columns: str) -> DataFrame:
    """Documents over all tasks: a file of few row groups is read by as few, and what is done to a text takes longer than to move it.

    The number of tasks is given, as adaptive execution would else join them by the bytes of short texts, to one for 100,000 of them.
    """
    spark = docs.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return docs.select("document_id", *columns).repartition(tasks, "document_id")


def let(value: Column, body) -> Column:
    """`body` of a value that is worked out once. Long chains of conditions written out in a stage's own code
    make a method that the JVM does not compile, which made each field cost several times as much."""
    return F.transform(F.array(value), body)[0]


def unfolded(df: DataFrame, array: Column, *keep: str) -> DataFrame:
    """The columns kept and those of each struct of the array. The outer form, as for the inner one the
    optimizer first filters by the array's size and works the array out once more for that."""
    return df.select(*keep, F.inline_outer(F.transform(array, lambda x: F.struct(x.alias("of"))))).filter("of is not null").select(*keep, "of.*")


def classify(text: Column) -> Column:
    """struct(document_type, score): the type with the highest share of its patterns found; the first of equals."""
    low = F.lower(F.coalesce(text, F.lit("")))
    scores = []
    for i, (name, patterns) in enumerate(V.DOCUMENT_TYPES):
        hits = sum((F.when(low.rlike(f"(?d){p}"), 1).otherwise(0) for p in patterns), F.lit(0))
        scores.append(F.struct(hits.alias("hits"), F.lit(len(patterns)).alias("all"), F.lit(-i).alias("ord"), F.lit(name).alias("name")))
    score = lambda s: F.when(s["hits"] > 0, F.least(0.5 + s["hits"] / s["all"] * 0.5, F.lit(0.99))).otherwise(0.0)
    ranked = F.transform(F.array(*scores), lambda s: F.struct(score(s).alias("score"), s["ord"], s["name"]))  # each pattern is tried once

    def best(top: Column) -> Column:
        known = (F.length(strip(low)) >= 10) & (top["score"] > 0)
        return F.struct(F.when(known, top["name"]).otherwise("Unknown").alias("document_type"), F.when(known, top["score"]).otherwise(0.0).alias("score"))

    return F.transform(F.array(F.array_max(ranked)), best)[0]


def canonical_key(label: Column) -> Column:
    """The known key of a label: by whole phrase, else by a contained word of four or more characters."""
    return _canonical(key_form(label))


def _canonical(low: Column) -> Column:
    keys = {w: key for key, words in reversed(V.CANONICAL) for w in words}  # the first key of a word stays
    exact = F.try_element_at(F.create_map(*[F.lit(x) for pair in keys.items() for x in pair]), low)
    inside = {key: long for key, words in V.CANONICAL if (long := [w for w in words if len(w) >= 4])}
    starts = sorted({re.escape(w[:4]) for long in inside.values() for w in long})
    some = F.when(low.rlike("|".join(starts)), first_of([(any_of(low, long), F.lit(key)) for key, long in inside.items()], F.lit(None).cast("string")))
    return F.coalesce(exact, some)  # most labels have none of the starts, so no word is tried


def data_type(label: Column, value: Column) -> Column:
    """Type of a field by words of its label, then by the shape of its value."""
    return _type(F.lower(label), strip(value))


def _type(low: Column, v: Column) -> Column:
    number = F.when(any_of(low, V.IDENTIFIER_WORDS), "identifier").when(F.contains(v, F.lit(".")), "decimal").otherwise("integer")
    return first_of(
        [
            (any_of(low, V.PERSON_WORDS), F.lit("person")), (any_of(low, V.DATE_WORDS), F.lit("date")), (any_of(low, V.AREA_WORDS), F.lit("area")),
            (any_of(low, V.CURRENCY_WORDS), F.lit("currency")), (any_of(low, V.ADDRESS_WORDS), F.lit("address")), (v.rlike(f"(?U){V.DATE_VALUE}"), F.lit("date")),
            (v.rlike(f"(?iU){V.CURRENCY_VALUE}"), F.lit("currency")), (v.rlike(f"(?iU){V.AREA_VALUE}"), F.lit("area")), (v.rlike(f"(?U){V.NUMBER_VALUE}"), number),
        ],
        F.lit("string"),
    )


def key_values(docs: DataFrame, learned: DataFrame | None = None) -> DataFrame:
    """document_id, seq, field_name, field_value, confidence, data_type, canonical_key, source_text.

    Strategies run in order over the whole text; of equal labels of a row the first stays, so
    no field is shuffled: documents have a row each.
    `learned` (label, canonical_key) comes before the built-in keys.
    """
    fields = unfolded(dealt(docs, "text"), _fields_of(F.coalesce("text", F.lit(""))), "document_id").withColumn("source_text", strip(F.col("source")))
    kind = let(F.struct("label", "field_value"), lambda f: _type(f["label"], f["field_value"]))
    typed = fields.withColumns({"data_type": kind, "canonical_key": let(F.col("label"), _canonical)})
    if learned is not None:
        taught = learned.select(key_form(F.col("label")).alias("label"), F.col("canonical_key").alias("taught"))
        typed = typed.join(taught, "label", "left").withColumn("canonical_key", F.coalesce("taught", "canonical_key")).drop("taught")
    return typed.select("document_id", "seq", "field_name", "field_value", "confidence", "data_type", "canonical_key", "source_text")


def _fields_of(text: Column) -> Column:
    """array<struct(seq, label, field_name, field_value, confidence, source)>: of equal labels, which are lower-case names, the first."""
    found = F.concat(*[_matches(text, pattern, confidence) for _, pattern, confidence in STRATEGIES])
    named = F.transform(found, lambda f, i: F.struct(i.alias("seq"), clean_label(f["l"]).alias("field_name"), clean_value(f["v"]).alias("field_value"), f["c"].alias("confidence"), f["s"].alias("source")))
    labelled = F.transform(named, lambda f: F.struct(f["seq"].alias("seq"), F.lower(f["field_name"]).alias("label"), *[f[n].alias(n) for n in ("field_name", "field_value", "confidence", "source")]))
    # Names and values have no white space at their ends any more.
    return _first_of_label(F.filter(labelled, lambda f: is_valid_key(f["label"]) & F.length(f["field_value"]).between(1, 500)))


def _first_of_label(fields: Column) -> Column:
    """Of the structs with one label the first. Within a lambda an array is there once; as a column the optimizer would write it out wherever it is used."""
    return let(fields, lambda all_: let(all_["label"], lambda labels: F.filter(all_, lambda f, i: F.array_position(labels, f["label"]) == i + 1)))


def _matches(text: Column, pattern: str, confidence: float) -> Column:
    """array<struct(l, v, s, c)> of the matches of one pattern.

    A text is searched once; its matches are then taken apart alone. All patterns begin and end at an
    end of a line, so each matches its own match in the same way.
    """
    part = lambda s, g: F.regexp_extract(s, pattern, g)
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda s: F.struct(part(s, 1).alias("l"), part(s, 2).alias("v"), s.alias("s"), F.lit(confidence).alias("c")))


def block_fields(pages: DataFrame) -> DataFrame:
    """Fields of OCR blocks: pages is document_id, page, blocks array<struct(text, confidence, bbox)>."""
    blocks = pages.select("document_id", "page", F.posexplode("blocks").alias("block", "b"))
    text = strip(F.coalesce("b.text", F.lit("")))
    pattern = rf"(?d)^(.+?)\s*{V.SEPARATORS}\s*(.+)$"
    rows = blocks.withColumn("t", text).filter(F.col("t").rlike(pattern)).select(
        "document_id", F.col("page").alias("page_number"), "block",
        clean_label(F.regexp_extract("t", pattern, 1)).alias("field_name"), clean_value(F.regexp_extract("t", pattern, 2)).alias("field_value"),
        F.least(F.coalesce("b.confidence", F.lit(0.8)), F.lit(0.95)).alias("confidence"), F.col("b.bbox").alias("bounding_box"), F.col("t").alias("source_text"),
    )
    good = rows.filter(is_valid_label(F.col("field_name")) & is_valid_value(F.col("field_value"))).withColumn("label", F.lower("field_name"))
    one = first_per_key(good, ["document_id", "label"], "page_number", "block")
    return one.drop("label").withColumn("data_type", data_type(F.col("field_name"), F.col("field_value"))).withColumn("canonical_key", canonical_key(F.col("field_name")))


def table_fields(docs: DataFrame) -> DataFrame:
    """document_id, row, col, field_name, field_value of pipe tables.

    Lines with two pipes or more; empty cells fall out and shift their row; rows of
    rules are skipped; the first row names the columns; cells of digits are skipped.
    """
    return unfolded(dealt(docs, "text"), _cells_of(F.coalesce("text", F.lit(""))), "document_id").withColumn("confidence", F.lit(0.80))


def _cells_of(text: Column) -> Column:
    """array<struct(row, col, field_name, field_value)> of the cells that count, row by row."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(x) - F.length(F.replace(x, F.lit("|"), F.lit(""))) >= 2)
    cells = F.filter(F.transform(lines, lambda x: F.filter(F.transform(F.split(x, r"\|"), strip), lambda c: c != "")), lambda r: (F.size(r) > 0) & ~F.forall(r, lambda c: c.rlike(r"^[-=:+\s]+$")))
    def named(t: Column) -> Column:
        """The cells below the head that count; each label is cleaned and judged once."""
        heads = F.transform(F.get(t, F.lit(0)), clean_label)
        labels = F.transform(heads, lambda h: let(F.lower(h), lambda low: F.when(is_valid_key(low), h)))

        def below(names: Column) -> Column:
            row = lambda r, i: F.transform(r, lambda c, j: F.struct((i - 1).alias("row"), j.alias("col"), F.get(names, j).alias("field_name"), c.alias("field_value")))
            kept = F.filter(F.flatten(F.transform(t, row)), lambda f: (f["row"] >= 0) & f["field_name"].isNotNull())
            return F.filter(kept, lambda f: ~f["field_value"].rlike(r"^\d+$"))

        return F.transform(F.array(labels), below)[0]

    return let(cells, named)


def document_fields(docs: DataFrame) -> DataFrame:
    """document_id, field_name, field_value, confidence: fields of the text, and of its tables where the text has none of that label.

    As `with_table_fields` of `key_values` and `table_fields`, but each document, of one row, is gone through once and no field is shuffled.
    """
    text = F.coalesce("text", F.lit(""))
    shown = lambda f, sure: F.struct(f["field_name"].alias("field_name"), f["field_value"].alias("field_value"), sure.alias("confidence"))
    cells = F.transform(_cells_of(text), lambda f: F.struct(F.lower(f["field_name"]).alias("label"), f["field_name"].alias("field_name"), f["field_value"].alias("field_value")))

    def both(of: Column) -> Column:
        new = let(of["fields"]["label"], lambda labels: F.filter(of["cells"], lambda f: ~F.array_contains(labels, f["label"])))
        return F.concat(F.transform(of["fields"], lambda f: shown(f, f["confidence"])), F.transform(new, lambda f: shown(f, F.lit(0.80))))

    return unfolded(dealt(docs, "text"), let(F.struct(_fields_of(text).alias("fields"), _first_of_label(cells).alias("cells")), both), "document_id")


def with_table_fields(fields: DataFrame, tables: DataFrame) -> DataFrame:
    """Table fields added where the document has no field of that label: of a column the first row stays."""
    label = F.lower("field_name").alias("label")
    first = first_per_key(tables.withColumn("label", F.lower("field_name")), ["document_id", "label"], "row", "col")
    new = first.join(fields.select("document_id", label).distinct(), ["document_id", "label"], "left_anti")
    keep = ["document_id", "field_name", "field_value", "confidence"]
    return fields.select(*keep).unionByName(new.select(*keep))


def found_entities(text: Column, language: Column) -> Column:
    """array<struct(ord, entity_type, value, confidence)> of the first match of each pattern of the language, then of English."""
    text = F.coalesce(text, F.lit(""))

    def found(code: str, offset: int) -> list[Column]:
        out = []
        for k, (kind, confidence, pattern) in enumerate(V.ENTITY_PATTERNS.get(code, [])):
            if kind is None:
                continue
            hit = strip(F.regexp_extract(text, f"(?iudU){pattern}", 1))
            out.append(F.struct(F.lit(offset + k).alias("ord"), F.lit(kind).alias("entity_type"), hit.alias("value"), F.lit(confidence).alias("confidence")))
        return out

    own = None
    for code in V.ENTITY_PATTERNS:
        if code != "en":
            row = F.array(*found(code, 0))
            own = F.when(language == code, row) if own is None else own.when(language == code, row)
    both = F.concat(F.coalesce(own, F.slice(F.array(*found("en", 100)), 1, 0)), F.array(*found("en", 100)))
    return F.filter(both, lambda x: x["value"] != "")


def entities(docs: DataFrame) -> DataFrame:
    """document_id, entity_type, value, confidence by the patterns of the document's language, then English.

    The first match of a pattern; of a type the first pattern that matched.
    """
    each = unfolded(dealt(docs, "text", "language"), found_entities(F.col("text"), F.col("language")), "document_id")
    return first_per_key(each, ["document_id", "entity_type"], "ord").select("document_id", "entity_type", "value", "confidence")


def pages_language(docs: DataFrame) -> DataFrame:
    """document_id, language to read documents in (document_id, t, given): as given, but what the text is in where none or English was."""
    seen = docs.withColumns({"script": detect_script(F.col("t")), "heard": detect_language(F.col("t"))})
    seen = seen.withColumn("seen", F.when(F.col("script") != "en", F.col("script")).otherwise(F.col("heard")))
    none = F.coalesce("given", F.lit("")).isin("", "auto", "unknown")
    language = F.when(none, F.col("seen")).when((F.col("given") == "en") & (F.col("seen") != "en"), F.col("seen")).otherwise(F.col("given"))
    return seen.select("document_id", language.alias("language"))


def page_entities(pages: DataFrame) -> DataFrame:
    """document_id, entity_type, value, confidence, page, bbox, language of documents of several pages.

    `pages` has document_id, page, language and blocks array<struct(text, bbox, ...)>. On each page
    blocks are read one by one, then the page's joined text, which has no box; of a type the
    first find in that order stays. Blocks without text are left out, documents without any are too.
    """
    said = lambda b: strip(F.coalesce(b["text"].cast("string"), F.lit("")))
    full = F.filter(F.coalesce("blocks", F.array()), lambda b: b.isNotNull() & (said(b) != ""))
    kept = pages.select("document_id", F.coalesce("page", F.lit(1)).alias("page"), "language", full.alias("blocks")).filter(F.size("blocks") > 0)
    joined = kept.withColumn("whole", F.array_join(F.transform("blocks", said), "\n"))
    of_document = F.array_join(F.sort_array(F.collect_list(F.struct("page", "whole")))["whole"], "\n")  # of one document
    languages = pages_language(joined.groupBy("document_id").agg(of_document.alias("t"), F.max("language").alias("given")))
    part = lambda t, at, box: F.struct(t.alias("t"), at.alias("at"), box.cast("array<double>").alias("bbox"))
    parts = F.concat(F.transform("blocks", lambda b, i: part(said(b), i, b["bbox"])), F.array(part(F.col("whole"), F.size("blocks"), F.lit(None))))
    each = joined.join(languages.withColumnRenamed("language", "read_in"), "document_id").select("document_id", "page", "read_in", F.explode(parts).alias("p"))
    read = each.select("document_id", "page", "read_in", "p.t", "p.at", "p.bbox")
    found = unfolded(read, found_entities(F.col("t"), F.col("read_in")), "document_id", "page", "read_in", "at", "bbox")
    first = first_per_key(found, ["document_id", "entity_type"], "page", "at", "ord")
    return first.select("document_id", "entity_type", "value", "confidence", "page", "bbox", F.col("read_in").alias("language"))


def page_store(pages: DataFrame) -> DataFrame:
    """Rows of the raw page store: text (null if blank), mean of the confidences that are not 0, engines sorted, blocks as JSON.

    `pages` has document_id, page, language, blocks array<struct(text, confidence, engine, ...)>.
    """
    blocks = F.filter(F.coalesce("blocks", F.array()), lambda b: b.isNotNull())
    said = F.array_join(F.transform(F.filter(blocks, lambda b: F.coalesce(b["text"], F.lit("")) != ""), lambda b: b["text"]), "\n")
    sure = F.transform(F.filter(blocks, lambda b: F.coalesce(b["confidence"], F.lit(0.0)) != 0), lambda b: b["confidence"].cast("double"))
    mean = F.coalesce(F.try_divide(F.aggregate(sure, F.lit(0.0), lambda s, x: s + x), F.size(sure)), F.lit(0.0))
    engines = F.array_sort(F.array_distinct(F.transform(blocks, lambda b: F.coalesce(b["engine"], F.lit("unknown")))))
    return pages.select(
        "document_id", F.coalesce("page", F.lit(1)).alias("page_number"), F.when(strip(said) != "", said).alias("raw_text"), "language", mean.alias("ocr_confidence"),
        F.when(F.size(engines) > 0, F.array_join(engines, ", ")).alias("ocr_engine"), F.to_json("blocks").alias("blocks"),
    )


#: Columns of a field as they are given out, and what stands for a missing one.
SERIALIZED = {
    "id": None, "document_id": None, "field_name": None, "field_value": None, "normalized_value": None, "data_type": "string", "confidence": None, "page_number": None, "bounding_box": None, "source_text": None,
    "extraction_method": None, "canonical_key": None, "original_text": None, "normalized_text": None, "transliteration": None, "translation": None, "validated": None, "validation_status": "pending",
    "anomaly_flag": None, "anomaly_reason": None, "created_at": None,
}


def serialized(fields: DataFrame) -> DataFrame:
    """document_id, value: each field as JSON with all of its names; columns that the table lacks have their default."""
    one = lambda n, d: F.col(n) if n in fields.columns else F.lit(d).cast("string")
    shown = {n: F.date_format(one(n, d), "yyyy-MM-dd'T'HH:mm:ss") if n == "created_at" and n in fields.columns else one(n, d) for n, d in SERIALIZED.items()}
    return fields.select("document_id", F.to_json(F.struct(*[c.alias(n) for n, c in shown.items()]), {"ignoreNullFields": "false"}).alias("value"))


def owner_count(c: Column) -> Column:
    """Names in a text, parted by commas, semicolons, ampersands or 'and'."""
    return F.size(F.filter(F.split(F.coalesce(c, F.lit("")), r"(?i)[,;&]|\band\b"), lambda x: strip(x) != ""))


def word_boxes(blocks: DataFrame) -> DataFrame:
    """One row for each word of a block with the block's box."""
    return blocks.select("*", F.posexplode(F.filter(F.split("text", r"\s+"), lambda w: w != "")).alias("word_index", "word"))


def ocr_lines(results: DataFrame) -> DataFrame:
    """Rows of parallel arrays of texts, scores and boxes; blank texts are dropped."""
    zipped = F.transform("texts", lambda t, i: F.struct(t.alias("text"), F.get("scores", i).alias("confidence"), F.get("boxes", i).alias("bbox")))
    return results.select("document_id", F.inline(F.filter(zipped, lambda x: strip(x["text"]) != "")))


def record_map(fields: DataFrame) -> DataFrame:
    """document_id, record: the last value of each key, by canonical key where there is one."""
    key = F.coalesce("canonical_key", "field_name")
    last = fields.select("document_id", "seq", "field_value", F.explode(F.array_distinct(F.array(key, F.lower(key)))).alias("key"))
    one = last.groupBy("document_id", "key").agg(F.max_by("field_value", "seq").alias("v"))
    return one.groupBy("document_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "v")))).alias("record"))
