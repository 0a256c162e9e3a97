"""Functions of text, numbers and dates against values worked out by hand."""

import datetime

import pytest
from pyspark.sql import functions as F

from recordloom import vocabulary as V
from recordloom.functions import dates, numbers, text


def values(spark, column, rows, schema="c string"):
    data = [r if isinstance(r, tuple) else (r,) for r in rows]
    return [r[0] for r in spark.createDataFrame(data, schema).coalesce(1).select(column).collect()]


def test_digits(spark):
    rows = ["०१२९", "૦૯", "୦୮", "౦౧", "௧", "੮੧", None, "a1"]
    assert values(spark, text.normalize_digits(F.col("c")), rows) == ["0129", "09", "୦୮", "౦1", "௧", "01", "", "a1"]
    assert values(spark, text.normalize_digits(F.col("c"), compat=False), rows) == ["0129", "09", "08", "01", "1", "81", "", "a1"]


@pytest.mark.parametrize("sample,code", [("खसरा संख्या", "hi"), ("தமிழ் நாடு", "ta"), ("తెలుగు భూమి", "te"), ("ಕನ್ನಡ ಭೂಮಿ", "kn"), ("മലയാളം ഭൂമി", "ml"), ("ગુજરાતી જમીન", "gu"), ("বাংলা জমি", "bn"), ("ਪੰਜਾਬੀ ਜ਼ਮੀਨ", "pa"), ("plain text", "en")])
def test_languages(spark, sample, code):
    row = spark.createDataFrame([(sample,)], "c string").select(text.dominant_language(F.col("c")).alias("a"), text.detect_language(F.col("c")).alias("b"), text.detect_script(F.col("c")).alias("c3"))
    got = row.first()
    assert (got["a"]["code"], got["b"], got["c3"]) == (code, code, code)


def test_language_edges(spark):
    assert values(spark, text.detect_language(F.col("c")), ["गाव तालुका", "abc", None, "123456", "அ b c d e"]) == ["mr", "unknown", "unknown", "en", "en"]
    assert values(spark, text.dominant_language(F.col("c"))["confidence"], ["...", None]) == [0.1, 0.1]
    assert values(spark, text.detect_script(F.col("c")), ["ଓଡ଼ିଆ", "गाव"]) == ["or", "hi"]
    shares = values(spark, text.script_distribution(F.col("c")), ["தமிழ் ab", "", "12"])
    assert [(s["code"], s["is_primary"]) for s in shares[0]] == [("ta", True), ("en", False)]
    assert shares[1][0]["code"] == "hi" and shares[1][0]["confidence"] == 0.40 and shares[2][0]["code"] == "en"


def test_labels_and_values(spark):
    assert values(spark, text.clean_label(F.col("c")), [" 1. Owner : ", "2) Khata-", "Plot.\t"]) == ["Owner", "Khata", "Plot"]
    assert values(spark, text.is_valid_label(F.col("c")), ["ok label", "x", "page", "12.5", "a" * 81]) == [True, False, False, False, False]
    assert values(spark, text.compare_form(F.col("c")), ["A-12/3.", None, " x\ty "]) == ["a 12 3", "none", "x y"]
    assert values(spark, text.compare_form(F.col("c"), compat=False), [None]) == [""]
    assert values(spark, text.mask_secret(F.col("c")), ["short", "abcdefghijkl"]) == ["*****", "abcd****ijkl"]


def test_terms(spark):
    assert values(spark, text.translate_term(F.col("c"), F.col("t")), [("खसरा संख्या", "AREA"), ("खसरा", "KHASRA_NUMBER"), ("none", "AREA")], "c string, t string") == ["Khasra", None, None]
    assert values(spark, text.translate_inline(F.col("c")), ["5 हेक्टर", "123", "abc"]) == ["5 Hectares", "123", "abc"]
    assert len(V.TERMS) == len(set(V.TERMS))


def test_block_types(spark):
    rows = [("", 0.9), ("SALE DEED", 0.9), ("a|b", 0.9), ("Owner: x", 0.9), ("Foo: x", 0.9), ("xy", 0.9), ("xy", 0.2), ("plain text", 0.9)]
    assert values(spark, text.block_type(F.col("c"), F.col("p")), rows, "c string, p double") == ["unknown", "title", "table", "field", "form", "signature", "text", "text"]


def test_numbers(spark):
    rows = ["123", "45.67", "  12 ", "₹ 1,00,000.50", "5.5 hectares", None, "text", "NaN", "Rs. 15,00,000", "१२"]
    assert values(spark, numbers.lenient_number(F.col("c")), rows) == [123.0, 45.67, 12.0, 100000.5, 5.5, None, None, None, 0.15, 12.0]
    assert values(spark, numbers.currency_number(F.col("c")), ["₹1,00,000", "2.5 hectares", "-5"]) == [100000.0, None, -5.0]
    assert values(spark, numbers.first_number(F.col("c")), ["-5 ha", "x", "1.5.2"]) == [5.0, None, 1.5]
    assert values(spark, numbers.confidence_category(F.col("c")), [0.85, 0.6, 0.3, 0.1], "c double") == ["HIGH", "MEDIUM", "LOW", "UNCERTAIN"]
    assert values(spark, numbers.field_score(F.col("c")), [None, -1.0, 0.5, 2.0], "c double") == [0.0, 0.0, 0.5, 1.0]


def test_boxes(spark):
    rows = [([10.0, 20.0, 30.0, 40.0], 100, 200), ([90.0, 10.0, 10.0, 500.0], 100, 100), ([1.0, 2.0], 10, 10), ([1.0, 2.0, 3.0, 4.0], 0, 10)]
    got = values(spark, numbers.normalize_bbox(F.col("b"), F.col("w"), F.col("h")), rows, "b array<double>, w int, h int")
    assert got == [[100, 100, 300, 200], [100, 100, 900, 1000], None, None]


def test_dates(spark):
    rows = ["05-03-2020", "5/3/85", "5/3/21", "12 January 2020", "1 Feb 2019", "2020-01-31", "31.12.1999", "someday", "45-01-2020", None]
    day = datetime.date
    want = [day(2020, 3, 5), day(1985, 3, 5), day(2021, 3, 5), day(2020, 1, 12), day(2019, 2, 1), day(2020, 1, 31), day(1999, 12, 31), None, None, None]
    assert values(spark, dates.parse_date(F.col("c")), rows) == want
    assert values(spark, dates.is_suspicious(F.col("c")), ["in future", "2099", "2020", None]) == [True, True, False, False]


def test_distance_and_area(spark):
    one = spark.range(1)
    assert one.select(numbers.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))).first()[0] == pytest.approx(111194.93, abs=0.1)
    ring = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (0.0, 3.0))])
    assert one.select(numbers.ring_area(ring)).first()[0] == 12.0


@pytest.mark.parametrize("said,latin", [
    ("खसरा संख्या १२३", "khasarA saMkhyA 123"), ("संतोष कुमार", "saMtoSha kumAra"), ("पाटील", "pAtila"), ("Survey No 245", "Survey No 245"), ("", ""), (None, ""),
    ("गाँव", "gA.Nva"), ("दुःख", "duHkha"), ("ऋषि", "RriShi"), ("ज्ञान", "j~nAna"), ("औरत", "aurata"), ("ज़मीन", "zamIna"), ("ज़मीन", "zamIna"), ("बड़ा", "ba.Da"), ("क्षेत्र", "kShetra"), ("  राम ", "rAma"),
    ("জমি খতিয়ান", "jami khatiYana"), ("ਜ਼ਿਲ੍ਹਾ", "zilhA"), ("ગુજરાત", "gujarAta"), ("ଓଡ଼ିଆ", "o.DiA"), ("தமிழ்", "tamizh"), ("తెలుగు", "telugu"), ("ಕನ್ನಡ", "kannaDa"), ("മലയാളം", "malayAlaM"),
    ("राम ગામ", "rAma ગામ"), ("ગામ राम", "gAma राम"),
])
def test_transliteration(spark, said, latin):
    assert values(spark, text.transliterate(F.col("c")), [said]) == [latin]


def test_transliteration_keeps_runs_of_capitals_without_compat(spark):
    assert values(spark, text.transliterate(F.col("c"), compat=False), ["पाटील", "ऋषि", "A B राम"]) == ["pATIla", "RRiShi", "A B rAma"]
