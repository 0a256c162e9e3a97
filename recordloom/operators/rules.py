"""Validation rules as columns: each is a struct(rule_id, passed, severity, message).

A record is a row; columns that a frame lacks count as absent. `as_of` stands for now.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocabulary as V
from ..functions import dates
from ..functions.numbers import currency_number, first_number
from ..functions.text import any_of, first_of, strip

COLUMNS = [
    "state", "area", "total_area", "plot_area", "registration_date", "date", "owner_name", "co_owner_name", "survey_number", "khasra_number",
    "khata_number", "patta_number", "dag_number", "gat_number", "khatian_number", "pul_en", "unique_code", "plot_code", "fasli_year", "land_classification",
]


def complete(records: DataFrame) -> DataFrame:
    """With all columns that rules read, absent ones as nulls."""
    missing = {c: F.lit(None).cast("string") for c in COLUMNS if c not in records.columns}
    if "plots" not in records.columns:
        missing["plots"] = F.lit(None).cast("array<struct<area:string>>")
    return records.withColumns(missing) if missing else records


def given(*names: str) -> Column:
    """The first of the columns that is neither null nor empty."""
    return F.coalesce(*[F.nullif(F.col(n).cast("string"), F.lit("")) for n in names])


def outcome(rule_id: str, failures: list[tuple[Column, str, str]]) -> Column:
    """The first failure that holds, else passed."""
    severity = first_of([(F.coalesce(c, F.lit(False)), F.lit(s)) for c, s, _ in failures], F.lit(None).cast("string"))
    message = first_of([(F.coalesce(c, F.lit(False)), F.lit(m)) for c, _, m in failures], F.lit(None).cast("string"))
    return F.struct(F.lit(rule_id).alias("rule_id"), severity.isNull().alias("passed"), severity.alias("severity"), message.alias("message"))


def of_state(code: str, condition: Column) -> Column:
    return F.upper(F.coalesce("state", F.lit(""))).isin(V.STATES[code]) & condition


def area_sanity(as_of: Column) -> Column:
    raw = given("area", "total_area", "plot_area")
    n = first_number(raw)
    return outcome("RULE_AREA_SANITY", [
        (raw.isNotNull() & n.isNull(), "HIGH", "area has no number"), (n <= 0, "CRITICAL", "area is not positive"), (n > 50000, "MEDIUM", "area is unusually large"),
    ])


def area_sum(as_of: Column) -> Column:
    """Total against the sum of plots, 5 % and 0.01 apart at most; a plot that is no number passes the rule."""
    total = first_number(given("total_area", "area"))
    parts = F.transform("plots", lambda p: F.coalesce(p["area"], F.lit("x")).try_cast("double"))
    sums = F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)
    return outcome("RULE_AREA_SUM", [((F.size("plots") > 0) & (F.abs(total - sums) > total * 0.05 + 0.01), "HIGH", "plots do not sum to the total")])


def date_sanity(as_of: Column) -> Column:
    return outcome("RULE_DATE_SANITY", [(dates.parse_rule_date(given("registration_date", "date")) > as_of, "HIGH", "date is in the future")])


def owner_duplicate(as_of: Column) -> Column:
    a, b = F.lower(strip(F.coalesce("owner_name", F.lit("")))), F.lower(strip(F.coalesce("co_owner_name", F.lit(""))))
    return outcome("RULE_OWNER_DUPLICATE", [((a != "") & (a == b), "HIGH", "owner and co-owner are identical")])


def survey_format(as_of: Column) -> Column:
    n = strip(given("survey_number", "khasra_number", "patta_number", "dag_number", "gat_number"))
    return outcome("RULE_SURVEY_FORMAT", [((n != "") & ~n.rlike(r"^[0-9A-Za-z/\-.\s]+$"), "MEDIUM", "number has an invalid form")])


def maharashtra(as_of: Column) -> Column:
    return outcome("RULE_MH_712", [
        (of_state("MH", given("khata_number").isNull()), "HIGH", "khata number is missing"),
        (of_state("MH", given("gat_number", "survey_number").isNull()), "HIGH", "gat or survey number is missing"),
    ])


def uttar_pradesh(as_of: Column) -> Column:
    code, year = strip(given("unique_code", "plot_code")), strip(given("fasli_year"))
    return outcome("RULE_UP_KHATAUNI", [
        (of_state("UP", given("khasra_number", "survey_number").isNull()), "HIGH", "khasra number is missing"),
        (of_state("UP", ~code.rlike(r"^\d{16}$")), "MEDIUM", "unique code is not of 16 digits"),
        (of_state("UP", ~year.rlike(r"^1[34]\d{2}(?:\s*-\s*1[34]\d{2})?$")), "LOW", "fasli year has an unknown form"),
    ])


def madhya_pradesh(as_of: Column) -> Column:
    return outcome("RULE_MP_KHASRA", [(of_state("MP", given("khasra_number", "survey_number").isNull()), "HIGH", "khasra number is missing")])


def tamil_nadu(as_of: Column) -> Column:
    land = F.lower(given("land_classification"))
    return outcome("RULE_TN_PATTA", [
        (of_state("TN", given("pul_en", "survey_number").isNull()), "HIGH", "pul en is missing"),
        (of_state("TN", ~any_of(land, V.PADDY_WORDS)), "LOW", "land classification is unusual"),
    ])


def andhra_telangana(as_of: Column) -> Column:
    return outcome("RULE_AP_TS_ADANGAL", [
        (of_state("AP_TS", given("survey_number", "khasra_number").isNull()), "HIGH", "survey number is missing"),
        (of_state("AP_TS", given("khata_number").isNull()), "MEDIUM", "khata number is missing"),
    ])


def karnataka(as_of: Column) -> Column:
    return outcome("RULE_KA_BHOOMI", [(of_state("KA", given("survey_number").isNull()), "HIGH", "survey number is missing")])


def west_bengal(as_of: Column) -> Column:
    neither = given("khatian_number", "khata_number").isNull() & given("dag_number", "survey_number").isNull()
    return outcome("RULE_WB_BANGLARBHUMI", [(of_state("WB", neither), "HIGH", "khatian and dag number are missing")])


RULES: list[Callable[[Column], Column]] = [
    area_sanity, area_sum, date_sanity, owner_duplicate, survey_format, maharashtra, uttar_pradesh,
    madhya_pradesh, tamil_nadu, andhra_telangana, karnataka, west_bengal,
]


def validate(records: DataFrame, as_of: Column, extra: list[Callable[[Column], Column]] = ()) -> DataFrame:
    """Records with is_valid, total_rules, failed_count and failures, in the order of the rules."""
    results = F.array(*[rule(as_of) for rule in [*RULES, *extra]])
    checked = complete(records).withColumn("failures", F.filter(results, lambda r: ~r["passed"]))
    return checked.withColumns({"total_rules": F.lit(len(RULES) + len(extra)), "failed_count": F.size("failures"), "is_valid": F.size("failures") == 0})


def field_problem(name: Column, value: Column, kind: Column, as_of: Column) -> Column:
    """What is wrong with a field by itself, or null."""
    low = F.lower(name)
    is_area = (kind == "area") | F.contains(low, F.lit("area"))
    is_date = (kind == "date") | F.contains(low, F.lit("date"))
    is_money = (kind == "currency") | any_of(low, ["value", "amount", "duty", "price", "consideration"])
    return (
        F.when(F.coalesce(strip(value), F.lit("")) == "", "empty").when(is_area & (currency_number(value) <= 0), "area is not positive")
        .when(is_date & (dates.parse_date(value) > as_of), "date is in the future").when(is_money & (currency_number(value) < 0), "amount is negative")
    )


def anomalies(records: DataFrame, as_of: Column) -> DataFrame:
    """Records with the array `anomalies` of eight checks, and needs_review."""
    missing = sum((F.when(given(c).isNull(), 1).otherwise(0) for c in ("owner_name", "survey_number", "area", "village", "district", "registration_date")), F.lit(0))
    owner, other = F.lower(strip(F.col("owner_name"))), F.lower(strip(F.col("co_owner_name")))
    checks = [
        (currency_number(F.col("area")) <= 0, "area is not positive"),
        (dates.parse_date(F.col("registration_date")) > as_of, "registration date is in the future"),
        (missing >= 3, "three fields or more are missing"),
        (currency_number(F.col("market_value")) > 1e8, "market value is unusually high"),
        ((owner != "") & (owner == other), "owner and co-owner are identical"),
        (F.length(F.coalesce("text", F.lit(""))) < 100, "text is short"),
        (F.col("ml_flag"), "anomaly model"),
        (F.size("failures") > 0, "rules failed"),
    ]
    listed = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), m) for c, m in checks]), lambda x: x.isNotNull())
    return records.withColumn("anomalies", listed).withColumn("needs_review", F.size("anomalies") > 0)
