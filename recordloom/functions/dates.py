"""Dates from text, Column to Column. `as_of` stands for now, so results can be repeated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocabulary as V
from .text import normalize_digits, strip

#: Shapes that the formats take, so that a lenient parser cannot take more.
SHAPES = {
    "d-M-yyyy": r"^\d{1,2}-\d{1,2}-\d{4}$", "d/M/yyyy": r"^\d{1,2}/\d{1,2}/\d{4}$", "d.M.yyyy": r"^\d{1,2}\.\d{1,2}\.\d{4}$",
    "d-M-yy": r"^\d{1,2}-\d{1,2}-\d{2}$", "d/M/yy": r"^\d{1,2}/\d{1,2}/\d{2}$", "yyyy-M-d": r"^\d{4}-\d{1,2}-\d{1,2}$",
    "d MMMM yyyy": r"^\d{1,2} [A-Za-z]{4,} \d{4}$", "d MMM yyyy": r"^\d{1,2} [A-Za-z]{3} \d{4}$",
}


def _parse(c: Column, formats: list[str]) -> Column:
    text = F.initcap(strip(normalize_digits(c, compat=False)))
    tried = []
    for f in formats:
        day = F.when(text.rlike(SHAPES[f]), F.try_to_timestamp(text, F.lit(f)).cast("date"))
        if f.endswith("-yy") or f.endswith("/yy"):  # 69..99 are of the last century
            day = F.when(F.year(day) % 100 >= 69, F.add_months(day, -1200)).otherwise(day)
        tried.append(day)
    return F.coalesce(*tried)


def parse_date(c: Column) -> Column:
    """The date of the first of eight formats that fits, else null."""
    return _parse(c, V.DATE_FORMATS)


def parse_rule_date(c: Column) -> Column:
    return _parse(c, V.RULE_DATE_FORMATS)


def is_future(day: Column, as_of: Column) -> Column:
    return F.coalesce(day > as_of, F.lit(False))


def is_suspicious(c: Column) -> Column:
    """Text that names the future or a year that cannot be."""
    return F.coalesce(F.lower(c).rlike("future|209|2100"), F.lit(False))


def display(day: Column) -> Column:
    return F.date_format(day, "dd MMM yyyy")
