"""Fiscal and calendar period columns.

Every label travels with an integer index that sorts in time order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Wording of the fiscal quarter labels (April start).
QUARTER_WORDS = {1: "Q1 (Avr-Juin)", 2: "Q2 (Juil-Sep)", 3: "Q3 (Oct-Déc)", 4: "Q4 (Jan-Mar)"}
# French month names.
MONTH_WORDS = [
    "Janvier", "Février", "Mars", "Avril", "Mai", "Juin",
    "Juillet", "Août", "Septembre", "Octobre", "Novembre", "Décembre",
]

GRAINS = ("month", "quarter", "year")


def fiscal_year(d: Column, start: int = 4) -> Column:
    """Year in which the fiscal year ends; a January start is the calendar year."""
    if start == 1:
        return F.year(d)
    return F.year(d) + F.when(F.month(d) >= start, 1).otherwise(0)


def fiscal_quarter(d: Column, start: int = 4) -> Column:
    return (F.floor(F.pmod(F.month(d) - start, F.lit(12)) / 3) + 1).cast("int")


def month_label(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM")


def quarter_words(q: Column) -> Column:
    out = F
    for number, words in QUARTER_WORDS.items():
        out = out.when(q == number, F.lit(words))
    return out


def period_label(d: Column, grain: str) -> Column:
    if grain == "month":
        return month_label(d)
    if grain == "quarter":
        return F.concat(fiscal_year(d).cast("string"), F.lit("Q"), fiscal_quarter(d).cast("string"))
    return F.concat(F.lit("FY"), fiscal_year(d).cast("string"))


def period_index(d: Column, grain: str) -> Column:
    if grain == "month":
        return F.year(d) * 100 + F.month(d)
    if grain == "quarter":
        return fiscal_year(d) * 10 + fiscal_quarter(d)
    return fiscal_year(d)


def period_ordinal(d: Column, grain: str) -> Column:
    """Consecutive number of the period, so differences count periods."""
    if grain == "month":
        return F.year(d) * 12 + F.month(d)
    if grain == "quarter":
        return fiscal_year(d) * 4 + fiscal_quarter(d)
    return fiscal_year(d)


def with_period(df: DataFrame, grain: str, date: str = "invoice_date") -> DataFrame:
    """Add ``period`` (label) and ``period_index`` and drop rows without a date."""
    if grain not in GRAINS:
        raise ValueError(f"grain must be one of {GRAINS}")
    d = F.col(date)
    return (
        df.where(d.isNotNull())
        .withColumn("period", period_label(d, grain))
        .withColumn("period_index", period_index(d, grain))
    )


def with_fiscal_calendar(df: DataFrame, date: str = "invoice_date", start: int = 4) -> DataFrame:
    """All calendar columns of the cleaned fact table."""
    d = F.col(date)
    fy, fq = fiscal_year(d, start), fiscal_quarter(d, start)
    label = F.concat(F.lit("FY"), fy.cast("string"))
    return df.withColumns(
        {
            "year": F.year(d),
            "month": month_label(d),
            "fiscal_year": fy,
            "fiscal_year_label": label,
            "fiscal_quarter_num": fq,
            "fiscal_quarter_code": F.concat(fy.cast("string"), F.lit("Q"), fq.cast("string")),
            "fiscal_quarter_label": F.concat(quarter_words(fq), F.lit(" "), label),
            "weekday": F.weekday(d),
        }
    )


def open_days(first: Column, last: Column, closures: list[tuple[str, str]] = ()) -> Column:
    """Weekdays from first to last (inclusive) outside the closure ranges."""

    def is_open(day: Column) -> Column:
        keep = F.weekday(day) < 5
        for a, b in closures:
            keep = keep & ~day.between(F.lit(a).cast("date"), F.lit(b).cast("date"))
        return keep

    return F.when(
        first <= last, F.size(F.filter(F.sequence(first, last), is_open))
    ).otherwise(F.lit(0))
