"""Period columns, labels, filters and working days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salestide.functions import calendar as cal

# Quarter number per month in the October-start calendar.
OCTOBER_QUARTERS = {10: 1, 11: 1, 12: 1, 1: 2, 2: 2, 3: 2, 4: 3, 5: 3, 6: 3, 7: 4, 8: 4, 9: 4}


def with_october_periods(df: DataFrame, date: str = "invoice_date") -> DataFrame:
    """Calendar year, month number and the October-start quarter number."""
    d = F.col(date)
    lookup = F.create_map(*[F.lit(v) for pair in OCTOBER_QUARTERS.items() for v in pair])
    return df.withColumns(
        {"cal_year": F.year(d), "cal_month": F.month(d), "october_quarter": lookup[F.month(d)]}
    )


def october_label(df: DataFrame, grain: str) -> DataFrame:
    """Display label of the October-start calendar with a sort key in group order."""
    y = F.col("cal_year").cast("string")
    if grain == "month":
        label = F.concat(y, F.lit("-"), F.lpad(F.col("cal_month").cast("string"), 2, "0"))
        key = F.col("cal_year") * 100 + F.col("cal_month")
    elif grain == "quarter":
        label = F.concat(y, F.lit("-Q"), F.col("october_quarter").cast("string"))
        key = F.col("cal_year") * 10 + F.col("october_quarter")
    else:
        label, key = y, F.col("cal_year")
    return df.withColumns({"period_label": label, "period_key": key})


def filter_period(df: DataFrame, kind: str, value: str | None) -> DataFrame:
    """Rows of one month (``2024-01``), fiscal quarter label or fiscal year label."""
    if value is None:
        return df
    column = {
        "month": "month", "quarter": "fiscal_quarter_label", "fiscal_year": "fiscal_year_label",
    }[kind]
    return df.where(F.col(column) == value)


def available_periods(df: DataFrame) -> DataFrame:
    """Distinct months, fiscal quarters and fiscal years with a sort key, in one pass."""
    d = F.col("invoice_date")
    entries = F.array(
        *[
            F.struct(F.lit(kind).alias("kind"), label.alias("label"), index.alias("sort_key"))
            for kind, label, index in (
                ("month", F.col("month"), cal.period_index(d, "month")),
                ("quarter", F.col("fiscal_quarter_label"), cal.period_index(d, "quarter")),
                ("fiscal_year", F.col("fiscal_year_label"), cal.period_index(d, "year")),
            )
        ]
    )
    # one row per day first, so that only a calendar's worth of rows is exploded
    days = df.where(d.isNotNull()).select(
        "invoice_date", "month", "fiscal_quarter_label", "fiscal_year_label"
    ).distinct()
    return days.select(F.inline(entries)).where("label is not null").distinct()


def label_sort_key(label: Column) -> Column:
    """Integer that sorts mixed labels (``FY2025``, ``Q1 (..) FY2025``, ``2025-03``) in time order."""
    fy = F.regexp_extract(label, r"FY\s*(\d{4})", 1)
    q = F.regexp_extract(label, r"Q\s*([1-4])", 1)
    month = F.regexp_extract(label, r"^(\d{4})-(\d{2})$", 1)
    return (
        F.when(
            fy != "",
            fy.try_cast("int") * 100 + F.coalesce(q.try_cast("int"), F.lit(0)),
        )
        .when(month != "", F.replace(label, F.lit("-"), F.lit("")).try_cast("int"))
    )


def short_label(label: Column) -> Column:
    """``Q1 (Avr-Juin) FY2025`` becomes ``FY2025 Q1``; other labels stay."""
    fy = F.regexp_extract(label, r"FY\s*(\d{4})", 1)
    q = F.regexp_extract(label, r"Q\s*([1-4])", 1)
    return F.when(
        (fy != "") & (q != ""), F.concat(F.lit("FY"), fy, F.lit(" Q"), q)
    ).otherwise(F.coalesce(label, F.lit("")))


def quarter_start(fy: Column, q: Column) -> Column:
    """First day of a fiscal quarter (April start)."""
    return F.when(
        q == 4, F.make_date(fy, F.lit(1), F.lit(1))
    ).otherwise(F.make_date(fy - 1, q * 3 + 1, F.lit(1)))


def business_days(first: Column, last: Column) -> Column:
    """Weekdays between two dates, at least 1."""
    return F.greatest(cal.open_days(first, last), F.lit(1))


def quarter_open_days(
    df: DataFrame, closures: dict[int, list[tuple[str, str]]] | None = None, date: str = "order_date"
) -> DataFrame:
    """Calendar quarters present with their open weekdays, closures (per year) removed."""
    d = F.col(date)
    start = F.trunc(d, "quarter")
    quarters = df.where(d.isNotNull()).select(start.alias("quarter_start")).distinct()
    end = F.last_day(F.add_months("quarter_start", 2))
    days = F.lit(None).cast("int")
    base = cal.open_days(F.col("quarter_start"), end)
    days = base
    for year, ranges in (closures or {}).items():
        days = F.when(
            F.year("quarter_start") == year, cal.open_days(F.col("quarter_start"), end, ranges)
        ).otherwise(days)
    return quarters.select(
        F.concat(
            F.year("quarter_start").cast("string"), F.lit("Q"), F.quarter("quarter_start").cast("string")
        ).alias("quarter"),
        "quarter_start",
        F.greatest(days, F.lit(1)).alias("open_days"),
    )


def order_years(df: DataFrame, date: str = "order_date") -> DataFrame:
    return df.select(F.year(date).alias("year")).where("year is not null").distinct()


def spanned_periods(df: DataFrame, grain: str, date: str = "invoice_date") -> DataFrame:
    """Periods from the first to the last date of each client, both included."""
    return (
        df.groupBy("client_id")
        .agg(F.min(date).alias("first_date"), F.max(date).alias("last_date"))
        .withColumn(
            "spanned_periods",
            cal.period_ordinal(F.col("last_date"), grain)
            - cal.period_ordinal(F.col("first_date"), grain)
            + 1,
        )
    )
