"""Data profile: sizes, missing values, numeric and categorical summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from salestide.functions.numeric import pct, total
from salestide.functions.ordering import exact_percentiles


def long_numeric(df: DataFrame, columns: list[str], keep: list[str] = ()) -> DataFrame:
    """(keep.., variable, value) rows of numeric columns."""
    return df.select(*keep, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        list(keep), columns, "variable", "value"
    )


def dataset_info(df: DataFrame) -> DataFrame:
    """Row count with the column names and types, one row per column."""
    fields = F.array(
        *[
            F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column"),
                     F.lit(f.dataType.simpleString()).alias("type"))
            for i, f in enumerate(df.schema.fields)
        ]
    )
    return df.agg(F.count("*").alias("rows")).select(
        "rows", F.lit(len(df.columns)).alias("columns"), F.inline(fields)
    )


def missing_values(df: DataFrame) -> DataFrame:
    """Missing count and share of the columns that have missing values."""
    counted = df.agg(
        F.count("*").alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]
    )
    return (
        counted.unpivot(["_rows"], df.columns, "column", "missing")
        .where("missing > 0")
        .select("column", "missing", pct("missing", "_rows").alias("missing_pct"))
    )


def numeric_summary(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """count, mean, sample std, min, exact quartiles, max per numeric column."""
    columns = columns or [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]
    values = long_numeric(df, columns)
    base = values.groupBy("variable").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    )
    quartiles = exact_percentiles(
        values, ["variable"], "value", {"q25": 0.25, "median": 0.5, "q75": 0.75}
    )
    return base.join(quartiles, "variable", "left")


def categorical_summary(df: DataFrame, columns: list[str], top: int = 5) -> DataFrame:
    """Distinct count and most frequent values of each column."""
    values = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot(
        [], columns, "variable", "value"
    )
    counts = values.where("value is not null").groupBy("variable", "value").agg(F.count("*").alias("n"))
    distinct = counts.groupBy("variable").agg(F.count("*").alias("distinct_values"))
    w = Window.partitionBy("variable").orderBy(F.desc("n"), "value")
    leading = counts.withColumn("position", F.row_number().over(w)).where(F.col("position") <= top)
    return leading.join(distinct, "variable")


def categorical_columns(df: DataFrame, max_distinct: int = 20) -> list[str]:
    """String columns, and others with fewer than ``max_distinct`` values (bounded result row)."""
    strings = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    others = [c for c in df.columns if c not in strings]
    if not others:
        return strings
    row = df.agg(*[F.approx_count_distinct(c, 0.01).alias(c) for c in others]).first()
    return strings + [c for c in others if row[c] < max_distinct]


def value_share(df: DataFrame, column: str = "family") -> DataFrame:
    """Rows and share of rows per value."""
    counts = df.groupBy(column).agg(F.count("*").alias("rows"))
    return counts.withColumn("share_pct", pct("rows", df.agg(F.count("*").alias("n")).scalar()))


def head_rows(df: DataFrame, order: list[Column], n: int = 10) -> DataFrame:
    return df.orderBy(*order).limit(n)


def date_range(df: DataFrame, date: str = "invoice_date") -> DataFrame:
    return df.agg(F.min(date).alias("first_date"), F.max(date).alias("last_date"))


def source_summary(df: DataFrame, variable: str, source: str = "source_file") -> DataFrame:
    """Numeric description of one variable per source file."""
    d = df.select(source, F.col(variable).cast("double").alias("value"), F.col(variable).alias("_raw"))
    base = d.groupBy(source).agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"),
        total("_raw").alias("total"),
    )
    return base.join(exact_percentiles(d, [source], "value", {"median": 0.5}), source, "left")


def histogram_by(df: DataFrame, key: str, variable: str, bins: int = 30) -> DataFrame:
    """Equal-width bins per key between the key's own minimum and maximum."""
    d = df.select(key, F.col(variable).cast("double").alias("value")).where("value is not null")
    edges = d.groupBy(key).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    position = F.coalesce(
        F.try_divide(F.col("value") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0)
    )
    # equal values are counted before they meet the edges, so a heavy key shuffles few rows
    counted = d.groupBy(key, "value").agg(F.count("*").alias("c"))
    return (
        counted.join(edges, key)
        .withColumn("bin", F.least(F.floor(position * bins), F.lit(bins - 1)).cast("int") + 1)
        .groupBy(key, "bin")
        .agg(F.sum("c").alias("rows"))
    )


def points(df: DataFrame, variable: str, date: str = "invoice_date") -> DataFrame:
    """(date, value) pairs without nulls, in date order."""
    return (
        df.select(F.col(date).alias("date"), F.col(variable).cast("double").alias("value"))
        .na.drop()
        .orderBy("date", "value")
    )

