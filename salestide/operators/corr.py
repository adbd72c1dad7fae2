"""Pearson and Spearman correlations."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salestide.functions.calendar import with_period
from salestide.functions.numeric import banded, safe_corr
from salestide.functions.ordering import average_ranks
from salestide.operators.products import item_series, item_stats
from salestide.session import durable

MEASURES = [
    "revenue", "qty", "price", "median_lead_time", "p90_deviation", "late_pct", "clients", "orders",
]


def _pairs(variables: list[str]) -> list[tuple[str, str]]:
    return list(combinations(variables, 2))


def _pearson(a: str, b: str) -> Column:
    return safe_corr(a, b)


def pearson_matrix(df: DataFrame, variables: list[str], keys: list[str] = ()) -> DataFrame:
    """One row per pair (and key), all pairs from one aggregate."""
    pairs = _pairs(variables)
    wide = df.groupBy(*keys).agg(
        F.count("*").alias("_rows"), *[_pearson(a, b).alias(f"p{i}") for i, (a, b) in enumerate(pairs)]
    )
    rows = F.array(
        *[
            F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"p{i}").alias("r"))
            for i, (a, b) in enumerate(pairs)
        ]
    )
    return wide.select(*keys, "_rows", F.inline(rows))


def strength(df: DataFrame, variables: list[str]) -> DataFrame:
    """Pairs with |r| > 0.3, their sign and strength."""
    m = pearson_matrix(df, variables).drop("_rows").where(F.abs("r") > 0.3)
    return m.withColumns(
        {
            "direction": F.when(F.col("r") > 0, "positive").otherwise("negative"),
            "strength": banded(F.abs("r"), [(0.7, "strong"), (0.5, "moderate")], "weak to moderate", "gt"),
        }
    )


def pearson_by_period(df: DataFrame, variables: list[str], grain: str) -> DataFrame:
    """Pairs per period with at least 3 lines; a period with any undefined pair is left out."""
    m = pearson_matrix(with_period(df, grain), variables, ["period", "period_index"]).where("_rows >= 3")
    undefined = F.count_if(F.col("r").isNull()).over(Window.partitionBy("period"))
    return m.withColumn("_u", undefined).where("_u = 0").select("period", "period_index", "a", "b", "r")


def spearman(df: DataFrame, keys: list[str], pairs: list[tuple[str, str]]) -> DataFrame:
    """Rank correlation per key over pairwise complete rows, ties averaged.

    Ranks come from one order of all values, so a pair may hold any number of
    rows.
    """
    rows = F.array(
        *[
            F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).cast("double").alias("x"),
                     F.col(b).cast("double").alias("y"))
            for a, b in pairs
        ]
    )
    long = df.select(*keys, F.inline(rows)).where("x is not null and y is not null")
    part = [*keys, "a", "b"]
    return (
        average_ranks(durable(long), part, {"x": "rx", "y": "ry"})
        .groupBy(*part)
        .agg(
            F.count("*").alias("n"),
            safe_corr("rx", "ry").alias("rho"),
        )
    )


def family_spearman(df: DataFrame) -> DataFrame:
    return spearman(item_stats(df, "family"), [], _pairs(MEASURES)).drop("n")


def item_spearman(df: DataFrame, item: str, grain: str) -> DataFrame:
    """Every item's period measures against its revenue, items with at least 3 periods."""
    series = item_series(df, item, grain)
    enough = series.groupBy("item").agg(F.count("*").alias("n")).where("n >= 3").select("item")
    pairs = [("revenue", m) for m in MEASURES if m != "revenue"]
    return (
        spearman(series.join(enough, "item", "left_semi"), ["item"], pairs)
        .select("item", F.col("b").alias("variable"), "rho")
    )


def lead_time_effects(summary: DataFrame, key: str = "client_id") -> DataFrame:
    """Lead time against orders and revenue of the same and of the next period.

    ``summary`` holds (key, period_index, median_lead_time, orders, revenue).
    At least 3 points and 2 distinct values on both sides are needed.
    """
    w = Window.partitionBy(key).orderBy("period_index")
    d = summary.withColumns(
        {"next_orders": F.lead("orders").over(w), "next_revenue": F.lead("revenue").over(w)}
    )

    def guarded(y: str, given: str) -> Column:
        ok = F.col("median_lead_time").isNotNull() & F.col(given).isNotNull()
        a, b = F.when(ok, F.col("median_lead_time")), F.when(ok, F.col(y).cast("double"))
        return F.when(F.count(a) >= 3, safe_corr(a, b))

    return d.groupBy(key).agg(
        guarded("orders", "orders").alias("orders_same"), guarded("revenue", "orders").alias("revenue_same"),
        guarded("next_orders", "next_orders").alias("orders_next"),
        guarded("next_revenue", "next_orders").alias("revenue_next"),
    )
