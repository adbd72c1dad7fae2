"""Client statistics, concentration and RFM segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salestide.functions.calendar import with_period
from salestide.functions.numeric import banded, mean, pct, ratio, total
from salestide.functions.ordering import globally_ranked, quantile_bucket
from salestide.session import durable

# RFM segments by least total score.
RFM_SEGMENTS = [(13, "Champions"), (10, "Fidèles"), (7, "Potentiels")]
LOWEST_SEGMENT = "Risque"


def client_options(df: DataFrame, n: int = 500) -> DataFrame:
    """Best clients by revenue with their name on the earliest named invoice."""
    name_order = F.when(F.col("client_name").isNotNull(), F.struct("invoice_date", "client_name"))
    return (
        df.where(F.col("client_id").isNotNull()).groupBy("client_id")
        .agg(total("amount").alias("revenue"), F.min_by("client_name", name_order).alias("client_name"))
        .orderBy(F.desc("revenue"), "client_id").limit(n)
    )


def _finish(per: DataFrame, last_day: Column) -> DataFrame:
    return per.withColumns(
        {"revenue_per_order": ratio("revenue", "orders"),
         "recency_days": F.date_diff(last_day, "last_date")}
    )


def client_stats(df: DataFrame, grain: str | None = None) -> DataFrame:
    """Revenue, lines, basket, frequency, first and last date, recency.

    Without a grain the frequency counts orders and the basket is the mean
    line.  With a grain it counts active periods and the basket is the mean
    revenue of those; rows without a client then form their own group.
    """
    last_day = df.agg(F.max("invoice_date")).scalar()
    if grain is None:
        per = df.where(F.col("client_id").isNotNull()).groupBy("client_id").agg(
            total("amount").alias("revenue"), F.count("amount").alias("lines"),
            mean("amount").alias("basket"), F.count_distinct("order_id").alias("orders"),
            F.min("invoice_date").alias("first_date"), F.max("invoice_date").alias("last_date"),
        )
        return _finish(per, last_day)
    periods = with_period(df, grain).groupBy("client_id", "period").agg(
        F.sum("amount").alias("_v"), F.count("amount").alias("_n"),
        F.min("invoice_date").alias("_a"), F.max("invoice_date").alias("_b"),
    )
    per = periods.groupBy("client_id").agg(
        total("_v").alias("revenue"), F.sum("_n").alias("lines"), mean("_v").alias("basket"),
        F.count("*").alias("orders"), F.min("_a").alias("first_date"), F.max("_b").alias("last_date"),
    )
    return _finish(per, last_day)


def concentration(stats: DataFrame) -> DataFrame:
    """Clients by revenue with rank, share and cumulative share."""
    exact = stats.withColumn("_v", F.col("revenue").cast("decimal(28,2)"))
    ranked = globally_ranked(exact, [F.desc("_v"), F.asc("client_id")], "rank", {"_run": "_v"})
    whole = ranked.agg(F.sum("_v").alias("t")).scalar()
    return ranked.withColumns(
        {"share_pct": pct("_v", whole), "cum_pct": pct("_run", whole)}
    ).drop("_v", "_run")


def concentration_summary(stats: DataFrame) -> DataFrame:
    """Share of the top 20 % of clients (rounded down) and of the top 10."""
    c = concentration(stats)
    n = c.agg(F.count("*").alias("n")).scalar()
    part = lambda m: F.coalesce(F.sum(F.when(m, F.col("share_pct"))), F.lit(0.0))
    return c.withColumn("n", n).agg(
        F.max("n").alias("clients"),
        part(F.col("rank") <= F.floor(F.col("n") * 0.2)).alias("top20_pct"),
        part(F.col("rank") <= 10).alias("top10_pct"),
    )


def rfm(stats: DataFrame) -> DataFrame:
    """Recency, frequency and money scores 1..5 and the segment.

    Scores cut unique ranks; ties are ranked by falling revenue, then client.
    """
    stats = durable(stats)
    n = stats.agg(F.count("*").alias("n")).scalar()
    tie = [F.desc("revenue"), F.asc("client_id")]
    orders = {"_r": [F.asc("recency_days"), *tie], "_f": [F.asc("orders"), *tie], "_m": [F.asc("revenue"), F.asc("client_id")]}
    # only what is ranked is sorted
    narrow = stats.select("client_id", "recency_days", "orders", "revenue")
    out = stats
    for name, order in orders.items():
        ranked = globally_ranked(narrow, order, name).select(F.col("client_id").alias("_c"), name)
        out = out.join(ranked, F.col("client_id").eqNullSafe(F.col("_c"))).drop("_c")
    out = out.withColumn("_n", n)
    best = F.least(F.lit(5), F.col("_n")) + 1
    bucket = lambda c: quantile_bucket(F.col(c), F.col("_n"))
    scored = out.withColumns(
        {"r_score": F.when(F.col("_n") < 2, 3).otherwise((best - bucket("_r")).cast("int")),
         "f_score": bucket("_f"), "m_score": bucket("_m")}
    ).drop("_r", "_f", "_m", "_n")
    score = F.col("r_score") + F.col("f_score") + F.col("m_score")
    return scored.withColumn("rfm_score", score).withColumn(
        "segment", banded(F.col("rfm_score"), RFM_SEGMENTS, LOWEST_SEGMENT)
    )


def segment_summary(scored: DataFrame) -> DataFrame:
    return scored.groupBy("segment").agg(
        F.sum("revenue").alias("revenue"), F.count("*").alias("clients"),
        F.avg("orders").alias("mean_orders"), F.avg("recency_days").alias("mean_recency"),
    )


def country_clients(df: DataFrame) -> DataFrame:
    return (
        df.where(F.col("country").isNotNull()).groupBy("country")
        .agg(F.count_distinct("client_id").alias("clients"), total("amount").alias("revenue"))
        .withColumn("revenue_per_client", ratio("revenue", "clients"))
    )


def client_kpis(stats: DataFrame) -> DataFrame:
    return stats.agg(
        F.count("*").alias("clients"), F.avg("revenue").alias("mean_revenue"),
        F.avg("revenue_per_order").alias("mean_per_order"),
    )
