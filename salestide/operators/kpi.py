"""Indicators, distributions, Pareto and lead times."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from salestide.functions import calendar as cal
from salestide.functions.numeric import banded, mean, pct, ratio, total
from salestide.functions.ordering import exact_percentiles, globally_ranked
from salestide.operators.periods import october_label, with_october_periods
from salestide.operators.profile import long_numeric
from salestide.session import spread

# Lead time buckets in days and the valid range.
LEAD_TIME_BUCKETS = [
    (0, 3, "0-3 jours"), (4, 7, "4-7 jours"), (8, 14, "8-14 jours"),
    (15, 30, "15-30 jours"), (31, 60, "31-60 jours"), (61, 730, ">60 jours"),
]
LEAD_TIME_VALID = (0, 730)


def global_kpis(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count("*").alias("lines"),
        total("amount").alias("revenue"),
        F.count_distinct("client_id").alias("clients"),
        F.count_distinct("family").alias("families"),
        mean("amount").alias("mean_line"),
        F.count_distinct("country").alias("countries"),
        ratio(F.sum("amount"), F.count_distinct("client_id")).alias("revenue_per_client"),
    )


def basket_kpis(df: DataFrame) -> DataFrame:
    """Indicators with the basket per order."""
    orders = F.count_distinct("order_id")
    return df.agg(
        total("amount").alias("revenue"), orders.alias("orders"),
        F.count_distinct("client_name").alias("clients"),
        F.count_distinct("country").alias("countries"),
        F.count_distinct("family").alias("families"),
        F.coalesce(ratio(F.sum("amount"), orders), F.lit(0.0)).alias("mean_basket"),
    )


def metric_by_october_period(df: DataFrame, grain: str, metric: str = "amount") -> DataFrame:
    return (
        october_label(with_october_periods(df), grain)
        .groupBy("period_label", "period_key")
        .agg(total(metric).alias("value"))
    )


def top_n(df: DataFrame, entity: str, metric: str = "amount", n: int = 10) -> DataFrame:
    """Largest entities by summed metric; ties in entity order."""
    return (
        df.where(F.col(entity).isNotNull())
        .groupBy(F.col(entity).alias("label"))
        .agg(total(metric).alias("value"))
        .orderBy(F.desc("value"), "label")
        .limit(n)
    )


def entity_curve(df: DataFrame, entity: str, metric: str = "amount") -> DataFrame:
    """Entities by falling metric with rank and cumulative metric (exact, distributed)."""
    per = (
        df.where(F.col(entity).isNotNull())
        .groupBy(F.col(entity).alias("entity"))
        .agg(F.coalesce(F.sum(metric), F.lit(0)).alias("value"))
    )
    return globally_ranked(per, [F.desc("value"), F.asc("entity")], "rank", {"running": "value"})


def pareto_curve(df: DataFrame, entity: str, metric: str = "amount") -> DataFrame:
    curve = entity_curve(df, entity, metric)
    whole = curve.agg(F.sum("value").alias("t")).scalar()
    return curve.select(
        "entity", "rank", F.col("value").cast("double").alias("value"),
        pct("running", whole).alias("cum_pct"),
    )


def pareto_shares(df: DataFrame, entity: str, metric: str = "amount") -> DataFrame:
    """Share of the top 20 % of the entities (at least one) and of the top 10."""
    curve = entity_curve(df, entity, metric)
    n = curve.agg(F.count("*").alias("n")).scalar()
    cut = F.greatest(F.lit(1), F.floor(F.col("n_total") * 0.2))
    return (
        curve.withColumn("n_total", n)
        .agg(
            F.max("n_total").alias("n_total"),
            F.max(cut).alias("n_20pct"),
            F.sum("value").alias("t"),
            F.sum(F.when(F.col("rank") <= cut, F.col("value"))).alias("t20"),
            F.sum(F.when(F.col("rank") <= 10, F.col("value"))).alias("t10"),
        )
        .select(
            "n_total", "n_20pct", pct("t20", "t").alias("top_20pct_share"),
            pct("t10", "t").alias("top_10_share"),
        )
    )


# ── lead time ──


def with_lead_time(df: DataFrame) -> DataFrame:
    """``lead_time_days`` as given, else from the dates at hand.

    ship - order; else ship - (invoice - 60 days); else invoice - order.
    """
    if "lead_time_days" in df.columns:
        return df
    has = set(df.columns)
    if {"ship_date", "order_date"} <= has:
        days = F.date_diff("ship_date", "order_date")
    elif {"ship_date", "invoice_date"} <= has:
        days = F.date_diff("ship_date", F.date_sub("invoice_date", 60))
    elif {"order_date", "invoice_date"} <= has:
        days = F.date_diff("invoice_date", "order_date")
    else:
        raise ValueError("lead time needs two of ship_date, order_date, invoice_date")
    return df.withColumn("lead_time_days", days)


def valid_lead_times(df: DataFrame) -> DataFrame:
    return with_lead_time(df).where(F.col("lead_time_days").between(*LEAD_TIME_VALID))


def lead_time_summary(df: DataFrame) -> DataFrame:
    """Median, mean, sample std over 0..730 days; share of negative and of > 365 days.

    The exact median is safe here: it holds at most 731 distinct values.
    """
    lt = F.col("lead_time_days")
    ok = F.when(lt.between(*LEAD_TIME_VALID), lt)
    return with_lead_time(df).where(lt.isNotNull()).agg(
        F.coalesce(F.median(ok), F.lit(0.0)).alias("median"),
        F.coalesce(mean(ok), F.lit(0.0)).alias("mean"),
        F.coalesce(F.stddev_samp(ok), F.lit(0.0)).alias("std"),
        pct(F.count_if(lt < 0), F.count("*")).alias("pct_anomalies"),
        pct(F.count_if(lt > 365), F.count("*")).alias("pct_extremes"),
        F.count("*").alias("n_total"),
        F.count(ok).alias("n_valid"),
    )


def lead_time_buckets(df: DataFrame) -> DataFrame:
    """Lines per lead time bucket, empty buckets as 0, from one row of conditional counts."""
    lt = F.col("lead_time_days")
    counted = with_lead_time(df).agg(
        *[F.count_if(lt.between(a, b)).alias(f"b{i}") for i, (a, b, _) in enumerate(LEAD_TIME_BUCKETS)]
    )
    rows = F.array(
        *[
            F.struct(F.lit(i + 1).alias("position"), F.lit(label).alias("bucket"),
                     F.col(f"b{i}").alias("lines"))
            for i, (_, _, label) in enumerate(LEAD_TIME_BUCKETS)
        ]
    )
    return counted.select(F.inline(rows))


def lead_time_by_period(df: DataFrame, grain: str) -> DataFrame:
    return (
        october_label(with_october_periods(valid_lead_times(df)), grain)
        .groupBy("period_label", "period_key")
        .agg(F.median("lead_time_days").alias("median"))
    )


# ── distributions ──


def describe(df: DataFrame, variables: list[str], keys: list[str] = ()) -> DataFrame:
    """Mean, exact median, sample std, min, max, count per variable (and key)."""
    keys = list(keys)
    values = long_numeric(df, variables, keys)
    base = values.groupBy(*keys, "variable").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"), F.count("value").alias("n"),
    )
    medians = exact_percentiles(values, [*keys, "variable"], "value", {"median": 0.5})
    return base.join(medians, [*keys, "variable"], "left")


def period_aggregate(df: DataFrame, grain: str) -> DataFrame:
    return (
        cal.with_period(df, grain)
        .groupBy("period", "period_index")
        .agg(
            total("amount").alias("revenue"), total("qty").alias("qty"),
            F.avg("unit_price").alias("mean_price"), F.avg("lead_time_days").alias("mean_lead_time"),
            F.avg("planned_days").alias("mean_planned"),
            F.avg("lead_time_deviation").alias("mean_deviation"),
        )
    )


def distinct_dimensions(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count_distinct("family").alias("families"), F.count_distinct("country").alias("countries")
    )


def period_revenue(df: DataFrame, grain: str) -> DataFrame:
    return (
        cal.with_period(df, grain).groupBy("period", "period_index").agg(total("amount").alias("revenue"))
    )


def _in_time() -> Window:
    # used on one row per period only
    return Window.orderBy("period_index")


def period_change(df: DataFrame, grain: str) -> DataFrame:
    before = F.lag("revenue").over(_in_time())
    return period_revenue(df, grain).withColumn(
        "change_pct", (ratio("revenue", before) - 1) * 100
    )


def period_share(df: DataFrame, grain: str) -> DataFrame:
    return period_revenue(df, grain).withColumn(
        "share_pct", pct("revenue", F.sum("revenue").over(Window.partitionBy(F.lit(1))))
    )


def extreme_periods(df: DataFrame, grain: str, n: int = 5) -> DataFrame:
    """The n best and n worst periods."""
    high = F.row_number().over(Window.orderBy(F.desc("revenue"), "period_index"))
    low = F.row_number().over(Window.orderBy("revenue", "period_index"))
    ranked = period_revenue(df, grain).withColumns({"top_rank": high, "bottom_rank": low})
    return ranked.where((F.col("top_rank") <= n) | (F.col("bottom_rank") <= n)).select(
        "period", "period_index", "revenue",
        (F.col("top_rank") <= n).alias("is_top"), (F.col("bottom_rank") <= n).alias("is_bottom"),
    )


def mean_line_by_period(df: DataFrame, grain: str) -> DataFrame:
    return (
        cal.with_period(df, grain).groupBy("period", "period_index").agg(mean("amount").alias("mean_line"))
    )


def stability(df: DataFrame, grain: str) -> DataFrame:
    """Sample std of line amounts per period against the median std of the periods."""
    per = (
        cal.with_period(df, grain)
        .groupBy("period", "period_index")
        .agg(F.stddev_samp(F.col("amount").cast("double")).alias("std"))
    )
    middle = F.median("std").over(Window.partitionBy(F.lit(1)))
    return per.withColumn("is_stable", F.col("std") < middle)


def evolution(df: DataFrame, grain: str, variable: str) -> DataFrame:
    """Mean, median and sum of one variable per period."""
    d = cal.with_period(df, grain).withColumn("_v", F.col(variable).cast("double"))
    keys = ["period", "period_index"]
    base = d.groupBy(*keys).agg(F.avg("_v").alias("mean"), F.sum("_v").alias("sum"))
    return base.join(exact_percentiles(d, keys, "_v", {"median": 0.5}), keys, "left")


def histogram(df: DataFrame, variable: str, bins: int = 50) -> DataFrame:
    """Equal-width bins from minimum to maximum, empty bins as 0."""
    v = df.select(F.col(variable).cast("double").alias("v")).where("v is not null")
    edges = v.agg(F.struct(F.min("v").alias("lo"), F.max("v").alias("hi")).alias("e")).scalar()
    position = F.coalesce(F.try_divide(F.col("v") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0))
    counts = (
        v.withColumn("e", edges).select("v", "e.lo", "e.hi")
        .groupBy(F.least(F.floor(position * bins), F.lit(bins - 1)).cast("int").alias("bin"))
        .agg(F.count("*").alias("rows"))
    )
    grid = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).select(
        "lo", ((F.col("hi") - F.col("lo")) / bins).alias("width"),
        F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"),
    )
    return grid.join(counts, "bin", "left").select(
        (F.col("bin") + 1).alias("bin"),
        (F.col("lo") + F.col("bin") * F.col("width")).alias("lower"),
        (F.col("lo") + (F.col("bin") + 1) * F.col("width")).alias("upper"),
        F.coalesce("rows", F.lit(0)).alias("rows"),
    )


def box_stats(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Quartiles, 1.5 IQR whiskers at data points, mean, std and outlier count per key."""
    d = df.select(*keys, F.col(value).cast("double").alias("v")).where("v is not null")
    q = exact_percentiles(d, keys, "v", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    # the fences join equal values, not lines
    counted = d.groupBy(*keys, "v").agg(F.count("*").alias("c"))
    iqr = F.col("q3") - F.col("q1")
    inside = F.col("v").between(F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr)
    whiskers = (
        counted.join(q, keys)
        .groupBy(*keys)
        .agg(
            F.min(F.when(inside, F.col("v"))).alias("low_whisker"),
            F.max(F.when(inside, F.col("v"))).alias("high_whisker"),
            F.coalesce(F.sum(F.when(~inside, F.col("c"))), F.lit(0)).alias("outliers"),
            F.sum("c").alias("n"),
        )
    )
    spread = d.groupBy(*keys).agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"))
    return q.join(whiskers, keys).join(spread, keys)


def outlier_share(df: DataFrame, variables: list[str]) -> DataFrame:
    """Count and share of lines outside the 1.5 IQR fences per variable, with a class."""
    values = long_numeric(df, variables)
    rows = df.agg(F.count("*").alias("n")).scalar()
    stats = box_stats(values, ["variable"], "value").withColumn("outlier_pct", pct("outliers", rows))
    level = banded(F.col("outlier_pct"), [(10, "high"), (5, "moderate")], "normal", "gt")
    return stats.select("variable", "outliers", "outlier_pct", level.alias("level"))


def variation_class(df: DataFrame, variable: str = "amount") -> DataFrame:
    v = F.col(variable).cast("double")
    out = df.agg((ratio(F.stddev_samp(v), F.avg(v)) * 100).alias("cv_pct"))
    return out.withColumn(
        "level", banded(F.col("cv_pct"), [(100, "very dispersed"), (50, "moderate")], "low", "gt")
    )


def concentration_class(df: DataFrame) -> DataFrame:
    """Share of the top 20 % of clients and of the leading country, with classes."""
    curve = entity_curve(df, "client_id")
    cut = F.floor(F.col("n") * 0.2)
    top20 = curve.withColumn("n", curve.agg(F.count("*").alias("n")).scalar()).agg(
        pct(F.sum(F.when(F.col("rank") <= cut, F.col("value"))), F.sum("value")).alias("v")
    ).scalar()
    countries = df.groupBy("country").agg(total("amount").alias("v"))
    out = countries.agg(pct(F.max("v"), F.sum("v")).alias("top_country_pct")).withColumn(
        "top20_client_pct", F.coalesce(top20, F.lit(0.0))
    )
    return out.select(
        "top20_client_pct",
        banded(F.col("top20_client_pct"), [(80, "strong"), (60, "moderate")], "spread", "gt").alias("client_level"),
        "top_country_pct",
        F.when(F.col("top_country_pct") > 50, "dependent").otherwise("diversified").alias("country_level"),
    )


def attention_counts(df: DataFrame, variables: list[str]) -> DataFrame:
    """Null and negative counts per variable."""
    counted = df.agg(
        *[
            F.struct(F.count_if(F.col(v).isNull()).alias("nulls"),
                     F.count_if(F.col(v) < 0).alias("negatives"), F.count("*").alias("rows")).alias(v)
            for v in variables
        ]
    )
    rows = F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).alias("s")) for v in variables])
    return counted.select(F.inline(rows)).select(
        "variable", "s.nulls", pct("s.nulls", "s.rows").alias("null_pct"), "s.negatives"
    )


def skew_flag(df: DataFrame, variable: str = "amount") -> DataFrame:
    """Mean against 1.2 × median."""
    d = df.select(F.col(variable).cast("double").alias("v"))
    middle = exact_percentiles(d, [], "v", {"median": 0.5})
    return middle.withColumn("mean", d.agg(F.avg("v").alias("m")).scalar()).withColumn(
        "is_skewed", F.col("mean") > F.col("median") * 1.2
    )


def _normal_quantile(p: np.ndarray) -> np.ndarray:
    """Inverse normal distribution function: Newton steps on ``erf`` from a logistic start."""
    half = np.minimum(p, 1 - p)
    t = np.sqrt(-2 * np.log(half))
    x = t - (2.30753 + 0.27061 * t) / (1 + 0.99229 * t + 0.04481 * t * t)
    erfc = np.vectorize(math.erfc, otypes=[float])
    for _ in range(3):
        err = 0.5 * erfc(x / math.sqrt(2)) - half
        x = x + err / (np.exp(-x * x / 2) / math.sqrt(2 * math.pi))
    return np.where(p < 0.5, -x, x)


@F.pandas_udf(DoubleType())
def normal_quantile(p: pd.Series) -> pd.Series:
    return pd.Series(_normal_quantile(p.to_numpy(dtype=float)))


#: positions of one value that are written out in one row
QQ_RUN = 1 << 16


def qq_points(df: DataFrame, variable: str) -> DataFrame:
    """Sorted values against normal quantiles at the order-statistic medians."""
    v = df.select(F.col(variable).cast("double").alias("v")).where("v is not null")
    counts = v.groupBy("v").agg(F.count("*").alias("c"))
    ranked = globally_ranked(counts, [F.col("v")], "_r", {"cum": "c"}).withColumn(
        "n", v.agg(F.count("*").alias("n")).scalar()
    )
    # equal values share one sorted run; expand to positions only at the end
    runs = ranked.select("v", "n", "cum", F.explode(F.sequence(F.col("cum") - F.col("c") + 1, F.col("cum"), F.lit(QQ_RUN))).alias("first"))
    # few rows by now, each of which makes up to QQ_RUN: dealt, or one task makes them all
    each = spread(runs, "first").select("v", "n", F.explode(F.sequence("first", F.least(F.col("first") + QQ_RUN - 1, F.col("cum")))).alias("i"))
    tail = F.pow(F.lit(0.5), 1.0 / F.col("n"))
    p = (
        F.when(F.col("i") == 1, 1 - tail)
        .when(F.col("i") == F.col("n"), tail)
        .otherwise((F.col("i") - 0.3175) / (F.col("n") + 0.365))
    )
    return each.select("i", F.col("v").alias("sample"), normal_quantile(p).alias("theoretical"))


def normality_screen(df: DataFrame, variables: list[str]) -> DataFrame:
    """Jarque-Bera statistic from moments of all rows; 5.99 is the 5 % point of chi-square(2)."""
    values = long_numeric(df, variables)
    m = values.groupBy("variable").agg(
        F.count("value").alias("n"), F.skewness("value").alias("skewness"),
        F.kurtosis("value").alias("kurtosis"),
    )
    jb = F.col("n") / 6.0 * (F.pow("skewness", F.lit(2)) + F.pow("kurtosis", F.lit(2)) / 4)
    return m.withColumn("jarque_bera", jb).withColumn(
        "is_non_normal", (F.col("n") > 3) & (F.col("jarque_bera") > 5.991464547107979)
    )


def normal_overlay(df: DataFrame, variable: str, bins: int = 50, grid: int = 100) -> DataFrame:
    """Density histogram (kind ``data``) and fitted normal curve (kind ``normal``)."""
    h = histogram(df, variable, bins)
    n = h.agg(F.sum("rows").alias("n")).scalar()
    data = h.select(
        F.lit("data").alias("kind"), ((F.col("lower") + F.col("upper")) / 2).alias("x"),
        F.try_divide("rows", n * (F.col("upper") - F.col("lower"))).alias("density"),
    )
    v = F.col(variable).cast("double")
    fit = df.agg(F.avg(v).alias("m"), F.stddev_samp(v).alias("s"), F.min(v).alias("lo"), F.max(v).alias("hi"))
    x = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / (grid - 1)
    curve = fit.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(grid - 1)))).select(
        F.lit("normal").alias("kind"), x.alias("x"),
        (F.exp(-F.pow((x - F.col("m")) / F.col("s"), F.lit(2)) / 2) / (F.col("s") * math.sqrt(2 * math.pi))).alias("density"),
    )
    return data.unionByName(curve)


# ── interpretation classes ──


def pareto_level(share: Column) -> Column:
    return banded(share, [(85, "very concentrated"), (70, "moderate")], "diversified", "gt")


def lead_time_level(median: Column) -> Column:
    return (
        F.when(median < 7, "excellent").when(median < 14, "good").when(median < 30, "acceptable")
        .otherwise("slow")
    )


def hhi_level(hhi: Column) -> Column:
    return banded(hhi, [(5000, "very concentrated"), (2500, "moderate")], "diversified", "gt")


def series_skewed(max_value: Column, mean_value: Column, min_value: Column) -> Column:
    return (max_value - mean_value) > 2 * (mean_value - min_value)


def interpretation(df: DataFrame) -> DataFrame:
    """One row of reading classes: Pareto, lead time, currency concentration, monthly skew."""
    share = pareto_shares(df, "client_id").select("top_20pct_share").scalar()
    median = lead_time_summary(df).select("median").scalar()
    cur = df.groupBy("currency").agg(total("amount").alias("v"))
    whole = cur.agg(F.sum("v").alias("t")).scalar()
    hhi = cur.agg((F.sum(F.pow(ratio("v", whole), F.lit(2))) * 10000).alias("h")).scalar()
    months = period_revenue(df, "month")
    return months.agg(
        F.max("revenue").alias("hi"), F.avg("revenue").alias("mid"), F.min("revenue").alias("lo")
    ).select(
        pareto_level(share).alias("pareto_level"), lead_time_level(median).alias("lead_time_level"),
        hhi_level(hhi).alias("currency_level"),
        series_skewed(F.col("hi"), F.col("mid"), F.col("lo")).alias("is_series_skewed"),
    )


