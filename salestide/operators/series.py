"""Time series: calendar fill, roll-up, statistics, insight, decomposition."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salestide.functions.calendar import MONTH_WORDS, period_index, period_label, with_period
from salestide.functions.loess import adf_statistic, decompose, kpss_statistic
from salestide.functions.numeric import mean, pct, ratio, total
from salestide.functions.quantiles import exact_quantiles
from salestide.session import spread


def daily(df: DataFrame, keys: list[str] = ()) -> DataFrame:
    """One row per calendar day from first to last (per key), zero filled; no price without quantity."""
    keys = list(keys)
    sums = df.where(F.col("invoice_date").isNotNull()).groupBy(
        *keys, F.col("invoice_date").alias("day")
    ).agg(
        total("amount").alias("revenue"), total("qty").alias("qty"),
        F.count_distinct("client_id").alias("clients"), F.count_distinct("order_id").alias("orders"),
    )
    calendar = sums.groupBy(*keys).agg(F.min("day").alias("_a"), F.max("day").alias("_b")).select(
        *keys, F.explode(F.sequence("_a", "_b")).alias("day")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return calendar.join(sums, [*keys, "day"], "left").select(
        *keys, "day", zero("revenue"), zero("qty"), zero("clients"), zero("orders"),
        ratio("revenue", "qty").alias("price"),
    )


def from_daily(days: DataFrame, grain: str) -> DataFrame:
    d = F.col("day")
    return (
        days.groupBy(period_label(d, grain).alias("period"), period_index(d, grain).alias("period_index"))
        .agg(*[F.sum(c).alias(c) for c in ("revenue", "qty", "clients", "orders")])
        .withColumn("price", ratio("revenue", "qty"))
    )


def by_period(df: DataFrame, grain: str) -> DataFrame:
    """Revenue, quantity, distinct clients and orders, price; calendar year at year grain."""
    d = (
        df.withColumns({"period": F.col("year").cast("string"), "period_index": F.col("year")})
        if grain == "year" else with_period(df, grain)
    )
    return (
        d.groupBy("period", "period_index")
        .agg(
            total("amount").alias("revenue"), total("qty").alias("qty"),
            F.count_distinct("client_id").alias("clients"), F.count_distinct("order_id").alias("orders"),
        )
        .withColumn("price", ratio("revenue", "qty"))
    )


def metric_arrays(df: DataFrame, grain: str) -> DataFrame:
    """One row with the period labels and the metrics as arrays in time order (one entry per period)."""
    fields = ["period", "revenue", "qty", "clients", "orders"]
    packed = by_period(df, grain).agg(
        F.array_sort(F.collect_list(F.struct("period_index", *fields))).alias("s")
    )
    return packed.select(*[F.col(f"s.{c}").alias(f"{c}s" if c == "period" else c) for c in fields])


def fiscal_quarter_share(df: DataFrame) -> DataFrame:
    """Revenue, clients and orders per fiscal quarter with the share in its fiscal year."""
    per = df.groupBy("fiscal_year", "fiscal_quarter_num").agg(
        total("amount").alias("revenue"), F.count_distinct("client_id").alias("clients"),
        F.count_distinct("order_id").alias("orders"),
    )
    return per.withColumn(
        "share", ratio("revenue", F.sum("revenue").over(Window.partitionBy("fiscal_year")))
    )


def _full_stats(df: DataFrame, keys: list[str]) -> DataFrame:
    base = df.groupBy(*keys).agg(
        total("amount").alias("revenue"), mean("amount").alias("mean_line"),
        F.stddev_samp(F.col("amount").cast("double")).alias("std_line"), F.count("amount").alias("sales"),
        total("qty").alias("qty"), F.avg("qty").alias("mean_qty"), F.avg("unit_price").alias("mean_price"),
        F.count_distinct("client_id").alias("clients"), F.count_distinct("order_id").alias("orders"),
    )
    medians = exact_quantiles(df, keys, {"median_line": ("amount", 0.5), "median_price": ("unit_price", 0.5)})
    return base.join(medians, keys, "left")


def fiscal_quarter_stats(df: DataFrame) -> DataFrame:
    """Eleven measures, share in the year, variation and revenue per client."""
    w = Window.partitionBy("fiscal_year_label")
    return _full_stats(df, ["fiscal_year_label", "fiscal_quarter_num"]).withColumns(
        {
            "share_pct": pct("revenue", F.sum("revenue").over(w)),
            "cv_pct": pct("std_line", "mean_line"),
            "revenue_per_client": ratio("revenue", "clients"),
        }
    )


def latest_year_trend(df: DataFrame) -> DataFrame:
    """First-to-last growth, best and worst quarter of the latest fiscal year (two quarters needed)."""
    per = df.groupBy("fiscal_year_label", "fiscal_quarter_num").agg(total("amount").alias("revenue"))
    q, r = F.col("fiscal_quarter_num"), F.col("revenue")
    years = per.groupBy("fiscal_year_label").agg(
        F.count("*").alias("quarters"), F.min_by("revenue", q).alias("first"), F.max_by("revenue", q).alias("last"),
        F.min_by("fiscal_quarter_num", F.struct(-r, q)).alias("best_quarter"),
        F.min_by("fiscal_quarter_num", F.struct(r, q)).alias("worst_quarter"),
    )
    return years.orderBy(F.desc("fiscal_year_label")).limit(1).where("quarters >= 2").select(
        "fiscal_year_label", ((ratio("last", "first") - 1) * 100).alias("growth_pct"),
        "best_quarter", "worst_quarter",
    )


def month_stats(df: DataFrame) -> DataFrame:
    """Months with their share in the fiscal year, French name, and rank marks within the year."""
    year = Window.partitionBy("fiscal_year_label")
    per = df.groupBy("fiscal_year_label", "month").agg(
        total("amount").alias("revenue"), mean("amount").alias("mean_line"), F.count("amount").alias("sales"),
        total("qty").alias("qty"), F.count_distinct("client_id").alias("clients"),
        F.count_distinct("order_id").alias("orders"),
    )
    words = F.array(*[F.lit(m) for m in MONTH_WORDS])
    return per.withColumns(
        {
            "share_pct": pct("revenue", F.sum("revenue").over(year)),
            "month_name": F.element_at(words, F.substring("month", 6, 2).cast("int")),
            "is_top3": F.row_number().over(year.orderBy(F.desc("revenue"), "month")) <= 3,
            "is_bottom3": F.row_number().over(year.orderBy("revenue", "month")) <= 3,
        }
    )


def fiscal_year_stats(df: DataFrame) -> DataFrame:
    before = F.lag("revenue").over(Window.orderBy("fiscal_year_label"))  # one row per year
    return _full_stats(df, ["fiscal_year_label"]).withColumns(
        {
            "change_pct": (ratio("revenue", before) - 1) * 100,
            "revenue_per_client": ratio("revenue", "clients"),
            "revenue_per_order": ratio("revenue", "orders"),
        }
    )


def series_insight(series: DataFrame, value: str, keys: list[str] = ()) -> DataFrame:
    """Last and previous value, % change, linear slope and R², population variation per series.

    ``series`` has one row per (key, period) with ``period`` and ``period_index``.
    """
    keys = list(keys)
    w = Window.partitionBy(*(keys or [F.lit(1)])).orderBy("period_index")
    d = series.withColumns(
        {"_y": F.coalesce(F.col(value).cast("double"), F.lit(0.0)), "_x": F.row_number().over(w) - 1,
         "_back": F.row_number().over(w.orderBy(F.desc("period_index")))}
    )
    last, prev = F.col("_back") == 1, F.col("_back") == 2
    pick = lambda c, m: F.max(F.when(m, F.col(c)))
    return d.groupBy(*keys).agg(
        F.count("*").alias("n_periods"), pick("period", last).alias("last_period"),
        pick("_y", last).alias("last_value"), pick("period", prev).alias("prev_period"),
        pick("_y", prev).alias("prev_value"),
        ((ratio(pick("_y", last), pick("_y", prev)) - 1) * 100).alias("pct_change_last"),
        F.regr_slope("_y", "_x").alias("slope"), F.regr_r2("_y", "_x").alias("r2"),
        pct(F.stddev_pop("_y"), F.avg("_y")).alias("cv_pct"),
    )


def series_extremes(series: DataFrame, value: str, keys: list[str] = (), n: int = 3) -> DataFrame:
    """The n highest and n lowest periods of each series."""
    part = list(keys) or [F.lit(1)]
    high = Window.partitionBy(*part).orderBy(F.desc(value), "period_index")
    low = Window.partitionBy(*part).orderBy(value, "period_index")
    marked = series.withColumns({"top": F.row_number().over(high), "bottom": F.row_number().over(low)})
    return marked.where((F.col("top") <= n) | (F.col("bottom") <= n)).select(
        *keys, "period", "period_index", F.col(value).alias("value"),
        (F.col("top") <= n).alias("is_top"), (F.col("bottom") <= n).alias("is_bottom"),
    )


def clients_per_period(df: DataFrame, grain: str) -> DataFrame:
    return with_period(df, grain).groupBy("period", "period_index").agg(
        F.count_distinct("client_id").alias("clients")
    )


def base100(series: DataFrame, columns: list[str], keys: list[str] = ()) -> DataFrame:
    """Columns as an index of their first non-null value; null when that value is 0."""
    w = (
        Window.partitionBy(*(list(keys) or [F.lit(1)])).orderBy("period_index")
        .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    return series.withColumns(
        {f"{c}_index": pct(c, F.first(c, ignorenulls=True).over(w)) for c in columns}
    )


def moving_average(series: DataFrame, value: str, window: int, keys: list[str] = ()) -> DataFrame:
    w = (
        Window.partitionBy(*(list(keys) or [F.lit(1)])).orderBy("period_index").rowsBetween(-(window - 1), 0)
    )
    return series.withColumn("moving_average", F.avg(value).over(w))


def attach_clients(display: DataFrame, clients: DataFrame) -> DataFrame:
    """True distinct client counts on the display series, by period label."""
    return display.drop("clients").join(clients.select("period", "clients"), "period", "left")


# ── decomposition ──


def stl(series: DataFrame, value: str, keys: list[str], period: int) -> DataFrame:
    """Trend, seasonal and residual per series, one grouped task per series.

    ``series`` is already aggregated to one row per (key, period).  Series with
    fewer than period + 1 points or a constant value get a moving average as
    trend and no seasonal part.
    """
    d = series.select(
        *keys, F.col("period_index").cast("long").alias("period_index"),
        F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("observed"),
    )
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields)

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("period_index").reset_index(drop=True)
        y = pdf["observed"].to_numpy(dtype=float)
        n = len(y)
        if n >= period + 1 and len(np.unique(y)) > 1:
            trend, season, resid = decompose(y, period)
            return pdf.assign(trend=trend, seasonal=season, resid=resid, is_stl=True)
        width = max(2, min(period // 2, n // 2))
        trend = pd.Series(y).rolling(width, min_periods=1).mean()
        return pdf.assign(trend=trend, seasonal=np.nan, resid=np.nan, is_stl=False)

    return spread(d, *keys).groupBy(*keys).applyInPandas(
        kernel, f"{fields}, trend double, seasonal double, resid double, is_stl boolean"
    )


def component_strength(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Trend and seasonal strength, series with at least 10 points."""
    rest = F.var_pop("resid")

    def power(c: str) -> Column:
        whole = F.var_pop(F.col(c) + F.col("resid"))
        return F.when(
            (F.count("resid") >= 10) & (whole > 0), F.greatest(F.lit(0.0), 1 - rest / whole)
        )

    return parts.where("is_stl").groupBy(*keys).agg(
        power("trend").alias("trend_strength"), power("seasonal").alias("seasonal_strength")
    )


def stationarity(days: DataFrame, value: str, keys: list[str], least: int = 30) -> DataFrame:
    """Unit-root and level-stationarity statistics per daily series, decided at 5 %.

    The unit-root bound is the usual finite-sample surface for a constant; the
    level bound is 0.463.
    """
    d = days.select(*keys, "day", F.col(value).cast("double").alias("y"))
    key_fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields if f.name in keys)
    columns = [*keys, "n", "adf_statistic", "adf_lags", "adf_critical", "adf_stationary",
               "kpss_statistic", "kpss_lags", "kpss_stationary"]

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values("day")["y"].fillna(0).to_numpy(dtype=float)
        n = len(y)
        if n < least or len(np.unique(y)) < 2:
            return pd.DataFrame(columns=columns)
        adf, adf_lags = adf_statistic(y)
        kpss, kpss_lags = kpss_statistic(y)
        bound = -2.86154 - 2.8903 / n - 4.234 / n**2 - 40.04 / n**3
        head = [pdf[k].iloc[0] for k in keys]
        return pd.DataFrame(
            [[*head, n, adf, adf_lags, bound, adf < bound, kpss, kpss_lags, kpss < 0.463]], columns=columns
        )

    return spread(d, *keys).groupBy(*keys).applyInPandas(
        kernel,
        f"{key_fields}, n long, adf_statistic double, adf_lags int, adf_critical double, "
        "adf_stationary boolean, kpss_statistic double, kpss_lags int, kpss_stationary boolean",
    )
