"""Anomalies: robust scores on client periods, isolation forests, decomposition residuals."""

from __future__ import annotations

import math
import pickle

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from salestide.functions.calendar import with_period
from salestide.functions.isolation import anomaly_score, grow, own_scores_each
from salestide.functions.loess import decompose
from salestide.functions.numeric import revenue_per_unit, total
from salestide.functions.ordering import exact_percentiles
from salestide.functions.robust import with_framed_medians, with_robust_z
from salestide.session import durable, spread

# Trailing window and least history per grain.
HISTORY = {"month": (12, 6), "quarter": (8, 5), "year": (5, 3)}
# Metric names as shown, in order of preference on ties.
METRICS = [("CA", "revenue"), ("Qty", "qty"), ("Freq", "orders"), ("Price", "price")]
UP, DOWN = "hausse", "baisse"


def client_periods(df: DataFrame, grain: str) -> DataFrame:
    """(client, period): revenue, quantity, orders, price."""
    return (
        with_period(df, grain).groupBy("client_id", "period", "period_index")
        .agg(total("amount").alias("revenue"), total("qty").alias("qty"), F.count_distinct("order_id").alias("orders"))
        .withColumn("price", revenue_per_unit())
    )


def history_spec(grain: str, window: int | None = None, min_history: int | None = None) -> tuple[int, int]:
    w, m = HISTORY[grain]
    return window or w, min_history or m


def client_scores(df: DataFrame, grain: str = "month", threshold: float = 3.5,
                  window: int | None = None, min_history: int | None = None) -> DataFrame:
    """Robust scores per metric, the largest one, the flag, its metric and direction."""
    w, m = history_spec(grain, window, min_history)
    scored = with_robust_z(client_periods(df, grain), [c for _, c in METRICS], ["client_id"], "period_index", w, m)
    size = F.greatest(*[F.abs(F.col(f"z_{c}")) for _, c in METRICS])
    main, z = F, F
    for name, c in METRICS:
        main = main.when(F.abs(F.col(f"z_{c}")) == F.col("score"), name)
        z = z.when(F.abs(F.col(f"z_{c}")) == F.col("score"), F.col(f"z_{c}"))
    return scored.withColumn("score", size).withColumns(
        {"is_anomaly": F.coalesce(F.col("score") >= threshold, F.lit(False)), "main_metric": main,
         "direction": F.when(z >= 0, UP).when(z < 0, DOWN)}
    )


def _reason() -> Column:
    """The three largest scores as text."""
    parts = F.array(
        *[F.struct((-F.abs(F.col(f"z_{c}"))).alias("k"), F.lit(i).alias("i"), F.lit(n).alias("n"), F.col(f"z_{c}").alias("z"))
          for i, (n, c) in enumerate(METRICS)]
    )
    best = F.slice(F.array_sort(F.filter(parts, lambda s: s["z"].isNotNull())), 1, 3)
    return F.array_join(F.transform(best, lambda s: F.format_string("%s: z=%+.2f", s["n"], s["z"])), ", ")


def top_anomalies(scores: DataFrame, n: int = 20, latest_only: bool = False) -> DataFrame:
    """Largest anomalies of all time or of the newest period."""
    hits = scores.where("is_anomaly")
    if latest_only:
        hits = hits.where(F.col("period_index") == scores.agg(F.max("period_index")).scalar())
    return (
        hits.orderBy(F.desc("score"), "client_id", "period_index").limit(n)
        .withColumn("reason", _reason())
        .select("client_id", "period", "score", "main_metric", "direction", "revenue", "qty", "orders", "price", "reason")
    )


def anomaly_kpis(scores: DataFrame) -> DataFrame:
    """Counts over all anomalies, and over all of the newest period."""
    newest = F.col("is_anomaly") & (F.col("period_index") == F.col("_newest"))
    return scores.withColumn("_newest", scores.agg(F.max("period_index")).scalar()).agg(
        F.max_by("period", "period_index").alias("latest_period"), F.count_if("is_anomaly").alias("anomalies_total"),
        F.count_distinct("client_id").alias("clients_total"), F.count_if(newest).alias("anomalies_latest"),
        F.count_distinct(F.when(newest, F.col("client_id"))).alias("clients_latest"),
    )


# ── isolation forest ──


def impute_and_scale(df: DataFrame, columns: list[str], key: list[str]) -> DataFrame:
    """Nulls to the exact median, then zero mean and unit population deviation (constant: 0)."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "variable", "value")
    medians = exact_percentiles(long, ["variable"], "value", {"m": 0.5})
    filled = df.select(
        *key,
        *[F.coalesce(F.col(c).cast("double"), medians.where(F.col("variable") == c).agg(F.max("m")).scalar()).alias(c)
          for c in columns],
    )
    moments = filled.agg(
        F.struct(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns])
    ).scalar()
    return filled.withColumn("_m", moments).select(
        *key, *[F.coalesce(F.try_divide(F.col(c) - F.col(f"_m.m_{c}"), F.col(f"_m.s_{c}")), F.lit(0.0)).alias(c) for c in columns]
    )


def forest_scores(df: DataFrame, columns: list[str], key: list[str], contamination: float,
                  trees: int = 100, sample: int = 256, seed: int = 42, weight: str | None = None) -> DataFrame:
    """Isolation score of every row and the flag of the most isolated share.

    Every tree is grown by one task on its own hash sample of at most
    ``sample`` rows: a row is offered to as many trees as it takes to give each
    about twice its sample, and a tree keeps the rows of smallest hash.  Only
    finished trees reach the driver; they are broadcast, and every row is scored
    where it lies.  Nulls are scored as the column's median.  Fewer than two
    rows, or no column that varies, give no trees and score 0.  ``weight`` names a
    column of counts when equal rows are already merged: samples, medians and the
    flagged share are then those of the rows before the merge.
    """
    told = df.agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("n"), F.count(F.lit(1)).alias("own"), *[F.count(c).alias(f"_{i}") for i, c in enumerate(columns)]).first()
    n, weights = told["n"] or 0, [weight] if weight else []
    full = {c: 0.0 for c in columns}
    if lacking := [c for i, c in enumerate(columns) if told[f"_{i}"] < told["own"]]:
        long = df.select(*weights, *[F.col(c).cast("double").alias(c) for c in lacking]).unpivot(weights, lacking, "variable", "value")
        for r in exact_percentiles(long.where("value is not null"), ["variable"], "value", {"m": 0.5}, weight).collect():
            full[r["variable"]] = r["m"]
    features = [f"_x{i}" for i in range(len(columns))]
    values = [F.coalesce(F.col(c).cast("double"), F.lit(full[c])).alias(x) for c, x in zip(columns, features)]
    offers = max(1, math.ceil(2 * trees * sample / max(n, 1)))
    offers = min(offers, trees)
    share = min(1.0, 2 * trees * sample / max(n * offers, 1))
    place = F.pmod(F.xxhash64(*[F.col(k) for k in key], F.col("_offer"), F.lit(seed)), F.lit(1 << 40))
    if weight is None:
        offered = df.select(*key, *values).withColumn("_offer", F.explode(F.sequence(F.lit(0), F.lit(offers - 1))))
    else:
        # many rows: their offers that hold, by systematic rounding; few: all offers of all rows. At most 2 x trees x sample + n
        few = offers > 1
        luck = F.pmod(F.xxhash64(*[F.col(k) for k in key], F.lit(seed + 1)), F.lit(1 << 30)) / (1 << 30)
        count = F.col(weight) * offers if few else F.floor(F.col(weight) * share + luck)
        offered = df.select(*key, *values, count.cast("long").alias("_count")).where("_count > 0").withColumn("_offer", F.explode(F.sequence(F.lit(0), F.col("_count") - 1)))
        share = share if few else 1.0
    # the row of a merged group that is offered
    line = F.floor(F.col("_offer") / offers) if weight else F.lit(0)
    offered = offered.withColumn("_h", place).where(F.col("_h") < int(share * (1 << 40))).withColumns(
        {"tree": ((F.col("_h") + F.col("_offer")) % trees).cast("int"), "_line": line}
    )

    def grown(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf.drop_duplicates([*key, "_line", *features]).sort_values(["_h", *key], kind="stable").head(sample)
        tree = grow(own[features].to_numpy(dtype=float), np.random.default_rng(seed + int(pdf["tree"].iloc[0])), math.ceil(math.log2(max(sample, 2))))
        return pd.DataFrame({"tree": [int(pdf["tree"].iloc[0])], "rows": [len(own)], "body": [pickle.dumps(tree)]})

    found = spread(offered, "tree").groupBy("tree").applyInPandas(grown, "tree int, rows int, body binary").orderBy("tree").collect()
    forest = [pickle.loads(bytes(r["body"])) for r in found if r["rows"] > 1]
    size = max((r["rows"] for r in found), default=0)
    varied = any((t["feature"] >= 0).any() for t in forest)
    if not varied:
        return df.withColumns({"anomaly_score": F.lit(0.0), "is_anomaly": F.lit(False)})
    shared = df.sparkSession.sparkContext.broadcast((forest, size))

    @F.pandas_udf(DoubleType())
    def score(*cols: pd.Series) -> pd.Series:
        grown, m = shared.value
        return pd.Series(anomaly_score(np.column_stack([c.to_numpy(dtype=float) for c in cols]), grown, m))

    scored = df.withColumn("anomaly_score", score(*[F.coalesce(F.col(c).cast("double"), F.lit(full[c])) for c in columns]))
    # the scores are read twice, the trees run once for it
    points = durable(scored.select(*weights, F.round("anomaly_score", 9).alias("s")))
    cut = exact_percentiles(points, [], "s", {"cut": 1 - contamination}, weight).scalar()
    return scored.withColumn("is_anomaly", F.round("anomaly_score", 9) > cut)


def client_forest(df: DataFrame, grain: str = "month", trees: int = 100, seed: int = 42) -> DataFrame:
    """Per client: multivariate isolation over revenue, quantity and orders.

    A client contributes one row per period, so its array of periods is bounded
    by the calendar.  Clients with as many periods are scored together, batch by
    batch, each in a forest of its own.
    """
    window, history = history_spec(grain)
    rows = with_robust_z(client_periods(df, grain), ["price"], ["client_id"], "period_index", window, history)
    months = Window.partitionBy("client_id").orderBy("period_index")
    names = ["revenue", "qty", "orders"]
    rows = with_framed_medians(rows.withColumns({f"_v_{c}": F.col(c).cast("double") for c in names}), {f"_v_{c}": f"_med_{c}" for c in names}, months, -window, -1, history)
    rows = rows.drop(*[f"_v_{c}" for c in names])
    least = max(5, history)
    # undated lines come last
    place = F.struct(F.col("period_index").isNull().alias("late"), "period_index")
    periods = F.array_sort(F.collect_list(F.struct(place.alias("place"), F.struct(*[c for c in rows.columns if c != "client_id"]).alias("row"))))
    packed = spread(rows.groupBy("client_id").agg(periods.alias("periods")), "client_id")

    @F.pandas_udf("scores array<double>, hits array<boolean>")
    def scored(revenue: pd.Series, qty: pd.Series, orders: pd.Series) -> pd.DataFrame:
        lengths = revenue.map(len)
        out: list[tuple[list, list]] = [([], [])] * len(lengths)
        for n, at in lengths.groupby(lengths).indices.items():
            if n < least:
                scores, hits = np.zeros((len(at), n)), np.zeros((len(at), n), dtype=bool)
            else:
                sets = np.stack([np.stack(c.iloc[at].to_numpy()).astype(float) for c in (revenue, qty, orders)], axis=2)
                for i in np.flatnonzero(np.isnan(sets).any(axis=(1, 2))):
                    known = pd.DataFrame(sets[i])
                    sets[i] = known.fillna(known.median()).to_numpy()
                scores = own_scores_each(sets, trees, seed)
                share = min(0.15, max(0.05, 1.0 / n))
                hits = scores > np.quantile(scores, 1 - share, axis=1)[:, None]
            for i, s, h in zip(at, scores.tolist(), hits.tolist()):
                out[i] = s, h
        return pd.DataFrame(out, columns=["scores", "hits"])

    values = [F.col(f"periods.row.{c}").cast("array<double>") for c in names]
    met = packed.withColumn("_s", scored(*values))
    zipped = F.arrays_zip(F.col("periods.row").alias("row"), F.col("_s.scores").alias("score"), F.col("_s.hits").alias("hit"))
    each = met.select("client_id", F.explode(zipped).alias("p"))
    own = {c: F.col(f"p.row.{c}") for c in rows.columns if c != "client_id"}
    return each.select(*[own[c].alias(c) if c in own else F.col(c) for c in rows.columns], F.col("p.score").alias("score_ml"), F.col("p.hit").alias("is_anomaly_ml"))


def client_metric_anomalies(scored: DataFrame, threshold: float = 3.5, n: int | None = None) -> DataFrame:
    """Anomalies of each client by metric: the forest for revenue, quantity and orders, the score for price."""
    def entry(name: str, c: str) -> Column:
        if c == "price":
            flag = F.coalesce(F.abs("z_price") >= threshold, F.lit(False))
            return F.struct(F.lit(name).alias("metric"), F.col(c).alias("value"), F.abs("z_price").alias("score"),
                            flag.alias("hit"), F.when(F.col("z_price") >= 0, UP).otherwise(DOWN).alias("direction"))
        up = F.coalesce(F.col(c) >= F.col(f"_med_{c}"), F.lit(False))
        return F.struct(F.lit(name).alias("metric"), F.col(c).cast("double").alias("value"), F.col("score_ml").alias("score"),
                        F.col("is_anomaly_ml").alias("hit"), F.when(up, UP).otherwise(DOWN).alias("direction"))

    long = scored.select(
        "client_id", "period", "period_index", F.inline(F.array(*[entry(a, b) for a, b in METRICS]))
    ).where("hit").drop("hit")
    if n is None:
        return long
    w = Window.partitionBy("client_id", "metric").orderBy(F.desc("score"), "period_index")
    return long.withColumn("_p", F.row_number().over(w)).where(F.col("_p") <= n).drop("_p")


def metric_counts(long: DataFrame) -> DataFrame:
    """Anomalies per client and metric, wide."""
    return long.groupBy("client_id").agg(
        *[F.count_if(F.col("metric") == n).alias(n.lower()) for n, _ in METRICS]
    )


def top_scores(scores: DataFrame, n: int = 20) -> DataFrame:
    return scores.where("score is not null").orderBy(F.desc("score"), "client_id", "period_index").limit(n).select(
        F.concat_ws(" — ", "client_id", "period").alias("label"), "score"
    )


# ── daily series ──


def daily_forest(days: DataFrame, columns: list[str], contamination: float = 0.1, window: int = 30) -> DataFrame:
    """Multivariate anomalies of a daily series with spike or drop per metric (one row per day)."""
    scored = forest_scores(days, columns, ["day"], contamination)
    w = Window.partitionBy(F.lit(1)).orderBy("day").rowsBetween(-(window - 1), 0)
    out = scored
    for c in columns:
        gap = F.col(c).cast("double") - F.percentile(F.col(c).cast("double"), F.lit(0.5)).over(w)
        out = out.withColumn(
            f"direction_{c}", F.when(~F.col("is_anomaly"), "").when(gap >= 0, "spike").otherwise("drop")
        )
    return out


def stl_anomalies(days: DataFrame, value: str, keys: list[str], period: int | None = None,
                  threshold: float = 3.5, least: int = 30) -> DataFrame:
    """Residual anomalies per daily series: |0.6745 (r − median) / MAD| above the threshold.

    The period is 365 from two years of days on, else 7.  Short series use a
    7-day mean as expectation; gaps are interpolated before the decomposition.
    """
    d = days.select(*keys, "day", F.col(value).cast("double").alias("observed"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields)

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("day").reset_index(drop=True)
        y = pdf["observed"].astype(float)
        n = len(y)
        nothing = pdf.assign(expected=np.nan, resid=np.nan, z=np.nan, is_anomaly=False, direction="")
        if y.notna().sum() < least or y.nunique() <= 1:
            return nothing
        y = y.interpolate(limit_direction="both")
        season = period or (365 if n >= 730 else 7)
        if n >= max(14, 2 * season):
            trend, seasonal, _ = decompose(y.to_numpy(), season)
            expected = pd.Series(trend + seasonal)
        else:
            expected = y.rolling(7 if n >= 7 else max(2, n), min_periods=1).mean()
        resid = y - expected
        med = resid.median()
        mad = (resid - med).abs().median()
        if not mad > 0:
            return nothing.assign(expected=expected, resid=resid)
        z = 0.6745 * (resid - med) / mad
        hit = z.abs() > threshold
        direction = np.where(hit & (resid > 0), "spike", np.where(hit & (resid < 0), "drop", ""))
        return pdf.assign(expected=expected, resid=resid, z=z, is_anomaly=hit, direction=direction)

    return spread(d, *keys).groupBy(*keys).applyInPandas(
        kernel, f"{fields}, expected double, resid double, z double, is_anomaly boolean, direction string"
    )


def anomaly_report(daily: DataFrame, columns: list[str], n: int = 10) -> DataFrame:
    """Per metric: anomaly count and the n days with the largest score, from ``daily_forest``."""
    long = daily.select(
        "day", "anomaly_score", "is_anomaly",
        F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("observed"),
                                    F.col(f"direction_{c}").alias("direction")) for c in columns])),
    ).where("is_anomaly")
    w = Window.partitionBy("metric").orderBy(F.desc("anomaly_score"), "day")
    counts = long.groupBy("metric").agg(F.count("*").alias("anomalies"))
    return long.withColumn("position", F.row_number().over(w)).where(F.col("position") <= n).join(counts, "metric").drop("is_anomaly")


def joint_days(flags: DataFrame, keys: list[str], n: int = 10, least: int = 2) -> DataFrame:
    """Days on which at least ``least`` metrics are anomalous, with the metrics and directions.

    ``flags`` is long: (keys.., day, metric, is_anomaly, direction); one small group per day.
    """
    hit = flags.where("is_anomaly")
    text = F.concat("metric", F.when(F.col("direction") != "", F.concat(F.lit(": "), F.col("direction"))).otherwise(""))
    return (
        hit.groupBy(*keys, "day")
        .agg(F.count("*").alias("joint_score"), F.array_join(F.array_sort(F.collect_list(text)), "; ").alias("summary"))
        .where(F.col("joint_score") >= least).orderBy(F.desc("joint_score"), "day", *keys).limit(n)
    )


def period_value_forest(df: DataFrame, grain: str, variable: str, contamination: float = 0.05) -> DataFrame:
    """Isolation on (period number, value) over all lines; equal pairs are scored once and weigh as many lines as they stand for."""
    d = with_period(df, grain).where(F.col(variable).isNotNull())
    pairs = d.groupBy("period", "period_index", F.col(variable).cast("double").alias("value")).agg(F.count("*").alias("rows"))
    numbers = pairs.select("period_index").distinct().withColumn(
        "period_number", F.dense_rank().over(Window.orderBy("period_index")) - 1  # one row per period
    )
    return forest_scores(pairs.join(numbers, "period_index"), ["period_number", "value"], ["period_index", "value"], contamination, weight="rows")
