"""Revenue forecast and churn: features, samples, models, projections, totals.

"Months" are the active months of a client: horizon h is its h-th next active
month.  All windows run over the months of one client.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salestide.functions.boosting import boost, predict
from salestide.functions.loess import decompose_rows
from salestide.functions.numeric import pct
from salestide.functions.ordering import globally_ranked
from salestide.functions.quantiles import exact_quantiles
from salestide.operators.behaviour import monthly_features, portfolio
from salestide.session import durable, spread, stored_by

HORIZONS = [3, 6, 12]
MIN_HISTORY = 6
STL_MIN_HISTORY = 18
# Weights of the two forecasts, quantiles and rounds of the model, names of its features.
MODEL_WEIGHT, STL_WEIGHT = 0.60, 0.40
QUANTILES = [0.10, 0.50, 0.90]
ROUNDS = 200
FEATURES = [
    "ca_lag1", "ca_lag2", "ca_lag3", "ca_lag6", "ca_lag12", "ca_roll3", "ca_roll6", "ca_roll12", "ca_roll3_std",
    "ca_roll6_std", "ca_slope3", "ca_slope6", "ca_slope12", "qty_lag1", "qty_roll3", "qty_slope3", "freq_lag1",
    "freq_roll3", "freq_slope3", "pu_lag1", "pu_roll3", "month_sin", "month_cos", "alert_score",
]
#: samples of one boosting task, and up to how many such tasks of a horizon there are more tasks only, and no larger ones
BUCKET_ROWS = 50_000
MOST_BUCKETS = 16


def monthly_matrix(df: DataFrame) -> DataFrame:
    """(client, month): revenue, quantity, price, orders, families, concentration."""
    return monthly_features(df, active_days=False).withColumnRenamed("nb_orders", "freq")


def _month_order() -> Window:
    return Window.partitionBy("client_id").orderBy("period_index")


def with_features(matrix: DataFrame) -> DataFrame:
    """Lags, rolling means and deviations, slopes, as known at each month."""
    w = _month_order()
    last = lambda n: w.rowsBetween(-(n - 1), 0)
    v = {"ca": F.col("ca"), "qty": F.col("qty"), "freq": F.col("freq").cast("double"), "pu": F.col("pu")}
    d = matrix.withColumn("rn", F.row_number().over(w))
    lag = lambda c, k: v[c] if k == 1 else F.lag(v[c], k - 1).over(w)
    slope = lambda c, n: F.coalesce(F.regr_slope(v[c], F.col("rn").cast("double")).over(last(n)), F.lit(0.0))
    return d.withColumns(
        {
            **{f"ca_lag{k}": lag("ca", k) for k in (1, 2, 3, 6, 12)},
            **{f"ca_roll{n}": F.avg(v["ca"]).over(last(n)) for n in (3, 6, 12)},
            **{f"ca_roll{n}_std": F.stddev_samp(v["ca"]).over(last(n)) for n in (3, 6)},
            **{f"ca_slope{n}": slope("ca", n) for n in (3, 6, 12)},
            **{f"{c}_lag1": lag(c, 1) for c in ("qty", "freq", "pu")},
            **{f"{c}_roll3": F.avg(v[c]).over(last(3)) for c in ("qty", "freq", "pu")},
            **{f"{c}_slope3": slope(c, 3) for c in ("qty", "freq")},
        }
    )


def _season(horizon: Column) -> tuple[Column, Column]:
    month = F.pmod(F.col("period_index") % 100 + horizon - 1, F.lit(12)) + 1
    angle = month * (2 * math.pi / 12)
    return F.sin(angle), F.cos(angle)


def with_scores(features: DataFrame, alerts: DataFrame) -> DataFrame:
    """Adds the client's alert score (0 when it has none)."""
    scores = alerts.select("client_id", F.col("alert_score"), F.col("alert_class").alias("risk_class"))
    return features.join(scores, "client_id", "left").withColumns(
        {"alert_score": F.coalesce("alert_score", F.lit(0.0)), "risk_class": F.coalesce("risk_class", F.lit("green"))}
    )


def scored_features(matrix: DataFrame, alerts: DataFrame) -> DataFrame:
    """The features of ``with_features`` with the scores of ``with_scores``, which join the narrow months, before the windows."""
    return with_features(with_scores(matrix, durable(alerts.select("client_id", "alert_score", "alert_class"))))


def training_samples(features: DataFrame, horizons: list[int] = HORIZONS) -> DataFrame:
    """One row per (client, month from the 6th on, horizon) whose target month exists and is not negative."""
    w = _month_order()
    d = features.withColumns({f"_t{h}": F.lead("ca", h).over(w) for h in horizons}).where(F.col("rn") >= MIN_HISTORY)
    rows = d.select(
        "*", F.inline(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"_t{h}").alias("target")) for h in horizons]))
    ).where("target >= 0").drop(*[f"_t{h}" for h in horizons])
    sin, cos = _season(F.col("horizon"))
    return rows.withColumns({"month_sin": sin, "month_cos": cos})


def latest_rows(features: DataFrame, horizons: list[int] = HORIZONS) -> DataFrame:
    """The newest month of each client with enough history, once per horizon."""
    n = F.count("*").over(Window.partitionBy("client_id"))
    d = features.withColumn("nb_months", n).where((F.col("rn") == F.col("nb_months")) & (F.col("nb_months") >= MIN_HISTORY))
    rows = d.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons])))
    sin, cos = _season(F.col("horizon"))
    return rows.withColumns({"month_sin": sin, "month_cos": cos})


def _filled(rows: DataFrame, middle: DataFrame) -> DataFrame:
    """``rows`` with (client_id, horizon, features as one array), nulls as the horizon's median (0 where it has none)."""
    # one row per horizon
    met = rows.join(F.broadcast(middle), "horizon", "left")
    values = F.array(*[F.coalesce(F.col(c).cast("double"), F.col(f"_{c}"), F.lit(0.0)) for c in FEATURES])
    return met.select("client_id", "horizon", values.alias("x"), *[c for c in ("target",) if c in rows.columns])


def buckets(sizes: dict[int, int]) -> dict[int, int]:
    """Buckets of each horizon by its number of samples.

    There is one per ``BUCKET_ROWS`` samples, up to ``MOST_BUCKETS``.  Of more
    samples, the buckets' number and their size both grow by the root, so that
    neither a task's memory nor the models of a forecast grow in proportion;
    all horizons then have as many.
    """
    most = max(sizes.values()) / (MOST_BUCKETS * BUCKET_ROWS)
    if most > 1:
        return dict.fromkeys(sizes, math.ceil(MOST_BUCKETS * math.sqrt(most)))
    return {h: max(1, math.ceil(n / BUCKET_ROWS)) for h, n in sizes.items()}


def fit_quantiles(samples: DataFrame, rounds: int = ROUNDS, depth: int = 5, step: float = 0.05, least_leaf: int = 5, least: int = 20,
                  seed: int = 42) -> tuple[dict[tuple[int, float], list[dict]], DataFrame]:
    """(trees by (horizon, quantile), medians of the features) from samples of ``training_samples``.

    Clients are dealt to buckets by hash, and every (horizon, quantile, bucket)
    has boosting rounds of its own on pinball loss; a forecast is the mean of
    the buckets' models.  All samples are in the fit: ``buckets`` tells how many
    there are.  Horizons with fewer than ``least`` samples have no model.  Only
    finished trees reach the driver, some 200 KB each.  ``samples`` is read four
    times and not kept, as it is many times as large as what it is made from.
    """
    samples = samples.select("client_id", "horizon", "target", *FEATURES)
    sizes = {r["horizon"]: r["n"] for r in samples.groupBy("horizon").agg(F.count("*").alias("n")).collect()}
    sizes = {h: n for h, n in sizes.items() if n >= least}
    middle = durable(exact_quantiles(samples, ["horizon"], {f"_{c}": (c, 0.5) for c in FEATURES}))
    if not sizes:
        return {}, middle
    counts = buckets(sizes)
    share = F.create_map(*[F.lit(x) for h, n in counts.items() for x in (h, n)])
    bucket = F.pmod(F.xxhash64("client_id", F.lit(seed)), share[F.col("horizon")])
    dealt = _filled(samples.where(F.col("horizon").isin(list(sizes))), middle).withColumn("bucket", bucket)
    # few tasks fit a quantile each; of many, each fits all, so that the samples travel once
    many = sum(counts.values()) >= 2 * int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fits = [QUANTILES] if many else [[q] for q in QUANTILES]
    tasks = dealt.withColumn("fit", F.explode(F.array(*[F.lit(i) for i in range(len(fits))])))

    def grown(pdf: pd.DataFrame) -> pd.DataFrame:
        # the order of rows decides nothing but ties; sorted, a rerun gives the same trees
        own = pdf.sort_values(["client_id", "target"], kind="stable")
        x, y, qs = np.stack(own["x"].to_numpy()), own["target"].to_numpy(dtype=float), fits[int(own["fit"].iloc[0])]
        bodies = [pickle.dumps(boost(x, y, q, rounds, depth, step, least_leaf)) for q in qs]
        return pd.DataFrame({"horizon": [int(own["horizon"].iloc[0])] * len(qs), "q": qs, "body": bodies})

    # a task per group: merging them would put costly ones one after the other; a client's samples of all horizons are
    # much alike, and together they are small
    met = spread(tasks, "bucket") if many else spread(tasks, "horizon", "fit", "bucket")
    found = met.groupBy("horizon", "fit", "bucket").applyInPandas(grown, "horizon int, q double, body binary").collect()
    models: dict[tuple[int, float], list[dict]] = {}
    for r in found:
        models.setdefault((r["horizon"], r["q"]), []).append(pickle.loads(bytes(r["body"])))
    return models, middle


def predict_quantiles(rows: DataFrame, models: dict[tuple[int, float], list[dict]], middle: DataFrame) -> DataFrame:
    """(client_id, horizon, m10, m50, m90) of feature rows, never negative and in order; horizons without a model are left out."""
    shared = rows.sparkSession.sparkContext.broadcast(models)

    @F.pandas_udf("array<double>")
    def score(horizon: pd.Series, x: pd.Series) -> pd.Series:
        out = np.zeros((len(x), len(QUANTILES)))
        for h in horizon.unique():
            own = (horizon == h).to_numpy()
            cells = np.stack(x[own].to_numpy())
            for i, q in enumerate(QUANTILES):
                parts = shared.value[int(h), q]
                weights = [m["rows"] for m in parts]
                out[own, i] = np.average([predict(m, cells) for m in parts], axis=0, weights=weights)
        return pd.Series(list(np.sort(np.maximum(out, 0.0), axis=1)))

    known = _filled(rows.where(F.col("horizon").isin(sorted({h for h, _ in models}))), middle).withColumn("m", score("horizon", "x"))
    names = ["m10", "m50", "m90"]
    return known.select("client_id", "horizon", *[F.col("m")[i].alias(n) for i, n in enumerate(names)], *[c for c in ("target",) if c in rows.columns])


def model_forecast(samples: DataFrame, latest: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """10, 50 and 90 % forecasts per client and horizon by boosted trees on pinball loss, as ``fit_quantiles`` grows them."""
    models, middle = fit_quantiles(samples, rounds)
    if not models:
        return latest.select("client_id", "horizon").limit(0).withColumns({c: F.lit(None).cast("double") for c in ("m10", "m50", "m90")})
    return predict_quantiles(latest, models, middle)


def band_coverage(samples: DataFrame, held_out: int = 5, rounds: int = ROUNDS) -> DataFrame:
    """Per horizon, of the clients that were held out of the fit (one of ``held_out`` by hash): samples, shares below each forecast."""
    held = F.pmod(F.xxhash64("client_id", F.lit(7)), F.lit(held_out)) == 0
    samples = durable(samples)
    models, middle = fit_quantiles(samples.where(~held), rounds)
    scored = predict_quantiles(samples.where(held), models, middle)
    below = {c: F.avg((F.col("target") <= F.col(c)).cast("double")).alias(f"below_{c}") for c in ("m10", "m50", "m90")}
    return scored.groupBy("horizon").agg(F.count("*").alias("samples"), *below.values())


def stl_forecast(matrix: DataFrame, horizons: list[int] = HORIZONS) -> DataFrame:
    """Trend line of the last six months plus the season of the target month, per client with 18 months.

    A client's months are one array; series of equal length are decomposed
    together, batch by batch.  ``spread`` is the residual deviation × √h.
    """
    months = F.array_sort(F.collect_list(F.struct(F.col("period_index").cast("long").alias("period_index"), F.col("ca").cast("double").alias("ca"))))
    series = matrix.groupBy("client_id").agg(months.alias("months")).where(F.size("months") >= STL_MIN_HISTORY)

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = []
            for n, own in batch.groupby(batch["y"].map(len)):
                trend, season, resid = decompose_rows(np.stack(own["y"].to_numpy()).astype(float), 12)
                slope, start = np.polyfit(np.arange(6.0), trend[:, -6:].T, 1)
                spreads = resid.std(axis=1, ddof=1)
                for h in horizons:
                    stl = np.fmax(0.0, start + slope * (5 + h) + season[:, n - 12 + (h - 1) % 12])
                    parts.append((own["client_id"].to_numpy(), np.full(len(own), h), stl, spreads * math.sqrt(h)))
            if parts:
                yield pd.DataFrame(dict(zip(["client_id", "horizon", "stl", "spread"], map(np.concatenate, zip(*parts)))))

    dealt = spread(series.select("client_id", F.col("months.ca").alias("y")), "client_id")
    return dealt.mapInPandas(kernel, "client_id string, horizon int, stl double, spread double")


def churn_probability(score: Column, recency_months: Column, slope: Column) -> Column:
    p = score / 100.0 * 0.55
    p = p + F.when(recency_months >= 2, F.least((recency_months - 1) * 0.07, F.lit(0.25))).otherwise(0.0)
    p = p + F.when(slope < 0, F.least(F.abs(slope) / F.greatest(F.lit(1.0), F.abs(slope) + 1) * 0.20, F.lit(0.20))).otherwise(0.0)
    return F.round(F.least(F.greatest(p, F.lit(0.01)), F.lit(0.97)), 3)


def _months_since(compat: bool, newest: Column) -> Column:
    """Calendar months from the client's last active month to the newest of all; always 0 in the older reading."""
    if compat:
        return F.lit(0)
    number = lambda c: F.floor(c / 100) * 12 + c % 100
    return number(newest) - number(F.col("period_index"))


def churn(latest: DataFrame, compat: bool = False) -> DataFrame:
    """Churn probability and trend of each client at its newest month."""
    one = latest.dropDuplicates(["client_id"])
    newest = latest.agg(F.max("period_index")).scalar()
    d = one.withColumn("recency_months", _months_since(compat, newest))
    return d.select(
        "client_id", F.col("ca").alias("current_ca"), "nb_months", "risk_class", "alert_score", "recency_months",
        F.col("ca_slope6").alias("slope_6m"),
        churn_probability(F.col("alert_score"), F.col("recency_months"), F.col("ca_slope6")).alias("churn_prob"),
        F.when(F.col("ca_slope6") > 0, "hausse").when(F.col("ca_slope6") < 0, "baisse").otherwise("stable").alias("trend"),
    )


def blend(latest: DataFrame, model: DataFrame, stl: DataFrame) -> DataFrame:
    """60/40 mix of model and decomposition, the model alone, or the six-month mean ± 25 %."""
    z, m = F.col("stl"), F.col("m50")
    both = z.isNotNull() & m.isNotNull()
    low = F.greatest(z - 1.28 * F.col("spread"), F.lit(0.0))
    mix = lambda a, b: a * MODEL_WEIGHT + b * STL_WEIGHT
    d = latest.select("client_id", "horizon", "ca", "ca_roll6").join(model, ["client_id", "horizon"], "left").join(
        stl, ["client_id", "horizon"], "left"
    )
    mean6 = F.col("ca_roll6")
    return d.select(
        "client_id", "horizon", "ca",
        F.when(both, F.greatest(mix(F.col("m10"), low), F.lit(0.0))).when(m.isNotNull(), F.col("m10")).otherwise(mean6 * 0.75).alias("q10"),
        F.when(both, mix(m, z)).when(m.isNotNull(), m).otherwise(mean6).alias("q50"),
        F.when(both, mix(F.col("m90"), z + 1.28 * F.col("spread"))).when(m.isNotNull(), F.col("m90")).otherwise(mean6 * 1.25).alias("q90"),
        z.isNotNull().alias("has_stl"),
    ).withColumn("change_pct", F.when(F.col("ca") > 0, pct(F.col("q50") - F.col("ca"), "ca")))


def fitted(df: DataFrame, horizons: list[int] = HORIZONS, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(monthly matrix, newest rows, model forecast) from invoice lines."""
    features7 = stored_by(monthly_features(df), "client_id")
    matrix = features7.drop("active_days").withColumnRenamed("nb_orders", "freq")
    features = scored_features(matrix, portfolio(features7))
    latest = durable(latest_rows(features, horizons))
    return matrix, latest, durable(model_forecast(training_samples(features, horizons), latest, rounds))


def project(df: DataFrame, horizons: list[int] = HORIZONS, rounds: int = ROUNDS, parts: tuple | None = None) -> tuple[DataFrame, DataFrame]:
    """(projection per client and horizon, churn per client) from invoice lines, or from their ``fitted`` parts."""
    matrix, latest, model = parts or fitted(df, horizons, rounds)
    return blend(latest, model, stl_forecast(matrix, horizons)), churn(latest)


def client_results(projection: DataFrame, risk: DataFrame, matrix: DataFrame, months: int = 18) -> DataFrame:
    """One row per client: state, projections by horizon, history of the last months as an array."""
    proj = projection.groupBy("client_id").agg(
        F.array_sort(F.collect_list(F.struct("horizon", "q10", "q50", "q90", "change_pct"))).alias("projections")
    )
    back = F.row_number().over(Window.partitionBy("client_id").orderBy(F.desc("period_index")))
    history = matrix.withColumn("_b", back).where(F.col("_b") <= months).groupBy("client_id").agg(
        F.array_sort(F.collect_list(F.struct("period", "ca"))).alias("history")
    )
    return risk.join(proj, "client_id").join(history, "client_id")


def portfolio_totals(projection: DataFrame, risk: DataFrame) -> DataFrame:
    """Per horizon: pessimistic, base and optimistic revenue, change, revenue at risk, likely leavers."""
    state = risk.agg(
        F.sum("current_ca").alias("current_ca"),
        F.coalesce(F.sum(F.when(F.col("risk_class").isin("red", "orange"), F.col("current_ca") * F.col("churn_prob"))), F.lit(0.0)).alias("at_risk_ca"),
        F.count_if(F.col("churn_prob") > 0.5).alias("n_churn_risk"), F.count("*").alias("n_clients"),
    )
    row = state.select(F.struct("*").alias("s")).scalar()
    return forecast_timeline(projection).withColumn("_s", row).select(
        "horizon", F.col("q10").alias("pessimistic"), F.col("q50").alias("base"), F.col("q90").alias("optimistic"),
        pct(F.col("q50") - F.col("_s.current_ca"), "_s.current_ca").alias("change_pct"), "_s.current_ca", "_s.at_risk_ca",
        "_s.n_churn_risk", "_s.n_clients",
    )


def history_timeline(matrix: DataFrame, months: int = 18) -> DataFrame:
    return matrix.groupBy("period", "period_index").agg(F.sum("ca").alias("ca")).orderBy(F.desc("period_index")).limit(months)


def forecast_timeline(projection: DataFrame) -> DataFrame:
    return projection.groupBy("horizon").agg(*[F.sum(c).alias(c) for c in ("q10", "q50", "q90")])


def simple_projection(matrix: DataFrame, horizons: list[int] = HORIZONS) -> DataFrame:
    """Projection without the model: decomposition, else the slope of the last max(h, 3) months ± 20 %.

    This is the single-client view, for every client at once; it differs from
    the portfolio view on purpose.
    """
    w = _month_order()
    matrix = durable(matrix)  # both kinds of projection start from it
    d = matrix.withColumn("rn", F.row_number().over(w))
    slopes = {
        f"_s{h}": F.coalesce(F.regr_slope(F.col("ca"), F.col("rn").cast("double")).over(w.rowsBetween(-(max(h, 3) - 1), 0)), F.lit(0.0))
        for h in horizons
    }
    d = d.withColumns({**slopes, "nb_months": F.count("*").over(Window.partitionBy("client_id"))})
    rows = d.where((F.col("rn") == F.col("nb_months")) & (F.col("nb_months") >= MIN_HISTORY)).select(
        "client_id", "ca", F.inline(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"_s{h}").alias("slope")) for h in horizons]))
    )
    z, line = F.col("stl"), F.greatest(F.col("ca") + F.col("slope") * F.col("horizon"), F.lit(0.0))
    return rows.join(stl_forecast(matrix, horizons), ["client_id", "horizon"], "left").select(
        "client_id", "horizon", "ca",
        F.when(z.isNotNull(), F.greatest(z - 1.28 * F.col("spread"), F.lit(0.0))).otherwise(line * 0.80).alias("q10"),
        F.coalesce(z, line).alias("q50"), F.when(z.isNotNull(), z + 1.28 * F.col("spread")).otherwise(line * 1.20).alias("q90"),
        z.isNotNull().alias("has_stl"),
    ).withColumn("change_pct", F.when(F.col("ca") > 0, pct(F.col("q50") - F.col("ca"), "ca")))


def result_pages(risk: DataFrame, contains: str = "", sort: str = "alert_score", descending: bool = True, size: int = 30) -> DataFrame:
    """Clients whose id holds the text, in order of a column, with their page number."""
    kept = risk.where(F.contains(F.lower("client_id"), F.lit(contains.lower())))
    order = F.desc(sort) if descending else F.asc(sort)
    ranked = globally_ranked(kept, [order, F.asc("client_id")], "position")
    return ranked.withColumn("page", F.ceil(F.col("position") / size).cast("int"))
