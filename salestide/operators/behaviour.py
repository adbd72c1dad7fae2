"""Behaviour monitoring: monthly signals, robust scores, CUSUM, alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salestide.functions.calendar import month_label, period_index
from salestide.functions.numeric import banded, pct, ratio, total
from salestide.functions.robust import with_robust_z

# Signal, short label, weight, whether a rise is bad.
SIGNALS = [
    ("ca", "CA", 0.30, False), ("qty", "Qté", 0.15, False), ("pu", "PU", 0.08, False),
    ("nb_orders", "Commandes", 0.15, False), ("nb_families", "Familles", 0.15, False),
    ("hhi", "Concentr.", 0.12, True), ("active_days", "Activité", 0.05, False),
]
NAMES = [s for s, *_ in SIGNALS]
BASELINE = 6
CUSUM_LIMIT = 4.0
# Alert classes with their lower bounds.
ALERT_CLASSES = [(60, "red"), (30, "orange")]
# Wording per signal for a fall and for a rise; %+.0f is the change in percent.
WORDING = {
    "ca": ("baisse significative du chiffre d'affaires (%+.0f%% vs baseline)", "hausse du chiffre d'affaires (%+.0f%% vs baseline)"),
    "qty": ("réduction des volumes achetés (%+.0f%%)", "augmentation des volumes achetés (%+.0f%%)"),
    "pu": ("baisse du prix unitaire moyen (%+.0f%%)", "hausse du prix unitaire moyen (%+.0f%%)"),
    "nb_orders": ("diminution de la fréquence de commandes (%+.0f%%)", "augmentation de la fréquence de commandes (%+.0f%%)"),
    "nb_families": ("rétrécissement du portefeuille produits — perte de familles (%+.0f%%)", "élargissement du portefeuille produits (%+.0f%%)"),
    "hhi": ("diversification du mix produits (%+.0f%%)", "concentration croissante sur peu de familles produits (%+.0f%%)"),
    "active_days": ("baisse des jours d'activité (%+.0f%%)", "hausse des jours d'activité (%+.0f%%)"),
}
NO_SIGNAL = "Aucun signal d'alerte significatif détecté. Comportement conforme à l'historique."
LEAD_IN = "Signaux détectés :\n"
BREACH = "⚠️ CUSUM déclenché — changement structurel détecté. "
RADAR = ["ca", "qty", "nb_orders", "nb_families", "active_days"]


def monthly_features(df: DataFrame, active_days: bool = True) -> DataFrame:
    """(client, month): revenue, quantity, price, orders, families, concentration, active days.

    The lines travel once, to their client's month.  There each stands once as
    part of its order, its day and its family, is merged by these without
    another shuffle, and all measures come from the three kinds of sums.
    """
    keys = ["client_id", "period_index"]
    d = df.where("invoice_date is not null and amount is not null and client_id is not null").select(
        "client_id", period_index(F.col("invoice_date"), "month").alias("period_index"), "order_id", "invoice_date", "family", "amount", "qty"
    ).repartition(*keys)
    kinds = ["order_id", "invoice_date", "family"]
    # an array keeps the rows where they are; grouping sets would deal them anew
    parts = F.array(*[
        F.struct(F.lit(i).alias("_kind"), *[(F.col(c) if c == kind else F.lit(None).cast(d.schema[c].dataType)).alias(c) for c in kinds])
        for i, kind in enumerate(kinds)
    ])
    sums = d.select(*keys, "amount", "qty", F.inline(parts)).groupBy(*keys, "_kind", *kinds).agg(F.sum("amount").alias("_amount"), F.sum("qty").alias("_qty"))
    order, day, family = [F.col("_kind") == i for i in range(3)]
    value = F.when(family & F.col("family").isNotNull(), F.col("_amount").cast("double"))
    known = lambda k, c: F.count_if(k & F.col(c).isNotNull())
    out = sums.groupBy(*keys).agg(
        total(F.when(day, F.col("_amount"))).alias("ca"), total(F.when(day, F.col("_qty"))).alias("qty"), known(order, "order_id").alias("nb_orders"),
        *([F.count_if(day).alias("active_days")] if active_days else []),
        F.nullif(known(family, "family"), F.lit(0)).alias("nb_families"),
        (ratio(F.sum(value * value), F.sum(value) * F.sum(value)) * 10000).alias("hhi"),
    )
    index = F.col("period_index")
    label = month_label(F.make_date(F.floor(index / 100).cast("int"), index % 100, F.lit(1)))
    return out.withColumns({"period": label, "pu": ratio("ca", F.nullif("qty", F.lit(0.0)))}).select(
        "client_id", "period", "period_index", "ca", "qty", "nb_orders", *(["active_days"] if active_days else []), "pu", "nb_families", "hhi"
    )


def with_scores(features: DataFrame, strict: bool = True, cusum: str | None = None) -> DataFrame:
    """Robust score of each of the seven signals, and the CUSUM of one of them."""
    return with_robust_z(features, NAMES, ["client_id"], "period_index", BASELINE, 3, strict, cusum=cusum)


def with_alerts(features: DataFrame, strict: bool = True) -> DataFrame:
    """Scores, CUSUM of the revenue score, alert score 0..100 and class, per client and month."""
    scored = with_scores(features, strict, "ca")
    raw = F.lit(0.0)
    for name, _, weight, rise_is_bad in SIGNALS:
        z = F.col(f"z_{name}") if rise_is_bad else -F.col(f"z_{name}")
        part = F.least(F.greatest(z, F.lit(0.0)), F.lit(3.0)) * weight / 3.0
        raw = raw + F.coalesce(F.when(z.isNotNull(), part), F.lit(0.0))
    drift = F.least(F.greatest("cusum_pos", "cusum_neg") / (2 * CUSUM_LIMIT), F.lit(1.0))
    score = F.round(F.least(F.lit(100.0), raw * 70.0 + drift * 30.0), 1)
    return scored.withColumn("alert_score", score).withColumn(
        "alert_class", banded(F.col("alert_score"), ALERT_CLASSES, "green")
    )


def _signal_array(field: str) -> Column:
    return F.array(
        *[
            F.struct(F.lit(i).alias("i"), F.lit(name).alias("signal"), F.lit(label).alias("label"),
                     F.col(f"z_{name}").alias("z"), F.col(name).cast("double").alias("value"),
                     F.col(f"base_{name}").alias("base"),
                     (F.col(f"z_{name}") if bad else -F.col(f"z_{name}")).alias("bad"))
            for i, (name, label, _, bad) in enumerate(SIGNALS)
        ]
    )


def latest_alerts(features: DataFrame, strict: bool = True) -> DataFrame:
    """The newest month of every client with at least two months, with its baselines."""
    w = Window.partitionBy("client_id")
    past = w.orderBy("period_index").rowsBetween(-BASELINE, -1)
    recent = F.collect_list("ca").over(w.orderBy("period_index").rowsBetween(-5, 0))
    rows = features.withColumns(
        {**{f"base_{n}": F.avg(F.col(n).cast("double")).over(past) for n in NAMES},
         "_place": F.row_number().over(w.orderBy("period_index")), "nb_months": F.count("*").over(w), "_recent": recent}
    )
    # before the scores, so that all windows share one order; only the newest month's values are carried on
    newest = {c: F.when(F.col("_place") == F.col("nb_months"), F.col(c)) for c in (*[f"base_{n}" for n in NAMES], "_recent")}
    return with_alerts(rows.withColumns(newest), strict).where("_place = nb_months and nb_months >= 2").drop("_place")


def portfolio(features: DataFrame, strict: bool = True) -> DataFrame:
    """One row per client: score, class, revenue against baseline, leading signal, trend."""
    rows = latest_alerts(features, strict)
    known = F.filter(_signal_array("z"), lambda s: s["z"].isNotNull())
    lead = F.try_element_at(
        F.array_sort(F.transform(known, lambda s: F.struct(-F.abs(s["z"]), s["i"], s["label"].alias("label"), s["z"].alias("z")))),
        F.lit(1),
    )
    return rows.withColumn("_lead", lead).select(
        "client_id", F.col("period").alias("latest_month"), "nb_months", "alert_score", "alert_class",
        F.col("ca").alias("latest_ca"), F.col("base_ca").alias("baseline_ca"),
        F.when(F.col("base_ca") > 0, pct(F.col("ca") - F.col("base_ca"), "base_ca")).alias("ca_change_pct"),
        F.col("_lead.label").alias("top_signal"), F.col("_lead.z").alias("top_signal_z"),
        (F.greatest("cusum_pos", "cusum_neg") >= CUSUM_LIMIT).alias("cusum_alert"),
        F.col("_recent").alias("ca_trend"),
    )


def class_counts(rows: DataFrame) -> DataFrame:
    """Clients per alert class, absent classes as 0."""
    counted = rows.agg(*[F.count_if(F.col("alert_class") == c).alias(c) for c in ("red", "orange", "green")])
    return counted.unpivot([], ["red", "orange", "green"], "alert_class", "clients")


def attribution(features: DataFrame, strict: bool = True) -> DataFrame:
    """Why a client is flagged: up to three signals with a bad score above 1, worst first."""
    rows = latest_alerts(features, strict)
    bad = F.filter(_signal_array("bad"), lambda s: s["bad"] > 1.0)
    worst = F.slice(
        F.array_sort(bad, lambda a, b: F.when(a["bad"] != b["bad"], F.when(a["bad"] > b["bad"], -1).otherwise(1))
                     .when(a["signal"] > b["signal"], -1).otherwise(1)), 1, 3,
    )

    def sentence(s: Column) -> Column:
        change = F.bround(F.coalesce(pct(s["value"] - s["base"], F.abs(s["base"])), F.lit(0.0)), 0)
        out = F
        for name, (fall, rise) in WORDING.items():
            out = out.when(
                s["signal"] == name,
                F.when(s["z"] < 0, F.format_string(fall, change)).otherwise(F.format_string(rise, change)),
            )
        return F.concat(F.lit("• "), out.otherwise(s["signal"]))

    text = F.concat(
        F.when(F.greatest("cusum_pos", "cusum_neg") >= CUSUM_LIMIT, BREACH).otherwise(""),
        F.lit(LEAD_IN), F.array_join(F.transform("_worst", sentence), "\n"),
    )
    return rows.withColumn("_worst", worst).select(
        "client_id", F.array_join(F.transform("_worst", lambda s: s["signal"]), ",").alias("signals"),
        F.when(F.size("_worst") == 0, NO_SIGNAL).otherwise(text).alias("attribution"),
    )


def client_history(features: DataFrame, strict: bool = True) -> DataFrame:
    """All months of all clients, long by signal: value, score, baseline band (mean ± 2 std), alert score."""
    past = Window.partitionBy("client_id").orderBy("period_index").rowsBetween(-BASELINE, -1)
    bands = {}
    for n in NAMES:
        v = F.col(n).cast("double")
        enough = F.count(v).over(past) >= 2
        bands[f"_m_{n}"] = F.when(enough, F.avg(v).over(past))
        bands[f"_s_{n}"] = F.when(enough, F.stddev_samp(v).over(past))
    out = with_alerts(features.withColumns(bands), strict)
    long = F.array(
        *[
            F.struct(F.lit(n).alias("signal"), F.col(n).cast("double").alias("value"), F.col(f"z_{n}").alias("z"),
                     F.col(f"_m_{n}").alias("base_mean"), (F.col(f"_m_{n}") + 2 * F.col(f"_s_{n}")).alias("base_upper"),
                     (F.col(f"_m_{n}") - 2 * F.col(f"_s_{n}")).alias("base_lower"))
            for n in NAMES
        ]
    )
    return out.select("client_id", "period", "alert_score", "cusum_pos", "cusum_neg", F.inline(long))


def radar(features: DataFrame) -> DataFrame:
    """Newest month as an index of the baseline (100) on five signals; 0 when undefined."""
    past = Window.partitionBy("client_id").orderBy("period_index").rowsBetween(-BASELINE, -1)
    w = Window.partitionBy("client_id")
    rows = features.withColumns(
        {**{f"base_{n}": F.avg(F.col(n).cast("double")).over(past) for n in RADAR},
         "_back": F.row_number().over(w.orderBy(F.desc("period_index"))), "_n": F.count("*").over(w)}
    ).where("_back = 1 and _n >= 2")
    long = F.array(
        *[F.struct(F.lit(n).alias("signal"), F.coalesce(pct(n, f"base_{n}"), F.lit(0.0)).alias("index")) for n in RADAR]
    )
    return rows.select("client_id", F.inline(long))
