from pyspark.sql import functions as F

from salestide.operators import anomaly as ano
from salestide.operators import series as ts
from salestide.plans.behaviour_queries import scores_sql
from salestide.plans.registry import query
from salestide.sources.views import sales_view

COLS = ("client_id", "invoice_date", "amount", "qty", "order_id")
_M = ["revenue", "qty", "orders", "price"]
_NAMES = ["CA", "Qty", "Freq", "Price"]
_CP = """, cp as (select client_id, "month" period, month_index period_index, sum(amount)::double revenue, sum(qty) qty, count(distinct order_id) orders, sum(amount)::double/sum(qty) price from s group by 1,2,3)"""


def _scored(window, least, threshold=3.5):
    best = "greatest(" + ",".join(f"abs(z_{m})" for m in _M) + ")"
    main = " ".join(f"when abs(z_{m})=score then '{n}'" for m, n in zip(_M, _NAMES))
    z = " ".join(f"when abs(z_{m})=score then z_{m}" for m in _M)
    return _CP + scores_sql(_M, "cp", window, least) + f""", sz as (select *, {best} score from zz),
     sa as (select *, coalesce(score>={threshold},false) is_anomaly, case {main} end main_metric, case when (case {z} end)>=0 then 'hausse' when (case {z} end)<0 then 'baisse' end direction from sz)"""


def _rows(spark, d):
    return sales_view(spark, d, *COLS)


def _client_scores(spark, d):
    # the months of a client are few in this data, so a shorter history than the default is asked for
    return ano.client_scores(_rows(spark, d), "month", 3.5, 6, 3)


@query("ano_01_client_periods", _CP + " select * from cp")
def _(spark, d):
    return ano.client_periods(_rows(spark, d), "month")


@query(
    "ano_02_robust_z", _scored(12, 6) + " select client_id, period, z_revenue, z_qty, z_orders, z_price from sa",
    floats="z_revenue:9 z_qty:9 z_orders:9 z_price:9",
)
def _(spark, d):
    return ano.client_scores(_rows(spark, d), "month").select("client_id", "period", *[f"z_{m}" for m in _M])


@query(
    "ano_03_history_by_grain",
    (_CP + scores_sql(_M, "cp", 8, 5)).replace('"month" period, month_index', "fiscal_quarter_code period, fiscal_quarter_index")
    + " select client_id, period, z_revenue, z_orders from zz",
    floats="z_revenue:9 z_orders:9",
)
def _(spark, d):
    return ano.client_scores(_rows(spark, d), "quarter").select("client_id", "period", "z_revenue", "z_orders")


@query(
    "ano_04_scores",
    _scored(6, 3) + " select client_id, period, score, is_anomaly, main_metric, direction from sa", floats="score:9",
)
def _(spark, d):
    return _client_scores(spark, d).select("client_id", "period", "score", "is_anomaly", "main_metric", "direction")


_REASON = "[" + ",".join(f"{{'k':-abs(z_{m}),'i':{i},'t':printf('{n}: z=%+.2f',z_{m})}}" for i, (m, n) in enumerate(zip(_M, _NAMES))) + "]"
_TOP = f""" select client_id, period, score, main_metric, direction, revenue, qty, orders, price,
  array_to_string(list_transform(list_slice(list_sort(list_filter({_REASON}, lambda x: x.k is not null)),1,3), lambda x: x.t), ', ') reason from sa where is_anomaly """
_ORDER = "order by score desc, client_id, period_index limit 20"


@query("ano_05_top_anomalies", _scored(6, 3) + _TOP + _ORDER, floats="score:9")
def _(spark, d):
    return ano.top_anomalies(_client_scores(spark, d))


@query(
    "ano_05_top_anomalies_latest",
    _scored(6, 3) + _TOP + "and period_index=(select max(period_index) from cp) " + _ORDER, floats="score:9",
)
def _(spark, d):
    return ano.top_anomalies(_client_scores(spark, d), latest_only=True)


@query(
    "ano_06_kpis",
    _scored(6, 3) + """, lt as (select * from sa where is_anomaly and period_index=(select max(period_index) from cp))
    select (select max(period) from cp) latest_period, count(*) filter (is_anomaly) anomalies_total, count(distinct client_id) clients_total,
     (select count(*) from lt) anomalies_latest, (select count(distinct client_id) from lt) clients_latest from sa""",
)
def _(spark, d):
    return ano.anomaly_kpis(_client_scores(spark, d))


@query("ano_07_client_forest", floats="score_ml")
def _(spark, d):
    out = ano.client_forest(_rows(spark, d), "month")
    return out.select("client_id", "period", "period_index", "revenue", "qty", "orders", "price", "score_ml", "is_anomaly_ml")


@query("ano_07_client_metric_anomalies", floats="score")
def _(spark, d):
    return ano.client_metric_anomalies(ano.client_forest(_rows(spark, d), "month"), n=10)


@query(
    "ano_08_impute_and_scale",
    _CP + """, f as (select client_id, period, revenue, qty, coalesce(price,(select median(price) from cp)) price from cp)
    select client_id, period, (revenue-avg(revenue) over ())/stddev_pop(revenue) over () revenue, (qty-avg(qty) over ())/stddev_pop(qty) over () qty, (price-avg(price) over ())/stddev_pop(price) over () price from f""",
    floats="revenue qty price",
)
def _(spark, d):
    return ano.impute_and_scale(ano.client_periods(_rows(spark, d), "month"), ["revenue", "qty", "price"], ["client_id", "period"])


@query("ano_09_forest", floats="anomaly_score")
def _(spark, d):
    cp = ano.client_periods(_rows(spark, d), "month")
    return ano.forest_scores(cp, ["revenue", "qty", "orders", "price"], ["client_id", "period_index"], 0.1)


DAILY = ["revenue", "qty", "clients"]


@query("ano_10_daily_forest", floats="anomaly_score revenue qty")
def _(spark, d):
    return ano.daily_forest(ts.daily(_rows(spark, d)).drop("price"), DAILY)


def _stl_flags(spark, d):
    days = ts.daily(sales_view(spark, d, "country", *COLS), ["country"])
    parts = [
        ano.stl_anomalies(days, m, ["country"]).withColumn("metric", F.lit(m)) for m in DAILY
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("ano_11_stl_anomalies", floats="observed expected resid z")
def _(spark, d):
    return ano.stl_anomalies(ts.daily(sales_view(spark, d, "country", *COLS), ["country"]), "revenue", ["country"])


@query("ano_12_report", floats="anomaly_score observed")
def _(spark, d):
    return ano.anomaly_report(ano.daily_forest(ts.daily(_rows(spark, d)), DAILY), DAILY)


@query("ano_12_joint_days")
def _(spark, d):
    return ano.joint_days(_stl_flags(spark, d), ["country"])


@query("ano_13_period_value_forest", floats="anomaly_score")
def _(spark, d):
    out = ano.period_value_forest(sales_view(spark, d, "invoice_date", "amount"), "month", "amount")
    return out.groupBy("period").agg(
        F.sum("rows").alias("n_lines"), F.sum(F.when(F.col("is_anomaly"), F.col("rows"))).alias("anomalies"),
        F.max("anomaly_score").alias("anomaly_score"),
    )


@query("ano_14_metric_counts")
def _(spark, d):
    return ano.metric_counts(ano.client_metric_anomalies(ano.client_forest(_rows(spark, d), "month")))


@query(
    "ano_14_top_scores",
    _scored(6, 3) + " select client_id||' — '||period label, score from sa where score is not null order by score desc, client_id, period_index limit 20",
    floats="score:9",
)
def _(spark, d):
    return ano.top_scores(_client_scores(spark, d))
