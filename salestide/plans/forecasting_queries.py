from pyspark.sql import functions as F

from salestide.operators import behaviour as beh
from salestide.operators import forecast as prj
from salestide.plans.behaviour_queries import ALERTS, COLS, CUSUM, FEATURES, LATEST, Z
from salestide.plans.registry import query
from salestide.session import stored_by
from salestide.sources.views import sales_view

_W = "over (partition by client_id order by period_index"
_R = lambda n: f"{_W} rows between {n - 1} preceding and current row)"
_FE = f""", fn as (select *, nb_orders freq, row_number() {_W}) rn from ft),
 fe as (select client_id, period, period_index, rn, ca, ca ca_lag1, lag(ca,1) {_W}) ca_lag2, lag(ca,2) {_W}) ca_lag3, lag(ca,5) {_W}) ca_lag6, lag(ca,11) {_W}) ca_lag12,
  avg(ca) {_R(3)} ca_roll3, avg(ca) {_R(6)} ca_roll6, avg(ca) {_R(12)} ca_roll12, stddev_samp(ca) {_R(3)} ca_roll3_std, stddev_samp(ca) {_R(6)} ca_roll6_std,
  case when rn<2 then 0 else regr_slope(ca,rn) {_R(3)} end ca_slope3, case when rn<2 then 0 else regr_slope(ca,rn) {_R(6)} end ca_slope6, case when rn<2 then 0 else regr_slope(ca,rn) {_R(12)} end ca_slope12,
  qty qty_lag1, avg(qty) {_R(3)} qty_roll3, case when rn<2 then 0 else regr_slope(qty,rn) {_R(3)} end qty_slope3, freq::double freq_lag1, avg(freq) {_R(3)} freq_roll3, case when rn<2 then 0 else regr_slope(freq,rn) {_R(3)} end freq_slope3,
  pu pu_lag1, avg(pu) {_R(3)} pu_roll3 from fn)"""
_FCOLS = [c for c in prj.FEATURES if c not in ("month_sin", "month_cos", "alert_score")]
_FF = "ca_roll3:7 ca_roll6:7 ca_roll12:7 ca_roll3_std:7 ca_roll6_std:7 ca_slope3:7 ca_slope6:7 ca_slope12:7 qty_roll3:7 qty_slope3:7 freq_roll3 freq_slope3 pu_roll3"


def _lines(spark, d):
    return sales_view(spark, d, *COLS)


def _matrix(spark, d):
    return prj.monthly_matrix(_lines(spark, d))


def _latest(spark, d):
    # the scores and the features both start from it
    f7 = stored_by(beh.monthly_features(_lines(spark, d)), "client_id")
    matrix = f7.drop("active_days").withColumnRenamed("nb_orders", "freq")
    return prj.latest_rows(prj.scored_features(matrix, beh.portfolio(f7)))


def _fitted(spark, d):
    """(monthly matrix, newest rows, model forecast)."""
    return prj.fitted(_lines(spark, d))


def _project(spark, d):
    return prj.project(_lines(spark, d), parts=_fitted(spark, d))


@query("prj_01_monthly_matrix", FEATURES + " select client_id, period, period_index, ca, qty, nb_orders freq, pu, nb_families, hhi from ft", floats="hhi")
def _(spark, d):
    return _matrix(spark, d)


@query("prj_02_features", FEATURES + _FE + " select client_id, period, " + ", ".join(_FCOLS) + " from fe", floats=_FF)
def _(spark, d):
    return prj.with_features(_matrix(spark, d)).select("client_id", "period", *_FCOLS)


@query(
    "prj_03_training_samples",
    FEATURES + _FE + f""", tg as (select *, lead(ca,3) {_W}) t3, lead(ca,6) {_W}) t6, lead(ca,12) {_W}) t12 from fe), tl as (select client_id, period_index, rn, 3 horizon, t3 target from tg union all select client_id, period_index, rn, 6, t6 from tg union all select client_id, period_index, rn, 12, t12 from tg)
    select client_id, period_index, horizon, target, sin(((period_index%100+horizon-1)%12+1)*2*pi()/12) month_sin, cos(((period_index%100+horizon-1)%12+1)*2*pi()/12) month_cos from tl where rn>=6 and target>=0""",
    floats="month_sin month_cos",
)
def _(spark, d):
    return prj.training_samples(prj.with_features(_matrix(spark, d))).select(
        "client_id", "period_index", "horizon", "target", "month_sin", "month_cos"
    )


@query("prj_04_model_forecast", floats="m10 m50 m90")
def _(spark, d):
    return _fitted(spark, d)[2]


@query("prj_05_stl_forecast", floats="stl:2 spread:2")
def _(spark, d):
    return prj.stl_forecast(_matrix(spark, d))


@query("prj_06_blend", floats="q10:2 q50:2 q90:2 change_pct:4")
def _(spark, d):
    return _project(spark, d)[0]


@query(
    "prj_07_churn",
    FEATURES + Z + CUSUM + ALERTS + LATEST + _FE + """, lt as (select * from (select *, count(*) over (partition by client_id) nb_months from fe) where rn=nb_months and nb_months>=6),
    cx as (select lt.client_id, lt.ca current_ca, lt.nb_months, coalesce(alert_class,'green') risk_class, coalesce(alert_score,0) alert_score,
      ((select max(period_index) from lt)//100*12+(select max(period_index) from lt)%100)-(lt.period_index//100*12+lt.period_index%100) recency_months, ca_slope6 slope_6m from lt left join la on la.client_id=lt.client_id)
    select *, round(least(greatest(alert_score/100.0*0.55+case when recency_months>=2 then least((recency_months-1)*0.07::double,0.25) else 0 end+case when slope_6m<0 then least(abs(slope_6m)/greatest(1.0,abs(slope_6m)+1)*0.20,0.20) else 0 end,0.01),0.97),3) churn_prob,
     case when slope_6m>0 then 'hausse' when slope_6m<0 then 'baisse' else 'stable' end trend from cx""",
    floats="slope_6m:7",
)
def _(spark, d):
    return prj.churn(_latest(spark, d))


@query("prj_08_client_results")
def _(spark, d):
    parts = _fitted(spark, d)
    projection, risk = prj.project(_lines(spark, d), parts=parts)
    # the monthly matrix is at hand
    out = prj.client_results(projection, risk, parts[0])
    return out.select("client_id", "risk_class", "trend", F.size("projections").alias("n_projections"), F.size("history").alias("n_history"))


@query("prj_09_portfolio_totals", floats="pessimistic:0 base:0 optimistic:0 change_pct:3 current_ca:2 at_risk_ca:2")
def _(spark, d):
    return prj.portfolio_totals(*_project(spark, d))


@query(
    "prj_10_history_timeline",
    FEATURES + " select period, period_index, sum(ca) ca from ft group by 1,2 order by period_index desc limit 18", floats="ca:2",
)
def _(spark, d):
    return prj.history_timeline(_matrix(spark, d))


@query("prj_11_forecast_timeline", floats="q10:0 q50:0 q90:0")
def _(spark, d):
    return prj.forecast_timeline(_project(spark, d)[0])


@query("prj_12_simple_projection", floats="q10:2 q50:2 q90:2 change_pct:4")
def _(spark, d):
    return prj.simple_projection(_matrix(spark, d))


@query(
    "prj_13_result_pages",
    FEATURES + Z + CUSUM + ALERTS + LATEST + """, lt as (select client_id, count(*) n from ft group by 1 having count(*)>=6), px as (select client_id, coalesce(alert_score,0) alert_score from lt left join la using (client_id) where contains(client_id,'1'))
    select client_id, alert_score, row_number() over (order by alert_score desc, client_id) position, ceil(row_number() over (order by alert_score desc, client_id)/30.0)::integer page from px""",
)
def _(spark, d):
    return prj.result_pages(prj.churn(_latest(spark, d)), "1").select("client_id", "alert_score", "position", "page")
