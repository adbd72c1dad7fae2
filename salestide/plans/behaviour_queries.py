from pyspark.sql import functions as F

from salestide.operators import behaviour as beh
from salestide.plans.registry import query
from salestide.sources.views import sales_view

COLS = ("client_id", "invoice_date", "amount", "qty", "order_id", "family")
S = beh.NAMES
FEATURES = """, fm as (select client_id, "month" period, month_index period_index, family, sum(amount)::double v from s group by 1,2,3,4),
 hh as (select client_id, period, count(*) nb_families, sum(v*v)/(sum(v)*sum(v))*10000 hhi from fm group by 1,2),
 ft as (select * from (select client_id, "month" period, month_index period_index, sum(amount)::double ca, sum(qty) qty, count(distinct order_id) nb_orders, count(distinct invoice_date) active_days, sum(amount)::double/nullif(sum(qty),0) pu from s group by 1,2,3) join hh using (client_id, period))"""


def scores_sql(names, source, window, least, key="client_id"):
    """Common table expression ``zz`` with a strict robust score per signal."""
    w = f"(partition by {key} order by period_index rows between"
    med = ", ".join(
        f"case when count({n}) over {w} {window} preceding and 1 preceding)>={least} then quantile_cont({n}::double,0.5) over {w} {window} preceding and 1 preceding) end med_{n}"
        for n in names
    )
    dev = ", ".join(f"abs(lag({n}::double) over (partition by {key} order by period_index)-med_{n}) dev_{n}" for n in names)
    mad = ", ".join(
        f"case when count(dev_{n}) over {w} {window - 1} preceding and current row)>={least} then quantile_cont(dev_{n},0.5) over {w} {window - 1} preceding and current row) end mad_{n}"
        for n in names
    )
    z = ", ".join(
        f"case when mad_{n}>0 then ({n}-med_{n})*0.6745/mad_{n} when mad_{n}=0 then sign({n}-med_{n})*999.0::double end z_{n}" for n in names
    )
    return (
        f", z1 as (select *, {med} from {source}), z2 as (select *, {dev} from z1), z3 as (select *, {mad} from z2), zz as materialized (select *, {z} from z3)"
    )


Z = scores_sql(S, "ft", 6, 3)
# the sums by recursion over the months, as defined
CUSUM = """, cz as (select client_id, period_index, z_ca, row_number() over (partition by client_id order by period_index) rn from zz),
 cu as materialized (with recursive r as (select client_id, rn, period_index, 0.0::double cusum_pos, 0.0::double cusum_neg from cz where rn=1
   union all select cz.client_id, cz.rn, cz.period_index, greatest(0, r.cusum_pos+coalesce(cz.z_ca,0)-0.5), greatest(0, r.cusum_neg-coalesce(cz.z_ca,0)-0.5) from r join cz on cz.client_id=r.client_id and cz.rn=r.rn+1) select * from r)"""
_RAW = "+".join(
    f"coalesce(least(greatest({'' if bad else '-'}z_{n},0),3)*{w}/3.0,0)*(z_{n} is not null)::integer" for n, _, w, bad in beh.SIGNALS
)
ALERTS = f""", aa as materialized (select zz.*, cusum_pos, cusum_neg, round(least(100,({_RAW})*70.0+least(greatest(cusum_pos,cusum_neg)/8,1)*30.0),1) alert_score from zz join cu using (client_id, period_index)),
 ab as (select *, case when alert_score>=60 then 'red' when alert_score>=30 then 'orange' else 'green' end alert_class from aa)"""
_BASE = ", ".join(f"avg({n}::double) over (partition by client_id order by period_index rows between 6 preceding and 1 preceding) base_{n}" for n in S)
LATEST = f""", la as (select * from (select *, {_BASE}, row_number() over (partition by client_id order by period_index desc) b, count(*) over (partition by client_id) nb_months,
   list(ca) over (partition by client_id order by period_index rows between 5 preceding and current row) ca_trend from ab) where b=1 and nb_months>=2)"""


def _features(spark, d):
    return beh.monthly_features(sales_view(spark, d, *COLS))


@query("beh_01_monthly_features", FEATURES + " select * from ft", floats="hhi")
def _(spark, d):
    return _features(spark, d)


_ZCOLS = ", ".join(f"z_{n}" for n in S)


@query(
    "beh_02_robust_scores", FEATURES + Z + f" select client_id, period, {_ZCOLS} from zz",
    floats=" ".join(f"z_{n}:9" for n in S),
)
def _(spark, d):
    return beh.with_scores(_features(spark, d)).select("client_id", "period", *[f"z_{n}" for n in S])


@query(
    "beh_02_robust_scores_compatible",
    FEATURES + Z + " select client_id, period, "
    + ", ".join(
        f"case when mad_{n}>0 then z_{n} when {n}=med_{n} then 0.0 when {n}>med_{n} then 999.0 else -999.0 end::double z_{n}" for n in S
    ) + " from zz",
    floats=" ".join(f"z_{n}:9" for n in S),
)
def _(spark, d):
    return beh.with_scores(_features(spark, d), strict=False).select("client_id", "period", *[f"z_{n}" for n in S])


@query(
    "beh_03_cusum", FEATURES + Z + CUSUM + " select client_id, period_index, cusum_pos, cusum_neg from cu",
    floats="cusum_pos cusum_neg",
)
def _(spark, d):
    return beh.with_alerts(_features(spark, d)).select("client_id", "period_index", "cusum_pos", "cusum_neg")


@query("beh_04_alert_score", FEATURES + Z + CUSUM + ALERTS + " select client_id, period_index, alert_score from ab")
def _(spark, d):
    return beh.with_alerts(_features(spark, d)).select("client_id", "period_index", "alert_score")


@query(
    "beh_05_class_counts",
    FEATURES + Z + CUSUM + ALERTS + LATEST
    + " select alert_class, count(client_id) clients from (values ('red'),('orange'),('green')) c(alert_class) left join la using (alert_class) group by 1",
)
def _(spark, d):
    return beh.class_counts(beh.portfolio(_features(spark, d)))


_KNOWN = "[" + ",".join(f"{{'z':z_{n},'l':'{label}','i':{i}}}" for i, (n, label, _, _) in enumerate(beh.SIGNALS)) + "]"


@query(
    "beh_06_portfolio",
    FEATURES + Z + CUSUM + ALERTS + LATEST
    + f""", ss as (select client_id, unnest({_KNOWN}) x from la), sb as (select client_id, x.l top_signal, x.z top_signal_z, row_number() over (partition by client_id order by abs(x.z) desc, x.i) p from ss where x.z is not null)
    select la.client_id, period latest_month, nb_months, alert_score, alert_class, ca latest_ca, base_ca baseline_ca, case when base_ca>0 then (ca-base_ca)/base_ca*100 end ca_change_pct, top_signal, top_signal_z,
     greatest(cusum_pos,cusum_neg)>=4.0 cusum_alert, ca_trend from la left join sb on sb.client_id=la.client_id and p=1""",
    floats="baseline_ca ca_change_pct top_signal_z",
)
def _(spark, d):
    return beh.portfolio(_features(spark, d))


_BAD = "[" + ",".join(
    f"{{'b':{'' if bad else '-'}z_{n},'z':z_{n},'s':'{n}','v':{n}::double,'base':base_{n}}}" for n, _, _, bad in beh.SIGNALS
) + "]"
_TEXT = "case x.s " + " ".join(
    "when '{}' then case when x.z<0 then printf('{}', c) else printf('{}', c) end".format(n, a.replace("'", "''"), b.replace("'", "''"))
    for n, (a, b) in beh.WORDING.items()
) + " end"


@query(
    "beh_07_attribution",
    FEATURES + Z + CUSUM + ALERTS + LATEST
    + f""", ss as (select client_id, unnest({_BAD}) x from la), sp as (select *, coalesce((x.v-x.base)/nullif(abs(x.base),0)*100,0) c, row_number() over (partition by client_id order by x.b desc, x.s desc) p from ss where x.b>1.0),
     st as (select client_id, string_agg(x.s, ',' order by p) signals, string_agg('• '||{_TEXT}, chr(10) order by p) t from sp where p<=3 group by 1)
    select la.client_id, coalesce(signals,'') signals, case when t is null then '{beh.NO_SIGNAL.replace("'", "''")}' else case when greatest(cusum_pos,cusum_neg)>=4.0 then '{beh.BREACH}' else '' end||'Signaux détectés :'||chr(10)||t end attribution
    from la left join st using (client_id)""",
)
def _(spark, d):
    return beh.attribution(_features(spark, d))


_HIST = ", ".join(
    f"{{'signal':'{n}','v':{n}::double,'z':z_{n},'bm':case when count({n}) over pw>=2 then avg({n}::double) over pw end,'bs':case when count({n}) over pw>=2 then stddev_samp({n}::double) over pw end}}"
    for n in S
)


@query(
    "beh_08_client_history",
    FEATURES + Z + CUSUM + ALERTS
    + f""", hp as (select *, [{_HIST}] xs from ab window pw as (partition by client_id order by period_index rows between 6 preceding and 1 preceding)),
    hs as (select client_id, period, alert_score, cusum_pos, cusum_neg, unnest(xs) x from hp)
    select client_id, period, alert_score, cusum_pos, cusum_neg, x.signal signal, x.v "value", x.z z, x.bm base_mean, x.bm+2*x.bs base_upper, x.bm-2*x.bs base_lower from hs""",
    floats="cusum_pos cusum_neg value:8 z:9 base_mean base_upper base_lower",
)
def _(spark, d):
    return beh.client_history(_features(spark, d))


@query(
    "beh_09_radar",
    FEATURES + Z + CUSUM + ALERTS + LATEST
    + " select client_id, signal, \"index\" from ("
    + " union all ".join(f"select client_id, '{n}' signal, coalesce({n}::double/nullif(base_{n},0)*100,0) \"index\" from la" for n in beh.RADAR)
    + ")",
    floats="index",
)
def _(spark, d):
    return beh.radar(_features(spark, d))
