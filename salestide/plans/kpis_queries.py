from pyspark.sql import functions as F

from salestide.operators import kpi
from salestide.plans.registry import query
from salestide.sources.views import sales_view

VARS = ["amount", "qty", "unit_price", "lead_time_days"]
_LONG = """, v as (select 'amount' variable, fiscal_quarter_code period, amount::double "value" from s union all select 'qty', fiscal_quarter_code, qty from s
  union all select 'unit_price', fiscal_quarter_code, unit_price from s union all select 'lead_time_days', fiscal_quarter_code, lead_time_days from s)"""
_OCT = """, o as (select *, year(invoice_date) y, month(invoice_date) m,
   case when month(invoice_date)>=10 then 1 when month(invoice_date)<=3 then 2 when month(invoice_date)<=6 then 3 else 4 end q from s)"""
_M = """, p as (select "month" period, month_index period_index, sum(amount)::double revenue from s group by 1,2)"""


@query(
    "agg_01_global_kpis",
    """select count(*) n_lines, sum(amount)::double revenue, count(distinct client_id) clients, count(distinct family) families,
     sum(amount)::double/count(amount) mean_line, count(distinct country) countries, sum(amount)::double/count(distinct client_id) revenue_per_client from s""",
    floats="revenue mean_line revenue_per_client",
)
def _(spark, d):
    s = sales_view(spark, d, "amount", "client_id", "family", "country")
    return kpi.global_kpis(s).withColumnRenamed("lines", "n_lines")


@query(
    "agg_02_basket_kpis",
    """select sum(amount)::double revenue, count(distinct order_id) orders, count(distinct client_name) clients, count(distinct country) countries,
     count(distinct family) families, sum(amount)::double/count(distinct order_id) mean_basket from s""",
    floats="revenue mean_basket",
)
def _(spark, d):
    return kpi.basket_kpis(sales_view(spark, d, "amount", "order_id", "client_name", "country", "family"))


@query(
    "agg_03_metric_by_period",
    _OCT + " select y||'-Q'||q period_label, y*10+q period_key, sum(amount)::double \"value\" from o group by 1,2",
    floats="value",
)
def _(spark, d):
    return kpi.metric_by_october_period(sales_view(spark, d, "amount", "invoice_date"), "quarter")


@query(
    "agg_04_top_clients",
    """select client_name label, sum(amount)::double "value" from s group by 1 order by 2 desc, 1 limit 10""",
    floats="value",
)
def _(spark, d):
    return kpi.top_n(sales_view(spark, d, "client_name", "amount"), "client_name")


_CURVE = """, c as (select client_id entity, sum(amount) v from s group by 1),
  k as (select entity, v, row_number() over (order by v desc, entity) "rank", sum(v) over (order by v desc, entity rows unbounded preceding) r, sum(v) over () t, count(*) over () n from c)"""


@query(
    "agg_05_pareto_curve",
    _CURVE + """ select entity, "rank", v::double "value", r::double/t::double*100 cum_pct from k""",
    floats="value cum_pct",
)
def _(spark, d):
    return kpi.pareto_curve(sales_view(spark, d, "client_id", "amount"), "client_id")


@query(
    "agg_05_pareto_shares",
    _CURVE + """ select max(n) n_total, greatest(1,floor(max(n)*0.2))::bigint n_20pct,
     (sum(v) filter ("rank"<=greatest(1,floor(n*0.2))))::double/max(t)::double*100 top_20pct_share,
     (sum(v) filter ("rank"<=10))::double/max(t)::double*100 top_10_share from k""",
    floats="top_20pct_share top_10_share",
)
def _(spark, d):
    return kpi.pareto_shares(sales_view(spark, d, "client_id", "amount"), "client_id")


@query(
    "agg_06_lead_time_summary",
    """, x as (select lead_time_days lt, case when lead_time_days between 0 and 730 then lead_time_days end ok from s)
    select median(ok)::double median, avg(ok) mean, stddev_samp(ok) std, count(*) filter (lt<0)*100.0/count(*) pct_anomalies,
      count(*) filter (lt>365)*100.0/count(*) pct_extremes, count(*) n_total, count(ok) n_valid from x""",
    floats="median mean std pct_anomalies pct_extremes",
)
def _(spark, d):
    return kpi.lead_time_summary(sales_view(spark, d, "lead_time_days"))


@query(
    "agg_06_lead_time_from_dates",
    """, x as (select datediff('day', order_date, invoice_date) lt from s), y as (select lt, case when lt between 0 and 730 then lt end ok from x)
    select median(ok)::double median, avg(ok) mean, stddev_samp(ok) std, count(*) filter (lt<0)*100.0/count(*) pct_anomalies,
      count(*) filter (lt>365)*100.0/count(*) pct_extremes, count(*) n_total, count(ok) n_valid from y""",
    floats="median mean std pct_anomalies pct_extremes",
)
def _(spark, d):
    return kpi.lead_time_summary(sales_view(spark, d, "order_date", "invoice_date"))


@query(
    "agg_07_lead_time_buckets",
    """, b(position,lo,hi,bucket) as (values (1,0,3,'0-3 jours'),(2,4,7,'4-7 jours'),(3,8,14,'8-14 jours'),(4,15,30,'15-30 jours'),(5,31,60,'31-60 jours'),(6,61,730,'>60 jours'))
    select position, bucket, count(lead_time_days) n_lines from b left join s on lead_time_days between lo and hi group by 1,2""",
)
def _(spark, d):
    out = kpi.lead_time_buckets(sales_view(spark, d, "lead_time_days"))
    return out.withColumnRenamed("lines", "n_lines")


@query(
    "agg_08_lead_time_by_period",
    _OCT + """ select y||'-'||lpad(m::varchar,2,'0') period_label, y*100+m period_key, median(lead_time_days)::double median from o
     where lead_time_days between 0 and 730 group by 1,2""",
    floats="median",
)
def _(spark, d):
    return kpi.lead_time_by_period(sales_view(spark, d, "lead_time_days", "invoice_date"), "month")


@query(
    "agg_09_describe",
    _LONG + """ select variable, avg("value") mean, median("value") median, stddev_samp("value") std, min("value") "min", max("value") "max", count("value") n from v group by 1""",
    floats="mean median std min max",
)
def _(spark, d):
    return kpi.describe(sales_view(spark, d, *VARS), VARS)


@query(
    "agg_10_describe_by_period",
    _LONG + """ select period, variable, avg("value") mean, median("value") median, stddev_samp("value") std, min("value") "min", max("value") "max", count("value") n from v group by 1,2""",
    floats="mean median std min max",
)
def _(spark, d):
    s = sales_view(spark, d, "fiscal_quarter_code", *VARS).withColumnRenamed("fiscal_quarter_code", "period")
    return kpi.describe(s, VARS, ["period"])


@query(
    "agg_11_period_aggregate",
    """select "month" period, month_index period_index, sum(amount)::double revenue, sum(qty) qty, avg(unit_price) mean_price, avg(lead_time_days) mean_lead_time,
     avg(planned_days) mean_planned, avg(lead_time_deviation) mean_deviation from s group by 1,2""",
    floats="revenue qty mean_price mean_lead_time mean_planned mean_deviation",
)
def _(spark, d):
    s = sales_view(spark, d, "invoice_date", "planned_days", "lead_time_deviation", *VARS)
    return kpi.period_aggregate(s, "month")


@query(
    "agg_12_distinct_dimensions",
    "select count(distinct family) families, count(distinct country) countries from s",
)
def _(spark, d):
    return kpi.distinct_dimensions(sales_view(spark, d, "family", "country"))


@query("agg_13_period_revenue", _M + " select * from p", floats="revenue")
def _(spark, d):
    return kpi.period_revenue(sales_view(spark, d, "invoice_date", "amount"), "month")


@query(
    "agg_14_period_change",
    _M + " select *, (revenue/lag(revenue) over (order by period_index)-1)*100 change_pct from p",
    floats="revenue change_pct",
)
def _(spark, d):
    return kpi.period_change(sales_view(spark, d, "invoice_date", "amount"), "month")


@query(
    "agg_15_period_share",
    _M + " select *, revenue/sum(revenue) over ()*100 share_pct from p",
    floats="revenue share_pct",
)
def _(spark, d):
    return kpi.period_share(sales_view(spark, d, "invoice_date", "amount"), "month")


@query(
    "agg_16_extreme_periods",
    _M + """, k as (select *, row_number() over (order by revenue desc, period_index) a, row_number() over (order by revenue, period_index) b from p)
    select period, period_index, revenue, a<=5 is_top, b<=5 is_bottom from k where a<=5 or b<=5""",
    floats="revenue",
)
def _(spark, d):
    return kpi.extreme_periods(sales_view(spark, d, "invoice_date", "amount"), "month")


@query(
    "agg_17_mean_line",
    """select "month" period, month_index period_index, sum(amount)::double/count(amount) mean_line from s group by 1,2""",
    floats="mean_line",
)
def _(spark, d):
    return kpi.mean_line_by_period(sales_view(spark, d, "invoice_date", "amount"), "month")


@query(
    "agg_18_stability",
    """, p as (select "month" period, month_index period_index, stddev_samp(amount::double) std from s group by 1,2)
    select *, std < median(std) over () is_stable from p""",
    floats="std",
)
def _(spark, d):
    return kpi.stability(sales_view(spark, d, "invoice_date", "amount"), "month")


@query(
    "agg_19_evolution",
    """select "month" period, month_index period_index, avg(unit_price) mean, sum(unit_price) sum, median(unit_price) median from s group by 1,2""",
    floats="mean sum median",
)
def _(spark, d):
    return kpi.evolution(sales_view(spark, d, "invoice_date", "unit_price"), "month", "unit_price")


@query(
    "agg_20_histogram",
    """, e as (select min(amount::double) lo, max(amount::double) hi from s),
    c as (select least(floor((amount::double-lo)/(hi-lo)*50),49)::integer bin, count(*) n from s, e group by 1)
    select g.bin+1 bin, lo+g.bin*((hi-lo)/50) "lower", lo+(g.bin+1)*((hi-lo)/50) "upper", coalesce(n,0) n_rows
    from (select unnest(range(50))::integer bin) g, e left join c on c.bin=g.bin""".replace("g, e left join c on c.bin=g.bin", "g cross join e left join c on c.bin=g.bin"),
    floats="lower upper",
)
def _(spark, d):
    return kpi.histogram(sales_view(spark, d, "amount"), "amount", 50).withColumnRenamed("rows", "n_rows")


_BOX = """, q as (select fiscal_quarter_code period, quantile_cont(amount::double,0.25) q1, median(amount::double) median, quantile_cont(amount::double,0.75) q3,
    avg(amount::double) mean, stddev_samp(amount::double) std, count(*) n from s group by 1),
  j as (select q.*, amount::double v, v between q1-1.5*(q3-q1) and q3+1.5*(q3-q1) ok from s join q on period=fiscal_quarter_code)"""


@query(
    "agg_21_box_stats",
    _BOX + """ select period, any_value(q1) q1, any_value(median) median, any_value(q3) q3, min(v) filter (ok) low_whisker, max(v) filter (ok) high_whisker,
     count(*) filter (not ok) outliers, any_value(n) n, any_value(mean) mean, any_value(std) std from j group by 1""",
    floats="q1 median q3 low_whisker high_whisker mean std",
)
def _(spark, d):
    s = sales_view(spark, d, "fiscal_quarter_code", "amount").withColumnRenamed("fiscal_quarter_code", "period")
    return kpi.box_stats(s, ["period"], "amount")


@query(
    "agg_22_outlier_share",
    _LONG + """, q as (select variable, quantile_cont("value",0.25) q1, quantile_cont("value",0.75) q3 from v group by 1),
    c as (select variable, count(*) filter ("value"<q1-1.5*(q3-q1) or "value">q3+1.5*(q3-q1)) outliers, count(*) n from v join q using (variable) group by 1)
    select variable, outliers, outliers*100.0/n outlier_pct, case when outliers*100.0/n>10 then 'high' when outliers*100.0/n>5 then 'moderate' else 'normal' end level from c""",
    floats="outlier_pct",
)
def _(spark, d):
    return kpi.outlier_share(sales_view(spark, d, *VARS), VARS)


@query(
    "agg_23_variation_class",
    """, x as (select stddev_samp(amount::double)/avg(amount::double)*100 cv_pct from s)
    select cv_pct, case when cv_pct>100 then 'very dispersed' when cv_pct>50 then 'moderate' else 'low' end level from x""",
    floats="cv_pct",
)
def _(spark, d):
    return kpi.variation_class(sales_view(spark, d, "amount"))


@query(
    "agg_24_concentration_class",
    _CURVE + """, a as (select (sum(v) filter ("rank"<=floor(n*0.2)))::double/max(t)::double*100 c from k),
    b as (select max(v)/sum(v)*100 g from (select country, sum(amount)::double v from s group by 1))
    select c top20_client_pct, case when c>80 then 'strong' when c>60 then 'moderate' else 'spread' end client_level,
      g top_country_pct, case when g>50 then 'dependent' else 'diversified' end country_level from a, b""",
    floats="top20_client_pct top_country_pct",
)
def _(spark, d):
    return kpi.concentration_class(sales_view(spark, d, "client_id", "country", "amount"))


@query(
    "agg_25_attention_counts",
    _LONG + """ select variable, count(*) filter ("value" is null) nulls, count(*) filter ("value" is null)*100.0/count(*) null_pct, count(*) filter ("value"<0) negatives from v group by 1""",
    floats="null_pct",
)
def _(spark, d):
    return kpi.attention_counts(sales_view(spark, d, *VARS), VARS)


@query(
    "agg_26_skew_flag",
    "select median(amount::double) median, avg(amount::double) mean, avg(amount::double)>median(amount::double)*1.2 is_skewed from s",
    floats="median mean",
)
def _(spark, d):
    return kpi.skew_flag(sales_view(spark, d, "amount"))


@query("agg_27_qq_points", floats="sample theoretical")
def _(spark, d):
    return kpi.qq_points(sales_view(spark, d, "amount"), "amount")


@query(
    "agg_28_normality_screen",
    _LONG + """, z as (select variable, count(*) n, avg("value") m from v group by 1),
    w as (select variable, any_value(n) n, avg(("value"-m)^2) m2, avg(("value"-m)^3) m3, avg(("value"-m)^4) m4 from v join z using (variable) group by 1),
    y as (select variable, n, m3/m2^1.5 skewness, m4/m2^2-3 kurtosis from w)
    select variable, n, skewness, kurtosis, n/6.0*(skewness^2+kurtosis^2/4) jarque_bera, n/6.0*(skewness^2+kurtosis^2/4)>5.991464547107979 is_non_normal from y""",
    floats="skewness kurtosis jarque_bera", digits=4,
)
def _(spark, d):
    return kpi.normality_screen(sales_view(spark, d, *VARS), VARS)


@query(
    "agg_29_interpretation",
    _CURVE + """, a as (select (sum(v) filter ("rank"<=greatest(1,floor(n*0.2))))::double/max(t)::double*100 p from k),
     b as (select median(lead_time_days) m from s where lead_time_days between 0 and 730),
     cc as (select sum((v/t)^2)*10000 h from (select currency, sum(amount)::double v, sum(sum(amount)) over ()::double t from s group by 1)),
     e as (select max(r) hi, avg(r) mid, min(r) lo from (select "month", sum(amount)::double r from s group by 1))
    select case when p>85 then 'very concentrated' when p>70 then 'moderate' else 'diversified' end pareto_level,
      case when m<7 then 'excellent' when m<14 then 'good' when m<30 then 'acceptable' else 'slow' end lead_time_level,
      case when h>5000 then 'very concentrated' when h>2500 then 'moderate' else 'diversified' end currency_level,
      hi-mid > 2*(mid-lo) is_series_skewed from a, b, cc, e""".replace("sum(sum(amount)) over ()::double", "(sum(sum(amount)) over ())::double"),
)
def _(spark, d):
    return kpi.interpretation(
        sales_view(spark, d, "client_id", "amount", "lead_time_days", "currency", "invoice_date")
    )


@query(
    "agg_30_normal_overlay",
    """, e as (select min(amount::double) lo, max(amount::double) hi, avg(amount::double) m, stddev_samp(amount::double) sd, count(*) n from s),
    c as (select least(floor((amount::double-lo)/(hi-lo)*50),49)::integer bin, count(*) c from s, e group by 1)
    select 'data' kind, ((lo+g.bin*((hi-lo)/50))+(lo+(g.bin+1)*((hi-lo)/50)))/2 x, coalesce(c,0)/(n*((lo+(g.bin+1)*((hi-lo)/50))-(lo+g.bin*((hi-lo)/50)))) density
      from (select unnest(range(50))::integer bin) g cross join e left join c on c.bin=g.bin
    union all select 'normal', lo+(hi-lo)*i/99, exp(-((((lo+(hi-lo)*i/99)-m)/sd)^2)/2)/(sd*sqrt(2*pi())) from e, (select unnest(range(100)) i)""",
    floats="x density", digits=9,
)
def _(spark, d):
    return kpi.normal_overlay(sales_view(spark, d, "amount"), "amount")
