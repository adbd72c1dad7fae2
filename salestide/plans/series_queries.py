from pyspark.sql import functions as F

from salestide.functions.calendar import with_period
from salestide.functions.numeric import total
from salestide.operators import series as ts
from salestide.plans.registry import query
from salestide.sources.views import sales_view

CORE = ("invoice_date", "amount", "qty", "client_id", "order_id")
FULL = ("fiscal_year_label", "amount", "qty", "unit_price", "client_id", "order_id")
_DAY = """, dd as (select invoice_date d, sum(amount)::double revenue, sum(qty) qty, count(distinct client_id) clients, count(distinct order_id) orders from s group by 1),
  cal as (select cast(unnest(generate_series(min(d), max(d), interval 1 day)) as date) "day" from dd),
  dy as (select "day", coalesce(revenue,0) revenue, coalesce(qty,0) qty, coalesce(clients,0) clients, coalesce(orders,0) orders, revenue/nullif(qty,0) price from cal left join dd on d="day")"""
_MON = """, m as (select "month" period, month_index period_index, sum(amount)::double revenue, sum(qty) qty, count(distinct client_id) clients, count(distinct order_id) orders, sum(amount)::double/sum(qty) price from s group by 1,2)"""
_STATS = """sum(amount)::double revenue, sum(amount)::double/count(amount) mean_line, stddev_samp(amount::double) std_line, count(amount) sales, sum(qty) qty, avg(qty) mean_qty,
  avg(unit_price) mean_price, count(distinct client_id) clients, count(distinct order_id) orders, median(amount::double) median_line, median(unit_price) median_price"""
_SF = "revenue mean_line std_line qty mean_qty mean_price median_line median_price"


@query(
    "tsr_05_fiscal_quarter_share",
    """, q as (select fiscal_year, fiscal_quarter_num, sum(amount)::double revenue, count(distinct client_id) clients, count(distinct order_id) orders from s group by 1,2)
    select *, revenue/sum(revenue) over (partition by fiscal_year) "share" from q""",
    floats="revenue share",
)
def _(spark, d):
    return ts.fiscal_quarter_share(
        sales_view(spark, d, "fiscal_year", "fiscal_quarter_num", "amount", "client_id", "order_id")
    )


@query("tsr_01_daily", _DAY + " select * from dy", floats="revenue qty price")
def _(spark, d):
    return ts.daily(sales_view(spark, d, *CORE))


@query(
    "tsr_02_from_daily",
    _DAY + """, e as (select *, year("day")+(case when month("day")>=4 then 1 else 0 end) fy, ((month("day")+8)%12)//3+1 fq from dy)
    select fy||'Q'||fq period, fy*10+fq period_index, sum(revenue) revenue, sum(qty) qty, sum(clients)::bigint clients, sum(orders)::bigint orders, sum(revenue)/sum(qty) price from e group by 1,2""",
    floats="revenue qty price",
)
def _(spark, d):
    return ts.from_daily(ts.daily(sales_view(spark, d, *CORE)), "quarter")


@query("tsr_03_by_period", _MON + " select * from m", floats="revenue qty price")
def _(spark, d):
    return ts.by_period(sales_view(spark, d, *CORE), "month")


@query(
    "tsr_03_by_year",
    """select "year"::varchar period, "year" period_index, sum(amount)::double revenue, sum(qty) qty, count(distinct client_id) clients, count(distinct order_id) orders, sum(amount)::double/sum(qty) price from s group by 1,2""",
    floats="revenue qty price",
)
def _(spark, d):
    return ts.by_period(sales_view(spark, d, "year", *CORE), "year")


@query(
    "tsr_04_metric_arrays",
    _MON + """ select list(period order by period_index) periods, list(revenue order by period_index) revenue, list(qty order by period_index) qty,
     list(clients order by period_index) clients, list(orders order by period_index) orders from m""",
)
def _(spark, d):
    return ts.metric_arrays(sales_view(spark, d, *CORE), "month")


@query(
    "tsr_05_quarter_stats",
    f""", q as (select fiscal_year_label, fiscal_quarter_num, {_STATS} from s group by 1,2)
    select *, revenue/sum(revenue) over (partition by fiscal_year_label)*100 share_pct, std_line/mean_line*100 cv_pct, revenue/clients revenue_per_client from q""",
    floats=_SF + " share_pct cv_pct revenue_per_client",
)
def _(spark, d):
    return ts.fiscal_quarter_stats(sales_view(spark, d, "fiscal_quarter_num", *FULL))


@query(
    "tsr_06_latest_year_trend",
    """, q as (select fiscal_year_label fy, fiscal_quarter_num q, sum(amount)::double r from s group by 1,2), l as (select * from q where fy=(select max(fy) from q))
    select fy fiscal_year_label, (arg_max(r,q)/arg_min(r,q)-1)*100 growth_pct, arg_max(q,r) best_quarter, arg_min(q,r) worst_quarter from l group by 1 having count(*)>=2""",
    floats="growth_pct",
)
def _(spark, d):
    return ts.latest_year_trend(sales_view(spark, d, "fiscal_year_label", "fiscal_quarter_num", "amount"))


@query(
    "tsr_07_month_stats",
    """, m as (select fiscal_year_label, "month", sum(amount)::double revenue, sum(amount)::double/count(amount) mean_line, count(amount) sales, sum(qty) qty, count(distinct client_id) clients, count(distinct order_id) orders from s group by 1,2)
    select *, revenue/sum(revenue) over (partition by fiscal_year_label)*100 share_pct,
     ['Janvier','Février','Mars','Avril','Mai','Juin','Juillet','Août','Septembre','Octobre','Novembre','Décembre'][right("month",2)::integer] month_name,
     row_number() over (partition by fiscal_year_label order by revenue desc, "month")<=3 is_top3, row_number() over (partition by fiscal_year_label order by revenue, "month")<=3 is_bottom3 from m""",
    floats="revenue mean_line qty share_pct",
)
def _(spark, d):
    return ts.month_stats(
        sales_view(spark, d, "fiscal_year_label", "month", "amount", "qty", "client_id", "order_id")
    )


@query(
    "tsr_08_fiscal_year_stats",
    f""", q as (select fiscal_year_label, {_STATS} from s group by 1)
    select *, (revenue/lag(revenue) over (order by fiscal_year_label)-1)*100 change_pct, revenue/clients revenue_per_client, revenue/orders revenue_per_order from q""",
    floats=_SF + " change_pct revenue_per_client revenue_per_order",
)
def _(spark, d):
    return ts.fiscal_year_stats(sales_view(spark, d, *FULL))


_INSIGHT = """, sr as (select family, "month" period, month_index period_index, sum(amount)::double y from s group by 1,2,3),
  x as (select *, row_number() over (partition by family order by period_index)-1 x, row_number() over (partition by family order by period_index desc) b from sr)"""


def _family_months(spark, d):
    s = with_period(sales_view(spark, d, "family", "invoice_date", "amount"), "month")
    return s.groupBy("family", "period", "period_index").agg(total("amount").alias("revenue"))


@query(
    "tsr_09_series_insight",
    _INSIGHT + """ select family, count(*) n_periods, max(period) filter (b=1) last_period, max(y) filter (b=1) last_value, max(period) filter (b=2) prev_period, max(y) filter (b=2) prev_value,
     ((max(y) filter (b=1))/(max(y) filter (b=2))-1)*100 pct_change_last, regr_slope(y,x) slope, regr_r2(y,x) r2, stddev_pop(y)/avg(y)*100 cv_pct from x group by 1""",
    floats="last_value prev_value pct_change_last slope r2 cv_pct",
)
def _(spark, d):
    return ts.series_insight(_family_months(spark, d), "revenue", ["family"])


@query(
    "tsr_09_series_extremes",
    _INSIGHT + """, r as (select *, row_number() over (partition by family order by y desc, period_index) t, row_number() over (partition by family order by y, period_index) w from sr)
    select family, period, period_index, y "value", t<=3 is_top, w<=3 is_bottom from r where t<=3 or w<=3""",
    floats="value",
)
def _(spark, d):
    return ts.series_extremes(_family_months(spark, d), "revenue", ["family"])


@query(
    "tsr_10_clients_per_period",
    "select fiscal_quarter_code period, fiscal_quarter_index period_index, count(distinct client_id) clients from s group by 1,2",
)
def _(spark, d):
    return ts.clients_per_period(sales_view(spark, d, "invoice_date", "client_id"), "quarter")


@query(
    "tsr_11_base100",
    _MON + """ select period, period_index, revenue, qty, clients, revenue/first_value(revenue) over w*100 revenue_index, qty/first_value(qty) over w*100 qty_index,
     clients::double/first_value(clients) over w*100 clients_index from m window w as (order by period_index)""",
    floats="revenue qty revenue_index qty_index clients_index",
)
def _(spark, d):
    m = ts.by_period(sales_view(spark, d, *CORE), "month").drop("orders", "price")
    return ts.base100(m, ["revenue", "qty", "clients"])


@query("tsr_12_stl", floats="observed trend seasonal resid")
def _(spark, d):
    return ts.stl(_family_months(spark, d), "revenue", ["family"], 12)


@query("tsr_13_component_strength", floats="trend_strength seasonal_strength")
def _(spark, d):
    return ts.component_strength(ts.stl(_family_months(spark, d), "revenue", ["family"], 12), ["family"])


@query(
    "tsr_14_moving_average",
    _INSIGHT + """ select family, period, period_index, y revenue, avg(y) over (partition by family order by period_index rows between 5 preceding and current row) moving_average from sr""",
    floats="revenue moving_average",
)
def _(spark, d):
    return ts.moving_average(_family_months(spark, d), "revenue", 6, ["family"])


@query("tsr_15_stationarity", floats="adf_statistic adf_critical kpss_statistic")
def _(spark, d):
    return ts.stationarity(ts.daily(sales_view(spark, d, "country", *CORE), ["country"]), "revenue", ["country"])


@query(
    "tsr_16_attach_clients",
    _DAY + _MON + """, e as (select strftime("day",'%Y-%m') period, year("day")*100+month("day") period_index, sum(revenue) revenue, sum(qty) qty, sum(orders)::bigint orders, sum(revenue)/nullif(sum(qty),0) price from dy group by 1,2)
    select e.*, m.clients from e left join m using (period)""",
    floats="revenue qty price",
)
def _(spark, d):
    s = sales_view(spark, d, *CORE)
    return ts.attach_clients(ts.from_daily(ts.daily(s), "month"), ts.clients_per_period(s, "month"))
