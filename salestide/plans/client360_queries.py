from pyspark.sql import functions as F

from salestide.operators import client360 as c36
from salestide.operators import corr
from salestide.plans.registry import query
from salestide.sources.views import sales_view

ORDER_COLS = ("client_id", "order_id", "amount", "order_date", "lead_time_days", "lead_time_deviation")
PRICE_COLS = ("client_id", "order_date", "unit_price", "qty", "amount")
_OO = """, oo as (select client_id, order_id order_key, sum(amount) amount, count(*) n_lines, min(order_date) order_date, median(lead_time_days)::double lead_time,
   max(case when lead_time_deviation>0 then 1 else 0 end) late from s group by 1,2)"""
_OM = """, om as (select *, strftime(order_date,'%Y-%m') period, year(order_date)*100+month(order_date) period_index from s)"""
_WP = "sum(unit_price*qty) filter (unit_price is not null and qty>0)/sum(qty) filter (unit_price is not null and qty>0)"


def _orders(spark, d):
    return c36.client_orders(sales_view(spark, d, *ORDER_COLS))


@query(
    "c36_01_client_lines",
    """select s.* exclude (month_index, fiscal_quarter_index, fiscal_year, fiscal_quarter_num, fiscal_year_label, fiscal_quarter_code, "month", "year", planned_days, lead_time_deviation, lead_time_days, label_1, label_2, unit_price, country, currency, invoice_date, order_date, client_name)
    from s where client_id='7' and family in ('PROMO','SMALL')""",
)
def _(spark, d):
    s = sales_view(spark, d, "client_id", "order_id", "family", "recipe_code", "amount", "qty")
    return c36.one_client(s, "7", ["PROMO", "SMALL"])


@query(
    "c36_02_order_keys",
    _OO + " select client_id, order_key, amount::double amount, n_lines, order_date, lead_time, late from oo",
)
def _(spark, d):
    return _orders(spark, d).withColumn("amount", F.col("amount").cast("double")).withColumnRenamed("lines", "n_lines")


@query(
    "c36_03_base_kpis",
    _OO + """ select client_id, sum(amount)::double revenue, sum(n_lines)::bigint n_lines, count(*) orders, sum(amount)::double/(select sum(amount)::double from s)*100 weight_pct,
     sum(amount)::double/count(*) revenue_per_order, sum(amount)::double/sum(n_lines)::double mean_line from oo group by 1""",
    floats="weight_pct",
)
def _(spark, d):
    return c36.base_kpis(_orders(spark, d)).withColumnRenamed("lines", "n_lines")


@query(
    "c36_04_recency",
    """select client_id, datediff('day', max(order_date), (select max(order_date) from s)) recency_days, datediff('day', min(order_date), max(order_date)) lifetime_days from s group by 1""",
)
def _(spark, d):
    return c36.recency(_orders(spark, d))


_RHYTHM = _OO + """, g as (select client_id, datediff('day', lag(order_date) over (partition by client_id order by order_date, order_key), order_date) gap from oo),
  gg as (select client_id, floor(round(quantile_cont(gap,0.5),6))::bigint median_gap, floor(round(quantile_cont(gap,0.9),6))::bigint p90_gap from g where gap is not null group by 1),
  rh as (select client_id, count(*)::double/((max(year(order_date)*12+month(order_date))-min(year(order_date)*12+month(order_date)))+1) orders_per_period from oo group by 1)"""


@query("c36_05_order_rhythm", _RHYTHM + " select * from rh left join gg using (client_id)", floats="orders_per_period")
def _(spark, d):
    return c36.order_rhythm(_orders(spark, d))


_LT = ", lt as (select client_id, median(lead_time) lead_time_median, case when count(lead_time)>=2 then quantile_cont(lead_time,0.9) end lead_time_p90 from oo group by 1)"


@query("c36_06_lead_times", _OO + _LT + " select * from lt", floats="lead_time_median lead_time_p90")
def _(spark, d):
    return c36.lead_times(_orders(spark, d))


@query("c36_07_late_rate", _OO + " select client_id, avg(late) late_rate from oo group by 1", floats="late_rate")
def _(spark, d):
    return c36.late_rate(_orders(spark, d))


@query(
    "c36_08_main_country",
    """, n as (select client_id, country, count(*) n from s group by 1,2), r as (select *, row_number() over (partition by client_id order by n desc, country) p from n)
    select client_id, country from r where p=1""",
)
def _(spark, d):
    return c36.main_country(sales_view(spark, d, "client_id", "country"))


def _mix(col, name, n):
    return f""", b as (select client_id, {col} "{name}", sum(amount) v from s group by 1,2),
    r as (select client_id, "{name}", row_number() over (partition by client_id order by v desc, "{name}") "rank", v::double revenue, v::double/(sum(v) over (partition by client_id))::double*100 share_pct from b)
    select * from r where "rank"<={n}"""


@query("c36_09_currency_mix", _mix("currency", "currency", 10), floats="share_pct")
def _(spark, d):
    return c36.currency_mix(sales_view(spark, d, "client_id", "currency", "amount"))


_PR = f""", pr as (select client_id, {_WP} price_weighted, case when count(unit_price)>=2 then stddev_samp(unit_price)/abs(avg(unit_price)) end price_cv, median(unit_price) price_median from s group by 1)"""


@query("c36_10_pricing", _PR + " select * from pr", floats="price_weighted:9 price_cv price_median:9")
def _(spark, d):
    return c36.pricing(sales_view(spark, d, "client_id", "unit_price", "qty"))


@query(
    "c36_11_family_portfolio",
    """, b as (select client_id, family, sum(amount) v from s group by 1,2), r as (select *, row_number() over (partition by client_id order by v desc, family) p, sum(v) over (partition by client_id) t from b),
    k as (select client_id, least(p,4) "rank", case when least(p,4)=4 then 'Autres' else min(family) end family, sum(v)::double revenue, sum(v)::double/any_value(t)::double*100 share_pct from r group by 1,2)
    select * from k where "rank"<=3 or revenue>0""",
    floats="share_pct",
)
def _(spark, d):
    return c36.family_portfolio(sales_view(spark, d, "client_id", "family", "amount"), 3)


_FC = """, fc as (select client_id, count(*) families, max(v)/sum(v)*100 top1_share_pct, sum(v*v)/(sum(v)*sum(v)) hhi from (select client_id, family, sum(amount)::double v from s group by 1,2) group by 1)"""


@query("c36_11_family_concentration", _FC + " select * from fc", floats="top1_share_pct hhi")
def _(spark, d):
    return c36.family_concentration(sales_view(spark, d, "client_id", "family", "amount"))


@query(
    "c36_12_family_mix",
    _OM + """, b as (select client_id, family, row_number() over (partition by client_id order by sum(amount) desc, family) p from om group by 1,2),
    m as (select client_id, period, period_index, case when p<=3 then family else 'Autres' end family, sum(amount)::double revenue from om join b using (client_id, family) group by 1,2,3,4)
    select *, revenue/sum(revenue) over (partition by client_id, period)*100 share_pct from m""",
    floats="share_pct",
)
def _(spark, d):
    return c36.family_mix(sales_view(spark, d, "client_id", "family", "amount", "order_date"), "month", 3)


@query("c36_13_top_products", _mix("recipe_code", "product", 10), floats="share_pct")
def _(spark, d):
    return c36.top_products(sales_view(spark, d, "client_id", "recipe_code", "amount"))


@query(
    "c36_14_product_lead_times",
    _OO + """, l as (select s.client_id, recipe_code product, order_id, s.amount, lead_time, late from s join oo on s.client_id=oo.client_id and order_id=order_key),
    o as (select client_id, product, order_id, any_value(late) late from l group by 1,2,3), lr as (select client_id, product, avg(late)*100 late_pct from o group by 1,2),
    b as (select client_id, product, count(distinct order_id) orders, median(lead_time) lead_time_median, case when count(*)>=2 then quantile_cont(lead_time,0.9) end lead_time_p90, sum(amount)::double revenue from l group by 1,2),
    r as (select *, row_number() over (partition by client_id order by revenue desc, product) p from b)
    select client_id, product, orders, lead_time_median, lead_time_p90, late_pct, revenue from r join lr using (client_id, product) where p<=10""",
    floats="lead_time_median lead_time_p90 late_pct",
)
def _(spark, d):
    lines = c36.with_order_key(sales_view(spark, d, "recipe_code", *ORDER_COLS))
    return c36.product_lead_times(lines, c36.client_orders(lines))


_PS = _OO + _OM + f""", ol as (select client_id, strftime(order_date,'%Y-%m') period, median(lead_time) median_lead_time, case when count(lead_time)>=2 then quantile_cont(lead_time,0.9) end p90_lead_time from oo group by 1,2),
  ps as (select * from (select client_id, period, period_index, sum(amount)::double revenue, {_WP} price_weighted, count(distinct order_id) orders from om group by 1,2,3) left join ol using (client_id, period))"""


def _summary(spark, d):
    lines = c36.with_order_key(sales_view(spark, d, "unit_price", "qty", *ORDER_COLS))
    return c36.period_summary(lines, c36.client_orders(lines), "month")


@query("c36_15_period_summary", _PS + " select * from ps", floats="price_weighted:9 median_lead_time p90_lead_time")
def _(spark, d):
    return _summary(spark, d)


@query(
    "cor_06_lead_time_effects",
    _PS + """, n as (select *, lead(orders) over w next_orders, lead(revenue) over w next_revenue from ps window w as (partition by client_id order by period_index)),
    k as (select client_id, median_lead_time l, case when median_lead_time is not null then orders end o, case when median_lead_time is not null then revenue end r,
      next_orders no, next_revenue nr, case when next_orders is not null then median_lead_time end l2, case when median_lead_time is not null then next_orders end no2, case when median_lead_time is not null then next_revenue end nr2 from n)
    select client_id, case when count(l)>=3 and min(l)<max(l) and min(o)<max(o) then corr(l,o) end orders_same, case when count(l)>=3 and min(l)<max(l) and min(r)<max(r) then corr(l,r) end revenue_same,
     case when count(l2)>=3 and min(l2)<max(l2) and min(no2)<max(no2) then corr(l2,no2) end orders_next, case when count(l2)>=3 and min(l2)<max(l2) and min(nr2)<max(nr2) then corr(l2,nr2) end revenue_next from k group by 1""",
    floats="orders_same revenue_same orders_next revenue_next",
)
def _(spark, d):
    return corr.lead_time_effects(_summary(spark, d))


@query(
    "c36_16_family_prices",
    _OM + f" select client_id, period, period_index, family, {_WP} price_weighted, sum(amount)::double revenue from om where unit_price is not null and qty>0 group by 1,2,3,4",
    floats="price_weighted:9",
)
def _(spark, d):
    return c36.family_prices(sales_view(spark, d, "family", *PRICE_COLS), "month")


_GAP = """, gn as (select *, datediff('day', order_date, lead(order_date) over (partition by client_id order by order_date, order_key)) gap from oo),
  gb as (select client_id, quantile_cont(lead_time,0.75) high_threshold from gn where gap is not null group by 1 having count(*)>=3 and min(lead_time)<max(lead_time)),
  ga as (select client_id, high_threshold, count(*) filter (lead_time>=high_threshold) orders_high, case when count(*) filter (lead_time>=high_threshold)>=2 then median(gap) filter (lead_time>=high_threshold) end gap_high,
    count(*) filter (lead_time<high_threshold) orders_low, case when count(*) filter (lead_time<high_threshold)>=2 then median(gap) filter (lead_time<high_threshold) end gap_low from gn join gb using (client_id) where gap is not null group by 1,2)"""


@query("c36_17_gap_after_lead_time", _OO + _GAP + " select *, gap_high-gap_low gap_delta from ga", floats="high_threshold")
def _(spark, d):
    return c36.gap_after_lead_time(_orders(spark, d))


_DROP = """, db as (select client_id, year(order_date)*100+month(order_date) mi, sum(amount) v, row_number() over (partition by client_id order by mi desc) b from s group by 1,2),
  dr as (select client_id, coalesce(count(*)>=6 and (sum(v) filter (b between 4 and 6))>0 and (sum(v) filter (b<=3))::double/(sum(v) filter (b between 4 and 6))::double<=0.70, false) is_dropping from db group by 1)"""
_PACK = (
    _RHYTHM + _LT + _PR + _FC + _GAP + _DROP
    + """, pk as (select b.client_id, b.revenue, b.n_lines, b.orders, b.weight_pct, b.revenue_per_order, b.mean_line, rc.recency_days, rc.lifetime_days, rh.orders_per_period, gg.median_gap, gg.p90_gap,
     lt.lead_time_median, lt.lead_time_p90, lr.late_rate, mc.country, pr.price_weighted, pr.price_cv, pr.price_median, fc.families, fc.top1_share_pct, fc.hhi,
     ga.high_threshold, ga.orders_high, ga.gap_high, ga.orders_low, ga.gap_low, ga.gap_high-ga.gap_low gap_delta, dr.is_dropping
    from (select client_id, sum(amount)::double revenue, sum(n_lines)::bigint n_lines, count(*) orders, sum(amount)::double/(select sum(amount)::double from s)*100 weight_pct, sum(amount)::double/count(*) revenue_per_order, sum(amount)::double/sum(n_lines)::double mean_line from oo group by 1) b
    left join (select client_id, datediff('day', max(order_date), (select max(order_date) from s)) recency_days, datediff('day', min(order_date), max(order_date)) lifetime_days from s group by 1) rc on rc.client_id=b.client_id
    left join rh on rh.client_id=b.client_id left join gg on gg.client_id=b.client_id left join lt on lt.client_id=b.client_id
    left join (select client_id, avg(late) late_rate from oo group by 1) lr on lr.client_id=b.client_id left join (select client_id, min(country) country from s group by 1) mc on mc.client_id=b.client_id
    left join pr on pr.client_id=b.client_id left join fc on fc.client_id=b.client_id left join ga on ga.client_id=b.client_id left join dr on dr.client_id=b.client_id)"""
)
PACK_COLS = ("country", "family", "unit_price", "qty", *ORDER_COLS)


@query(
    "c36_18_alerts",
    _PACK + """, al as (select client_id, list_filter([case when top1_share_pct>=70 then 'concentration' end, case when recency_days>=90 then 'dormant' end, case when price_cv>=0.30 then 'unstable_price' end,
      case when lead_time_p90>=30 then 'slow' end, case when late_rate>=0.20 then 'late' end, case when is_dropping then 'dropping' end], lambda x: x is not null) a from pk)
    select client_id, coalesce(array_to_string(a, ','),'') alerts, len(a)::integer n_alerts from al""",
)
def _(spark, d):
    return c36.alerts(c36.kpi_pack(sales_view(spark, d, *PACK_COLS)))


@query(
    "c36_19_kpi_pack", _PACK + " select * from pk",
    floats="weight_pct orders_per_period lead_time_median lead_time_p90 late_rate price_weighted:9 price_cv price_median:9 top1_share_pct hhi high_threshold",
)
def _(spark, d):
    return c36.kpi_pack(sales_view(spark, d, *PACK_COLS)).withColumnRenamed("lines", "n_lines")


_PY = """, py as (select client_id, recipe_code||' — '||label_2 product, fiscal_year, sum(amount) v, sum(qty) q from s group by 1,2,3)"""
YEAR_COLS = ("client_id", "recipe_code", "label_2", "fiscal_year", "amount", "qty")


@query(
    "c36_20_product_years",
    _PY + """ select client_id, product, fiscal_year, sum(v)::double revenue, sum(q) qty, case when grouping(product)=0 and grouping(fiscal_year)=0 then 'cell' when grouping(product)=0 then 'product' when grouping(fiscal_year)=0 then 'year' else 'client' end "level"
    from py group by grouping sets ((client_id, product, fiscal_year), (client_id, product), (client_id, fiscal_year), (client_id))""",
)
def _(spark, d):
    return c36.product_years(sales_view(spark, d, *YEAR_COLS))


@query(
    "c36_21_product_status",
    _PY + """, y as (select client_id, fiscal_year, row_number() over (partition by client_id order by fiscal_year desc) b from (select distinct client_id, fiscal_year from py)),
    l as (select client_id, max(fiscal_year) filter (b=1) y1, max(fiscal_year) filter (b=2) y2 from y group by 1 having max(fiscal_year) filter (b=2) is not null),
    p as (select client_id, product, coalesce((sum(v) filter (fiscal_year=y2))::double,0) previous, coalesce((sum(v) filter (fiscal_year=y1))::double,0) "last" from py join l using (client_id) group by 1,2)
    select *, "last"-previous change, ("last"-previous)/nullif(previous,0)*100 change_pct,
     case when previous=0 and "last">0 then 'new' when previous>0 and "last"=0 then 'stopped' when "last">previous then 'increasing' when "last"<previous then 'declining' else 'unchanged' end status from p""",
    floats="change_pct",
)
def _(spark, d):
    return c36.product_status(sales_view(spark, d, *YEAR_COLS))


def _efq(item):
    return f""" select client_id, fiscal_year||'-Q'||fiscal_quarter_num efq, {item} item, grouping({item})=1 is_total, sum(amount)::double revenue, sum(qty) qty,
     case when grouping({item})=0 then {_WP} end price_weighted from s group by grouping sets ((client_id, fiscal_year, fiscal_quarter_num, {item}), (client_id, fiscal_year, fiscal_quarter_num))"""


MATRIX_COLS = ("client_id", "fiscal_year", "fiscal_quarter_num", "amount", "qty", "unit_price")


@query("c36_22_quarter_family_matrix", _efq("family"), floats="price_weighted:9")
def _(spark, d):
    return c36.quarter_matrix(sales_view(spark, d, "family", *MATRIX_COLS), "family")


@query("c36_23_quarter_product_matrix", _efq("recipe_code"), floats="price_weighted:9")
def _(spark, d):
    return c36.quarter_matrix(sales_view(spark, d, "recipe_code", *MATRIX_COLS), "recipe_code")


@query(
    "c36_24_product_price_trend",
    _OM + f""", p as (select client_id, recipe_code||' — '||label_2 product, period_index, {_WP} p from om group by 1,2,3),
    t as (select client_id, product, avg(p) mean_price, count(*) filter (p>0) periods, case when count(*) filter (p>0)>=2 then (arg_max(p, period_index) filter (p>0)-arg_min(p, period_index) filter (p>0))/arg_min(p, period_index) filter (p>0)*100 end change_pct from p group by 1,2),
    r as (select *, row_number() over (partition by client_id order by mean_price desc, product) k from t)
    select client_id, product, mean_price, periods, change_pct from r where k<=20""",
    floats="mean_price:9 change_pct",
)
def _(spark, d):
    return c36.product_price_trend(sales_view(spark, d, "recipe_code", "label_2", *PRICE_COLS), "month")


@query(
    "c36_25_product_prices_over_time",
    _OM + f""", t as (select client_id, recipe_code product, row_number() over (partition by client_id order by sum(amount) desc, recipe_code) k from om group by 1,2)
    select client_id, recipe_code product, period, period_index, {_WP} price_weighted, sum(amount)::double revenue from om join t using (client_id) where t.product=recipe_code and k<=6 group by 1,2,3,4""".replace("recipe_code product, period,", "om.recipe_code product, period,"),
    floats="price_weighted:9",
)
def _(spark, d):
    return c36.product_prices_over_time(sales_view(spark, d, "recipe_code", *PRICE_COLS))
