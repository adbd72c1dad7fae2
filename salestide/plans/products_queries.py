from salestide.operators import products as prd
from salestide.plans.registry import query
from salestide.sources.views import sales_view

BASE = ["amount", "qty", "order_id", "client_id", "lead_time_days", "lead_time_deviation"]
_M = """sum(amount)::double revenue, sum(qty) qty, count(distinct order_id) orders, count(distinct client_id) clients,
  median(lead_time_days)::double median_lead_time, quantile_cont(lead_time_deviation,0.9)::double p90_deviation,
  (count(*) filter (lead_time_deviation>0))*100.0/count(*) late_pct, sum(amount)::double/sum(qty) price"""
_MF = "median_lead_time p90_deviation late_pct"


def _stats(item):
    return f""", i as (select {item} item, {_M} from s group by 1), x as (select {item} item, sum(amount) v from s group by 1),
  k0 as (select i.*, row_number() over (order by v desc, item) "rank", v::double/(sum(v) over ())::double*100 share_pct,
   (sum(v) over (order by v desc, item rows unbounded preceding))::double/(sum(v) over ())::double*100 cum_pct from i join x using (item)),
  k as (select *, case when cum_pct<=80 then 'A' when cum_pct<=95 then 'B' else 'C' end abc from k0)"""


@query("prd_01_family_stats", _stats("family") + " select * from i", floats=_MF)
def _(spark, d):
    return prd.item_stats(sales_view(spark, d, "family", *BASE), "family")


@query("prd_02_product_ranking", _stats("recipe_code") + " select * from k", floats=_MF + " share_pct cum_pct")
def _(spark, d):
    return prd.item_ranking(sales_view(spark, d, "recipe_code", *BASE), "recipe_code")


@query(
    "prd_03_abc_summary",
    _stats("recipe_code") + """, p as (select *, row_number() over (partition by abc order by "rank") p from k)
    select abc, sum(revenue) revenue, count(*) items, sum(share_pct) share_pct, sum(revenue) filter (p<=20) shown_revenue, sum(share_pct) filter (p<=20) shown_share_pct from p group by 1""",
    floats="revenue:2 share_pct shown_revenue:2 shown_share_pct",
)
def _(spark, d):
    return prd.abc_summary(prd.item_ranking(sales_view(spark, d, "recipe_code", *BASE), "recipe_code"))


_SEG = """, g as (select item, revenue, qty, price, case when qty>=median(qty) over () then 'HighVolume' else 'LowVolume' end||' x '||
   case when price>=median(price) over () then 'HighPrice' else 'LowPrice' end segment from i)"""


@query("prd_04_price_volume_segments", _stats("recipe_code") + _SEG + " select * from g")
def _(spark, d):
    return prd.price_volume_segments(sales_view(spark, d, "recipe_code", *BASE), "recipe_code")


@query(
    "prd_05_segment_summary",
    _stats("recipe_code") + _SEG + """, p as (select *, row_number() over (partition by segment order by revenue desc, item) p from g)
    select segment, sum(revenue) revenue, count(*) items, string_agg(item, ', ' order by p) filter (p<=8) || case when count(*)>8 then '… (+'||(count(*)-8)||')' else '' end preview from p group by 1""",
    floats="revenue:2",
)
def _(spark, d):
    return prd.segment_summary(sales_view(spark, d, "recipe_code", *BASE), "recipe_code")


@query(
    "prd_06_global_score",
    _stats("recipe_code") + """, z as (select item, revenue, qty, price, late_pct, round((0.45*((revenue-min(revenue) over ())/(max(revenue) over ()-min(revenue) over ()))
      +0.20*((qty-min(qty) over ())/(max(qty) over ()-min(qty) over ()))+0.20*((price-min(price) over ())/(max(price) over ()-min(price) over ()))
      +0.15*(1-((late_pct-min(late_pct) over ())/(max(late_pct) over ()-min(late_pct) over ()))))*100, 2) score from i)
    select *, dense_rank() over (order by score desc) score_rank from z order by score desc, revenue desc, item limit 20""",
    floats="revenue qty price late_pct score",
)
def _(spark, d):
    return prd.global_score(sales_view(spark, d, "recipe_code", *BASE), "recipe_code")


@query(
    "prd_07_leaders",
    _stats("family") + """, t as (select item from i order by revenue desc, item limit 1)
    select (select item from t) top_revenue, (select item from i order by qty desc, item limit 1) top_qty, (select item from i order by price desc, item limit 1) top_price,
     (select item from i order by p90_deviation desc, item limit 1) worst_delay,
     (select country from s where family=(select item from t) group by 1 order by sum(amount) desc, 1 limit 1) dominant_country""",
)
def _(spark, d):
    return prd.leaders(sales_view(spark, d, "family", "country", *BASE))


@query(
    "prd_08_product_series",
    f" select recipe_code item, fiscal_quarter_code period, fiscal_quarter_index period_index, {_M} from s group by 1,2,3",
    floats=_MF,
)
def _(spark, d):
    return prd.item_series(sales_view(spark, d, "recipe_code", "invoice_date", *BASE), "recipe_code", "quarter")


_FP = """, fp as (select "month" period, month_index period_index, family, sum(amount)::double revenue, sum(qty) qty, sum(amount)::double/sum(qty) price from s group by 1,2,3)"""
_FAM = ("family", "invoice_date", "amount", "qty")


@query("prd_09_family_periods", _FP + " select * from fp")
def _(spark, d):
    return prd.family_periods(sales_view(spark, d, *_FAM), "month")


@query(
    "prd_10_product_options",
    "select recipe_code item, sum(amount)::double revenue from s group by 1 order by 2 desc, 1 limit 300",
    floats="revenue",
)
def _(spark, d):
    return prd.item_options(sales_view(spark, d, "recipe_code", "amount"), "recipe_code", 300)


@query(
    "prd_11_compare_families",
    f""", i as (select family item, "month" period, month_index period_index, {_M} from s where family in ('PROMO','SMALL','LARGE') group by 1,2,3)
    select item, period, period_index, late_pct "value" from i""",
    floats="value",
)
def _(spark, d):
    s = sales_view(spark, d, "family", "invoice_date", *BASE)
    return prd.compare_items(s, "family", ["PROMO", "SMALL", "PROMO", " LARGE"], "late_pct", "month")


@query(
    "prd_12_abc_by_period",
    """, b as (select "month" period, month_index period_index, family, sum(amount) v from s group by 1,2,3),
    p as (select *, row_number() over (partition by period order by v desc, family) p from b),
    c as (select period, period_index, least(p,5) "rank", sum(v) v, case when least(p,5)=5 then 'Autres' else min(family) end family from p group by 1,2,3),
    e as (select *, v::double/(sum(v) over (partition by period))::double*100 share_pct, (sum(v) over (partition by period order by "rank" rows unbounded preceding))::double/(sum(v) over (partition by period))::double*100 cum_pct from c)
    select period, period_index, "rank", family, v::double revenue, share_pct, cum_pct, case when cum_pct<=80 then 'A' when cum_pct<=95 then 'B' else 'C' end abc from e""",
    floats="revenue share_pct cum_pct",
)
def _(spark, d):
    return prd.abc_by_period(sales_view(spark, d, *_FAM), "month", 4)


_GRID = _FP + """, tf as (select family from s group by 1 order by sum(amount) desc, 1 limit 4),
  gr as (select p.period, p.period_index, tf.family, coalesce(revenue,0) revenue, coalesce(qty,0) qty, coalesce(price,0) price
   from (select distinct period, period_index from fp) p cross join tf left join fp on fp.period=p.period and fp.family=tf.family)"""


@query("prd_13_period_family_grid", _GRID + " select * from gr")
def _(spark, d):
    return prd.period_family_grid(sales_view(spark, d, *_FAM), "month", 4)


@query(
    "prd_14_value_volume_grid",
    _GRID + """, cl as (select period, family, (sum(revenue) over (partition by period order by revenue desc, family rows unbounded preceding))/(sum(revenue) over (partition by period))*100 c from fp)
    select gr.*, case when c<=80 then 'A' when c<=95 then 'B' else 'C' end abc from gr left join cl using (period, family)""",
)
def _(spark, d):
    return prd.value_volume_grid(sales_view(spark, d, *_FAM), "month", 4)


_FC = """, tf as (select family from s group by 1 order by sum(amount) desc, 1 limit 4), tc as (select country from s group by 1 order by sum(amount) desc, 1 limit 10)"""


@query(
    "prd_15_family_country",
    _FC + " select family, country, sum(amount)::double revenue from s where family in (from tf) and country in (from tc) group by 1,2",
    floats="revenue",
)
def _(spark, d):
    return prd.family_country_matrix(sales_view(spark, d, "family", "country", "amount"), 4, 10)


@query(
    "prd_15_family_country_by_period",
    _FC + """ select "month" period, month_index period_index, family, country, sum(amount)::double revenue from s where family in (from tf) and country in (from tc) group by 1,2,3,4""",
    floats="revenue",
)
def _(spark, d):
    s = sales_view(spark, d, "family", "country", "amount", "invoice_date")
    return prd.family_country_matrix(s, 4, 10, "month")


@query(
    "prd_16_top_and_others",
    """, tf as (select family from s group by 1 order by sum(amount) desc, 1 limit 4)
    select "month" period, month_index period_index, case when family in (from tf) then family else 'Others' end family, sum(amount)::double revenue from s group by 1,2,3""",
    floats="revenue",
)
def _(spark, d):
    return prd.top_and_others(sales_view(spark, d, "family", "invoice_date", "amount"), "month", 4)


_PRICE = """, pp as (select recipe_code item, month_index, row_number() over (partition by recipe_code order by month_index desc) p, count(*) over (partition by recipe_code) np from s group by 1,2),
  pt as (select recipe_code item, client_id, country, sum(amount)::double revenue, sum(qty) qty, sum(amount)::double/sum(qty) price
    from s join pp on pp.item=recipe_code and pp.month_index=s.month_index where p<=6 group by 1,2,3),
  pc as (select item, quantile_cont(revenue,0.98) cap from pt where revenue>=0 and qty>0 and price>0 group by 1),
  px as (select pt.*, case when cap>0 then least(revenue,cap) else revenue end bubble from pt join pc using (item) where revenue>=0 and qty>0 and price>0)"""
_PT = ("recipe_code", "client_id", "country", "invoice_date", "amount", "qty")


@query("prd_17_price_distribution", _PRICE + " select * from px", floats="bubble")
def _(spark, d):
    return prd.price_distribution(sales_view(spark, d, *_PT))


@query(
    "prd_17_price_labels",
    _PRICE + """, r as (select *, row_number() over (partition by item order by revenue desc, client_id, country) a, row_number() over (partition by item order by price desc, client_id, country) b,
      row_number() over (partition by item order by qty desc, client_id, country) c from px)
    select item, client_id, country, revenue, qty, price from r where a<=6 or b<=1 or c<=1""",
)
def _(spark, d):
    return prd.price_labels(prd.price_distribution(sales_view(spark, d, *_PT)))


@query(
    "prd_18_price_impact",
    _PRICE + """, b as (select recipe_code item, client_id, (sum(amount) filter (p<=6))::double al, sum(qty) filter (p<=6) ql, (sum(amount) filter (p>6))::double ap, sum(qty) filter (p>6) qp
      from s join pp on pp.item=recipe_code and pp.month_index=s.month_index where p<=12 and np>=12 group by 1,2),
    c as (select item, client_id, ap revenue_prev, al revenue_last, (al/ql-ap/qp)/(ap/qp) price_change, (ql-qp)/qp qty_change from b)
    select * from c where qty_change is not null and abs(price_change)>=0.001""",
    floats="revenue_prev revenue_last price_change qty_change",
)
def _(spark, d):
    return prd.price_impact(sales_view(spark, d, "recipe_code", "client_id", "invoice_date", "amount", "qty"))
