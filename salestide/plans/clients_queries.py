from pyspark.sql import functions as F

from salestide.operators import clients as cli
from salestide.plans.registry import query
from salestide.sources.views import sales_view

STATS = ("client_id", "amount", "order_id", "invoice_date")
_ST = """, st as (select client_id, sum(amount)::double revenue, count(amount) n_lines, sum(amount)::double/count(amount) basket, count(distinct order_id) orders,
   min(invoice_date) first_date, max(invoice_date) last_date from s group by 1),
  cs as (select *, revenue/orders revenue_per_order, datediff('day', last_date, (select max(invoice_date) from s)) recency_days from st)"""
_CC = _ST + """, cc as (select *, row_number() over (order by revenue desc, client_id) "rank", revenue/(select sum(amount)::double from s)*100 share_pct,
   (sum(revenue::decimal(28,2)) over (order by revenue desc, client_id rows unbounded preceding))::double/(select sum(amount)::double from s)*100 cum_pct from cs)"""
_RFM = _ST + """, rk as (select *, count(*) over () n, row_number() over (order by recency_days, revenue desc, client_id) r, row_number() over (order by orders, revenue desc, client_id) f,
   row_number() over (order by revenue, client_id) m from cs),
  sc as (select client_id, revenue, orders, recency_days, (6-greatest(1,ceil((r-1)*5.0/(n-1))))::integer r_score, greatest(1,ceil((f-1)*5.0/(n-1)))::integer f_score, greatest(1,ceil((m-1)*5.0/(n-1)))::integer m_score from rk),
  rf as (select *, r_score+f_score+m_score rfm_score, case when r_score+f_score+m_score>=13 then 'Champions' when r_score+f_score+m_score>=10 then 'Fidèles' when r_score+f_score+m_score>=7 then 'Potentiels' else 'Risque' end segment from sc)"""
RFM = ["client_id", "revenue", "orders", "recency_days", "r_score", "f_score", "m_score", "rfm_score", "segment"]


def _stats(spark, d):
    return cli.client_stats(sales_view(spark, d, *STATS))


@query(
    "cli_01_client_options",
    "select client_id, sum(amount)::double revenue, min(client_name) client_name from s group by 1 order by 2 desc, 1 limit 500",
)
def _(spark, d):
    return cli.client_options(sales_view(spark, d, "client_id", "client_name", "amount", "invoice_date"))


@query("cli_02_client_stats", _ST + " select * from cs")
def _(spark, d):
    return _stats(spark, d).withColumnRenamed("lines", "n_lines")


@query(
    "cli_03_client_stats_by_period",
    """, p as (select client_id, fiscal_quarter_code q, sum(amount) v, count(amount) n, min(invoice_date) a, max(invoice_date) b from s group by 1,2),
    c as (select client_id, sum(v)::double revenue, sum(n)::bigint n_lines, sum(v)::double/count(v) basket, count(*) orders, min(a) first_date, max(b) last_date from p group by 1)
    select *, revenue/orders revenue_per_order, datediff('day', last_date, (select max(invoice_date) from s)) recency_days from c""",
)
def _(spark, d):
    s = sales_view(spark, d, "client_id", "amount", "invoice_date")
    return cli.client_stats(s, "quarter").withColumnRenamed("lines", "n_lines")


@query("cli_04_concentration", _CC + ' select client_id, revenue, "rank", share_pct, cum_pct from cc', floats="share_pct cum_pct")
def _(spark, d):
    return cli.concentration(_stats(spark, d)).select("client_id", "revenue", "rank", "share_pct", "cum_pct")


@query(
    "cli_04_concentration_summary",
    _CC + """ select count(*) clients, sum(share_pct) filter ("rank"<=floor((select count(*) from cc)*0.2)) top20_pct, sum(share_pct) filter ("rank"<=10) top10_pct from cc""",
    floats="top20_pct top10_pct",
)
def _(spark, d):
    return cli.concentration_summary(_stats(spark, d))


@query("cli_05_rfm_scores", _RFM + " select client_id, revenue, orders, recency_days, r_score, f_score, m_score from rf")
def _(spark, d):
    return cli.rfm(_stats(spark, d)).select(*RFM[:7])


@query("cli_06_rfm_segment", _RFM + " select client_id, rfm_score, segment from rf")
def _(spark, d):
    return cli.rfm(_stats(spark, d)).select("client_id", "rfm_score", "segment")


@query(
    "cli_07_segment_summary",
    _RFM + " select segment, sum(revenue) revenue, count(*) clients, avg(orders) mean_orders, avg(recency_days) mean_recency from rf group by 1",
    floats="revenue:2 mean_orders mean_recency",
)
def _(spark, d):
    return cli.segment_summary(cli.rfm(_stats(spark, d)))


@query(
    "cli_08_country_clients",
    "select country, count(distinct client_id) clients, sum(amount)::double revenue, sum(amount)::double/count(distinct client_id) revenue_per_client from s group by 1",
)
def _(spark, d):
    return cli.country_clients(sales_view(spark, d, "country", "client_id", "amount"))


@query(
    "cli_09_client_kpis",
    _ST + " select count(*) clients, avg(revenue) mean_revenue, avg(revenue_per_order) mean_per_order from cs",
    floats="mean_revenue:4 mean_per_order:4",
)
def _(spark, d):
    return cli.client_kpis(_stats(spark, d))


@query(
    "agg_20_client_revenue_histogram",
    _ST + """, e as (select min(revenue) lo, max(revenue) hi from cs)
    select least(floor((revenue-lo)/(hi-lo)*30),29)::integer+1 bin, count(*) clients from cs, e group by 1""",
)
def _(spark, d):
    from salestide.operators.kpi import histogram

    h = histogram(_stats(spark, d), "revenue", 30).where("rows > 0")
    return h.select("bin", F.col("rows").alias("clients"))
