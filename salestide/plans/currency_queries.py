from salestide.operators import currency as cur
from salestide.plans.registry import query
from salestide.sources.views import sales_view

_F = ", f as (select * from s where currency<>'EUR')"


def _lines(spark, d, *cols):
    return cur.positive_lines(sales_view(spark, d, "currency", "amount", *cols))


@query(
    "cln_25_currency_normalised",
    """select case o_orderstatus when 'x' then '' else upper(o_orderstatus) end currency, count(*) n_lines from lineitem join orders on l_orderkey=o_orderkey group by 1""",
)
def _(spark, d):
    from pyspark.sql import functions as F

    from salestide.sources.views import raw_view

    raw = raw_view(spark, d).select(cur.normal_currency(F.col("Nom Devise")).alias("currency"))
    return raw.groupBy("currency").agg(F.count("*").alias("n_lines"))


@query(
    "cln_26_positive_lines",
    "select currency, count(*) n_lines, sum(amount)::double revenue from s where amount>0 group by 1",
    floats="revenue",
)
def _(spark, d):
    from pyspark.sql import functions as F

    from salestide.functions.numeric import total

    return _lines(spark, d).groupBy("currency").agg(
        F.count("*").alias("n_lines"), total("amount").alias("revenue")
    )


@query(
    "cur_01_kpis",
    """select sum(amount)::double revenue, (select string_agg(c, ',' order by c) from (select distinct currency c from s)) currencies,
     (sum(amount) filter (currency<>'EUR'))::double foreign_amount, (sum(amount) filter (currency<>'EUR'))::double/sum(amount)::double*100 foreign_pct from s""",
    floats="revenue foreign_amount foreign_pct",
)
def _(spark, d):
    return cur.currency_kpis(_lines(spark, d))


@query(
    "cur_02_top_currencies",
    """, b as (select currency, sum(amount)::double amount from s group by 1)
    select *, amount/sum(amount) over ()*100 pct_total, case when currency='EUR' then 0 else amount/(sum(amount) filter (currency<>'EUR') over ())*100 end pct_foreign
    from b order by amount desc, currency limit 5""",
    floats="amount pct_total pct_foreign",
)
def _(spark, d):
    return cur.top_currencies(_lines(spark, d))


@query(
    "cur_03_hhi",
    """, b as (select sum(amount)::double a from s group by currency), c as (select a/sum(a) over () x from b) select sum(x*x)*10000 hhi from c""",
    floats="hhi",
)
def _(spark, d):
    return cur.currency_hhi(_lines(spark, d))


def _top(col):
    return _F + f""", b as (select {col} entity, sum(amount)::double amount from f group by 1 order by 2 desc, 1 limit 5),
    c as (select *, amount/(select sum(amount)::double from f)*100 pct_foreign from b) select *, sum(pct_foreign) over () combined_pct from c"""


@query("cur_04_top_foreign_clients", _top("client_name"), floats="amount pct_foreign combined_pct")
def _(spark, d):
    return cur.top_foreign(_lines(spark, d, "client_name"), "client_name")


@query("cur_05_top_foreign_countries", _top("country"), floats="amount pct_foreign combined_pct")
def _(spark, d):
    return cur.top_foreign(_lines(spark, d, "country"), "country")


_MONTHLY = """, m as (select "month", sum(amount)::double revenue, coalesce((sum(amount) filter (currency<>'EUR'))::double,0)/sum(amount)::double*100 foreign_pct from s group by 1)"""


@query("cur_06_volatility", _MONTHLY + " select stddev_samp(foreign_pct) volatility from m", floats="volatility")
def _(spark, d):
    return cur.foreign_volatility(_lines(spark, d, "month"))


@query(
    "cur_07_currency_by_period",
    """, b as (select cast(date_trunc('quarter', invoice_date) as date) period_start, currency, sum(amount)::double revenue from s group by 1,2),
    g as (select * from (select distinct period_start from b), (select distinct currency from s))
    select period_start, currency, coalesce(revenue,0) revenue from g left join b using (period_start, currency)""",
    floats="revenue",
)
def _(spark, d):
    return cur.currency_by_period(_lines(spark, d, "invoice_date"), "quarter")


@query("cur_08_foreign_share_by_month", _MONTHLY + " select * from m", floats="revenue foreign_pct")
def _(spark, d):
    return cur.foreign_share(_lines(spark, d, "month"), ["month"])


@query(
    "cur_09_country_currency_mix",
    """, b as (select country, currency, sum(amount)::double revenue from s group by 1,2),
    t as (select country, sum(revenue) t from b group by 1 order by 2 desc, 1 limit 15)
    select country, currency, revenue/t*100 share_pct from b join t using (country)""",
    floats="share_pct",
)
def _(spark, d):
    return cur.country_currency_mix(_lines(spark, d, "country"))


_PARETO = _F + """, b as (select client_name, sum(amount) a from f group by 1),
  k as (select client_name, row_number() over (order by a desc, client_name) "rank", a::double amount,
   (sum(a) over (order by a desc, client_name rows unbounded preceding))::double/(sum(a) over ())::double*100 cum_pct from b)"""


@query("cur_10_foreign_client_pareto", _PARETO + " select * from k", floats="amount cum_pct")
def _(spark, d):
    return cur.foreign_client_pareto(_lines(spark, d, "client_name"))


@query(
    "cur_10_clients_to_80",
    _PARETO + ' select "rank" n80, cum_pct n80_pct from k where cum_pct>=80 order by "rank" limit 1',
    floats="n80_pct",
)
def _(spark, d):
    return cur.clients_to_80(_lines(spark, d, "client_name"))


@query(
    "cur_11_family_foreign_share",
    """select family, sum(amount)::double revenue, coalesce((sum(amount) filter (currency<>'EUR'))::double,0)/sum(amount)::double*100 foreign_pct from s group by 1""",
    floats="revenue foreign_pct",
)
def _(spark, d):
    return cur.foreign_share(_lines(spark, d, "family"), ["family"])


@query(
    "cur_12_report",
    _MONTHLY + _F + """, b as (select sum(amount)::double a from s group by currency), c as (select a/sum(a) over () x from b),
    k1 as (select sum(a)/(select sum(amount)::double from f)*100 p from (select sum(amount)::double a from f group by client_name order by 1 desc limit 5)),
    k2 as (select sum(a)/(select sum(amount)::double from f)*100 p from (select sum(amount)::double a from f group by country order by 1 desc limit 5))
    select sum(amount)::double revenue, (select string_agg(c, ',' order by c) from (select distinct currency c from s)) currencies,
     (sum(amount) filter (currency<>'EUR'))::double foreign_amount, (sum(amount) filter (currency<>'EUR'))::double/sum(amount)::double*100 foreign_pct,
     (select sum(x*x)*10000 from c) hhi, (select stddev_samp(foreign_pct) from m) volatility, (select p from k1) top5_clients_pct, (select p from k2) top5_countries_pct from s""",
    floats="revenue foreign_amount foreign_pct hhi volatility top5_clients_pct top5_countries_pct",
)
def _(spark, d):
    return cur.currency_report(
        sales_view(spark, d, "currency", "amount", "client_name", "country", "month")
    )
