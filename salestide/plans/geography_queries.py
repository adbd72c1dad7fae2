from pyspark.sql import functions as F

from salestide.operators import geo, kpi
from salestide.plans.registry import query
from salestide.sources.views import sales_view


def _case(col="country"):
    whens = " ".join(
        f"when {col} in ({','.join(repr(c) for c in codes)}) then '{z}'" for z, codes in geo.ZONES.items()
    )
    return f"case {whens} else '{geo.OTHER_ZONE}' end"


_SCORES = """, b as (select country, sum(amount)::double revenue, count(distinct client_id) clients, count(distinct order_id) orders from s group by 1),
 c as (select *, revenue/orders basket from b),
 e as (select *, revenue/max(revenue) over ()*100 score_revenue, basket/max(basket) over ()*100 score_basket, clients::double/max(clients) over ()*100 score_clients from c),
 f as (select *, score_revenue*0.5+score_basket*0.3+score_clients*0.2 score from e),
 g as (select *, case when score>=70 then 'Excellence' when score>=50 then 'Performant' when score>=30 then 'Moyen' else 'À Développer' end score_class from f)"""
_SCORE_FLOATS = "revenue basket score_revenue score_basket score_clients score"
_GEO = ("country", "amount", "client_id", "order_id")


@query(
    "geo_01_country_stats",
    f""", b as (select country, sum(amount)::double revenue, sum(amount)::double/count(amount) mean_line, stddev_samp(amount::double) std_line, count(amount) sales,
     sum(qty) qty, avg(qty) mean_qty, avg(unit_price) mean_price, count(distinct client_id) clients, count(distinct order_id) orders, count(distinct family) families,
     median(amount::double) median_line, median(unit_price) median_price from s group by 1)
    select *, revenue/sum(revenue) over ()*100 share_pct, row_number() over (order by revenue desc, country) "rank", revenue/clients revenue_per_client,
     revenue/orders basket, clients::double/sum(clients) over ()*100 penetration_pct, {_case()} "zone" from b""",
    floats="revenue mean_line std_line qty mean_qty mean_price median_line median_price share_pct revenue_per_client basket penetration_pct",
)
def _(spark, d):
    return geo.country_stats(sales_view(spark, d, *_GEO, "qty", "unit_price", "family"))


@query("geo_02_zones", f'select distinct country, {_case()} "zone" from s')
def _(spark, d):
    c = sales_view(spark, d, "country").distinct()
    return c.withColumn("zone", geo.zone_of(F.col("country")))


@query(
    "geo_03_zone_stats",
    f""", b as (select {_case()} "zone", sum(amount)::double revenue, sum(amount)::double/count(amount) mean_line, count(distinct client_id) clients,
      count(distinct order_id) orders, count(distinct country) countries from s group by 1)
    select *, revenue/sum(revenue) over ()*100 share_pct, revenue/orders basket from b""",
    floats="revenue mean_line share_pct basket",
)
def _(spark, d):
    return geo.zone_stats(sales_view(spark, d, *_GEO))


@query("geo_04_scores", _SCORES + " select * from g", floats=_SCORE_FLOATS)
def _(spark, d):
    return geo.country_scores(sales_view(spark, d, *_GEO))


@query("geo_05_best_scores", _SCORES + " select * from g order by score desc, country limit 10", floats=_SCORE_FLOATS)
def _(spark, d):
    return geo.best_scores(sales_view(spark, d, *_GEO))


@query(
    "geo_06_class_summary",
    _SCORES + """, n(score_class) as (values ('Excellence'),('Performant'),('Moyen'),('À Développer')),
    h as (select n.score_class, coalesce(sum(revenue),0) revenue, count(country) countries, coalesce(avg(score),0) mean_score from n left join g using (score_class) group by 1)
    select *, revenue/sum(revenue) over ()*100 share_pct from h""",
    floats="revenue mean_score share_pct",
)
def _(spark, d):
    return geo.class_summary(sales_view(spark, d, *_GEO))


@query(
    "geo_07_map_rows",
    ", n(country, iso3, name) as (values "
    + ",".join(f"('{a}','{b}','{c}')" for a, b, c in geo.COUNTRY_CODES)
    + ") select country, iso3, name, sum(amount)::double revenue from s join n using (country) group by 1,2,3",
    floats="revenue",
)
def _(spark, d):
    return geo.map_rows(sales_view(spark, d, "country", "amount"))


@query(
    "geo_08_top_countries",
    'select country label, sum(amount)::double "value" from s group by 1 order by 2 desc, 1 limit 15',
    floats="value",
)
def _(spark, d):
    return kpi.top_n(sales_view(spark, d, "country", "amount"), "country", n=15)


@query("geo_09_class_counts", _SCORES + " select score_class, count(*) countries from g group by 1")
def _(spark, d):
    return geo.class_counts(sales_view(spark, d, *_GEO))
