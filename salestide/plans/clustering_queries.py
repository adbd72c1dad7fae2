from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from salestide.operators import cluster as clu
from salestide.plans.registry import query
from salestide.session import durable
from salestide.sources.views import sales_view

COLS = ("client_id", "order_date", "order_id", "family", "country", "amount", "qty", "unit_price", "planned_days")
YEAR = 1997
CLOSURES = {YEAR: [(f"{YEAR}-08-01", f"{YEAR}-08-26")]}
# the families of the test tables, for the SQL texts; the queries take the leading families of their data
FAMILIES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


def _features_sql(keys, source, days):
    fam = ", ".join(
        f"coalesce(max(case when family='{f}' then price end),0) price_{f}, coalesce(max(case when family='{f}' then v end),0) revenue_{f}, coalesce(max(case when family='{f}' then gap end),0) gap_{f}"
        for f in FAMILIES
    )
    logs = ", ".join(f"ln(1+greatest({c},0)) log_{c}" for c in clu.LOGGED)
    shares = ", ".join(f"revenue_{f}/revenue share_{f}" for f in FAMILIES)
    return f""", pf as (select {keys}, family, sum(amount)::double v, avg(unit_price) price, datediff('day',min(order_date),max(order_date))::double/nullif(count(*)-1,0) gap from {source} group by all),
 pw as (select {keys}, count(*) families, {fam} from pf group by all),
 pb as (select {keys}, sum(amount)::double revenue, sum(amount)::double/count(amount) mean_line, sum(qty) qty, count(distinct order_id) orders, avg(planned_days) mean_planned, min(country) country from {source} group by all),
 pj as (select *, {days} dy from pb join pw using ({keys})),
 pr as (select * exclude (dy), revenue/dy revenue_per_day, qty/dy qty_per_day, orders/dy orders_per_day, revenue/orders basket, qty/orders qty_per_order, revenue/qty revenue_per_qty, {shares} from pj),
 pl as (select *, {logs} from pr)"""


_ALL = _features_sql("client_id", "s", "(select count(*) from (select unnest(generate_series(min(order_date), max(order_date), interval 1 day)) d from s) where isodow(d)<6)")
_Q = f""", y as (select *, year(order_date)||'Q'||quarter(order_date) "quarter" from s where year(order_date)={YEAR}),
 od as (select year(d)||'Q'||quarter(d) "quarter", count(*) open_days from (select unnest(generate_series(date '{YEAR}-01-01', date '{YEAR}-12-31', interval 1 day)) d) where isodow(d)<6 and not (month(d)=8 and day(d)<=26) group by 1)"""
_QF = _Q + _features_sql('client_id, "quarter"', "y", '(select open_days from od where od."quarter"=pb."quarter")')
_LOGF = " ".join(f"log_{c}" for c in clu.LOGGED) + " mean_line:9 mean_planned revenue_per_day:9 qty_per_day orders_per_day:9"


def _lines(spark, d):
    return sales_view(spark, d, *COLS)


def _features(spark, d):
    lines = _lines(spark, d)
    return clu.client_features(lines, clu.leading_families(lines))


def _vectors(spark, d):
    """(vectors, feature names, families)."""
    lines = _lines(spark, d)
    families = clu.leading_families(lines)
    f = durable(clu.with_country_code(clu.client_features(lines, families)))
    names = clu.feature_names(families, f.columns)
    return durable(clu.with_vector(f, names)), names, families


def _year(spark, d):
    return clu.year_lines(_lines(spark, d), YEAR)


def _quarter_features(spark, d):
    lines = _year(spark, d)
    families = clu.leading_families(lines)
    return clu.quarter_features(lines, families, CLOSURES), families


def _quarter_vectors(spark, d):
    f, families = _quarter_features(spark, d)
    f = durable(clu.with_country_code(f))
    names = clu.feature_names(families, f.columns)
    return durable(clu.with_vector(f, names)), names


def _quarter_clusters(spark, d):
    vectors, _ = _quarter_vectors(spark, d)
    return clu.cluster_quarters(vectors, clu.shared_k(vectors).where("is_best").first()["k"])


def _long(vectors, names, *keys):
    """One row per feature: its standardised value."""
    pairs = F.arrays_zip(F.array(*[F.lit(n) for n in names]).alias("feature"), vector_to_array("vector").alias("value"))
    return vectors.select(*keys, F.inline(pairs))


def _long_sql(keys, source):
    names = clu.feature_names(FAMILIES, [f"log_{c}" for c in clu.LOGGED] + ["country_code", "families", "mean_planned"]
                              + [f"{p}_{f}" for p in ("price", "share", "gap") for f in FAMILIES])
    parts = " union all ".join(
        f"select {keys}, '{n}' feature, coalesce((x-avg(x) over ())/nullif(stddev_samp(x) over (), 0), 0) \"value\" from (select {keys}, {n}::double x from lv)" for n in names)
    return f"{source}, lv as (select *, dense_rank() over (order by country)-1 country_code from pl) {parts}"


@query("clu_01_leading_families", 'select family label, sum(amount)::double "value" from s group by 1 order by 2 desc, 1 limit 30')
def _(spark, d):
    from salestide.operators.kpi import top_n

    return top_n(sales_view(spark, d, "family", "amount"), "family", n=30)


_C2 = ["client_id", "revenue", "mean_line", "qty", "orders", "mean_planned", "revenue_per_day", "qty_per_day", "orders_per_day", *[f"log_{c}" for c in clu.LOGGED]]


@query("clu_02_client_features", _ALL + " select " + ", ".join(_C2) + " from pl", floats=_LOGF)
def _(spark, d):
    return _features(spark, d).select(*_C2)


_C3 = ["client_id", *[f"{p}_{f}" for f in FAMILIES for p in ("price", "revenue", "share")]]


@query("clu_03_family_prices_shares", _ALL + " select " + ", ".join(_C3) + " from pl", floats=" ".join(f"price_{f}:9 share_{f}" for f in FAMILIES))
def _(spark, d):
    return _features(spark, d).select(*_C3)


_C4 = ["client_id", *[f"gap_{f}" for f in FAMILIES]]


@query("clu_04_family_rhythm", _ALL + " select " + ", ".join(_C4) + " from pl", floats=" ".join(_C4[1:]))
def _(spark, d):
    return _features(spark, d).select(*_C4)


@query("clu_05_country_code", _ALL + " select client_id, country, dense_rank() over (order by country)-1 country_code from pl")
def _(spark, d):
    return clu.with_country_code(_features(spark, d)).select("client_id", "country", "country_code")


@query("clu_06_family_count", _ALL + " select client_id, families from pl")
def _(spark, d):
    return _features(spark, d).select("client_id", "families")


@query("clu_07_vectors", _long_sql("client_id", _ALL), floats="value")
def _(spark, d):
    vectors, names, _ = _vectors(spark, d)
    return _long(vectors, names, "client_id")


@query("clu_08_search_k", floats="silhouette inertia:2 davies_bouldin:4 calinski_harabasz:2")
def _(spark, d):
    return clu.search_k(_vectors(spark, d)[0])


def _assigned(spark, d):
    return clu.cluster_clients(_vectors(spark, d)[0])


@query("clu_09_scores", floats="silhouette inertia:2 davies_bouldin:4 calinski_harabasz:2")
def _(spark, d):
    return _assigned(spark, d)[1]


@query("clu_10_profiles", floats="total_revenue:2 pct " + " ".join(f"mean_{c}:4" for c in clu.PROFILE))
def _(spark, d):
    return clu.cluster_profiles(_assigned(spark, d)[0])


@query("clu_10_families", floats="mean_revenue:2")
def _(spark, d):
    return clu.cluster_families(_assigned(spark, d)[0], clu.leading_families(_lines(spark, d)))


@query("clu_10_countries", floats="pct")
def _(spark, d):
    return clu.cluster_countries(_assigned(spark, d)[0])


@query("clu_11_plane", floats="x y x_share y_share")
def _(spark, d):
    return clu.plane(_assigned(spark, d)[0])


@query(
    "qcl_01_panel",
    _Q + """, a as (select distinct client_id, "quarter" from y), g as (select * from (select distinct client_id from a), (select distinct "quarter" from a))
    select g.client_id, g."quarter", a.client_id is not null is_active from g left join a on a.client_id=g.client_id and a."quarter"=g."quarter\"""",
)
def _(spark, d):
    return clu.quarter_panel(_year(spark, d))


_C5 = ["client_id", "quarter", "revenue", "orders", "families", "revenue_per_day", "orders_per_day", *[f"log_{c}" for c in clu.LOGGED]]


@query(
    "qcl_02_quarter_features", _QF + " select " + ", ".join(f'"{c}"' for c in _C5) + " from pl",
    floats=" ".join(f"log_{c}" for c in clu.LOGGED) + " revenue_per_day:9 orders_per_day:9",
)
def _(spark, d):
    return _quarter_features(spark, d)[0].select(*_C5)


@query("qcl_03_quarter_vectors", _long_sql('client_id, "quarter"', _QF), floats="value")
def _(spark, d):
    vectors, names = _quarter_vectors(spark, d)
    return _long(vectors, names, "client_id", "quarter")


@query("qcl_04_shared_k", floats="silhouette")
def _(spark, d):
    return clu.shared_k(_quarter_vectors(spark, d)[0])


@query("qcl_05_aligned_clusters")
def _(spark, d):
    return _quarter_clusters(spark, d).select("client_id", "quarter", "cluster")


@query("qcl_06_distribution", floats="pct")
def _(spark, d):
    return clu.quarter_distribution(clu.quarter_panel(_year(spark, d)), _quarter_clusters(spark, d))


@query("qcl_07_first_two", floats="cluster_0:4 cluster_1:4")
def _(spark, d):
    return clu.first_two(_quarter_clusters(spark, d))


@query("qcl_08_transitions", floats="row_pct")
def _(spark, d):
    return clu.transitions(clu.quarter_panel(_year(spark, d)), _quarter_clusters(spark, d))


@query(
    "qcl_09_quarter_summary",
    _Q + """ select "quarter", count(*) n_lines, count(distinct client_id) active_clients, any_value(open_days) open_days, (select count(distinct client_id) from y) clients from y join od using ("quarter") group by 1""",
)
def _(spark, d):
    return clu.quarter_summary(_year(spark, d), CLOSURES).withColumnRenamed("lines", "n_lines")
