from salestide.operators import corr
from salestide.plans.products_queries import _M, BASE, _stats
from salestide.plans.registry import query
from salestide.sources.views import sales_view

VARS = ["amount", "qty", "unit_price", "lead_time_days"]
_PAIRS = [(a, b) for i, a in enumerate(VARS) for b in VARS[i + 1:]]


def _union(template, pairs):
    return " union all ".join(template.format(a=a, b=b) for a, b in pairs)


@query(
    "cor_01_pearson",
    _union("select '{a}' a, '{b}' b, corr({a}::double,{b}::double) r from s", _PAIRS),
    floats="r",
)
def _(spark, d):
    return corr.pearson_matrix(sales_view(spark, d, *VARS), VARS).drop("_rows")


@query(
    "cor_02_strength",
    ", m as (" + _union("select '{a}' a, '{b}' b, corr({a}::double,{b}::double) r from s", _PAIRS)
    + """) select *, case when r>0 then 'positive' else 'negative' end direction, case when abs(r)>0.7 then 'strong' when abs(r)>0.5 then 'moderate' else 'weak to moderate' end strength
    from m where abs(r)>0.3""",
    floats="r",
)
def _(spark, d):
    return corr.strength(sales_view(spark, d, *VARS), VARS)


@query(
    "cor_03_pearson_by_period",
    ", m as ("
    + _union("select \"month\" period, month_index period_index, '{a}' a, '{b}' b, count(*) n, corr({a}::double,{b}::double) r from s group by 1,2", _PAIRS)
    + """), u as (select period from m where n>=3 group by 1 having count(*) filter (r is null or isnan(r))=0)
    select period, period_index, a, b, r from m where n>=3 and period in (from u)""",
    floats="r",
)
def _(spark, d):
    return corr.pearson_by_period(sales_view(spark, d, "invoice_date", *VARS), VARS, "month")


_RANK = """, rk as (select {k} a, b, rank() over (partition by {k} a,b order by x)+(count(*) over (partition by {k} a,b,x)-1)/2.0 rx,
   rank() over (partition by {k} a,b order by y)+(count(*) over (partition by {k} a,b,y)-1)/2.0 ry from l where x is not null and y is not null)"""


@query(
    "cor_04_family_spearman",
    _stats("family") + ", l as ("
    + _union("select '{a}' a, '{b}' b, {a}::double x, {b}::double y from i",
             [(a, b) for n, a in enumerate(corr.MEASURES) for b in corr.MEASURES[n + 1:]])
    + ")" + _RANK.format(k="")
    + " select a, b, case when min(rx)<max(rx) and min(ry)<max(ry) then corr(rx,ry) end rho from rk group by 1,2",
    floats="rho",
)
def _(spark, d):
    return corr.family_spearman(sales_view(spark, d, "family", *BASE))


@query(
    "cor_05_product_spearman",
    f", i0 as (select recipe_code item, fiscal_year period_index, {_M} from s group by 1,2), i as (select * from i0 where item in (select item from i0 group by 1 having count(*)>=3)), l as ("
    + _union("select item, '{a}' a, '{b}' b, {a}::double x, {b}::double y from i",
             [("revenue", m) for m in corr.MEASURES if m != "revenue"])
    + ")" + _RANK.format(k="item,")
    + " select item, b variable, case when min(rx)<max(rx) and min(ry)<max(ry) then corr(rx,ry) end rho from rk group by 1,2",
    floats="rho",
)
def _(spark, d):
    s = sales_view(spark, d, "recipe_code", "invoice_date", *BASE)
    return corr.item_spearman(s, "recipe_code", "year")
