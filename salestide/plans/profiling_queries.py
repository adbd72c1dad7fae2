from pyspark.sql import functions as F

from salestide.operators import profile as pro
from salestide.plans.registry import query
from salestide.sources.views import raw_view, read_table, sales_view

NUMERIC = ["amount", "qty", "unit_price", "lead_time_days"]


INFO = ["order_id", "invoice_date", "amount", "qty"]


@query(
    "pro_01_dataset_info",
    """, c(position, "column", "type") as (values (0,'order_id','string'),(1,'invoice_date','date'),(2,'amount','decimal(18,2)'),(3,'qty','double'))
    select (select count(*) from s) n_rows, 4 n_columns, position, "column", "type" from c""",
)
def _(spark, d):
    info = pro.dataset_info(sales_view(spark, d, *INFO))
    return info.withColumnsRenamed({"rows": "n_rows", "columns": "n_columns"})


@query(
    "pro_02_missing_values",
    """select 'unit_price' "column", count(*) filter (l_tax=0) missing, count(*) filter (l_tax=0)*100.0/count(*) missing_pct from lineitem""",
    floats="missing_pct",
)
def _(spark, d):
    r = raw_view(spark, d)
    from salestide.sources.schema import HEADER_CANDIDATES, resolve_columns

    named = {k: v for k, v in HEADER_CANDIDATES.items() if k != "country"}
    return pro.missing_values(resolve_columns(r, named))


_LONG = """, v as (select 'amount' variable, amount::double value from s union all select 'qty', qty from s
  union all select 'unit_price', unit_price from s union all select 'lead_time_days', lead_time_days from s)"""


@query(
    "pro_03_numeric_summary",
    _LONG + """ select variable, count(value) n, avg(value) mean, stddev_samp(value) std, min(value) "min", max(value) "max",
      quantile_cont(value,0.25) q25, median(value) median, quantile_cont(value,0.75) q75 from v group by 1""",
    floats="mean std min max q25 median q75",
)
def _(spark, d):
    return pro.numeric_summary(sales_view(spark, d, *NUMERIC))


@query(
    "pro_04_categorical_summary",
    """, v as (select 'family' variable, family "value" from s union all select 'country', country from s union all select 'currency', currency from s),
    c as (select variable, "value", count(*) n from v group by all),
    k as (select *, count(*) over (partition by variable) distinct_values, row_number() over (partition by variable order by n desc, "value") position from c)
    select variable, "value", n, position, distinct_values from k where position<=5""",
)
def _(spark, d):
    return pro.categorical_summary(
        sales_view(spark, d, "family", "country", "currency"), ["family", "country", "currency"]
    )


@query(
    "pro_06_family_share",
    """select family, count(*) n_rows, count(*)*100.0/(select count(*) from s) share_pct from s group by 1""",
    floats="share_pct",
)
def _(spark, d):
    return pro.value_share(sales_view(spark, d, "family")).withColumnRenamed("rows", "n_rows")


@query(
    "pro_07_head_rows",
    "select invoice_date, client_id, order_id, recipe_code, amount from s order by invoice_date, client_id, order_id, recipe_code, amount limit 10",
)
def _(spark, d):
    cols = ["invoice_date", "client_id", "order_id", "recipe_code", "amount"]
    return pro.head_rows(sales_view(spark, d, *cols), [F.col(c) for c in cols])


@query("pro_08_date_range", "select min(invoice_date) first_date, max(invoice_date) last_date from s")
def _(spark, d):
    return pro.date_range(sales_view(spark, d, "invoice_date"))


@query(
    "pro_09_source_summary",
    """select source_file, count(v) n, avg(v) mean, stddev_samp(v) std, min(v) "min", max(v) "max", sum(v::decimal(18,2))::double total, median(v) median
    from (select 'lineitem.parquet' source_file, l_extendedprice v from lineitem) group by 1""",
    floats="mean std min max total median",
)
def _(spark, d):
    lines = read_table(spark, d, "lineitem").select(
        F.col("_metadata.file_name").alias("source_file"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"),
    )
    return pro.source_summary(lines, "amount")


@query(
    "pro_09_source_histogram",
    """, e as (select family, min(amount::double) lo, max(amount::double) hi from s group by 1)
    select family, least(floor((amount::double-lo)/(hi-lo)*30),29)::integer+1 bin, count(*) n_rows from s join e using (family) group by 1,2""",
)
def _(spark, d):
    out = pro.histogram_by(sales_view(spark, d, "family", "amount"), "family", "amount", 30)
    return out.withColumnRenamed("rows", "n_rows")


@query("pro_10_points", """select invoice_date "date", amount::double "value" from s""")
def _(spark, d):
    return pro.points(sales_view(spark, d, "invoice_date", "amount"), "amount")
