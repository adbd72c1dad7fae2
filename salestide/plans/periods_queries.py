from pyspark.sql import functions as F

from salestide.functions import calendar as cal
from salestide.operators import periods as per
from salestide.plans.registry import query
from salestide.sources.views import sales_view

CLOSURES = {y: [(f"{y}-08-01", f"{y}-08-26")] for y in range(1992, 2004)}


@query(
    "cln_10_fiscal_calendar",
    """select "year", "month", fiscal_year, fiscal_year_label, fiscal_quarter_num, fiscal_quarter_code,
      ['Q1 (Avr-Juin)','Q2 (Juil-Sep)','Q3 (Oct-Déc)','Q4 (Jan-Mar)'][fiscal_quarter_num]||' '||fiscal_year_label fiscal_quarter_label,
      isodow(invoice_date)-1 weekday, count(*) n_lines from s group by all""",
)
def _(spark, d):
    s = cal.with_fiscal_calendar(sales_view(spark, d, "invoice_date"))
    keys = [c for c in s.columns if c != "invoice_date"]
    return s.groupBy(*keys).agg(F.count("*").alias("n_lines"))


@query(
    "per_02_october_periods",
    """select year(invoice_date) cal_year, month(invoice_date) cal_month,
      case when month(invoice_date)>=10 then 1 when month(invoice_date)<=3 then 2 when month(invoice_date)<=6 then 3 else 4 end october_quarter,
      count(*) n_lines from s group by all""",
)
def _(spark, d):
    s = per.with_october_periods(sales_view(spark, d, "invoice_date"))
    return s.groupBy("cal_year", "cal_month", "october_quarter").agg(F.count("*").alias("n_lines"))


@query(
    "per_03_period_labels",
    """, o as (select year(invoice_date) y, month(invoice_date) m,
      case when m>=10 then 1 when m<=3 then 2 when m<=6 then 3 else 4 end q from s)
    select 'month' grain, y||'-'||lpad(m::varchar,2,'0') period_label, y*100+m period_key, count(*) n_lines from o group by all
    union all select 'quarter', y||'-Q'||q, y*10+q, count(*) from o group by all
    union all select 'year', y::varchar, y, count(*) from o group by all""",
)
def _(spark, d):
    s = per.with_october_periods(sales_view(spark, d, "invoice_date"))
    by_month = s.groupBy("cal_year", "cal_month", "october_quarter").agg(F.count("*").alias("c"))
    parts = [
        per.october_label(by_month, g).withColumn("grain", F.lit(g))
        .groupBy("grain", "period_label", "period_key").agg(F.sum("c").alias("n_lines"))
        for g in cal.GRAINS
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "per_04_filter_period",
    "select client_id, order_id, recipe_code, invoice_date, amount from s where fiscal_year_label='FY1998'",
)
def _(spark, d):
    s = sales_view(
        spark, d, "client_id", "order_id", "recipe_code", "invoice_date", "amount", "fiscal_year_label"
    )
    return per.filter_period(s, "fiscal_year", "FY1998").drop("fiscal_year_label")


@query(
    "per_05_available_periods",
    """select distinct 'month' kind, "month" label, month_index sort_key from s
    union select distinct 'quarter', ['Q1 (Avr-Juin)','Q2 (Juil-Sep)','Q3 (Oct-Déc)','Q4 (Jan-Mar)'][fiscal_quarter_num]||' '||fiscal_year_label, fiscal_quarter_index from s
    union select distinct 'fiscal_year', fiscal_year_label, fiscal_year from s""",
)
def _(spark, d):
    return per.available_periods(
        sales_view(spark, d, "invoice_date", "month", "fiscal_quarter_label", "fiscal_year_label")
    )


_LABELS = """, l as (select distinct ['Q1 (Avr-Juin)','Q2 (Juil-Sep)','Q3 (Oct-Déc)','Q4 (Jan-Mar)'][fiscal_quarter_num]||' '||fiscal_year_label label, fiscal_year fy, fiscal_quarter_num q, null::integer mi from s
  union select distinct fiscal_year_label, fiscal_year, 0, null from s union select distinct "month", null, null, month_index from s)"""


def _labels(spark, d):
    s = sales_view(spark, d, "invoice_date", "month", "fiscal_quarter_label", "fiscal_year_label")
    return per.available_periods(s).select("label")


@query("per_06_label_order", _LABELS + " select label, coalesce(fy*100+q, mi) sort_key from l")
def _(spark, d):
    return _labels(spark, d).withColumn("sort_key", per.label_sort_key(F.col("label")))


@query(
    "per_07_short_labels",
    _LABELS + " select label, case when q>0 then 'FY'||fy||' Q'||q else label end short from l",
)
def _(spark, d):
    return _labels(spark, d).withColumn("short", per.short_label(F.col("label")))


@query(
    "per_08_quarter_start",
    """select distinct fiscal_quarter_code, cast(date_trunc('quarter', invoice_date) as date) period_start from s""",
)
def _(spark, d):
    s = sales_view(spark, d, "fiscal_quarter_code", "fiscal_year", "fiscal_quarter_num").distinct()
    return s.select(
        "fiscal_quarter_code",
        per.quarter_start(F.col("fiscal_year"), F.col("fiscal_quarter_num")).alias("period_start"),
    )


@query(
    "per_09_period_index",
    """select 'month' grain, "month" period, month_index period_index, count(*) n_lines from s group by all
    union all select 'quarter', fiscal_quarter_code, fiscal_quarter_index, count(*) from s group by all
    union all select 'year', fiscal_year_label, fiscal_year, count(*) from s group by all""",
)
def _(spark, d):
    days = sales_view(spark, d, "invoice_date").groupBy("invoice_date").agg(F.count("*").alias("c"))
    parts = [
        cal.with_period(days, g).groupBy(F.lit(g).alias("grain"), "period", "period_index")
        .agg(F.sum("c").alias("n_lines"))
        for g in cal.GRAINS
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "per_10_business_days",
    """, c as (select client_id, min(order_date) a, max(order_date) b from s group by 1)
    select client_id, greatest(1, (select count(*) from (select unnest(generate_series(a, b, interval 1 day)) dd) where isodow(dd)<6)) business_days from c""",
)
def _(spark, d):
    c = sales_view(spark, d, "client_id", "order_date").groupBy("client_id").agg(
        F.min("order_date").alias("a"), F.max("order_date").alias("b")
    )
    return c.select("client_id", per.business_days(F.col("a"), F.col("b")).alias("business_days"))


@query(
    "per_11_quarter_open_days",
    """, q as (select distinct cast(date_trunc('quarter', order_date) as date) quarter_start from s)
    select year(quarter_start)||'Q'||quarter(quarter_start) "quarter", quarter_start,
     (select count(*) from (select unnest(generate_series(quarter_start, quarter_start + interval 3 month - interval 1 day, interval 1 day)) dd)
      where isodow(dd)<6 and not (month(dd)=8 and day(dd)<=26)) open_days from q""",
)
def _(spark, d):
    return per.quarter_open_days(sales_view(spark, d, "order_date"), CLOSURES)


@query("per_12_order_years", """select distinct year(order_date) "year" from s""")
def _(spark, d):
    return per.order_years(sales_view(spark, d, "order_date"))


@query(
    "per_13_spanned_periods",
    """select client_id, min(invoice_date) first_date, max(invoice_date) last_date,
      max(fiscal_year*4+fiscal_quarter_num)-min(fiscal_year*4+fiscal_quarter_num)+1 spanned_periods from s group by 1""",
)
def _(spark, d):
    return per.spanned_periods(sales_view(spark, d, "client_id", "invoice_date"), "quarter")
