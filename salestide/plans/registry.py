"""Registry of the named queries and the SQL that states the same result.

A query is registered with the names of its floating-point columns; those are
rounded on both sides, because engines may differ in the last bits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salestide.sources.views import NATION_CODES, REGION_CURRENCIES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _sql_list(values: list[str]) -> str:
    return "[" + ",".join(f"'{v}'" for v in values) + "]"


# The sales view as SQL; oracle texts continue after this common table expression.
SALES = f"""with s0 as (
 select cast(o_custkey as varchar) client_id, c_name client_name, cast(l_orderkey as varchar) order_id,
  cast(o_orderdate as date) order_date, cast(l_shipdate as date) invoice_date,
  p_type family, cast(l_partkey as varchar) recipe_code, p_name label_1, p_brand label_2,
  {_sql_list(NATION_CODES)}[c_nationkey+1] country,
  {_sql_list(REGION_CURRENCIES)}[n_regionkey+1] currency,
  cast(l_extendedprice as decimal(18,2)) amount, l_quantity qty, l_extendedprice/l_quantity unit_price,
  15*cast(o_orderpriority[1] as integer) planned_days
 from lineitem join orders on l_orderkey=o_orderkey join customer on o_custkey=c_custkey
 join nation on c_nationkey=n_nationkey join part on l_partkey=p_partkey),
s as (select *, year(invoice_date) "year", strftime(invoice_date,'%Y-%m') "month",
  year(invoice_date)*100+month(invoice_date) month_index,
  year(invoice_date)+(case when month(invoice_date)>=4 then 1 else 0 end) fiscal_year,
  ((month(invoice_date)+8)%12)//3+1 fiscal_quarter_num,
  'FY'||fiscal_year fiscal_year_label, fiscal_year||'Q'||fiscal_quarter_num fiscal_quarter_code,
  fiscal_year*10+fiscal_quarter_num fiscal_quarter_index,
  datediff('day',order_date,invoice_date) lead_time_days,
  datediff('day',order_date,invoice_date)-planned_days lead_time_deviation
 from s0)"""


def query(name: str, sql: str | None = None, floats: str = "", digits: int = 6, base: str = SALES):
    """Register a query; ``sql`` continues the base expression (start it with ``select`` or ``, x as``).

    ``floats`` lists the columns to round, ``name`` or ``name:places``.
    """
    columns = {}
    for token in floats.split():
        column, _, places = token.partition(":")
        columns[column] = int(places or digits)

    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            df = fn(spark, folder)
            return df.withColumns({c: F.round(F.col(c), n) for c, n in columns.items()}) if columns else df

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            text = f"{base} {sql.strip()}"
            if columns:
                swaps = ", ".join(f"round({c},{n})+0 as {c}" for c, n in columns.items())
                text = f"select * replace ({swaps}) from ({text}) t"
            ORACLES[name] = text
        return fn

    return wrap
