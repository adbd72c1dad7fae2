from pyspark.sql import functions as F

from salestide.operators import clean as cln
from salestide.plans.registry import query
from salestide.sources import files
from salestide.sources.schema import resolve_columns
from salestide.sources.views import NATION_CODES, raw_view, recipe_view

_ISO = "[" + ",".join(f"'{c}'" for c in NATION_CODES) + "]"
_KNOWN = ",".join(f"'{c}'" for c in cln.COUNTRY_PREFIXES)
# raw lines as read, then typed; continues as the cleaning steps
RAW = f"""with r0 as (select case c_mktsegment when 'MACHINERY' then '13' when 'HOUSEHOLD' then 'ZZ' else {_ISO}[c_nationkey+1] end||o_custkey client_id, c_name client_name,
   case when l_discount<>0 then cast(l_shipdate as date) end invoice_date, cast(o_orderdate as date) order_date, cast(l_shipdate as date) ship_date,
   cast(o_orderdate as date)+15*cast(o_orderpriority[1] as integer) planned_date,
   case when p_size>25 then 'BX L'||lpad((l_partkey%1000)::varchar,3,'0')||'T'||lpad((l_partkey%1000)::varchar,3,'0') else 'L'||lpad((l_partkey%1000)::varchar,3,'0') end article_code,
   p_name label_1, p_brand label_2, p_type family,
   (case when l_linestatus='O' and l_discount>=0.09 then -(l_quantity*p_retailprice) when l_discount>=0.09 and l_quantity>25 then l_quantity*p_retailprice/1000 else l_quantity*p_retailprice end)::decimal(18,2)::double amount,
   case when l_returnflag='R' then -l_quantity else l_quantity end qty, case when l_tax>0 then p_retailprice end unit_price, ' '||lower(o_orderstatus) currency, l_orderkey::varchar order_id
  from lineitem join orders on l_orderkey=o_orderkey join customer on o_custkey=c_custkey join part on l_partkey=p_partkey),
 r as (select *, case when regexp_matches(client_id[1:2],'^[0-9]{{1,2}}$') then 'FR' when client_id[1:2] in ({_KNOWN}) then client_id[1:2] else 'Unknown' end country,
   coalesce(regexp_extract_all(article_code,'[A-Z][0-9]{{3}}')[2], regexp_extract_all(article_code,'[A-Z][0-9]{{3}}')[1]) recipe_code from r0),
 l as (select article_code, arg_min(label_1, (order_date::varchar||label_1)) label from r group by 1),
 d as (select r.* exclude (label_1), label label_1, year(invoice_date) yr, month(invoice_date) mo, datediff('day',order_date,ship_date) lead_time_days, datediff('day',order_date,planned_date) planned_days
   from r left join l using (article_code) where family not in ('PROMO') and invoice_date is not null),
 pa as (select article_code, median(unit_price) pa from d where unit_price>0 group by 1), pf as (select family, median(unit_price) pf from d where unit_price>0 group by 1),
 f as (select d.*, coalesce(pa, pf) reference_price from d left join pa using (article_code) left join pf using (family)),
 n1 as (select * replace (case when qty<0 and amount>=0 and unit_price>0 then amount/unit_price else qty end as qty) from f),
 n2 as (select * replace (case when amount<0 and qty>=0 and unit_price>=0 then qty*unit_price else amount end as amount) from n1),
 n3 as (select * replace (case when unit_price<0 and amount>=0 and qty>0 then amount/qty else unit_price end as unit_price) from n2),
 n4 as (select * from n3 where not coalesce(qty<0,false) and not coalesce(amount<0,false)),
 s1 as (select * replace (case when amount>=0 and qty>0 and (unit_price is null or unit_price<0 or (reference_price is not null and abs(amount/qty-reference_price)+0.05<abs(unit_price-reference_price)*0.1)) then amount/qty else unit_price end as unit_price) from n4),
 s2 as (select * replace (case when qty>0 and unit_price>0 and (amount is null or amount<0 or abs(amount-qty*unit_price)>0.05+1e-6*abs(qty*unit_price) or abs(amount-qty*unit_price)/greatest(abs(qty*unit_price),1.0)>0.01) then qty*unit_price else amount end as amount) from s1),
 s3 as (select * replace (case when amount>=0 and unit_price>0 and (qty is null or qty<0) then amount/unit_price else qty end as qty) from s2)"""
EXCLUDED = ["PROMO"]


def _dated(spark, d):
    out = cln.prepare(raw_view(spark, d)).transform(cln.exclude_families, EXCLUDED).transform(cln.drop_undated)
    return cln.with_reference_price(out)


def _money(df, *keys):
    """Sums per key that tell the three money columns apart."""
    return df.groupBy(*keys).agg(
        F.count("*").alias("n_lines"), F.sum("qty").alias("qty"), F.sum("amount").alias("amount"), F.sum("unit_price").alias("unit_price")
    )


_MONEY = "count(*) n_lines, sum(qty) qty, sum(amount) amount, sum(unit_price) unit_price"
_MF = "qty:3 amount:2 unit_price:2"


@query("src_04_resolve_columns", "select client_id, order_id, article_code, family, count(*) n_lines from r group by all", base=RAW)
def _(spark, d):
    out = resolve_columns(raw_view(spark, d))
    return out.groupBy("client_id", "order_id", "article_code", "family").agg(F.count("*").alias("n_lines"))


@query("src_05_drop_footer", "select family, count(*) n_lines from r group by 1", base=RAW)
def _(spark, d):
    raw = raw_view(spark, d)
    footer = raw.agg(F.sum(F.col("`Montant`").try_cast("double")).cast("string").alias("Montant"))
    both = raw.unionByName(footer, allowMissingColumns=True)
    return files.drop_footer(both).groupBy(F.col("Famille").alias("family")).agg(F.count("*").alias("n_lines"))


@query("snk_04_upsert", """select case when p_size>25 and p_retailprice>=1000 then 'updated' when p_size>25 then 'created' else 'kept' end "action", count(distinct p_partkey) n_rows
  from part where p_size>25 or p_retailprice>=1000 group by 1""".replace("p_size>25 or p_retailprice>=1000", "p_retailprice>=1000 or p_size>25"), base="")
def _(spark, d):
    rows = recipe_view(spark, d).select("source_file", "product_name", "kcal_100g", "portion_size")
    from salestide.sources.views import read_table

    part = read_table(spark, d, "part").select(
        F.concat(F.lit("sheet_"), F.col("p_partkey").cast("string"), F.lit(".txt")).alias("source_file"), "p_size", "p_retailprice"
    )
    tagged = rows.join(part, "source_file")
    merged = files.upsert(
        tagged.where("p_retailprice >= 1000").select(*rows.columns),
        tagged.where("p_size > 25").select(*rows.columns), "source_file",
    )
    return files.upsert_counts(merged).withColumnRenamed("rows", "n_rows")


@query("cln_01_country", "select country, count(*) n_lines, count(distinct client_id) clients from r group by 1", base=RAW)
def _(spark, d):
    p = cln.prepare(raw_view(spark, d))
    return p.groupBy("country").agg(F.count("*").alias("n_lines"), F.count_distinct("client_id").alias("clients"))


@query("cln_02_dates", "select invoice_date, order_date, ship_date, planned_date, count(*) n_lines from r group by all", base=RAW)
def _(spark, d):
    p = cln.prepare(raw_view(spark, d))
    return p.groupBy(*cln.DATES).agg(F.count("*").alias("n_lines"))


@query("cln_03_numbers", f"select family, {_MONEY} from r group by 1", floats=_MF, base=RAW)
def _(spark, d):
    return _money(cln.prepare(raw_view(spark, d)), "family")


@query("cln_04_drop_accounting", "select client_id, family, count(*) n_lines from r group by all", base=RAW)
def _(spark, d):
    kept = cln.drop_accounting(raw_view(spark, d))
    if any(c in kept.columns for c in cln.ACCOUNTING_COLUMNS):
        raise ValueError("accounting columns left")
    return kept.groupBy(F.col("Cpt Client").alias("client_id"), F.col("Famille").alias("family")).agg(F.count("*").alias("n_lines"))


@query("cln_05_recipe_code", "select article_code, recipe_code, count(*) n_lines from r group by 1,2", base=RAW)
def _(spark, d):
    p = cln.prepare(raw_view(spark, d))
    return p.groupBy("article_code", "recipe_code").agg(F.count("*").alias("n_lines"))


@query("cln_06_article_label", "select article_code, label label_1, count(*) n_lines from r left join l using (article_code) group by 1,2", base=RAW)
def _(spark, d):
    p = cln.with_article_label(cln.prepare(raw_view(spark, d)))
    return p.groupBy("article_code", "label_1").agg(F.count("*").alias("n_lines"))


@query("cln_07_exclude_families", "select family, count(*) n_lines from r where family<>'PROMO' group by 1", base=RAW)
def _(spark, d):
    p = cln.exclude_families(cln.prepare(raw_view(spark, d)), EXCLUDED)
    return p.groupBy("family").agg(F.count("*").alias("n_lines"))


@query("cln_08_drop_undated", "select family, count(*) n_lines from r where invoice_date is not null group by 1", base=RAW)
def _(spark, d):
    p = cln.drop_undated(cln.prepare(raw_view(spark, d)))
    return p.groupBy("family").agg(F.count("*").alias("n_lines"))


@query(
    "cln_09_duplicate_count",
    "select ((select count(*) from lineitem)-(select count(*) from (select distinct * from lineitem)))::bigint duplicates", base="",
)
def _(spark, d):
    from salestide.sources.views import read_table

    return cln.duplicate_count(read_table(spark, d, "lineitem"))


@query(
    "cln_11_lead_times",
    "select client_id, sum(lead_time_days)::bigint lead_time_days, sum(planned_days)::bigint planned_days, sum(lead_time_days-planned_days)::bigint lead_time_deviation from d group by 1", base=RAW,
)
def _(spark, d):
    p = cln.with_lead_times(cln.prepare(raw_view(spark, d)).transform(cln.exclude_families, EXCLUDED).transform(cln.drop_undated))
    return p.groupBy("client_id").agg(*[F.sum(c).alias(c) for c in ("lead_time_days", "planned_days", "lead_time_deviation")])


@query("cln_12_reference_price", "select distinct article_code, family, reference_price from f", floats="reference_price", base=RAW)
def _(spark, d):
    return _dated(spark, d).select("article_code", "family", "reference_price").distinct()


@query("cln_13_repair_negatives", f"select family, {_MONEY} from n3 group by 1", floats=_MF, base=RAW)
def _(spark, d):
    return _money(cln.repair_negatives(_dated(spark, d)), "family")


@query("cln_14_drop_negatives", f"select family, {_MONEY} from n4 group by 1", floats=_MF, base=RAW)
def _(spark, d):
    return _money(cln.drop_negatives(cln.repair_negatives(_dated(spark, d))), "family")


def _kept(spark, d):
    return cln.drop_negatives(cln.repair_negatives(_dated(spark, d)))


@query("cln_15_settle_price", f"select family, {_MONEY} from s1 group by 1", floats=_MF, base=RAW)
def _(spark, d):
    return _money(cln.settle_price(_kept(spark, d)), "family")


@query("cln_16_settle_amount", f"select family, {_MONEY} from s2 group by 1", floats=_MF, base=RAW)
def _(spark, d):
    return _money(cln.settle_amount(cln.settle_price(_kept(spark, d))), "family")


@query("cln_17_settle_quantity", f"select family, {_MONEY} from s3 group by 1", floats=_MF, base=RAW)
def _(spark, d):
    return _money(cln.settle_quantity(cln.settle_amount(cln.settle_price(_kept(spark, d)))), "family")


_CLEAN = """select invoice_date, client_id, country, recipe_code, family, label_1, yr+(case when mo>=4 then 1 else 0 end) fiscal_year, lead_time_days-planned_days lead_time_deviation, order_id, qty, amount, unit_price from s3"""
_CLEAN_COLS = ["invoice_date", "client_id", "country", "recipe_code", "family", "label_1", "fiscal_year", "lead_time_deviation", "order_id", "qty", "amount", "unit_price"]


@query("cln_18_final_columns", _CLEAN, floats="qty amount unit_price", base=RAW)
def _(spark, d):
    return cln.clean(raw_view(spark, d), EXCLUDED).select(*_CLEAN_COLS)


@query(
    "cln_24_pipeline",
    "select fiscal_year, country, family, count(*) n_lines, sum(amount) amount, sum(qty) qty from (" + _CLEAN + ") group by 1,2,3", floats="amount:2 qty:3", base=RAW,
)
def _(spark, d):
    return cln.clean(raw_view(spark, d), EXCLUDED).groupBy("fiscal_year", "country", "family").agg(
        F.count("*").alias("n_lines"), F.sum("amount").alias("amount"), F.sum("qty").alias("qty")
    )


@query(
    "cln_19_step_log",
    """, k as (select (select count(*) from r) n0, (select count(*) from r where family<>'PROMO') n1, (select count(*) from d) n2, (select count(*) from n4) n3)
    select 1 position, 'families' step, n0 before, n1 "after", n1-n0 delta from k union all select 2, 'undated', n1, n2, n2-n1 from k union all select 3, 'negatives', n2, n3, n3-n2 from k""", base=RAW,
)
def _(spark, d):
    return cln.step_log(raw_view(spark, d), EXCLUDED)


@query(
    "cln_20_sign_profile",
    ", v as (select 'qty' c, qty v from r union all select 'amount', amount from r union all select 'unit_price', unit_price from r) select c \"column\", count(*) filter (v is null) nulls, count(*) filter (v<0) negatives, count(*) filter (v=0) zeros, count(*) filter (v>0) positives from v group by 1", base=RAW,
)
def _(spark, d):
    return cln.sign_profile(cln.prepare(raw_view(spark, d)))


@query(
    "cln_21_ratio_signatures",
    """, x as (select amount/(qty*unit_price) ratio from r where amount>=0 and qty>0 and unit_price>0)
    select case when abs(ratio-0.001)<=0.0002+1e-8 then '~0.001' when abs(ratio-1)<=0.01+1e-5 then '~1' else 'other' end signature, count(*) n_lines, count(*) filter (ratio<0.01) suspicious from x group by 1""", base=RAW,
)
def _(spark, d):
    return cln.ratio_signatures(cln.prepare(raw_view(spark, d))).withColumnRenamed("lines", "n_lines")


@query(
    "cln_22_changed_rows",
    """, b as (select article_code, sum(coalesce(amount,0)) a, sum(coalesce(unit_price,0)) p from n4 group by 1), c as (select article_code, sum(coalesce(amount,0)) a, sum(coalesce(unit_price,0)) p from s3 group by 1)
    select count(*) changed from b join c using (article_code) where abs(b.a-c.a)>0.001 or abs(b.p-c.p)>0.001""", base=RAW,
)
def _(spark, d):
    before = _kept(spark, d)
    after = cln.settle_quantity(cln.settle_amount(cln.settle_price(before)))

    def by_article(df):
        rounded = lambda c: F.round(F.sum(F.coalesce(F.col(c), F.lit(0.0))), 2).alias(c)
        return df.groupBy("article_code").agg(rounded("amount"), rounded("unit_price"))

    changed = cln.changed_rows(by_article(before), by_article(after), "article_code", ["amount", "unit_price"])
    return changed.agg(F.count("*").alias("changed"))


@query(
    "cln_23_settle_totals",
    "select (select sum(amount) from n4) amount_before, (select sum(amount) from s3) amount_after, (select sum(qty*unit_price) from s3) theoretical",
    floats="amount_before:2 amount_after:2 theoretical:2", base=RAW,
)
def _(spark, d):
    return cln.settle_totals(_kept(spark, d))


