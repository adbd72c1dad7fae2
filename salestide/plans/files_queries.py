"""Readers and writers over the given tables: what is written to the shared folder is read back."""

import uuid

from pyspark.sql import functions as F

from salestide.plans.registry import query
from salestide.session import shared_base
from salestide.sources import files
from salestide.sources.views import read_table, sales_view

_CSV = "select o_orderstatus, count(*) n_rows, sum(o_custkey)::bigint customers from orders group by 1"


def _folder(spark):
    return f"{shared_base(spark)}/files-{uuid.uuid4().hex}"


def _told(orders):
    return orders.groupBy("o_orderstatus").agg(F.count("*").alias("n_rows"), F.sum(F.col("o_custkey").cast("long")).alias("customers"))


@query("src_01_read_parquet", _CSV, base="")
def _(spark, d):
    return _told(files.read_lines(spark, f"{d}/orders.parquet"))


@query("src_02_read_csv", _CSV, base="")
def _(spark, d):
    folder = _folder(spark)
    files.export_csv(read_table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), folder)
    return _told(files.read_lines(spark, folder))


@query("src_03_read_yearly", "select year(o_orderdate) \"year\", o_orderstatus, count(*) n_rows, sum(o_custkey)::bigint customers from orders group by all", base="")
def _(spark, d):
    folder = _folder(spark)
    orders = read_table(spark, d, "orders").withColumn("year", F.year(F.col("o_orderdate").cast("date")))
    # two layouts: the columns of odd years stand in another order
    for odd, columns in ((0, ["o_orderkey", "o_custkey", "o_orderstatus", "year"]), (1, ["year", "o_orderstatus", "o_orderkey", "o_custkey"])):
        part = orders.where(F.col("year") % 2 == odd).select(*columns).coalesce(2)
        part.write.mode("append").option("header", True).csv(folder)
    return files.read_yearly(spark, folder).groupBy(F.col("year").cast("int").alias("year"), "o_orderstatus").agg(
        F.count("*").alias("n_rows"), F.sum(F.col("o_custkey").cast("long")).alias("customers")
    )


@query("snk_01_write_clean", 'select fiscal_year, client_id, count(*) n_lines, sum(amount)::double amount from s group by 1,2', floats="amount:2")
def _(spark, d):
    folder = _folder(spark)
    files.write_clean(sales_view(spark, d, "fiscal_year", "client_id", "amount", "invoice_date"), folder)
    return spark.read.parquet(folder).groupBy("fiscal_year", "client_id").agg(F.count("*").alias("n_lines"), F.sum("amount").cast("double").alias("amount"))


@query("snk_02_write_table", _CSV, base="")
def _(spark, d):
    folder = _folder(spark)
    files.write_table(read_table(spark, d, "orders"), folder)
    return _told(spark.read.parquet(folder))


@query("snk_03_export_csv", _CSV, base="")
def _(spark, d):
    folder = _folder(spark)
    files.export_csv(read_table(spark, d, "orders").select("o_orderstatus", "o_custkey"), folder)
    return _told(spark.read.option("header", True).csv(folder))


@query("src_06_read_sheets", "select count(*) n_rows, sum(length(text))::bigint n_chars, count(distinct text) n_texts from documents", base="")
def _(spark, d):
    folder = _folder(spark)
    # a page per document, parted by form feeds; a mark keeps the line end between rows apart from the texts
    read_table(spark, d, "documents").select(F.concat(F.lit("#"), F.translate("text", "\f", " "), F.lit("\f")).alias("value")).write.text(folder)
    pages = files.read_sheets(spark, folder).where(F.col("text").rlike("^\n?#"))
    kept = pages.select(F.regexp_replace("text", "^\n?#", "").alias("text"))
    return kept.agg(F.count("*").alias("n_rows"), F.sum(F.length("text")).alias("n_chars"), F.count_distinct("text").alias("n_texts"))


@query(
    "snk_04_merge_keyed",
    """, a as (select c_custkey::bigint k, c_name v from customer), b as (select distinct o_custkey::bigint*2 k from orders where o_orderstatus='P')
    select case when a.k is null then 'created' when b.k is null then 'kept' else 'updated' end "action", count(*) n_rows, sum(coalesce(b.k, a.k))::bigint keys,
     count(*) filter (b.k is not null) n_new from a full join b using (k) group by 1""".replace(", a as", "with a as", 1), base="",
)
def _(spark, d):
    folder = _folder(spark)
    files.write_keyed(read_table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("k"), F.col("c_name").alias("v")), folder, "k")
    incoming = read_table(spark, d, "orders").where("o_orderstatus = 'P'").select((F.col("o_custkey").cast("long") * 2).alias("k"), F.lit("new").alias("v"))
    counts = files.merge_keyed(spark, folder, incoming, "k")
    known = read_table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("k"), F.lit(True).alias("old"))
    now = spark.read.parquet(folder).join(known, "k", "left")
    new = F.col("v") == "new"
    told = now.groupBy(F.when(F.col("old").isNull(), "created").when(new, "updated").otherwise("kept").alias("action")).agg(
        F.sum("k").alias("keys"), F.count_if(new).alias("n_new")
    )
    return counts.where("action != 'rejected'").withColumnRenamed("rows", "n_rows").join(told, "action")
