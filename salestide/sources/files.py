"""Readers, writers and the keyed merge."""

from __future__ import annotations

import csv
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from salestide.session import durable
from salestide.sources.schema import CLEAN_COLUMNS

#: folders of a table that is merged by key
BUCKETS = 64


def all_strings(names: list[str]) -> StructType:
    return StructType([StructField(n, StringType()) for n in names])


def _header(spark: SparkSession, path: str, sep: str) -> list[str]:
    return spark.read.options(header=True, sep=sep).csv(path).columns


def _layouts(spark: SparkSession, folder: str, pattern: str) -> dict[tuple[str, ...], list[str]]:
    """Files below a folder by their header, from one pass over the first block of every file.

    Only headers and paths reach the driver.
    """
    lines = spark.read.option("pathGlobFilter", pattern).text(folder).where(F.col("_metadata.file_block_start") == 0)
    # a block is read by one task in order, so its first line has the smallest number
    first = lines.select(F.col("_metadata.file_path").alias("path"), "value", F.monotonically_increasing_id().alias("at"))
    headers = first.groupBy("path").agg(F.min_by("value", "at").alias("header"))
    found: dict[tuple[str, ...], list[str]] = {}
    for r in headers.groupBy("header").agg(F.collect_list("path").alias("paths")).collect():
        names = next(csv.reader([r["header"].lstrip("\ufeff")]))
        found.setdefault(tuple(names), []).extend(unquote(p) for p in sorted(r["paths"]))
    return found


def read_lines(
    spark: SparkSession, path: str, names: list[str] | None = None, sep: str = ","
) -> DataFrame:
    """Invoice lines from one CSV or Parquet path, chosen by suffix, as strings.

    CSV is never type-inferred; types are decided by the cleaning step.  In a
    folder, a file whose header differs from the first one's is an error.
    """
    if path.rstrip("/").endswith(".parquet"):
        df = spark.read.parquet(path)
        return df.select([F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])
    schema = all_strings(names or _header(spark, path, sep))
    return spark.read.schema(schema).options(header=True, sep=sep, multiLine=False, enforceSchema=names is not None).csv(path)


def read_yearly(
    spark: SparkSession, folder: str, pattern: str = "*.csv", headers: list[list[str]] | None = None
) -> DataFrame:
    """Stack all files of a folder whose name matches ``pattern``, column by column name.

    The headers of all files are read in one job; files of one layout are one
    scan, and layouts are joined by name, absent columns null.  Pass
    (pattern, names) pairs in ``headers`` for files without a usable header.
    """
    if headers:
        found = [(names, spark.read.schema(all_strings(names)).option("pathGlobFilter", glob).options(header=True).csv(folder)) for glob, names in headers]
    else:
        layouts = _layouts(spark, folder, pattern)
        found = [(names, spark.read.schema(all_strings(list(names))).options(header=True).csv(paths)) for names, paths in sorted(layouts.items())]
    parts = [df.withColumn("source_file", F.col("_metadata.file_name")) for _, df in found]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def drop_footer(df: DataFrame, client: str = "Cpt Client", order: str = "N° Bon") -> DataFrame:
    """Drop the totals rows of a sheet: they carry neither client nor order."""
    blank = lambda c: F.coalesce(F.trim(F.col(f"`{c}`")), F.lit("")) == ""
    return df.where(~(blank(client) & blank(order)))


def processed_name(name: str) -> str:
    """Output name of a processed input: legacy ``.xls`` becomes ``.xlsx``."""
    return name + "x" if name.lower().endswith(".xls") else name


def write_clean(df: DataFrame, path: str) -> None:
    """Cleaned lines as Parquet, one folder per fiscal year, clients clustered in the files."""
    columns = [c for c in CLEAN_COLUMNS if c in df.columns]
    (
        df.select(*columns)
        .repartitionByRange("fiscal_year", "client_id")
        .sortWithinPartitions("fiscal_year", "client_id")
        .write.mode("overwrite")
        .partitionBy("fiscal_year")
        .parquet(path)
    )


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_sheets(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    """Sheet texts below ``folder``: (source_file, page, text), form feeds part the pages."""
    return (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .text(folder, wholetext=True)
        .select(
            F.col("_metadata.file_name").alias("source_file"),
            F.posexplode(F.split("value", "\f")).alias("pos", "text"),
        )
        .select("source_file", (F.col("pos") + 1).alias("page"), "text")
    )


def upsert(
    current: DataFrame, incoming: DataFrame, key: str = "product_id", newest: Column | None = None
) -> DataFrame:
    """Merge ``incoming`` into ``current``: the incoming row wins, ``action`` tells what happened.

    ``newest`` picks between several incoming rows of one key (largest wins);
    the pick is a partial aggregate, so a key with many copies does not gather
    in one task.  Incoming rows without a key are left out; ``upsert_counts``
    tells how many.
    """
    value_cols = [c for c in current.columns if c != key]
    order = newest if newest is not None else F.struct(*value_cols)
    latest = (
        incoming.where(F.col(key).isNotNull()).groupBy(key)
        .agg(F.max_by(F.struct(*value_cols), order).alias("_new"))
    )
    old = current.select(F.col(key), F.struct(*value_cols).alias("_old"))
    merged = old.join(latest, key, "full_outer")
    action = (
        F.when(F.col("_old").isNull(), "created")
        .when(F.col("_new").isNotNull(), "updated")
        .otherwise("kept")
    )
    return merged.select(
        key,
        *[F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(f"_old.{c}")).alias(c)
          for c in value_cols],
        action.alias("action"),
    )


def upsert_counts(merged: DataFrame, incoming: DataFrame | None = None, key: str = "product_id") -> DataFrame:
    """Rows per action; with ``incoming`` also those rejected for want of a key."""
    counts = merged.groupBy("action").agg(F.count("*").alias("rows"))
    if incoming is None:
        return counts
    return counts.union(incoming.agg(F.lit("rejected").alias("action"), F.count_if(F.col(key).isNull()).alias("rows")))


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")


def write_keyed(df: DataFrame, path: str, key: str = "product_id", buckets: int = BUCKETS) -> None:
    """A table that ``merge_keyed`` can update: Parquet, one folder per bucket of the key."""
    df.withColumn("bucket", _bucket(key, buckets)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


def read_keyed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("bucket")


def merge_keyed(
    spark: SparkSession, path: str, incoming: DataFrame, key: str = "product_id", newest: Column | None = None, buckets: int = BUCKETS
) -> DataFrame:
    """Merge ``incoming`` into the table of ``write_keyed`` by copy on write; returns the counts of ``upsert_counts``.

    Only buckets that hold an incoming key are read whole and replaced; of the
    others the rows are counted.  Buckets are replaced at the end of the job, so
    a job that fails leaves the table as it was, and one that is run again
    gives the same table.
    """
    given = durable(incoming.withColumn("bucket", _bucket(key, buckets)))
    # at most ``buckets`` numbers
    touched = sorted(r["bucket"] for r in given.where(F.col(key).isNotNull()).select("bucket").distinct().collect())
    table = spark.read.parquet(path)
    current = table.where(F.col("bucket").isin(touched))
    merged = durable(upsert(current.drop("bucket"), given.drop("bucket"), key, newest))
    replaced = merged.drop("action").withColumn("bucket", _bucket(key, buckets)).repartition("bucket")
    others = durable(table.where(~F.col("bucket").isin(touched)).agg(F.count("*").alias("rows")))
    counts = durable(upsert_counts(merged, given, key))
    if touched:
        replaced.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    kept = others.where("rows > 0").select(F.lit("kept").alias("action"), "rows")
    return counts.unionByName(kept).groupBy("action").agg(F.sum("rows").alias("rows"))
