"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from salestide.session import shared_base

# a word: a run of anything but blank, tab, line feed, vertical tab, form feed and carriage return
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def packed(df: DataFrame) -> Column:
    """All columns of ``df`` as one struct, so that names of an operator's own columns can't clash with them."""
    return F.struct(*[df[f"`{c}`"] for c in df.columns])


def content_key(*columns: Column) -> Column:
    """64 bits that stand for a row's identity and text; nulls count as values of their own."""
    return F.xxhash64(*[x for c in columns for x in (c.isNull(), c)])


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share."""
    return f"{shared_base(spark)}/table-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: a lineage cut that is smaller than a checkpoint."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# a key row takes some 50 bytes in a hash table, so that a broadcast side stays under 64 MB
MOST_BROADCAST_KEYS = 1_000_000


def row_key(df: DataFrame) -> Column:
    """Key of a whole row."""
    return content_key(*[df[f"`{c}`"] for c in df.columns])


def rows_without(docs: DataFrame, key: str, own: Column, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose (``key``, ``own``) is not in ``gone`` (doc, row_key), a durable table.

    Few keys are broadcast, after a count; more are joined by a shuffle.
    """
    side = F.broadcast(gone) if gone.count() <= MOST_BROADCAST_KEYS else gone
    rows = docs.select(packed(docs).alias("row"), F.col(key).alias("own_doc"), own.alias("own_key"))
    return rows.join(side, rows["own_doc"].eqNullSafe(side["doc"]) & (rows["own_key"] == side["row_key"]), "left_anti").select("row.*")
