"""Sorted tables whose neighbours and running totals need no task larger than one range of the sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salestide.session import durable

# monotonically_increasing_id keeps the partition above this bit
_POSITION_BITS = 33


def ranged(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df`` sorted over the cluster and pinned, with ``_part`` (number of the range) and ``_at`` (place in it)."""
    pinned = durable(df.orderBy(*order)).withColumn("_id", F.monotonically_increasing_id())
    return pinned.withColumn("_part", F.shiftright("_id", _POSITION_BITS)).withColumn("_at", F.col("_id").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1))).drop("_id")


def _earlier(totals: DataFrame, folds: dict[str, Column], *keys: str) -> DataFrame:
    """``totals`` by (keys, _part) folded over the parts before; a row per part, so the window is small."""
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*keys, "_part", *[fold.over(before).alias(f"_before_{name}") for name, fold in folds.items()])


def numbered(sorted_rows: DataFrame, name: str) -> DataFrame:
    """``sorted_rows`` of ``ranged`` with their place from 0 in the whole order."""
    sizes = sorted_rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    base = _earlier(sizes, {"n": F.sum("_n")})
    # bounded: one row per range
    return sorted_rows.join(F.broadcast(base), "_part").withColumn(name, F.coalesce("_before_n", F.lit(0)) + F.col("_at")).drop("_before_n")


def running(df: DataFrame, segment: str, order: list[Column], values: dict[str, tuple[str, str]]) -> DataFrame:
    """``df`` with running totals inside every ``segment``, in ``order``: ``{name: (column, "sum" or "xor")}``.

    A segment that fills several ranges of the sort is totalled range by range,
    and only what stands before each range is carried on.
    """
    fold = {"sum": F.sum, "xor": F.bit_xor}
    rows = ranged(df, [F.col(segment), *order])
    # only the first segment of a range can have begun earlier
    edges = rows.groupBy("_part").agg(F.array_distinct(F.array(F.min(segment), F.max(segment))).alias("both")).select("_part", F.explode("both").alias(segment))
    totals = rows.join(F.broadcast(edges), ["_part", segment]).groupBy("_part", segment).agg(*[fold[kind](column).alias(f"_{name}") for name, (column, kind) in values.items()])
    carried = _earlier(totals, {name: fold[kind](f"_{name}") for name, (_, kind) in values.items()}, segment)
    here = Window.partitionBy("_part", segment).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    for name, (column, kind) in values.items():
        rows = rows.withColumn(f"_own_{name}", fold[kind](column).over(here))
    rows = rows.join(F.broadcast(carried), ["_part", segment], "left")
    joined = {"sum": lambda x, y: x + y, "xor": lambda x, y: x.bitwiseXOR(y)}
    found = [joined[kind](F.coalesce(f"_before_{name}", F.lit(0)), F.col(f"_own_{name}")).alias(name) for name, (_, kind) in values.items()]
    return rows.select(*[f"`{c}`" for c in df.columns], *found)


def prefix_sums(df: DataFrame, place: str, values: list[str], bits: int = 16) -> DataFrame:
    """``df`` with ``<value>_to``, the sum up to the row, for rows that have every ``place`` from 0 on once.

    Places are cut into blocks of ``2 ** bits``; one row per block is totalled
    in one task.
    """
    blocked = df.withColumn("_block", F.shiftright(place, bits))
    totals = blocked.groupBy("_block").agg(*[F.sum(v).alias(f"_{v}") for v in values])
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("_block", *[F.coalesce(F.sum(f"_{v}").over(before), F.lit(0)).alias(f"_before_{v}") for v in values])
    here = Window.partitionBy("_block").orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    local = blocked.select("*", *[F.sum(v).over(here).alias(f"_own_{v}") for v in values])
    return local.join(base, "_block").select(*[f"`{c}`" for c in df.columns], *[(F.col(f"_before_{v}") + F.col(f"_own_{v}")).alias(f"{v}_to") for v in values])
