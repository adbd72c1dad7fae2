"""Total orders over large tables without a single-task window.

``globally_ranked`` sorts by range partitioning, pins the partitions with a
checkpoint, and then needs only the per-partition sizes and sums (as many rows
as there are partitions) to turn local positions into global ones.  No task
ever sees more than its own range, and a heavy sort value is split as long as
the sort columns form a total order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salestide.functions.quantiles import exact_quantiles
from salestide.session import durable

_POSITION_BITS = 33  # monotonically_increasing_id keeps the partition above this bit


def globally_ranked(
    df: DataFrame,
    order: list[Column],
    rank: str = "rank",
    running: dict[str, str] | None = None,
) -> DataFrame:
    """Add the 1-based global rank and, per ``running`` entry, a running sum.

    ``order`` must be a total order (end it with a unique key).  ``running``
    maps an output name to the numeric column that is summed up to the row.
    """
    running = running or {}
    pinned = durable(df.orderBy(*order)).withColumn("_id", F.monotonically_increasing_id())
    placed = pinned.withColumn(
        "_part", F.shiftright("_id", _POSITION_BITS).cast("int")
    ).withColumn("_pos", F.col("_id").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1)))

    # one row per partition: bounded by the number of partitions
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_part")
        .agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_s_{o}") for o, c in running.items()])
        .select(
            "_part",
            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"),
            *[F.sum(f"_s_{o}").over(before).alias(f"_base_{o}") for o in running],
        )
    )
    local = Window.partitionBy("_part").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    out = placed
    for o, c in running.items():
        out = out.withColumn(f"_run_{o}", F.sum(c).over(local))
    out = out.join(F.broadcast(offsets), "_part").withColumn(
        rank, (F.col("_base") + F.col("_pos") + 1).cast("long")
    )
    for o in running:
        base = F.coalesce(F.col(f"_base_{o}"), F.lit(0))
        out = out.withColumn(o, F.col(f"_run_{o}") + base)
    return out.select(*df.columns, rank, *running)


def quantile_bucket(rank: Column, n: Column, q: int = 5) -> Column:
    """Bucket 1..q of a unique rank, with the edges of a linear quantile cut."""
    q_eff = F.least(F.lit(q), n)
    return F.when(n < 2, F.lit(3)).otherwise(
        F.greatest(F.lit(1), F.ceil((rank - 1) * q_eff / (n - 1)))
    ).cast("int")


def exact_percentiles(
    df: DataFrame, keys: list[str], value: str, probs: dict[str, float], weight: str | None = None
) -> DataFrame:
    """Exact linear-interpolated percentiles of one column per key, as ``quantiles.exact_quantiles`` finds them.

    ``weight`` names a column of counts when the rows are already merged.
    """
    return exact_quantiles(df, keys, {name: (value, p) for name, p in probs.items()}, weight)


def average_ranks(df: DataFrame, groups: list[str], values: dict[str, str]) -> DataFrame:
    """``df`` with the rank of every value in its group, ties averaged, ``{column: name}``; null for null.

    Equal values of a group are counted first; the counts are ranged over the
    cluster, and a value's rank follows from what stands before it in the whole
    order and before its group.  No task holds a group.
    """
    columns = list(values)
    keys = [f"_g{i}" for i in range(len(groups))]
    sides = F.array(*[F.struct(F.lit(i).alias("_side"), F.col(c).cast("double").alias("_v")) for i, c in enumerate(columns)])
    long = df.select(*[F.col(g).alias(k) for g, k in zip(groups, keys)], F.inline(sides)).where("_v is not null")
    counts = long.groupBy(*keys, "_side", "_v").agg(F.count("*").alias("_c"))
    ranked = durable(globally_ranked(counts, [*[F.col(k) for k in keys], F.col("_side"), F.col("_v")], "_r", {"_cum": "_c"}))
    group = [*keys, "_side"]
    starts = ranked.groupBy(*[F.col(k).alias(f"{k}_s") for k in group]).agg(F.min(F.col("_cum") - F.col("_c")).alias("_before"))
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"{k}_s")) for k in group])
    ranks = durable(ranked.join(starts, same).select(*group, "_v", (F.col("_cum") - F.col("_before") - (F.col("_c") - 1) / 2.0).alias("_rank")))
    out = df
    for i, c in enumerate(columns):
        side = ranks.where(F.col("_side") == i).select(*[F.col(k).alias(f"{k}_{i}") for k in keys], F.col("_v").alias(f"_v_{i}"), F.col("_rank").alias(values[c]))
        condition = reduce(lambda x, y: x & y, [out[g].eqNullSafe(side[f"{k}_{i}"]) for g, k in zip(groups, keys)] + [F.col(c).cast("double") == F.col(f"_v_{i}")])
        out = out.join(side, condition, "left").drop(*[f"{k}_{i}" for k in keys], f"_v_{i}")
    return out


def day_percentiles(
    df: DataFrame, keys: list[str | Column], wanted: dict[str, tuple[str, float]]
) -> DataFrame:
    """Exact percentiles of day counts per key, ``{name: (column, p)}``.

    Day counts have few distinct values, so the state of a percentile (equal
    values counted) stays small however many lines a group has.  It is made
    before the shuffle, where one row per key and task carries the states of
    all columns.  A key without any value has no row.
    """
    columns = list(dict.fromkeys(c for c, _ in wanted.values()))
    names = [f"_k{i}" for i in range(len(keys))]
    labels = [k if isinstance(k, str) else f"k{i}" for i, k in enumerate(keys)]
    source = df.select(
        *[(F.col(k) if isinstance(k, str) else k).alias(n) for k, n in zip(keys, names)],
        *[F.col(c).cast("double").alias(f"_d{i}") for i, c in enumerate(columns)],
    ).where(F.coalesce(*[F.col(f"_d{i}") for i in range(len(columns))]).isNotNull())
    picks = [F.percentile(f"_d{columns.index(c)}", F.lit(p)).alias(n) for n, (c, p) in wanted.items()]
    return source.groupBy(*names).agg(*picks).select(*[F.col(n).alias(k) for n, k in zip(names, labels)], *wanted)
