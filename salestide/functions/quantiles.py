"""Exact percentiles of many variables at once, without ordering all values.

A first scan counts values by coarse bin: sign and a 64th of an octave.  The
counts of a group are its rank sketch; they add up, so they are merged before
the shuffle, and their running total tells which few bins hold the wanted
ranks.  A second scan keeps the values of those bins only, equal ones merged.
Bins that still hold many different values are cut finer, between their least
and their greatest value, until each fits one window.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salestide.session import durable

#: bins per doubling of a value
_PER_OCTAVE = 64
_BEYOND = 1 << 17
#: different values of a bin that one window orders
MOST_INSIDE = 1 << 16
_CUTS = 1 << 12
#: rows of a broadcast table of bins, some 60 bytes each
_MOST_BROADCAST = 500_000


def _coarse(v: Column) -> Column:
    """Bin of a value: never smaller for a larger value; infinite values and NaN have bins of their own."""
    octave = F.floor(F.log2(F.abs(v)) * _PER_OCTAVE)
    size = F.when(F.abs(v) == float("inf"), F.lit(_BEYOND)).otherwise(octave) + _BEYOND
    return F.when(F.isnan(v), F.lit(4 * _BEYOND)).when(v == 0, F.lit(0)).when(v > 0, size).otherwise(-size).cast("long")


def _places(wanted: list[tuple[str, int, float]], var: Column, n: Column) -> Column:
    """The ranks from 0 on that the percentiles of a variable need."""
    by_var: dict[int, set[float]] = {}
    for _, at, p in wanted:
        by_var.setdefault(at, set()).add(float(p))
    found = F.lit(None)
    for at, ps in by_var.items():
        ranks = [f(F.lit(p) * (n - 1)).cast("long") for p in sorted(ps) for f in (F.floor, F.ceil)]
        found = F.when(var == at, F.array(*ranks)).otherwise(found)
    return found


def _holds(wanted: list[tuple[str, int, float]], before: Column, own: Column) -> Column:
    places = _places(wanted, F.col("_var"), F.col("_n"))
    return F.exists(places, lambda x: (x >= before) & (x < before + own))


def _cut(inside: DataFrame, keys: list[str], wanted: list[tuple[str, int, float]]) -> DataFrame:
    """``inside`` with bins of too many values cut to the parts that hold wanted ranks."""
    group = [*keys, "_var", "_bin"]
    span = inside.groupBy(*group).agg(F.count(F.lit(1)).alias("_many"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    large = durable(span.where((F.col("_many") > MOST_INSIDE) & (F.col("_low") < F.col("_high"))))
    renamed = large.select(*[F.col(c).alias(f"{c}_") for c in group], "_low", "_high")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in group])
    # at most one row per MOST_INSIDE values
    placed = inside.join(F.broadcast(renamed), same, "left").withColumn(
        "_part", F.when(F.col("_low").isNotNull(), F.least(F.floor((F.col("_v") - F.col("_low")) / (F.col("_high") - F.col("_low")) * _CUTS), F.lit(_CUTS - 1)))
    ).drop(*renamed.columns)
    placed = durable(placed)
    parts = placed.where("_part is not null").groupBy(*group, "_part", "_before", "_n").agg(F.sum("_c").alias("_own"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ranked = parts.withColumn("_start", F.col("_before") + F.coalesce(F.sum("_own").over(earlier), F.lit(0)))
    kept = ranked.where(_holds(wanted, F.col("_start"), F.col("_own"))).select(*[F.col(c).alias(f"{c}_") for c in group], F.col("_part").alias("_part_"), "_start")
    same = same & (F.col("_part") == F.col("_part_"))
    finer = placed.where("_part is not null").join(F.broadcast(kept), same).select(
        *keys, "_var", F.xxhash64("_bin", "_part").alias("_bin"), F.col("_start").alias("_before"), "_n", "_v", "_c"
    )
    return durable(placed.where("_part is null").drop("_part").unionByName(finer))


def exact_quantiles(df: DataFrame, keys: list[str], wanted: dict[str, tuple[str, float]], weight: str | None = None) -> DataFrame:
    """(keys, names): exact percentiles with linear interpolation per key, ``{name: (column, p)}``.

    Nulls are left out; a key has a row if any of its columns has a value, and
    null for the others.  ``weight`` names a column that tells how many rows a
    row stands for.  ``df`` is read twice.
    """
    columns = list(dict.fromkeys(c for c, _ in wanted.values()))
    asked = [(name, columns.index(c), p) for name, (c, p) in wanted.items()]
    inner = [f"_k{i}" for i in range(len(keys))]
    values = F.array(*[F.struct(F.lit(i).alias("_var"), F.col(c).cast("double").alias("_v")) for i, c in enumerate(columns)])
    count = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    named = df.select(*[F.col(k).alias(n) for k, n in zip(keys, inner)], count.alias("_c"), values.alias("_values"))
    long = named.select(*inner, "_c", F.inline("_values")).where("_v is not null").withColumn("_bin", _coarse(F.col("_v")))

    bins = long.groupBy(*inner, "_var", "_bin").agg(F.sum("_c").alias("_own"))
    whole = Window.partitionBy(*inner, "_var")
    earlier = whole.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    ranked = bins.withColumns({"_n": F.sum("_own").over(whole), "_before": F.coalesce(F.sum("_own").over(earlier), F.lit(0))})
    kept = durable(ranked.where(_holds(asked, F.col("_before"), F.col("_own"))).select(
        *[F.col(c).alias(f"{c}_") for c in (*inner, "_var", "_bin")], "_before", "_n"
    ))
    if kept.count() <= _MOST_BROADCAST:
        side = F.broadcast(kept)
    else:
        # many keys: equal values are merged before they travel
        side, long = kept, long.groupBy(*inner, "_var", "_bin", "_v").agg(F.sum("_c").alias("_c"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in (*inner, "_var", "_bin")])
    group = [*inner, "_var", "_bin"]
    inside = durable(long.join(side, same).groupBy(*group, "_before", "_n", "_v").agg(F.sum("_c").alias("_c")))
    crowded = F.count(F.lit(1)) > MOST_INSIDE
    while not inside.groupBy(*group).agg(crowded.alias("x"), (F.min("_v") < F.max("_v")).alias("y")).where("x and y").isEmpty():
        inside = _cut(inside, inner, asked)

    up_to = Window.partitionBy(*group).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    last = F.col("_last")
    at = inside.withColumn("_last", F.col("_before") + F.sum("_c").over(up_to) - 1)
    picks = []
    for name, var, p in asked:
        place = F.lit(float(p)) * (F.col("_n") - 1)
        here = lambda rank, var=var: F.max(F.when((F.col("_var") == var) & rank.cast("long").between(last - F.col("_c") + 1, last), F.col("_v")))
        low, high = here(F.floor(place)), here(F.ceil(place))
        part = F.max(F.when(F.col("_var") == var, place - F.floor(place)))
        picks.append((low + (high - low) * part).alias(name))
    return at.groupBy(*inner).agg(*picks).select(*[F.col(n).alias(k) for n, k in zip(inner, keys)], *wanted)
