"""Null-safe arithmetic shared by all operators.

Money is carried as ``decimal(18,2)``, so totals do not depend on the order
in which partitions are merged; ratios are computed on doubles.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def total(c: str | Column) -> Column:
    """Sum as double, 0 when every value is null."""
    return F.coalesce(F.sum(col(c)).cast("double"), F.lit(0.0))


def mean(c: str | Column) -> Column:
    """Mean as (order-independent) total over count, null on no values."""
    return F.try_divide(F.sum(col(c)).cast("double"), F.count(col(c)).cast("double"))


def ratio(num: str | Column, den: str | Column) -> Column:
    """num / den as double, null when the denominator is 0 or null."""
    return F.try_divide(col(num).cast("double"), col(den).cast("double"))


def pct(num: str | Column, den: str | Column) -> Column:
    return ratio(num, den) * 100.0


def ratio_or_zero(num: str | Column, den: str | Column) -> Column:
    return F.coalesce(ratio(num, den), F.lit(0.0))


def weighted_price() -> Column:
    """Quantity-weighted unit price over lines with a price and a positive quantity."""
    ok = F.col("unit_price").isNotNull() & (F.col("qty") > 0)
    return ratio(
        F.sum(F.when(ok, F.col("unit_price") * F.col("qty"))), F.sum(F.when(ok, F.col("qty")))
    )


def revenue_per_unit(revenue: str | Column = "revenue", qty: str | Column = "qty") -> Column:
    """revenue / qty, null unless the quantity is positive."""
    return F.when(col(qty) > 0, ratio(revenue, qty))


def safe_corr(a: str | Column, b: str | Column) -> Column:
    """Pearson correlation over pairwise complete rows, null for a constant side."""
    a, b = col(a).cast("double"), col(b).cast("double")
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    # the minimum and maximum tell a constant side exactly; its spread may not be exactly 0
    varied = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    return F.when(varied, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def banded(value: Column, bands: list[tuple[float, str]], otherwise: str, op: str = "ge") -> Column:
    """First label whose bound the value reaches (``ge``), exceeds (``gt``) or stays under (``le``)."""
    tests = {"ge": lambda b: value >= b, "gt": lambda b: value > b, "le": lambda b: value <= b}
    test = tests[op]
    out = F
    for bound, label in bands:
        out = out.when(test(bound), F.lit(label))
    return out.otherwise(F.lit(otherwise))


def minmax(value: Column, low: Column, high: Column) -> Column:
    """Scale to 0..1; a constant column gives 0.5."""
    return F.when(high == low, F.lit(0.5)).otherwise(ratio(value - low, high - low))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)
