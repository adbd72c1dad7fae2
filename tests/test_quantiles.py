"""Exact percentiles against numpy, with ties, weights, nulls, skew, and bins that must be cut finer."""

import math
import random

import numpy as np
import pytest

from salestide.functions import quantiles
from salestide.operators import kpi

PS = {"p0": 0.0, "q1": 0.25, "mid": 0.5, "p90": 0.9, "p1": 1.0}


def check(rows, got, keys=True):
    groups = {}
    for k, x, w in rows:
        if x is not None:
            groups.setdefault(k if keys else None, []).extend([x] * w)
    assert len(got) == len(groups)
    for r in got:
        want = np.quantile(np.array(groups[r["k"] if keys else None]), list(PS.values()))
        assert all(math.isclose(r[n], x, rel_tol=1e-12, abs_tol=1e-300) for n, x in zip(PS, want)), (r, want)


def values(seed):
    rnd = random.Random(seed)
    kinds = [lambda: round(rnd.gauss(0, 100), 2), lambda: rnd.choice([0.0, 5.0, -5.0]), lambda: rnd.lognormvariate(0, 20), lambda: 1000 + rnd.random(), lambda: None]
    return [(rnd.choice(["a", "a", "a", "b", None, "c"]), rnd.choice(kinds)(), 1) for _ in range(6000)] + [("only null", None, 1), ("one", 7.5, 1)]


@pytest.mark.parametrize("inside", [1 << 16, 40])
def test_groups(spark, monkeypatch, inside):
    monkeypatch.setattr(quantiles, "MOST_INSIDE", inside)
    rows = values(1)
    df = spark.createDataFrame(rows, "k string, x double, w long")
    wanted = {n: ("x", p) for n, p in PS.items()}
    check(rows, quantiles.exact_quantiles(df, ["k"], wanted).collect())
    check(rows, quantiles.exact_quantiles(df, [], wanted).collect(), keys=False)


def test_many_keys_and_weights(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "_MOST_BROADCAST", 10)
    rnd = random.Random(2)
    rows = [(str(rnd.randrange(300)), float(rnd.randrange(50)), rnd.randrange(1, 5)) for _ in range(4000)]
    df = spark.createDataFrame(rows, "k string, x double, w long")
    check(rows, quantiles.exact_quantiles(df, ["k"], {n: ("x", p) for n, p in PS.items()}, "w").collect())


def test_several_columns_and_empty(spark):
    df = spark.createDataFrame([("a", 1.0, 4), ("a", None, 6), ("b", None, 2)], "k string, x double, y int")
    got = {r.k: (r.mx, r.my) for r in quantiles.exact_quantiles(df, ["k"], {"mx": ("x", 0.5), "my": ("y", 0.5)}).collect()}
    assert got == {"a": (1.0, 5.0), "b": (None, 2.0)}
    assert quantiles.exact_quantiles(df.where("k = 'z'"), ["k"], {"mx": ("x", 0.5)}).count() == 0


def test_no_range_exchange(spark):
    df = spark.range(1000).selectExpr("cast(id as double) x", "id % 7 k")
    plan = quantiles.exact_quantiles(df, ["k"], {"m": ("x", 0.5)})._jdf.queryExecution().toString()
    assert "rangepartitioning" not in plan


def test_one_value_on_all_rows_of_the_quantile_plot(spark, monkeypatch):
    monkeypatch.setattr(kpi, "QQ_RUN", 7)
    df = spark.range(100).selectExpr("cast(if(id < 95, 3, id) as double) x")
    got = sorted((r.i, r["sample"]) for r in kpi.qq_points(df, "x").collect())
    assert got == [(i + 1, 3.0 if i < 95 else float(i)) for i in range(100)]
