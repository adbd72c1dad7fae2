"""Decomposition of short series by matrix products, and quantile points dealt over tasks."""

import numpy as np
from pyspark.sql import functions as F

from salestide.functions import loess
from salestide.operators import kpi


def test_matrix_form_equals_neighbour_form(monkeypatch):
    rng = np.random.default_rng(5)
    for n in (18, 25, 40):
        y = np.abs(rng.normal(size=(12, n))) * 1000
        y[0], y[1], y[2, :] = 0.0, 5.0, 0.0
        y[2, 5], y[3:6, rng.integers(0, n, 8)] = 1e6, 0.0
        short = loess.decompose_rows(y, 12)
        with monkeypatch.context() as m:
            # a series counted as long takes its neighbours row by row
            m.setattr(loess, "_SHORT", 0)
            plain = loess.decompose_rows(y, 12)
        for a, b in zip(short, plain):
            assert np.allclose(a, b, rtol=1e-9, atol=1e-6)


def test_short_series_need_no_neighbour_rows(monkeypatch):
    def refuse(*_):
        raise AssertionError("neighbours gathered")

    monkeypatch.setattr(loess, "_moving", refuse)
    loess._low_pass.cache_clear()
    known = loess._plain_factors(36, 13)
    monkeypatch.setattr(loess, "_low_pass", lambda n, period, span: np.zeros((n + 2 * period, n)))
    assert known[0].shape[0] == 36
    trend, season, resid = loess.decompose_rows(np.abs(np.random.default_rng(1).normal(size=(3, 36))), 12)
    assert trend.shape == season.shape == resid.shape == (3, 36)


def test_quantile_points_of_few_values_are_made_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(kpi, "QQ_RUN", 100)
    df = spark.range(5000).select((F.col("id") % 3).alias("x"))
    points = kpi.qq_points(df, "x")
    sizes = [r["n"] for r in points.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 5000 and max(sizes) < 2500
    assert sorted(r["i"] for r in points.select("i").collect()) == list(range(1, 5001))
