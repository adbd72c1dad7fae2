"""Percentiles of day counts: one row per key and task is shuffled."""

import re

import numpy as np
import pytest

from salestide.functions.ordering import day_percentiles


def test_one_shuffle_and_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(f"k{i % 5}" if i % 13 else None, int(a) if i % 7 else None, int(b) if i % 5 else None) for i, (a, b) in enumerate(rng.integers(-20, 90, (600, 2)))]
    rows.append(("empty", None, None))
    df = spark.createDataFrame(rows, "key string, a int, b int").repartition(3)
    out = day_percentiles(df, ["key"], {"mid": ("a", 0.5), "high": ("b", 0.9), "low": ("a", 0.1)})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1 and "Expand" not in plan
    got = {r["key"]: (r["mid"], r["high"], r["low"]) for r in out.collect()}
    assert set(got) == {r[0] for r in rows} - {"empty"}
    for key, found in got.items():
        a = [x for k, x, _ in rows if k == key and x is not None]
        b = [x for k, _, x in rows if k == key and x is not None]
        for value, values, p in zip(found, (a, b, a), (50, 90, 10)):
            assert (value is None and not values) or value == pytest.approx(np.percentile(values, p))
