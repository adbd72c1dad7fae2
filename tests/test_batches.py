"""Kernels that take many clients at once: each as if it stood alone, and no Python group per client."""

import math

import numpy as np
import pytest

import __spark_entry__ as entry
from salestide.functions import isolation, loess
from salestide.operators import anomaly, forecast

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["ano_07_client_forest", "prj_05_stl_forecast", "prj_12_simple_projection"])
def test_no_python_group_per_client(spark, name):
    plan = entry.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan


def test_rows_are_decomposed_as_alone(monkeypatch):
    rng = np.random.default_rng(5)
    y = rng.gamma(2, 100, (7, 31))
    y[2], y[4] = 3.0, np.arange(31)
    monkeypatch.setattr(loess, "_CELLS", 31 * 23 * 3)
    got = loess.decompose_rows(y, 12)
    for i, row in enumerate(y):
        assert all(np.allclose(a[i], b, rtol=0, atol=1e-9) for a, b in zip(got, loess.decompose(row, 12)))
    assert np.allclose(sum(got), y)


def plain_scores(points, trees=100, seed=42):
    """All trees of one set, sorted by node anew on every level."""
    n, dims = points.shape
    rng = np.random.default_rng(seed)
    x, group, depth = np.tile(points, (trees, 1)), np.repeat(np.arange(trees), n), np.zeros(trees * n)
    for _ in range(math.ceil(math.log2(max(n, 2)))):
        ids, node = np.unique(group, return_inverse=True)
        low = np.array([x[node == g].min(axis=0) for g in range(len(ids))])
        high = np.array([x[node == g].max(axis=0) for g in range(len(ids))])
        usable = high > low
        if not usable.any():
            break
        feature = np.argmax(np.where(usable, rng.random(usable.shape), -1.0), axis=1)
        at = np.arange(len(ids))
        cut = low[at, feature] + rng.random(len(ids)) * (high[at, feature] - low[at, feature])
        moves = usable.any(axis=1)[node]
        right = x[np.arange(len(x)), feature[node]] > cut[node]
        depth += moves
        group = 2 * node + (moves & right)
    _, where, count = np.unique(group, return_inverse=True, return_counts=True)
    depth += isolation.expected_depth(count)[where]
    return 2.0 ** (-depth.reshape(trees, n).mean(axis=0) / (float(isolation.expected_depth(n)) or 1.0))


@pytest.mark.parametrize("n", [1, 2, 5, 13])
def test_sets_are_scored_as_alone(monkeypatch, n):
    rng = np.random.default_rng(n)
    sets = rng.integers(0, 6, (6, n, 3)).astype(float)
    sets[0], sets[1, :, 1] = 4.0, np.nan
    monkeypatch.setattr(isolation, "_ROWS", 20 * n * 4)
    got = isolation.own_scores_each(sets, 20)
    assert np.array_equal(got, [plain_scores(points, 20) for points in sets])


def test_clients_of_one_period_and_lines_without_client(spark):
    rows = [(c, f"2023-{m:02d}-03", 10.0 * m + k, float(m), f"o{k}") for c, months in (("a", 12), ("b", 1), (None, 9)) for m in range(1, months + 1) for k in range(2)]
    lines = spark.createDataFrame(rows, "client_id string, d string, amount double, qty double, order_id string").selectExpr(
        "client_id", "to_date(d) invoice_date", "cast(amount as decimal(18,2)) amount", "qty", "order_id")
    got = anomaly.client_forest(lines).collect()
    assert {c: sum(r.client_id == c for r in got) for c in ("a", "b", None)} == {"a": 12, "b": 1, None: 9}
    assert all(r.score_ml == 0 and not r.is_anomaly_ml for r in got if r.client_id == "b")
    assert all(r.score_ml > 0 for r in got if r.client_id != "b") and any(r.is_anomaly_ml for r in got if r.client_id == "a")


def test_forecast_of_series_of_several_lengths(spark):
    rng = np.random.default_rng(9)
    known = {c: rng.gamma(2, 100, n) for c, n in (("a", 18), ("b", 30), ("c", 30), ("d", 17))}
    rows = [(c, 202001 + 100 * (i // 12) + i % 12, float(v)) for c, y in known.items() for i, v in reversed(list(enumerate(y)))]
    got = {(r.client_id, r.horizon): r for r in forecast.stl_forecast(spark.createDataFrame(rows, "client_id string, period_index int, ca double")).collect()}
    assert set(got) == {(c, h) for c in "abc" for h in forecast.HORIZONS}
    for (c, h), r in got.items():
        y = known[c]
        trend, season, resid = loess.decompose(y, 12)
        slope, start = np.polyfit(np.arange(6.0), trend[-6:], 1)
        assert abs(r.stl - max(0.0, start + slope * (5 + h) + season[len(y) - 12 + (h - 1) % 12])) < 1e-6
        assert abs(r.spread - resid.std(ddof=1) * math.sqrt(h)) < 1e-6
