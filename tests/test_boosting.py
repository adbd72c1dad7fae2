"""Quantile boosting: leaves, coverage, order of the quantiles, bounded tasks."""

import numpy as np
import pytest

from salestide.functions import boosting
from salestide.operators import forecast


def test_leaf_quantiles_are_numpys():
    rng = np.random.default_rng(1)
    leaf, values = rng.integers(0, 7, 500), rng.normal(size=500)
    for q in (0.1, 0.5, 0.9):
        got = boosting.leaf_quantiles(leaf, values, 9, q)
        assert np.allclose(got[:7], [np.quantile(values[leaf == i], q) for i in range(7)]) and (got[7:] == 0).all()


def test_a_tree_finds_the_best_split():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 4))
    above = x[:, 2] > 0.3
    edges = boosting.edges_of(x)
    cells = boosting.binned(x, edges)
    bins = max(len(e) for e in edges) + 1
    column, cut, leaf = boosting.grow_tree(cells, above, 0.5, 1, 5, bins)
    assert column[0] == 2 and (leaf == (x[:, 2] > edges[2][cut[0]])).all() and (leaf == above).all()


@pytest.mark.parametrize("q", [0.1, 0.5, 0.9])
def test_quantiles_cover_new_rows(q):
    rng = np.random.default_rng(3)
    x = rng.uniform(-2, 2, (6000, 3))
    y = x[:, 0] + (1 + np.abs(x[:, 1])) * rng.normal(size=6000)
    model = boosting.boost(x[:4000], y[:4000], q, 200, 5, 0.05, 5)
    assert model["leaf"].shape == (200, 32)
    below = (y[4000:] <= boosting.predict(model, x[4000:])).mean()
    assert abs(below - q) < 0.04
    # applied to its own rows the trees give what was fitted: pinball loss far under that of a constant
    loss = lambda p, t: np.maximum(q * (t - p), (q - 1) * (t - p)).mean()
    assert loss(boosting.predict(model, x[4000:]), y[4000:]) < 0.92 * loss(np.quantile(y[:4000], q), y[4000:])


def _samples(spark, n):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(n):
        f = rng.normal(size=len(forecast.FEATURES))
        known = [float(v) if rng.random() > 0.1 else None for v in f]
        for h in (3, 6):
            rows.append((f"c{i}", h, float(max(0.0, 50 + 10 * f[0] + h * rng.normal())), *known))
    return spark.createDataFrame(rows, "client_id string, horizon int, target double, " + ", ".join(f"{c} double" for c in forecast.FEATURES))


def test_forecast_in_buckets(spark, monkeypatch):
    monkeypatch.setattr(forecast, "BUCKET_ROWS", 200)
    samples = _samples(spark, 500)
    models, _ = forecast.fit_quantiles(samples, rounds=20)
    assert {k: len(v) for k, v in models.items()} == {(h, q): 3 for h in (3, 6) for q in forecast.QUANTILES}
    assert all(sum(m["rows"] for m in v) == 500 for v in models.values())
    got = forecast.model_forecast(samples, samples.drop("target"), rounds=20).collect()
    assert len(got) == 1000 and all(0 <= r.m10 <= r.m50 <= r.m90 for r in got)
    assert forecast.model_forecast(samples.limit(5), samples.drop("target"), rounds=2).count() == 0


def test_band_covers_held_out_clients(spark):
    for r in forecast.band_coverage(_samples(spark, 900), rounds=60).collect():
        assert abs(r.below_m10 - 0.1) < 0.08 and abs(r.below_m50 - 0.5) < 0.1 and abs(r.below_m90 - 0.9) < 0.08


def test_every_sample_is_in_the_fit(spark, monkeypatch):
    monkeypatch.setattr(forecast, "BUCKET_ROWS", 20)
    monkeypatch.setattr(forecast, "MOST_BUCKETS", 4)
    samples = _samples(spark, 500)
    models, _ = forecast.fit_quantiles(samples, rounds=3)
    # 500 samples over 80: the buckets' number and their size grow by the root of 6.25
    assert {k: len(v) for k, v in models.items()} == {(h, q): 10 for h in (3, 6) for q in forecast.QUANTILES}
    assert all(sum(m["rows"] for m in v) == 500 for v in models.values())
    got = forecast.model_forecast(samples, samples.drop("target"), rounds=3).collect()
    assert len(got) == 1000 and all(0 <= r.m10 <= r.m50 <= r.m90 for r in got)


def test_buckets_up_to_the_bound_are_of_one_size():
    most, rows = forecast.MOST_BUCKETS, forecast.BUCKET_ROWS
    assert forecast.buckets({3: most * rows, 6: 2 * rows + 1, 12: 20}) == {3: most, 6: 3, 12: 1}
    assert forecast.buckets({3: 100 * most * rows, 6: rows}) == {3: 10 * most, 6: 10 * most}
