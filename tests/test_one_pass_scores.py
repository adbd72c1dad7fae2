"""Scores and CUSUM in one sorted pass, against plain recomputation, and how often rows travel for them."""

import datetime
import random
import statistics
from decimal import Decimal

import pytest

from salestide.functions.robust import with_cusum, with_robust_z
from salestide.operators import behaviour, forecast


def plain_scores(own, window, least, strict):
    med = [statistics.median(k) if len(k := [x for x in own[max(0, t - window) : t] if x is not None]) >= least else None for t in range(len(own))]
    dev = [abs(own[t - 1] - med[t]) if t and own[t - 1] is not None and med[t] is not None else None for t in range(len(own))]
    found = []
    for t, v in enumerate(own):
        known = [x for x in dev[max(0, t - window + 1) : t + 1] if x is not None]
        mad = statistics.median(known) if len(known) >= least else None
        gap = v - med[t] if v is not None and med[t] is not None else None
        sign = None if gap is None else (gap > 0) * 999.0 - (gap < 0) * 999.0
        if mad:
            found.append(None if gap is None else gap * 0.6745 / mad)
        else:
            found.append(sign if mad == 0 or not strict else None)
            if not strict and sign is None:
                found[-1] = -999.0
    return found


def plain_cusum(z):
    pos, neg, found = 0.0, 0.0, []
    for t, x in enumerate(z):
        pos, neg = (max(0.0, pos + (x or 0.0) - 0.5), max(0.0, neg - (x or 0.0) - 0.5)) if t else (0.0, 0.0)
        found.append((pos, neg))
    return found


@pytest.mark.parametrize("strict", [True, False])
@pytest.mark.parametrize("batch", [7, 10000])
def test_scores_of_keys_that_span_batches(spark, strict, batch):
    rng = random.Random(5)
    own = {k: [None if rng.random() < 0.15 else float(rng.randint(-3, 3)) for _ in range(n)] for k, n in {"a": 40, "b": 1, "c": 25, "d": 7, None: 9}.items()}
    rows = [(k, t, v, Decimal(t)) for k, vs in own.items() for t, v in enumerate(vs)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, t int, v double, more decimal(18,2)")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        out = with_robust_z(df, ["v"], ["k"], "t", 6, 3, strict, cusum="v").collect()
        again = {(r["k"], r["t"]): r for r in with_cusum(df, "v", ["k"], "t").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(out) == len(rows) and all(r["more"] == r["t"] for r in out)
    got = {(r["k"], r["t"]): r for r in out}
    for k, vs in own.items():
        z = plain_scores(vs, 6, 3, strict)
        for t, (s, (pos, neg), (pos_v, neg_v)) in enumerate(zip(z, plain_cusum(z), plain_cusum(vs))):
            assert got[k, t]["z_v"] == (None if s is None else pytest.approx(s))
            assert (got[k, t]["cusum_pos"], got[k, t]["cusum_neg"]) == (pytest.approx(pos), pytest.approx(neg))
            assert (again[k, t]["cusum_pos"], again[k, t]["cusum_neg"]) == (pytest.approx(pos_v), pytest.approx(neg_v))


def test_no_rows_give_no_scores(spark):
    assert with_robust_z(spark.createDataFrame([], "k string, t int, v double"), ["v"], ["k"], "t", 6, 3, cusum="v").count() == 0


def lines(spark, clients=4, months=20):
    rng = random.Random(6)
    rows = [
        (f"c{c}", datetime.date(2022 + m // 12, m % 12 + 1, rng.randint(1, 28)), Decimal(rng.randint(1, 500)), float(rng.randint(1, 9)), f"o{c}-{m}-{i // 2}", rng.choice("ABC"))
        for c in range(clients) for m in range(months) for i in range(rng.randint(1, 4))
    ]
    return spark.createDataFrame(rows, "client_id string, invoice_date date, amount decimal(18,2), qty double, order_id string, family string")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("make", [behaviour.with_scores, behaviour.with_alerts, behaviour.portfolio, behaviour.attribution, behaviour.client_history])
def test_lines_and_months_travel_once_each(spark, make):
    found = plan(make(behaviour.monthly_features(lines(spark))))
    assert found.count("Exchange hashpartitioning") == 2 and "Expand" not in found


def test_features_shuffle_lines_and_months_only(spark):
    found = plan(forecast.with_features(forecast.monthly_matrix(lines(spark))))
    assert found.count("Exchange hashpartitioning") == 2 and "Expand" not in found
