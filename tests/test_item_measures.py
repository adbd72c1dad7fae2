"""Measures per item: sums and percentiles do not pass through the groups of the distinct counts."""

import re
from decimal import Decimal

import numpy as np
import pytest

from salestide.operators import products as prd


def test_sums_and_states_travel_once(spark):
    rng = np.random.default_rng(8)
    rows = [
        (f"p{i % 7}" if i % 50 else None, Decimal(int(a)), float(q) if i % 9 else None, f"o{i // 3}", f"c{i % 11}" if i % 6 else None, int(a) % 60 if i % 4 else None, int(q) - 5 if i % 5 else None)
        for i, (a, q) in enumerate(rng.integers(1, 100, (500, 2)))
    ] + [("none", None, None, None, None, None, None)]
    names = ["item_code", "amount", "qty", "order_id", "client_id", "lead_time_days", "lead_time_deviation"]
    df = spark.createDataFrame(rows, "item_code string, amount decimal(18,2), qty double, order_id string, client_id string, lead_time_days int, lead_time_deviation int")
    out = prd.item_stats(df.repartition(3), "item_code")
    (expand,) = re.findall(r"Expand \[([^\n]*)\]", out._jdf.queryExecution().optimizedPlan().toString())
    assert "amount" not in expand and "lead_time" not in expand
    got = {r["item"]: r for r in out.collect()}
    assert set(got) == {r[0] for r in rows} - {None}
    for item, r in got.items():
        own = [dict(zip(names, x)) for x in rows if x[0] == item]
        some = lambda c: [x[c] for x in own if x[c] is not None]
        assert r["revenue"] == sum(map(float, some("amount"))) and r["qty"] == sum(some("qty"))
        assert r["orders"] == len(set(some("order_id"))) and r["clients"] == len(set(some("client_id")))
        assert r["late_pct"] == pytest.approx(100 * sum(x > 0 for x in some("lead_time_deviation")) / len(own))
        for c, n, p in (("lead_time_days", "median_lead_time", 50), ("lead_time_deviation", "p90_deviation", 90)):
            assert r[n] == (pytest.approx(np.percentile(some(c), p)) if some(c) else None)
        assert r["price"] == (pytest.approx(r["revenue"] / r["qty"]) if r["qty"] > 0 else None)
