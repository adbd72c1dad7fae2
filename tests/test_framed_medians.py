"""Framed medians and monthly features against plain recomputation, and how their plans run."""

import datetime
import random
import statistics

from pyspark.sql import Window

from salestide.functions.robust import with_framed_medians
from salestide.operators.behaviour import monthly_features


def test_medians_equal_plain_ones_without_a_list_per_row(spark):
    rng = random.Random(3)
    rows = [(k, t, *[None if rng.random() < 0.2 else float(rng.randint(-9, 9)) for _ in range(2)]) for k in "ab" for t in range(30)]
    df = spark.createDataFrame(rows, "k string, t int, u double, v double")
    out = with_framed_medians(df, {"u": "mu", "v": "mv"}, Window.partitionBy("k").orderBy("t"), -6, -1, 3)
    assert "collect_list" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {(r["k"], r["t"]): r for r in out.collect()}
    for key in "ab":
        own = [r for r in rows if r[0] == key]
        for t in range(30):
            for i, name in ((2, "mu"), (3, "mv")):
                known = [r[i] for r in own[max(0, t - 6) : t] if r[i] is not None]
                assert got[key, t][name] == (statistics.median(known) if len(known) >= 3 else None)


def test_monthly_features_read_the_lines_once(spark):
    day = datetime.date
    lines = [
        ("c", day(2024, 1, 2), 10, 1.0, "o1", "A"), ("c", day(2024, 1, 2), 30, 2.0, "o1", "B"), ("c", day(2024, 1, 9), 20, None, "o2", None),
        ("c", day(2024, 2, 1), -5, 1.0, None, "A"), ("d", None, 10, 1.0, "o3", "A"), (None, day(2024, 1, 2), 10, 1.0, "o4", "A"),
        ("e", day(2024, 1, 2), None, 1.0, "o5", "A"), ("f", day(2024, 3, 2), 8, 0.0, "o6", None),
    ]
    df = spark.createDataFrame(lines, "client_id string, invoice_date date, amount int, qty double, order_id string, family string")
    out = monthly_features(df.selectExpr("* except(amount)", "cast(amount as decimal(18,2)) amount"))
    got = {(r["client_id"], r["period"]): r.asDict() for r in out.collect()}
    assert set(got) == {("c", "2024-01"), ("c", "2024-02"), ("f", "2024-03")}
    one = got["c", "2024-01"]
    assert (one["ca"], one["qty"], one["nb_orders"], one["active_days"], one["pu"], one["nb_families"], one["hhi"]) == (60.0, 3.0, 2, 2, 20.0, 2, 6250.0)
    assert (got["c", "2024-02"]["nb_orders"], got["c", "2024-02"]["hhi"]) == (0, 10000.0)
    assert (got["f", "2024-03"]["pu"], got["f", "2024-03"]["nb_families"], got["f", "2024-03"]["hhi"]) == (None, None, None)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
