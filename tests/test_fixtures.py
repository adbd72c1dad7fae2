"""Small hand-built cases: money repair, calendar, robust scores, text, kernels, skew."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from salestide.functions import calendar as cal
from salestide.functions.isolation import anomaly_score, grow_forest, own_scores
from salestide.functions.keywords import keywords
from salestide.functions.loess import adf_statistic, decompose, kpss_statistic
from salestide.functions.ordering import day_percentiles, exact_percentiles, globally_ranked, quantile_bucket
from salestide.functions.robust import with_cusum, with_robust_z
from salestide.operators import clean, cluster, text
from salestide.sources import files


def test_country_prefixes(spark):
    df = spark.createDataFrame([("13RLCA",), ("IENEWY",), ("ZZ001",), (None,)], "c string")
    assert [r[0] for r in df.select(clean.country_of(F.col("c"))).collect()] == ["FR", "IE", "Unknown", "Unknown"]


def test_recipe_code(spark):
    df = spark.createDataFrame([("BX L123T456",), ("L123",), ("abc",), (None,)], "c string")
    assert [r[0] for r in df.select(clean.recipe_code(F.col("c"))).collect()] == ["T456", "L123", None, None]


def test_money_repair(spark):
    rows = [
        ("a", -5.0, 50.0, 10.0), ("b", 5.0, -50.0, 10.0), ("c", 5.0, 50.0, -10.0), ("d", -5.0, -50.0, 10.0),
        ("e", 10.0, 100.0, None), ("f", 10.0, 0.1, 10.0), ("g", None, 100.0, 10.0), ("h", 0.0, 0.0, 10.0),
    ]
    df = spark.createDataFrame(rows, "k string, qty double, amount double, unit_price double").withColumn("reference_price", F.lit(10.0))
    out = df
    for step in (clean.repair_negatives, clean.drop_negatives, clean.settle_price, clean.settle_amount, clean.settle_quantity):
        out = out.transform(step)
    got = {r["k"]: (r["qty"], r["amount"], r["unit_price"]) for r in out.collect()}
    assert got == {
        "a": (5.0, 50.0, 10.0), "b": (5.0, 50.0, 10.0), "c": (5.0, 50.0, 10.0), "e": (10.0, 100.0, 10.0),
        "f": (10.0, 100.0, 10.0), "g": (10.0, 100.0, 10.0), "h": (0.0, 0.0, 10.0),
    }


def test_fiscal_calendar(spark):
    days = ["2024-03-31", "2024-04-01", "2024-12-31", "2025-02-01"]
    df = spark.createDataFrame([(dt.date.fromisoformat(d),) for d in days], "invoice_date date")
    got = cal.with_fiscal_calendar(df).orderBy("invoice_date").collect()
    assert [r["fiscal_quarter_code"] for r in got] == ["2024Q4", "2025Q1", "2025Q3", "2025Q4"]
    assert got[1]["fiscal_quarter_label"] == "Q1 (Avr-Juin) FY2025"


def test_open_days_with_closure(spark):
    c = cal.open_days(F.lit("2024-07-01").cast("date"), F.lit("2024-09-30").cast("date"), [("2024-08-01", "2024-08-26")])
    assert spark.range(1).select(c).first()[0] == 48


@pytest.mark.parametrize(
    "strict, expected",
    [(False, [-999, -999, -999, 999, -999, 0.45, -0.34, 3.37, -1.01]), (True, [None] * 5 + [0.45, -0.34, 3.37, -1.01])],
)
def test_robust_z(spark, strict, expected):
    df = spark.createDataFrame([("k", i, float(v)) for i, v in enumerate([10, 12, 11, 13, 9, 12, 11, 14, 10])], "k string, t int, v double")
    out = with_robust_z(df, ["v"], ["k"], "t", 6, 3, strict).orderBy("t").collect()
    assert [None if r["z_v"] is None else round(r["z_v"], 2) for r in out] == expected


def test_cusum_equals_recursion(spark):
    rng = np.random.default_rng(1)
    z = [None if i % 7 == 3 else float(x) for i, x in enumerate(rng.normal(size=40))]
    df = spark.createDataFrame([("k", i, v) for i, v in enumerate(z)], "k string, t int, z double")
    got = with_cusum(df, "z", ["k"], "t").orderBy("t").collect()
    pos = neg = 0.0
    for i, r in enumerate(got):
        if i:
            pos, neg = max(0.0, pos + (z[i] or 0.0) - 0.5), max(0.0, neg - (z[i] or 0.0) - 0.5)
        assert r["cusum_pos"] == pytest.approx(pos) and r["cusum_neg"] == pytest.approx(neg)


def test_global_rank_with_heavy_tie(spark):
    df = spark.range(5000).select(F.col("id"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 11).alias("v"))
    got = globally_ranked(df, [F.desc("v"), F.asc("id")], "r", {"run": "v"}).orderBy("r").collect()
    want = sorted([(r["v"], r["id"]) for r in df.collect()], key=lambda t: (-t[0], t[1]))
    assert [r["id"] for r in got] == [i for _, i in want]
    assert [r["run"] for r in got] == list(np.cumsum([v for v, _ in want]))


def test_percentiles_with_heavy_key(spark):
    rng = np.random.default_rng(2)
    rows = [("hot" if i % 3 else f"k{i % 20}", float(np.round(v, 2))) for i, v in enumerate(rng.gamma(2, 50, 3000))]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: (r["a"], r["b"]) for r in exact_percentiles(df, ["k"], "v", {"a": 0.5, "b": 0.9}).collect()}
    days = {r["k"]: (r["a"], r["b"]) for r in day_percentiles(df, ["k"], {"a": ("v", 0.5), "b": ("v", 0.9)}).collect()}
    for k in {r[0] for r in rows}:
        values = [v for key, v in rows if key == k]
        assert got[k] == pytest.approx((np.percentile(values, 50), np.percentile(values, 90)))
        assert days[k] == pytest.approx(got[k])


@pytest.mark.parametrize("n", [1, 2, 3, 7, 12, 101])
def test_quantile_buckets(spark, n):
    import pandas as pd

    got = [r[0] for r in spark.range(1, n + 1).select(quantile_bucket(F.col("id"), F.lit(n))).collect()]
    want = [3] if n < 2 else list(pd.qcut(pd.Series(range(1, n + 1)), min(5, n), labels=False) + 1)
    assert sorted(got) == want


def test_decomposition_adds_up_and_resists_an_outlier():
    n = 96
    t = np.arange(n)
    y = 0.5 * t + 10 * np.sin(2 * np.pi * t / 12) + np.random.default_rng(5).normal(scale=0.3, size=n)
    y[40] += 60
    trend, season, resid = decompose(y, 12)
    assert np.allclose(trend + season + resid, y)
    assert resid[40] > 55 and np.abs(np.delete(resid, 40)).max() < 2


def test_stationarity_statistics():
    rng = np.random.default_rng(3)
    noise, walk = rng.normal(size=400), np.cumsum(rng.normal(size=400))
    assert adf_statistic(noise)[0] < -2.87 < adf_statistic(walk)[0]
    assert kpss_statistic(noise)[0] < 0.463 < kpss_statistic(walk)[0]


def test_forests_find_the_outlier():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 3))
    x[17] = 9
    forest, size = grow_forest(x)
    assert anomaly_score(x, forest, size).argmax() == own_scores(x).argmax() == 17


def test_matching_is_optimal():
    a = [np.array([float(i), 0.0]) for i in range(4)]
    assert cluster.matching(a, [a[2], a[0], a[3], a[1]]) == [2, 0, 3, 1]


def test_keywords():
    # the percent rule wants a word right behind the sign, so "2% salt" loses only its number
    assert keywords("Milk proteins (soy lecithin, 2% salt); Sugars and sugar, cocoa (powder (fat reduced)) 3 g") == [
        "Milk proteins", "soy lecithin", "% salt", "Sugars", "cocoa", "fat reduced", "powder",
    ]


def test_portion(spark):
    df = spark.createDataFrame([("x 3 g\nServing size : 1 packet = 2 wafers : 40,4 g.\n9 g",), ("about 12 g here",), ("none",)], "t string")
    assert [r[0] for r in df.select(text.portion_size(F.col("t"))).collect()] == ["40.4 g", "12 g", ""]


def test_missing_year_is_an_error(spark):
    df = spark.createDataFrame([(dt.date(2025, 1, 5), "c")], "order_date date, client_id string")
    with pytest.raises(ValueError, match="2024"):
        cluster.year_lines(df, 2024)


def test_files_round_trip(spark, tmp_path):
    rows = [("C1", "B1", "10"), ("C2", "B2", "20"), (None, None, "30")]
    df = spark.createDataFrame(rows, "`Cpt Client` string, `N° Bon` string, `Montant` string")
    files.export_csv(files.drop_footer(df), str(tmp_path / "csv"))
    back = files.read_lines(spark, str(tmp_path / "csv"))
    assert sorted(tuple(r) for r in back.collect()) == sorted(rows[:2])
    assert files.read_yearly(spark, str(tmp_path / "csv")).count() == 2
    assert files.processed_name("raw_upload.xls") == "raw_upload.xlsx"
    clean_lines = spark.createDataFrame([(2024, "c1", 1.0), (2025, "c2", 2.0)], "fiscal_year int, client_id string, amount double")
    files.write_clean(clean_lines, str(tmp_path / "clean"))
    assert spark.read.parquet(str(tmp_path / "clean")).where("fiscal_year = 2025").count() == 1
    files.write_table(clean_lines, str(tmp_path / "all.parquet"))
    assert files.read_lines(spark, str(tmp_path / "all.parquet")).count() == 2


def test_read_sheets(spark, tmp_path):
    folder = tmp_path / "a" / "b"
    folder.mkdir(parents=True)
    (folder / "one.txt").write_text("page one\fpage two")
    got = files.read_sheets(spark, str(tmp_path)).orderBy("page").collect()
    assert [(r["page"], r["text"]) for r in got] == [(1, "page one"), (2, "page two")]


def test_dates_in_all_shapes(spark):
    from salestide.operators.clean import parse_date, unparsed_dates

    texts = ["5/3/2024", "05.03.2024", "05/03/24", "2024-03-05T10:00:00", "2024-03-05 00:00:00.123", "05/03/2024 10:00", "2024-03-05", "05-03-2024"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {str(r.d) for r in rows.select(parse_date(F.col("t")).alias("d")).collect()} == {"2024-03-05"}
    bad = spark.createDataFrame([(t,) for t in ("31/02/2024", "xx", "2024-13-01", "1/2", None, "")], "t string")
    assert {r.d for r in bad.select(parse_date(F.col("t")).alias("d")).collect()} == {None}
    told = unparsed_dates(bad.withColumnRenamed("t", "Date Fact.")).collect()
    assert ("invoice_date", 4, 4) in [tuple(r) for r in told]


def test_yearly_files_with_other_header_order(spark, tmp_path):
    from salestide.sources import files

    (tmp_path / "sales 2023.csv").write_text("Cpt Client,Montant,N° Bon\n20,1.5,a\n")
    (tmp_path / "sales 2024.csv").write_text("N° Bon,Cpt Client,Montant,Extra\nb,21,2.5,x\n")
    got = files.read_yearly(spark, str(tmp_path)).select("source_file", "Cpt Client", "Montant", "N° Bon", "Extra").collect()
    assert sorted(map(tuple, got)) == [("sales%202023.csv", "20", "1.5", "a", None), ("sales%202024.csv", "21", "2.5", "b", "x")] or sorted(
        map(tuple, got)
    ) == [("sales 2023.csv", "20", "1.5", "a", None), ("sales 2024.csv", "21", "2.5", "b", "x")]


def test_upsert_rejects_rows_without_a_key(spark):
    from salestide.sources import files

    now = spark.createDataFrame([("a", 1)], "product_id string, v int")
    new = spark.createDataFrame([("a", 2), (None, 3), (None, 4), ("b", 5)], "product_id string, v int")
    counts = {r.action: r["rows"] for r in files.upsert_counts(files.upsert(now, new), new).collect()}
    assert counts == {"updated": 1, "created": 1, "rejected": 2}


def test_blank_orders_have_one_key_in_every_branch(spark):
    from salestide.operators.client360 import with_order_key

    rows = spark.range(100).selectExpr("'c' client_id", "'' order_id", "id amount")
    one, two = with_order_key(rows.repartition(7)), with_order_key(rows.repartition(3))
    assert one.join(two, ["order_key", "amount"]).count() == 100
