"""Plans of the dearer queries: how often they read, shuffle and order."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from salestide.operators import clean

FOLDER = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def count(pattern, text):
    return len(re.findall(pattern, text))


@pytest.mark.parametrize("name", ["geo_01_country_stats", "agg_10_describe_by_period", "agg_21_box_stats", "pro_03_numeric_summary"])
def test_quantiles_order_no_values(spark, name):
    assert "rangepartitioning" not in plan_of(entry.queries()[name](spark, FOLDER))


@pytest.mark.parametrize("name", ["beh_06_portfolio", "ano_04_scores"])
def test_medians_collect_one_frame(spark, name):
    plan = plan_of(entry.queries()[name](spark, FOLDER))
    assert "percentile(" not in plan and count(r"collect_list\(struct\(_v_", plan) <= 2 and count(r"collect_list\(struct\(_dev_", plan) <= 2


def test_reports_read_their_lines_once(spark):
    for name, scans in (("c36_19_kpi_pack", 0), ("cur_12_report", 0)):
        # lines and orders are tables of their own
        assert count("FileScan", plan_of(entry.queries()[name](spark, FOLDER))) == scans


def test_cleaning_reads_its_input_twice(spark, tmp_path):
    path = str(tmp_path / "raw")
    spark.createDataFrame([("13A", "A123", "01/02/2024", "1", "2", "2.0", "F", "x")], ["Cpt Client", "Code Artic", "Date Fact.", "Quantité", "Montant", "PU Net", "Famille", "Libelle 1"]).withColumns(
        {c: F.lit("01/02/2024") for c in ("Date Cde", "Date Exp.", "Delai Prev")}
    ).write.parquet(path)
    out = clean.clean(spark.read.parquet(path))
    # one scan made the table of articles; the result reads the input once more, and no line is shuffled
    assert count("FileScan", plan_of(out)) == 1 and count(r"(?<!Broadcast)Exchange (?:hash|range)", plan_of(out)) <= 2
    assert out.count() == 1


def test_shuffled_article_table_agrees(spark):
    rows = [(f"A{i % 7}", None if i % 5 == 0 else f"F{i % 3}", float(i % 4), i) for i in range(200)] + [(None, "F1", 2.0, 999), (None, None, None, 1000)]
    lines = spark.createDataFrame(rows, "article_code string, family string, unit_price double, n int").selectExpr("*", "cast(null as date) order_date", "concat('l', n % 9) label_1")
    table = clean.article_table(lines, lines["n"] >= 0)
    whole = sorted(map(str, clean.with_article_table(lines, table).collect()))
    assert len(whole) == 202 and sorted(map(str, clean.with_article_table(lines, table, most=3).collect())) == whole
