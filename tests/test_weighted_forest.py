"""The forest over merged rows against the share of all rows."""

from pyspark.sql import functions as F

from salestide.operators.anomaly import forest_scores


def test_merged_rows_weigh_as_their_counts(spark):
    # a value of a third of the lines far from the others, which are distinct
    rows = [(float(i), 1) for i in range(2_000)] + [(50_000.0, 1_000)]
    merged = spark.createDataFrame(rows, "value double, rows long")
    got = forest_scores(merged, ["value"], ["value"], 0.05, weight="rows")
    flagged = got.where("is_anomaly").agg(F.sum("rows")).first()[0]
    assert flagged is not None and 0.03 * 3_000 <= flagged <= 0.06 * 3_000


def test_many_rows_in_one_value(spark):
    rows = [(float(i), 40) for i in range(2_000)] + [(50_000.0, 40_000)]
    got = forest_scores(spark.createDataFrame(rows, "value double, rows long"), ["value"], ["value"], 0.05, weight="rows")
    flagged = got.where("is_anomaly").agg(F.sum("rows")).first()[0]
    assert flagged is not None and 0.03 * 120_000 <= flagged <= 0.06 * 120_000
    assert not got.where("value = 50000").first()["is_anomaly"]
