"""The points of the price distribution are found once."""

import datetime

from salestide.operators import products as prd


def test_caps_and_points_share_one_pass_over_the_lines(spark):
    lines = [("p", f"c{i}", "FR", datetime.date(2024, 1 + i % 8, 3), 10 * (i + 1), 2.0) for i in range(16)]
    df = spark.createDataFrame(lines, "recipe_code string, client_id string, country string, invoice_date date, amount int, qty double")
    out = prd.price_distribution(df.selectExpr("* except(amount)", "cast(amount as decimal(18,2)) amount"))
    # the lines are behind a cut, for the points and for the caps alike
    assert "invoice_date" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r["client_id"]: (r["revenue"], r["price"], round(r["bubble"], 6)) for r in out.collect()}
    # months 3 to 8 are the last six: revenues 30 to 80 and 110 to 160
    assert sorted(v[0] for v in got.values()) == [*range(30, 90, 10), *range(110, 170, 10)]
    assert got["c2"] == (30.0, 15.0, 30.0) and got["c15"] == (160.0, 80.0, 157.8)
