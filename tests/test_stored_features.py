"""Monthly features are stored by client, and nothing wide is kept of them."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from salestide.operators import forecast
from salestide.session import stored_by
from tests.test_one_pass_scores import lines, plan


def test_stored_rows_stay_with_their_key(spark):
    df = lines(spark)
    kept = stored_by(df, "client_id")
    out = kept.withColumn("n", F.count("*").over(Window.partitionBy("client_id").orderBy("invoice_date")))
    assert "Exchange" not in plan(out) and sorted(kept.collect()) == sorted(df.collect())


def test_fitted_keeps_no_wide_rows(spark, monkeypatch):
    widths = []
    durable = forecast.durable
    monkeypatch.setattr(forecast, "durable", lambda df: widths.append((len(df.columns), df.count())) or durable(df))
    matrix, latest, model = forecast.fitted(lines(spark, 8, 30), rounds=2)
    assert matrix.count() == 240 and latest.count() == 24 and model.count() == 24
    # the newest rows are as wide as the features, but few; nothing as long as the months or the samples is kept
    assert all(n <= 24 for wide, n in widths if wide > 5), widths
