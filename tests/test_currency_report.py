"""The currency report merges its lines by what its sums run over."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from salestide.operators import currency as cur


def test_report_keeps_no_row_per_client_and_month(spark, monkeypatch):
    rows = []
    for c in range(200):
        for m in range(12):
            code = ["EUR", "usd ", "JPY", None][c % 4]
            country = None if c % 7 == 0 else f"C{c % 3}"
            rows.append((code, Decimal(100 + 7 * c + m), None if c % 11 == 0 else f"n{c}", country, f"2024-{m + 1:02d}" if m else None))
    rows.append(("USD", Decimal(-5), "n1", "C1", "2024-02"))
    df = spark.createDataFrame(rows, "currency string, amount decimal(18,2), client_name string, country string, month string")
    kept = []
    whole = cur.durable
    monkeypatch.setattr(cur, "durable", lambda x: kept.append(whole(x)) or kept[-1])
    (got,) = cur.currency_report(df).collect()
    # 4 currencies x 4 countries x 12 months, the foreign clients, and none; not 2,400 rows
    assert kept[0].count() <= 4 * 4 * 12 + 200 + 4
    lines = cur.positive_lines(df)
    (want,) = cur.currency_kpis(lines).collect()
    assert all(got[c] == pytest.approx(want[c]) for c in want.asDict())
    assert got["hhi"] == pytest.approx(cur.currency_hhi(lines).first()[0])
    assert got["volatility"] == pytest.approx(cur.foreign_volatility(lines).first()[0])
    for column, entity in (("top5_clients_pct", "client_name"), ("top5_countries_pct", "country")):
        assert got[column] == pytest.approx(cur.top_foreign(lines, entity).agg(F.max("combined_pct")).first()[0])
