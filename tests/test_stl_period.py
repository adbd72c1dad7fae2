"""The registered decomposition queries leave the period to the operator."""

import pytest

from salestide.operators import anomaly
from salestide.plans import load_queries
from salestide.plans.registry import QUERIES


@pytest.mark.parametrize("name", ["ano_11_stl_anomalies", "ano_12_joint_days"])
def test_the_operator_decides(spark, monkeypatch, name):
    load_queries()
    periods, plain = [], anomaly.stl_anomalies

    def noted(days, value, keys, period=None, **options):
        periods.append(period)
        return plain(days, value, keys, period, **options)

    monkeypatch.setattr(anomaly, "stl_anomalies", noted)
    QUERIES[name](spark, "/root/testdata/sf0.001")
    assert periods and set(periods) == {None}
