"""Registered queries against their SQL on the smallest data."""

import os

import pytest

import __spark_entry__ as entry
from tests.check_oracles import compare, oracle_connection

FOLDER = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
# one or two per group; ``python tests/check_oracles.py`` runs all of them
CHOSEN = [
    "tsr_05_fiscal_quarter_share", "cln_24_pipeline", "per_05_available_periods", "pro_03_numeric_summary", "agg_05_pareto_curve",
    "agg_21_box_stats", "cor_05_product_spearman", "tsr_01_daily", "prd_02_product_ranking", "prd_18_price_impact", "cli_05_rfm_scores",
    "c36_19_kpi_pack", "geo_01_country_stats", "cur_12_report", "ano_05_top_anomalies", "beh_06_portfolio", "clu_02_client_features",
    "prj_03_training_samples", "txt_09_records", "rcp_02_search", "snk_04_merge_keyed", "src_06_read_sheets", "agg_27_qq_stated", "tsr_12_stl_stated",
]


@pytest.fixture(scope="module")
def con():
    return oracle_connection(FOLDER)


@pytest.mark.parametrize("name", CHOSEN)
def test_matches_sql(spark, con, name):
    result = compare(entry.queries()[name](spark, FOLDER), con, entry.oracle_sql()[name])
    assert result is None or result.startswith("~"), result


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
