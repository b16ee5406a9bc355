"""The registered queries against their SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as contract
from workload.check import compare, database
from workload.duckdb_sql import ORACLES
from workload.spark_queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
# the rest runs with `python -m workload.check`
QUICK = ["parse_air_quality", "scan_recent", "backfill_chunks", "join_match_report",
         "dedup_keep_last", "normalize_timestamp", "aqi_sub_indices", "aqi_dominant",
         "aqi_category", "pollutant_breakdown", "ewma", "feature_build", "feature_build_time",
         "eda_describe", "eda_corr_matrix", "resample_weekly", "category_distribution",
         "outlier_summary", "time_split", "regression_metrics", "forecast_alerts",
         "current_conditions", "upsert_features", "stream_daily_mean", "payload_rejects",
         "source_fallback", "store_overview", "scan_recent_stored", "stream_corrected_mean", "gbt_stump",
         "model_fallback", "report_by_rule", "ridge_pair", "importance_pair", "forecast_pair",
         "feature_columns"]

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")


def test_contract():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    fits = {"ridge_fit", "forest_fit", "gbt_fit", "model_selection", "feature_importance",
            "model_report", "forecast"}
    assert set(QUERIES) - set(ORACLES) == fits
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLES) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", QUICK)
def test_equals_sql(spark, name):
    df = contract.queries()[name](spark, FOLDER)
    assert compare(df, database(FOLDER), contract.oracle_sql()[name]).startswith("ok")


def test_flagship(spark):
    assert len(contract.entry(spark).columns) == 109
