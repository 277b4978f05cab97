"""Registered queries against DuckDB. All of them with KILOHOUR_ALL=1, otherwise a cross-section."""

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

from check import compare, connect  # noqa: E402

from kilohour.queries import ORACLES, QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"
SECTION = (
    "c1_segments", "c2_window_audit", "w3_segment_lags", "w9_prior_residual_window", "a2_pivot_measures",
    "a4_reconciliation", "a5_regional_weather", "j7_latest_forecast", "j8_interval_match", "d1_rule_detection",
    "d1h_solar_collapses", "e3_alert_second_batch", "m2_seasonal_naive", "a11_metric_slices", "b1_dispatch_inputs",
    "b3_physics_audit", "o5_latest_horizon", "s13_keyed_upsert", "a32_score_distribution",
)
NAMES = sorted(ORACLES) if os.environ.get("KILOHOUR_ALL") else SECTION


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, duck, name):
    text, _, good = compare(spark, duck, SF, name)
    assert good, text


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
