"""Segments, windows and features on small series."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from kilohour.errors import ConflictingDuplicates, InsufficientHistory
from kilohour.operators import continuity, features, windows
from kilohour.operators.joins import net_load, net_load_report
from kilohour.series import SeriesSpec

SPEC = SeriesSpec(chunk_rows=16)


def gapped(spark, hours, removed=(), regions=("PJM",)):
    rows = [
        (r, (pd.Timestamp("2024-01-01") + pd.Timedelta(hours=i)).to_pydatetime(), 1000.0 + 100 * n + i)
        for n, r in enumerate(regions) for i in range(hours) if i not in removed
    ]
    return spark.createDataFrame(rows, "region string, timestamp_utc timestamp, demand_mw double")


def test_segments_split_at_the_gap(spark):
    rows, table = continuity.detect_segments(gapped(spark, 6, {2, 3}), SPEC)
    found = {r["region_segment_id"]: r for r in table.collect()}
    assert {k: v["row_count"] for k, v in found.items()} == {"PJM::0001": 2, "PJM::0002": 2}
    assert found["PJM::0002"]["missing_expected_hours_before"] == 2
    assert found["PJM::0002"]["gap_before_hours"] == 3.0
    assert rows.count() == 4


def test_half_hour_step_breaks_without_missing_hours(spark):
    extra = gapped(spark, 4).unionByName(
        spark.sql("SELECT 'PJM' region, timestamp'2024-01-01 01:30:00' timestamp_utc, 1D demand_mw")
    )
    table = continuity.detect_segments(extra, SPEC)[1].orderBy("segment_no").collect()
    assert [r["row_count"] for r in table] == [2, 1, 2]
    assert sum(r["missing_expected_hours_before"] for r in table) == 0


def test_duplicates_are_rejected(spark):
    df = gapped(spark, 3)
    with pytest.raises(ConflictingDuplicates):
        continuity.detect_segments(df.unionByName(df), SPEC)


def test_windows_avoid_the_gap(spark):
    df = gapped(spark, 201, {185}, ("PJM", "MISO"))
    chosen = windows.select_windows(df, horizon=4, windows=3, step_size=4, required_history=24, spec=SPEC)
    origins = [str(r["origin"]) for r in chosen.orderBy("validation_window").collect()]
    assert origins == ["2024-01-08 04:00:00", "2024-01-08 08:00:00", "2024-01-08 12:00:00"]
    audit = windows.window_audit(df, horizon=4, windows=3, step_size=4, required_history=24, spec=SPEC)
    assert audit.where("accepted").count() == 3
    reasons = [r["reason"] for r in audit.where("NOT accepted").collect()]
    assert reasons and all(r is not None for r in reasons)
    assert "MISO:insufficient_contiguous_history:1_missing_hours" in reasons


def test_too_few_windows_is_an_error(spark):
    with pytest.raises(InsufficientHistory):
        windows.select_windows(gapped(spark, 30), horizon=4, windows=9, step_size=4, required_history=10, spec=SPEC)


def test_future_values_never_change_earlier_features(spark):
    spec = features.FeatureSpec(lags=(1, 5), windows=(3,))
    df = gapped(spark, 60, {20}, ("A", "B"))
    changed = df.withColumn(
        "demand_mw", F.when(F.col("timestamp_utc") > "2024-01-02 12:00:00", 9e9).otherwise(F.col("demand_mw"))
    )
    cut = "timestamp_utc <= '2024-01-02 12:00:00'"
    one = features.training_matrix(df, spec, SPEC).where(cut).toPandas().sort_values(["region", "timestamp_utc"])
    two = features.training_matrix(changed.repartition(3), spec, SPEC).where(cut).toPandas().sort_values(["region", "timestamp_utc"])
    pd.testing.assert_frame_equal(one.reset_index(drop=True), two.reset_index(drop=True))


def test_lags_equal_pandas_within_segments(spark):
    df = gapped(spark, 80, {30, 31, 55})
    out = features.past_features(df, [("demand_mw", "d")], lags=[1, 7], windows=[4], spec=SPEC).toPandas()
    out = out.sort_values("timestamp_utc").reset_index(drop=True)
    part = (out["timestamp_utc"].diff() != pd.Timedelta(hours=1)).cumsum()
    grouped = out.groupby(part)["demand_mw"]
    pd.testing.assert_series_equal(out["d_lag_7"], grouped.shift(7), check_names=False)
    mean = grouped.transform(lambda s: s.shift(1).rolling(4, min_periods=4).mean())
    pd.testing.assert_series_equal(out["d_rolling_mean_4"], mean, check_names=False)
    std = grouped.transform(lambda s: s.shift(1).rolling(4, min_periods=4).std())
    pd.testing.assert_series_equal(out["d_rolling_std_4"], std, check_names=False)


def test_future_row_matches_training_row(spark):
    spec = features.FeatureSpec(lags=(1, 24), windows=(3, 24))
    df = gapped(spark, 49)
    at = F.lit("2024-01-03 00:00:00").cast("timestamp")
    ahead = features.future_rows(df, at, spec).first().asDict()
    row = features.training_matrix(df, spec, SPEC).where("timestamp_utc = '2024-01-03 00:00:00'").first().asDict()
    for name in spec.names:
        assert ahead[name] == pytest.approx(row[name]), name


def test_persistence_weather_shifts_inside_the_segment(spark):
    base = gapped(spark, 30, {26})
    cols = {c: F.col("demand_mw") for c in features.WEATHER_COLUMNS}
    hist = base.withColumns(cols).withColumn("weather_data_type", F.lit("historical")).drop("demand_mw")
    out = features.persistence_weather(hist, spec=SPEC).orderBy("timestamp_utc").collect()
    assert [str(r["timestamp_utc"])[8:13] for r in out] == ["02 00", "02 01"]
    assert {r["weather_data_type"] for r in out} == {"forecast"}
    assert out[0]["temperature_c"] == 1000.0


def test_net_load_needs_both_sides(spark):
    demand = gapped(spark, 3)
    renewable = gapped(spark, 4, {0}).select(
        "region", "timestamp_utc",
        F.when(F.hour("timestamp_utc") == 1, None).otherwise(F.lit(10.0)).alias("total_renewable_generation_mw"),
    )
    assert [r["net_load_mw"] for r in net_load(demand, renewable).collect()] == [992.0]
    assert tuple(net_load_report(demand, renewable).first()) == (3, 3, 2, 1, 3)
