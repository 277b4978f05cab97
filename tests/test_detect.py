"""Rules, residuals, ensemble, alerts and label scoring."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kilohour import contracts
from kilohour.errors import ContractViolation, NotFound
from kilohour.operators import alerts, backtest, ensemble, residuals
from kilohour.operators.events import event, to_events
from kilohour.operators.rules import Rules

START = pd.Timestamp("2024-01-01")


def at(text):
    return F.lit(text).cast("timestamp")


def hour(i):
    return (START + pd.Timedelta(hours=i)).to_pydatetime()


def rule_rows(spark):
    values = [100.0, 180.0, -1.0, 105.0, 105.0, 105.0, 105.0, None, 110.0, 112.0, 113.0, 114.0]
    rows = [("A", hour(i), v, 150.0 if i == 9 else 50.0, i) for i, v in enumerate(values) if i != 8]
    rows.append(("A", hour(3), 105.0, 50.0, 20))
    return spark.createDataFrame(rows, "region string, timestamp_utc timestamp, demand_mw double, relative_humidity_pct double, seq long")


def test_every_rule_fires_once_per_cause(spark):
    rules = Rules("demand_mw", at("2024-01-03"), chunk_rows=5, sequence="seq")
    empty = spark.createDataFrame([], "region string, timestamp_utc timestamp")
    events = contracts.anomaly_events().enforce(rules.detect(rule_rows(spark), weather=empty, renewables=empty))
    found = {}
    for r in events.collect():
        found.setdefault(r["anomaly_type"], []).append(int((r["timestamp_utc"] - START).total_seconds() // 3600))
    assert sorted(found.pop("weather_grid_mismatch")) == sorted(found.pop("coverage_mismatch")) == [0, 1, 2, 3, 4, 5, 6, 7, 9, 10, 11]
    assert {k: sorted(v) for k, v in found.items()} == {
        "duplicate_timestamp": [3], "non_monotonic_timestamp": [3], "unexpected_frequency": [9], "missing_timestamp": [8],
        "invalid_value": [2, 7, 9], "demand_spike": [1, 3], "demand_drop": [2], "flatline": [6], "stale_observation": [11],
    }


def test_rules_do_not_depend_on_partitioning_or_other_regions(spark):
    rows = rule_rows(spark)
    other = rows.withColumn("region", F.lit("B")).withColumn("demand_mw", F.col("demand_mw") * 3)
    rules = Rules("demand_mw", at("2024-01-03"), chunk_rows=3, sequence="seq")
    alone = {r["anomaly_id"] for r in rules.detect(rows).collect()}
    both = {r["anomaly_id"] for r in rules.detect(rows.unionByName(other).repartition(7)).where("region = 'A'").collect()}
    assert alone == both


def test_solar_collapse_keeps_its_anchor(spark):
    values = [300, 400, 150, 160, 390, 400, 100, 380, 0, 0]
    rad = [200] * 8 + [0, 0]
    rows = spark.createDataFrame(
        [("A", hour(8 + i), float(v), float(r)) for i, (v, r) in enumerate(zip(values, rad))],
        "region string, timestamp_utc timestamp, solar_generation_mw double, shortwave_radiation_wm2 double",
    )
    rules = Rules("solar_generation_mw", at("2024-01-02"), chunk_rows=4)
    out = rules.solar_collapses(rules.unique_rows(rows)).collect()
    assert [(r["timestamp_utc"], r["observed_value"], r["expected_value"]) for r in out] == [(hour(10), 150.0, 400.0)]
    # A one-hour dip is too short; the night is not a collapse.


def residual_input(spark, n=40):
    actuals = spark.createDataFrame([("A", hour(i), 100.0) for i in range(n)], "region string, timestamp_utc timestamp, demand_mw double")
    wanted = [(-2, -1, 1, 2)[i % 4] for i in range(n - 1)] + [50]
    rows = [
        ("A", "demand_mw", hour(i - back), hour(i), 1, 100.0 - r + back - 1, m, "1", "run", "none", hour(0))
        for i, r in enumerate(wanted) for back, m in ((1, "new"), (2, "old"))
    ]
    schema = "region string, target string, forecast_origin timestamp, timestamp_utc timestamp, forecast_step int, predicted_value double, model_name string, model_version string, run_id string, weather_mode string, created_at_utc timestamp"
    return actuals, spark.createDataFrame(rows, schema)


def test_residual_scores_use_the_past_only(spark):
    actuals, forecasts = residual_input(spark)
    settings = residuals.ResidualSettings(min_history=12, window=24)
    events, scored = residuals.detect_residuals(actuals, forecasts, "demand_mw", at("2024-02-01"), settings=settings, chunk_rows=7)
    rows = scored.toPandas().sort_values("timestamp_utc").reset_index(drop=True)
    assert (rows["history_rows"] < 12).sum() == 12
    for i in (0, 1, 2, 11, 30, 39):
        past = rows["residual"][max(0, i - 24) : i]
        if len(past):
            assert rows["rolling_residual_mean"][i] == pytest.approx(past.mean())
            assert rows["prior_residual_median"][i] == pytest.approx(past.median())
            assert rows["prior_residual_mad"][i] == pytest.approx((past - past.median()).abs().median())
    last = contracts.anomaly_events().enforce(events).orderBy(F.desc("timestamp_utc")).first()
    assert last["anomaly_type"] == "unexpected_demand_spike" and last["severity"] == "critical"
    assert rows["residual_zscore"].iloc[-1] > 4


def test_infinite_scores_stay_usable(spark):
    actuals, forecasts = residual_input(spark)
    flat = forecasts.withColumn("predicted_value", F.when(F.col("timestamp_utc") == F.lit(hour(39)), 90.0).otherwise(100.0))
    settings = residuals.ResidualSettings(min_history=12, window=24)
    events, scored = residuals.detect_residuals(actuals, flat, "demand_mw", at("2024-02-01"), settings=settings)
    only = contracts.anomaly_events().enforce(events).collect()
    assert [(r["anomaly_score"], r["severity"]) for r in only] == [(100.0, "critical")]
    assert '"zscore":null' in only[0]["feature_summary"]
    assert np.isinf(scored.agg(F.max("residual_mad_score")).first()[0])


def made_events(spark, rows):
    """(region, hour, detector, kind, severity, score) to events."""
    base = spark.createDataFrame([(r, hour(h), d, k, s, float(x)) for r, h, d, k, s, x in rows], "region string, timestamp_utc timestamp, d string, k string, s string, x double")
    parts = []
    for detector in sorted({r[2] for r in rows}):
        body = event(kind=F.col("k"), score=F.col("x"), severity=F.col("s"), explanation=F.concat(F.lit("e"), F.hour("timestamp_utc")))
        part = base.where(F.col("d") == detector)
        stamped = to_events(part, F.array(body), target="demand_mw", detector=detector, detected_at=at("2024-01-05"))
        parts.append(stamped)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def test_ensemble_votes_and_overrides(spark):
    rows = [
        ("A", 0, "rules", "flatline", "warning", 50), ("A", 0, "residual", "forecast_residual", "critical", 80),
        ("A", 1, "isolation_forest", "multivariate_outlier", "info", 20),
        ("A", 2, "isolation_forest", "multivariate_outlier", "warning", 60),
        ("A", 3, "rules", "stale_observation", "warning", 10), ("A", 3, "residual", "forecast_residual", "warning", 12),
    ]
    out = {r["timestamp_utc"].hour: r for r in ensemble.combine(made_events(spark, rows), at("2024-01-05")).collect()}
    assert (out[0]["severity"], out[0]["anomaly_type"]) == ("critical", "forecast_residual")
    assert out[1]["severity"] == "info" and out[1]["anomaly_score"] <= 29
    assert out[2]["severity"] == "warning" and out[2]["anomaly_score"] <= 69
    assert out[3]["severity"] == "warning"
    contracts.anomaly_events().enforce(ensemble.combine(made_events(spark, rows), at("2024-01-05")))


def test_alert_lifecycle_and_replay(spark):
    events = made_events(spark, [("A", 0, "rules", "flatline", "warning", 50), ("A", 2, "rules", "flatline", "critical", 80)])
    first = alerts.process_events(events)
    row = contracts.alerts().enforce(first.alerts).collect()
    assert [(r["occurrence_count"], r["severity"], r["title"], r["summary"]) for r in row] == [(2, "critical", "Critical flatline in A", "e2")]
    assert tuple(alerts.outcome_counts(first.outcomes).first()) == (1, 1, 0)
    again = alerts.process_events(events, first.alerts, first.history)
    assert tuple(alerts.outcome_counts(again.outcomes).first()) == (0, 0, 2)
    assert again.alerts.count() == 0 and again.history.count() == 0


def test_alert_gap_of_exactly_six_hours_joins_and_late_events_open(spark):
    rows = [("A", h, "rules", "flatline", "warning", 50) for h in (10, 16, 23)]
    state = alerts.process_events(made_events(spark, rows))
    assert sorted(r["occurrence_count"] for r in state.alerts.collect()) == [1, 2]
    late = alerts.process_events(made_events(spark, [("A", 8, "rules", "flatline", "warning", 50)]), state.alerts, state.history)
    assert [r["outcome"] for r in late.outcomes.collect()] == ["opened"]


def test_batches_equal_one_batch(spark):
    hours = [0, 1, 5, 6, 13, 20, 21, 40, 46, 53]
    rows = [("A", h, "rules", "flatline", "critical" if h == 20 else "warning", 50) for h in hours]
    events = made_events(spark, rows)
    whole = alerts.process_events(events, chunk_hours=8)
    cut = "timestamp_utc <= '2024-01-01 20:00:00'"
    one = alerts.process_events(events.where(cut), chunk_hours=8)
    two = alerts.process_events(events.where(f"NOT {cut}"), one.alerts, one.history, chunk_hours=8)
    merged = {r["alert_id"]: r for r in one.alerts.collect()} | {r["alert_id"]: r for r in two.alerts.collect()}
    assert merged == {r["alert_id"]: r for r in whole.alerts.collect()}
    ids = sorted(r["history_id"] for r in one.history.unionByName(two.history).collect())
    assert ids == sorted(r["history_id"] for r in whole.history.collect())


def test_status_changes_and_auto_resolve(spark):
    state = alerts.process_events(made_events(spark, [("A", 0, "rules", "flatline", "warning", 50), ("B", 30, "rules", "flatline", "warning", 50)])).alerts
    ident = state.where("region = 'A'").first()["alert_id"]
    move = spark.createDataFrame([(ident, "acknowledged")], "alert_id string, new_status string").withColumn("at", at("2024-01-02"))
    once = alerts.change_status(state, move)
    assert once.alerts.first()["acknowledged_at_utc"] is not None and once.history.first()["change_reason"] == "acknowledged"
    assert alerts.change_status(once.alerts, move).alerts.count() == 0
    with pytest.raises(NotFound):
        alerts.change_status(state, move.withColumn("alert_id", F.lit("nope")))
    with pytest.raises(ContractViolation):
        alerts.change_status(state, move.withColumn("new_status", F.lit("odd")))
    resolved = alerts.auto_resolve(state, at("2024-01-02 02:00:00"))
    assert [(r["region"], r["status"]) for r in resolved.alerts.collect()] == [("A", "resolved")]
    assert resolved.history.first()["change_reason"] == "auto_resolved"


def test_a_closed_alert_with_the_same_start_is_reopened(spark):
    events = made_events(spark, [("A", 0, "rules", "flatline", "warning", 50)])
    state = alerts.auto_resolve(alerts.process_events(events).alerts, at("2024-01-09"))
    other = made_events(spark, [("A", 0, "residual", "flatline", "critical", 90)])
    out = alerts.process_events(other, state.alerts, state.history)
    assert [r["outcome"] for r in out.outcomes.collect()] == ["reopened"]
    assert out.alerts.first()["status"] == "open"


def test_detection_scores(spark):
    labels = spark.createDataFrame(
        [("i1", "A", "x", hour(1), hour(2), "critical"), ("i2", "A", "y", hour(10), hour(12), "warning")],
        "injection_id string, region string, anomaly_type string, start_utc timestamp, end_utc timestamp, expected_severity string",
    )
    found = made_events(spark, [("A", 1, "rules", "flatline", "critical", 50), ("A", 11, "rules", "flatline", "critical", 50), ("A", 20, "rules", "flatline", "warning", 50)])
    matches = backtest.match_labels(found, labels, bucket_hours=5)
    row = backtest.detection_metrics(found, matches, at("2024-01-01"), at("2024-01-02")).first()
    assert row["precision"] == pytest.approx(2 / 3) and row["recall"] == 1 and row["f1"] == pytest.approx(0.8)
    assert (row["false_positives_per_day"], row["mean_detection_delay_hours"], row["severity_accuracy"]) == (1, 0.5, 0.5)
    none = backtest.match_labels(found.where("region = 'Z'"), labels)
    assert backtest.detection_metrics(found.where("region = 'Z'"), none, at("2024-01-01"), at("2024-01-02")).first()["f1"] == 0


def test_injection_is_repeatable_and_labelled(spark):
    rows = spark.createDataFrame([("A", hour(i), 100.0 + i % 24, 50.0) for i in range(120)], "region string, timestamp_utc timestamp, demand_mw double, relative_humidity_pct double")
    one, labels = backtest.inject(rows, "demand_mw", chunk_rows=11)
    two, again = backtest.inject(rows.repartition(5), "demand_mw", chunk_rows=50)
    assert labels.count() == 9 and sorted(map(tuple, labels.collect())) == sorted(map(tuple, again.collect()))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))
    assert one.count() in (118, 119)
    assert one.where("relative_humidity_pct = 250").count() == 1
