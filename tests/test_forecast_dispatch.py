"""Metrics, baselines, models, forests, dispatch, jobs and the alert stream."""

import collections
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from kilohour import contracts
from kilohour.errors import ContractViolation, InsufficientHistory
from kilohour.operators import dispatch, features, forecast, forest, metrics, models, reads
from kilohour.plans import adapters, jobs
from kilohour.streaming.alerts import alert_stream

START = pd.Timestamp("2024-01-01")


def at(text):
    return F.lit(text).cast("timestamp")


def hour(i):
    return (START + pd.Timedelta(hours=i)).to_pydatetime()


def two_regions(spark, n=240):
    rows = [(r, hour(i), 1000.0 + off + (i % 24) * 8 + (i % 168) * 0.25) for r, off in (("PJM", 0), ("MISO", 300)) for i in range(n)]
    return spark.createDataFrame(rows, "region string, timestamp_utc timestamp, demand_mw double")


def test_metric_triplet(spark):
    rows = spark.createDataFrame([(1, "r", hour(0), 10.0, 12.0), (1, "r", hour(1), 20.0, 18.0), (1, "r", hour(2), 30.0, 33.0), (1, "r", hour(3), None, 1.0)],
                                 "validation_window int, region string, timestamp_utc timestamp, actual_value double, predicted_value double")
    out = metrics.forecast_metrics(rows, mase_scale=5).first()
    assert [out[n] for n in metrics.NAMES] == pytest.approx([7 / 3, (17 / 3) ** 0.5, 7 / 60, 7 / 15, 1])
    assert metrics.forecast_metrics(rows).first()["mase"] == pytest.approx(7 / 30)
    zero = rows.withColumn("actual_value", F.lit(0.0))
    assert metrics.forecast_metrics(zero).first()["wape"] is None and metrics.forecast_metrics(zero).first()["mase"] is None


def test_seasonal_forecast_repeats_beyond_its_lag(spark):
    df = two_regions(spark, 200)
    made = forecast.baseline_forecasts(df, forecast.end_origins(df), horizon=30, models=["seasonal_naive_24h"])
    rows = {r["forecast_step"]: r["predicted_value"] for r in made.where("region = 'PJM'").collect()}
    assert rows[25] == rows[1] and rows[30] == rows[6]
    gap = df.where(F.col("timestamp_utc") != F.lit(hour(180)))
    with pytest.raises(InsufficientHistory):
        forecast.require_complete(forecast.baseline_forecasts(gap, forecast.end_origins(gap), horizon=24, models=["seasonal_naive_24h"]))


def test_promotion_gate(spark):
    rows = spark.createDataFrame([("a", 0.1, 0.0, 0.2), ("b", 0.19, 0.0, 0.2), ("c", float("nan"), 0.0, 0.2), ("d", 0.1, 0.0, 0.0)],
                                 "model_name string, wape double, forecast_bias double, ref double")
    out = {r["model_name"]: r for r in metrics.promotion_decisions(rows, reference="ref", threshold=0.1).collect()}
    assert [out[m]["champion_promoted"] for m in "abcd"] == [True, False, False, False]
    assert all(r["candidate_assigned"] for r in out.values())
    assert out["d"]["improvement"] is None and "nothing to compare" in out["d"]["reason"] and "missing or infinite" in out["c"]["reason"]
    assert out["a"]["improvement"] == pytest.approx(0.5) and "falls short" in out["b"]["reason"]


def test_training_job_and_prediction(spark, tmp_path):
    df = two_regions(spark)
    spec = features.FeatureSpec("target", lags=(1, 24), windows=(3,))
    settings = models.ModelSettings(iterations=2, depth=3, step=0.5)
    out = jobs.train(df, spec, settings, horizon=2, windows=1, step_size=2, created_at=at("2024-02-01"))
    assert {r["model_name"] for r in out.leaderboard.collect()} == {*forecast.ALL_BASELINES, "gbt"}
    assert out.decisions.count() == 1
    path = str(tmp_path / "forecasts")
    rows = jobs.predict(spark, out.model, df, path, horizon=4, created_at=at("2024-02-01"))
    assert rows.groupBy("region").count().collect()[0]["count"] == 4
    assert reads.latest_forecast(rows, region="PJM", target="demand_mw", horizon=4).count() == 4
    with pytest.raises(InsufficientHistory):
        models.recursive_forecast(out.model, df.where(F.col("timestamp_utc") != F.lit(hour(239)) ).unionByName(df.where("region = 'PJM'")).distinct(), horizon=1, created_at=at("2024-02-01"))


def test_tuning_must_not_see_the_final_windows(spark):
    windows = spark.sql("SELECT 1 validation_window, timestamp'2024-01-05' origin, timestamp'2024-01-06' validation_end")
    with pytest.raises(ValueError, match="overlap"):
        models.tune_model(two_regions(spark), windows, hour(24), models.FeatureSpec(), [], horizon=1, created_at=at("2024-02-01"))
    drawn = models.draw_settings(models.ModelSettings(), 5, 7)
    assert drawn == models.draw_settings(models.ModelSettings(), 5, 7) and all(80 <= d.iterations <= 300 for d in drawn)


def forest_rows(spark, regions=("A", "B"), n=92):
    rows = []
    for k, r in enumerate(regions):
        for i in range(n):
            odd = i >= n - 2
            pick = random.Random(1000 * k + i)
            load = (1000.0 if i == n - 2 else -100.0) if odd else pick.gauss(100.0 + k * 50, 5.0)
            heat = (60.0 if i == n - 2 else -60.0) if odd else pick.gauss(15.0, 3.0)
            rows.append((r, hour(i), load, None if i == n - 5 else heat))
    return spark.createDataFrame(rows, "region string, timestamp_utc timestamp, demand_mw double, temperature_c double")


def test_forest_ranks_planted_outliers_and_isolates_regions(spark):
    settings = forest.ForestSettings(trees=25, min_training_rows=50, slice_rows=40)
    names = ("demand_mw", "temperature_c")
    rows = forest_rows(spark)
    past, later = rows.where(F.col("timestamp_utc") < F.lit(hour(80))), rows.where(F.col("timestamp_utc") >= F.lit(hour(80)))
    fitted = forest.fit_forest(past, names, settings)
    scored = forest.score_forest(fitted, later, "demand_mw").toPandas()
    assert len(scored) == 22  # one incomplete row per region
    for _, part in scored.groupby("region"):
        top = part.sort_values("isolation_score", ascending=False).head(2)
        assert set(top["timestamp_utc"]) == {pd.Timestamp(hour(90)), pd.Timestamp(hour(91))}
        assert top["is_outlier"].any() and top["deviations"].iloc[0][0]["feature"] == "demand_mw"
        assert len(top["deviations"].iloc[0]) == 2
    alone = forest.fit_forest(past.where("region = 'A'").repartition(5), names, settings)
    again = forest.score_forest(alone, later.where("region = 'A'"), "demand_mw").toPandas()
    pd.testing.assert_series_equal(
        scored[scored["region"] == "A"].sort_values("timestamp_utc")["isolation_score"].reset_index(drop=True),
        again.sort_values("timestamp_utc")["isolation_score"].reset_index(drop=True),
    )
    events = contracts.anomaly_events().enforce(forest.forest_events(forest.score_forest(fitted, later, "demand_mw"), "demand_mw", at("2024-02-01")))
    assert {r["severity"] for r in events.collect()} <= {"info", "warning"}
    with pytest.raises(InsufficientHistory):
        forest.score_forest(fitted, past, "demand_mw")
    with pytest.raises(InsufficientHistory):
        forest.fit_forest(past.limit(10), names, settings)


def battery(spark, **changes):
    values = dict(capacity_mwh=100.0, max_charge_mw=25.0, max_discharge_mw=20.0, min_soc_mwh=10.0, max_soc_mwh=100.0, initial_soc_mwh=50.0,
                  terminal_soc_target_mwh=50.0, charge_efficiency=0.9, discharge_efficiency=0.8, self_discharge_rate=0.01,
                  maximum_daily_cycles=1.5, degradation_cost_per_mwh=2.0, reserve_soc_mwh=20.0) | changes
    return spark.createDataFrame([("b", "PJM", *values.values())], "battery_id string, region string, " + ", ".join(f"{k} double" for k in values))


def dispatch_inputs(spark):
    rows = [("PJM", hour(0), hour(i + 1), i + 1, n + 10, 5.0, 5.0, 10.0, float(n), float(p), "{}") for i, (n, p) in enumerate(zip((50, 60, 130, 120), (20, 25, 120, 100)))]
    return spark.createDataFrame(rows, "region string, forecast_origin timestamp, timestamp_utc timestamp, forecast_step int, demand_forecast_mw int, solar_forecast_mw double, wind_forecast_mw double, renewable_forecast_mw double, net_load_before_battery_mw double, energy_price double, metadata_json string").withColumn("demand_forecast_mw", F.col("demand_forecast_mw").cast("double"))


def test_charge_transition(spark):
    soc = dispatch.soc_after(F.lit(50.0), F.lit(10.0), F.lit(4.0), 0.5)
    assert battery(spark).select(soc.alias("s")).first()["s"] == pytest.approx(50 * 0.99**0.5 + 10 * 0.9 * 0.5 - 4 / 0.8 * 0.5)


def test_policy_schedule_passes_its_audit(spark):
    fleet = battery(spark)
    contracts.enforce_dispatch_input(dispatch_inputs(spark), 4)
    dispatch.battery_contract(tuple(fleet.columns)).enforce(fleet)
    made = dispatch.policy_schedules(dispatch_inputs(spark), fleet, created_at=at("2024-02-01"))
    rows = made.orderBy("timestamp_utc").collect()
    assert [r["operating_mode"] for r in rows] == ["charge", "idle", "discharge", "idle"]
    audit = dispatch.physics_audit(made, fleet, terminal_required=False, chunk_rows=2).first()
    assert audit["valid"] and audit["continuity_violations"] == 0
    broken = made.withColumn("soc_end_mwh", F.when(F.col("forecast_step") == 2, 5.0).otherwise(F.col("soc_end_mwh")))
    row = dispatch.physics_audit(broken, fleet, terminal_required=False, chunk_rows=2).first()
    assert (row["valid"], row["soc_violations"], row["continuity_violations"]) == (False, 1, 3)
    idle = dispatch.policy_schedules(dispatch_inputs(spark), fleet, "no_battery", created_at=at("2024-02-01"))
    board = {r["strategy"]: r for r in dispatch.compare_strategies({"none": idle, "rule": made}, fleet).collect()}
    assert board["none"]["total_throughput_mwh"] == 0 and board["rule"]["absolute_peak_reduction_mw"] == pytest.approx(10.0)


def test_dispatch_input_checks(spark):
    with pytest.raises(ContractViolation):
        contracts.enforce_dispatch_input(dispatch_inputs(spark).where("forecast_step <> 2"), 4)
    with pytest.raises(ContractViolation):
        dispatch.robust_batteries(battery(spark), 0.9)
    bad = battery(spark, charge_efficiency=1.2, initial_soc_mwh=5.0)
    failed = {r["check"] for r in dispatch.battery_contract().violations(bad).where("failures > 0").collect()}
    assert failed == {"efficiencies", "soc_levels_within_bounds"}


def test_missing_hour_inside_a_present_target_fails(spark):
    rows = [("PJM", t, hour(0), hour(i), i, 10.0, "m", "1", "r", "none") for t in ("demand_mw", "solar_generation_mw") for i in (1, 2, 3) if not (t.startswith("solar") and i == 2)]
    fc = spark.createDataFrame(rows, "region string, target string, forecast_origin timestamp, timestamp_utc timestamp, forecast_step int, predicted_value double, model_name string, model_version string, run_id string, weather_mode string")
    out = dispatch.dispatch_inputs(fc, horizon=3)
    assert [r["wind_forecast_mw"] for r in out.collect()] == [0.0, 0.0, 0.0]
    with pytest.raises(ContractViolation):
        contracts.enforce_dispatch_input(out, 3)
    mixed = fc.unionByName(fc.limit(1).withColumn("model_name", F.lit("other")))
    with pytest.raises(ContractViolation):
        dispatch.dispatch_inputs(mixed, horizon=3)


def test_gapped_newer_series_is_skipped(spark):
    rows = [("A", "t", hour(o), hour(o + i), 1.0, "m", "1", "r", "n") for o in (0, 10) for i in (1, 2, 3) if not (o == 10 and i == 2)]
    fc = spark.createDataFrame(rows, "region string, target string, forecast_origin timestamp, timestamp_utc timestamp, predicted_value double, model_name string, model_version string, run_id string, weather_mode string")
    assert {r["forecast_origin"] for r in reads.latest_horizons(fc, 3).collect()} == {hour(0)}
    info = reads.page(fc, ["timestamp_utc"], limit=2, offset=4)[1].first()
    assert (info["total"], info["returned"], info["has_more"]) == (5, 1, False)


def test_detection_job_and_alert_stream(spark, tmp_path):
    df = two_regions(spark, 72).where(F.col("timestamp_utc") != F.lit(hour(50)))
    spiked = df.withColumn("demand_mw", F.when(F.col("timestamp_utc") == F.lit(hour(60)), 5000.0).otherwise(F.col("demand_mw")))
    out = jobs.detect_and_alert({"demand_mw": spiked}, start=at("2024-01-02"), end=at("2024-01-03 23:00:00"), chunk_rows=20)
    kinds = {(r["detector_name"], r["anomaly_type"]) for r in out.events.collect()}
    assert ("rules", "demand_spike") in kinds and ("ensemble", "missing_timestamp") in kinds
    assert out.events.agg(F.min("timestamp_utc")).first()[0] >= pd.Timestamp("2024-01-02")
    folder = str(tmp_path / "events")
    paths = [str(tmp_path / p) for p in ("alerts", "history", "checkpoint")]
    for cut in ("timestamp_utc <= '2024-01-03 02:00:00'", "timestamp_utc > '2024-01-03 02:00:00'"):
        out.events.where(cut).write.mode("append").parquet(folder)
        alert_stream(spark, folder, out.events.schema, *paths).awaitTermination()
    last = max(p.name for p in (tmp_path / "alerts").glob("version=*"))
    streamed = {(r["alert_id"], r["occurrence_count"]) for r in spark.read.parquet(str(tmp_path / "alerts" / last)).collect()}
    assert streamed == {(r["alert_id"], r["occurrence_count"]) for r in out.alerts.alerts.collect()}


@pytest.mark.parametrize("hours, fleet", [(2, 400), (200, 40)])
def test_dispatch_points_are_made_by_many_tasks(spark, tmp_path, hours, fleet):
    """Few hours of five regions and many batteries, or the other way round: the pairs of both are spread, and each comes once."""
    types = ["click", "error", "purchase", "signup", "view"]
    events = [((START + pd.Timedelta(minutes=20 * i)).to_pydatetime(), t, float(i % 9)) for i in range(3 * hours) for t in types]
    spark.createDataFrame(events, "ts timestamp, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    keys = [*range(fleet), 7]  # a battery twice
    spark.createDataFrame([(k,) for k in keys], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    points = adapters.dispatch_points(spark, str(tmp_path))
    rows = points.select("dispatch_run_id", "region", "timestamp_utc", F.spark_partition_id().alias("task")).collect()
    tasks = collections.Counter(r["task"] for r in rows)
    assert len(tasks) > 1 and max(tasks.values()) < 0.6 * len(rows)
    want = sorted((f"run-b{k}", types[k % 5], hour(i)) for k in keys for i in range(hours))
    assert sorted((r["dispatch_run_id"], r["region"], r["timestamp_utc"]) for r in rows) == want


def test_realised_schedule_is_not_shuffled_to_its_few_actuals(spark):
    made = dispatch.policy_schedules(dispatch_inputs(spark), battery(spark), created_at=at("2024-02-01"))
    actuals = dispatch_inputs(spark).select("region", "timestamp_utc", *dispatch.REALISED).groupBy("region", "timestamp_utc").agg(
        *[F.max(c).alias(c) for c in dispatch.REALISED]
    )
    schedule = made.repartition(3, "battery_id")
    out = dispatch.apply_realised(schedule, actuals.withColumn("demand_forecast_mw", F.lit(500.0)), check=False)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan.split("REPARTITION_BY_NUM")[0] and "BroadcastHashJoin" in plan.split("REPARTITION_BY_NUM")[0]
    planned = F.get_json_object("metadata_json", "$.optimization_forecast.demand_forecast_mw").cast("double")
    assert sorted((r[0], r[1]) for r in out.select("demand_forecast_mw", planned).collect()) == [(500.0, 60.0), (500.0, 70.0), (500.0, 130.0), (500.0, 140.0)]
