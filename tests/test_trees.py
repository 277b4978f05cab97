"""Compiled trees against the library's own model, step by step, and path attributions against a walk over the nodes."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kilohour.operators import features, models, trees
from kilohour.operators.features import context_arrays, features_from_context

SPEC = features.FeatureSpec("target", lags=(1, 2, 24), windows=(3, 12))
START = pd.Timestamp("2024-01-01")


def table(spark, n=200):
    pick = np.random.default_rng(4)
    rows = [(r, (START + pd.Timedelta(hours=i)).to_pydatetime(), float(off + (i % 24) * 8 + pick.normal(0, 6)), float(pick.integers(0, 4) * 10)) for r, off in (("A", 0), ("B", 300), ("C", -60)) for i in range(n)]
    return spark.createDataFrame(rows, "region string, timestamp_utc timestamp, demand_mw double, temperature_c double")


def by_the_library(model, history, horizon, future=None):
    """Every step through the whole pipeline, the last prediction appended to the history."""
    out, known = {}, {r: [] for r in "ABC"}
    rows = history.orderBy("timestamp_utc").collect()
    for row in rows:
        known[row["region"]].append(row["demand_mw"])
    last, spark = max(r["timestamp_utc"] for r in rows), history.sparkSession
    for step in range(1, horizon + 1):
        at = last + pd.Timedelta(hours=step).to_pytimedelta()
        state = spark.createDataFrame([(r, at, 0, v[-SPEC.required_history :]) for r, v in known.items()], "region string, timestamp_utc timestamp, missing_context_hours int, _context array<double>")
        if future is not None:
            state = state.join(future, ["region", "timestamp_utc"])
        for r in model.predict(features_from_context(state, model.features)).collect():
            out[r["region"], step] = r["_prediction"]
            known[r["region"]].append(max(r["_prediction"], 0.0))
    return out


def test_recursive_forecast_equals_the_pipeline_step_by_step(spark):
    rows = table(spark)
    model = models.fit_target_model(rows, SPEC, models.ModelSettings(iterations=8, depth=4, step=0.3))
    made = models.recursive_forecast(model, rows, horizon=4, created_at=F.lit("2024-02-01").cast("timestamp")).collect()
    want = by_the_library(model, rows, 4)
    assert {(r["region"], r["forecast_step"]) for r in made} == set(want)
    for r in made:
        assert r["predicted_value"] == pytest.approx(max(want[r["region"], r["forecast_step"]], 0.0), abs=1e-9)
        assert r["clipped"] == (want[r["region"], r["forecast_step"]] < 0)


def test_weather_of_the_coming_steps_is_used(spark):
    spec = features.FeatureSpec("target", lags=(1, 24), windows=(3,), extra=("temperature_c",))
    rows = table(spark).withColumn("demand_mw", F.col("demand_mw") + F.col("temperature_c") * 50)
    past = rows.where(F.col("timestamp_utc") < F.lit(START + pd.Timedelta(hours=190)))
    future = rows.where(F.col("timestamp_utc") >= F.lit(START + pd.Timedelta(hours=190))).select("region", "timestamp_utc", "temperature_c")
    model = models.fit_target_model(past, spec, models.ModelSettings(iterations=5, depth=4, step=0.3))
    made = models.recursive_forecast(model, past, horizon=3, created_at=F.lit("2024-02-01").cast("timestamp"), future=future).collect()
    context = context_arrays(past, F.lit(START + pd.Timedelta(hours=190)), spec.required_history).join(future, ["region", "timestamp_utc"])
    first = {r["region"]: r["_prediction"] for r in model.predict(features_from_context(context, spec)).collect()}
    assert {r["region"]: r["predicted_value"] for r in made if r["forecast_step"] == 1} == pytest.approx(first, abs=1e-9)


def test_contributions_add_up_and_follow_the_nodes(spark):
    rows = table(spark, 120)
    matrix = features.training_matrix(rows, SPEC)
    model = models.fit_model(matrix, SPEC, models.ModelSettings(iterations=4, depth=3, step=0.5))
    found = trees.path_contributions(model, matrix).collect()
    assert len(found) == matrix.dropna().count()
    plain = {(r["region"], r["timestamp_utc"]): r for r in trees.with_level(model, matrix.dropna()).collect()}
    nodes = {(n["tree"], n["node"]): n for n in trees.exported_nodes(model).collect()}
    library = {(r["region"], r["timestamp_utc"]): r["_prediction"] for r in model.predict(matrix.dropna()).collect()}
    assert len({r["base"] for r in found}) == 1
    for r in found[::17]:
        row, want, base = plain[r["region"], r["timestamp_utc"]], {}, 0.0
        for tree in range(4):
            node = nodes[tree, 0]
            base += node["weight"] * node["prediction"]
            while node["feature"] is not None:
                side = "left_child" if row[node["feature"]] <= node["threshold"] else "right_child"
                after = nodes[tree, node[side]]
                want[node["feature"]] = want.get(node["feature"], 0.0) + node["weight"] * (after["prediction"] - node["prediction"])
                node = after
        got = {c["feature"]: c["contribution"] for c in r["contributions"]}
        assert set(got) == set(model.columns) and all(got[k] == pytest.approx(want.get(k, 0.0), abs=1e-9) for k in got)
        assert r["base"] == pytest.approx(base) and r["prediction"] == pytest.approx(library[r["region"], r["timestamp_utc"]], abs=1e-9)
        assert sum(got.values()) == pytest.approx(r["prediction"] - r["base"], abs=1e-9)
        assert [c["size"] for c in r["contributions"]] == sorted((abs(v) for v in got.values()), reverse=True)
    top = models.local_contributions(model, matrix, top=2).first()
    assert len(top["contributions"]) == 2
