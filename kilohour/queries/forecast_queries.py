"""Baselines, metrics and leaderboards over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from kilohour.operators import forecast, metrics
from kilohour.plans import adapters as a
from kilohour.plans.adapters import with_sql
from kilohour.queries.registry import query
from kilohour.series import SeriesSpec

SMALL = SeriesSpec(chunk_rows=100)

# Three origins a day apart, as a window table.
_WINDOWS = """SELECT n + 1 AS validation_window, timestamp'2024-01-20 23:00:00' + n * interval 1 day AS origin
FROM (SELECT explode(sequence(0, 2)) AS n)"""
_WINDOWS_SQL = """,
win AS (SELECT CAST(n + 1 AS BIGINT) AS validation_window, TIMESTAMP '2024-01-20 23:00:00' + n * INTERVAL 1 DAY AS origin FROM range(3) r(n)),
steps AS (SELECT CAST(s AS BIGINT) AS forecast_step FROM range(1, 31) r(s)),
org AS (SELECT region, origin, validation_window, demand_mw AS ov FROM hourly JOIN win ON timestamp_utc = origin),
grid AS (SELECT region, origin, validation_window, ov, forecast_step, origin + forecast_step * INTERVAL 1 HOUR AS timestamp_utc FROM org, steps),
src AS (SELECT g.*, a.demand_mw AS v24, b.demand_mw AS v168 FROM grid g
  LEFT JOIN hourly a ON a.region = g.region AND a.timestamp_utc = g.timestamp_utc - INTERVAL 24 HOUR * CAST(ceil(forecast_step / 24.0) AS INT)
  LEFT JOIN hourly b ON b.region = g.region AND b.timestamp_utc = g.timestamp_utc - INTERVAL 168 HOUR),
pred AS (SELECT region, origin AS forecast_origin, validation_window, forecast_step, timestamp_utc, 'last_value' AS model_name, ov AS predicted_value FROM src
  UNION ALL SELECT region, origin, validation_window, forecast_step, timestamp_utc, 'seasonal_naive_24h', v24 FROM src
  UNION ALL SELECT region, origin, validation_window, forecast_step, timestamp_utc, 'seasonal_naive_168h', v168 FROM src
  UNION ALL SELECT region, origin, validation_window, forecast_step, timestamp_utc, 'seasonal_naive_average_24h_168h', (v24 + v168) / 2.0::DOUBLE FROM src),
eval AS (SELECT p.*, h.demand_mw AS actual_value FROM pred p LEFT JOIN hourly h USING (region, timestamp_utc)),
both_known AS (SELECT *, predicted_value - actual_value AS e FROM eval WHERE predicted_value IS NOT NULL AND actual_value IS NOT NULL)
"""


def _evaluated(spark, d):
    series = a.hourly_by_type(spark, d)
    return forecast.evaluate_baselines(series, spark.sql(_WINDOWS), horizon=30, spec=SMALL)


def _metrics_sql(by: str, order: str) -> str:
    part = f"PARTITION BY {by} " if by else ""
    pick = f"{by}, " if by else ""
    return f"""
SELECT {pick}count(*) AS n, round(avg(abs(e)) + 1e-9, 6) AS mae, round(sqrt(avg(e * e)) + 1e-9, 6) AS rmse,
  round(sum(abs(e)) / nullif(sum(abs(actual_value)), 0) + 1e-9, 6) AS wape,
  round(CASE WHEN avg(abs(step)) > 0 THEN avg(abs(e)) / avg(abs(step)) END + 1e-9, 6) AS mase, round(avg(e) + 1e-9, 6) AS bias
FROM (SELECT *, actual_value - lag(actual_value) OVER ({part}ORDER BY {order}) AS step FROM both_known)
{'GROUP BY ' + by if by else ''}"""


def _rounded(df, names=metrics.NAMES, digits=6):
    return df.select(*[F.round(F.col(c) + 1e-9, digits).alias(c) if c in names else F.col(c) for c in df.columns])


@query("m1_last_value", with_sql("hourly") + """,
l AS (SELECT region, max(timestamp_utc) AS origin, arg_max(demand_mw, timestamp_utc) AS v FROM hourly GROUP BY 1)
SELECT region, origin AS forecast_origin, s AS forecast_step, origin + s * INTERVAL 1 HOUR AS timestamp_utc,
  'last_value' AS model_name, v AS predicted_value FROM l, range(1, 25) r(s)""")
def m1(spark, d):
    series = a.hourly_by_type(spark, d)
    origins = forecast.end_origins(series)
    return forecast.baseline_forecasts(series, origins, horizon=24, models=["last_value"])


@query("m2_seasonal_naive", with_sql("hourly") + """,
l AS (SELECT region, max(timestamp_utc) AS origin FROM hourly GROUP BY 1),
g AS (SELECT region, origin, s, origin + s * INTERVAL 1 HOUR AS timestamp_utc FROM l, range(1, 61) r(s))
SELECT g.region, origin AS forecast_origin, s AS forecast_step, g.timestamp_utc, 'seasonal_naive_24h' AS model_name,
  h.demand_mw AS predicted_value FROM g LEFT JOIN hourly h ON h.region = g.region
  AND h.timestamp_utc = g.timestamp_utc - INTERVAL 24 HOUR * CAST(ceil(s / 24.0) AS INT)""")
def m2(spark, d):
    series = a.hourly_by_type(spark, d)
    origins = forecast.end_origins(series)
    return forecast.baseline_forecasts(series, origins, horizon=60, models=["seasonal_naive_24h"])


@query("m3_seasonal_average", with_sql("hourly") + _WINDOWS_SQL + """
SELECT region, forecast_origin, validation_window, forecast_step, timestamp_utc, model_name, predicted_value
FROM pred WHERE model_name LIKE '%average%'""")
def m3(spark, d):
    series = a.hourly_by_type(spark, d)
    origins = forecast.origins_at(series, spark.sql(_WINDOWS))
    return forecast.baseline_forecasts(series, origins, horizon=30, models=[forecast.SEASONAL_AVERAGE])


@query("m4_positional_origins", with_sql("hourly") + """,
n AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY timestamp_utc) - (count(*) OVER (PARTITION BY region) - 24 - 3 * 12) AS o FROM hourly)
SELECT region, timestamp_utc AS origin, demand_mw AS origin_value, CAST(o / 12 + 1 AS BIGINT) AS validation_window
FROM n WHERE o BETWEEN 0 AND 36 AND o % 12 = 0""")
def m4(spark, d):
    """Rolling origins by row position."""
    return forecast.positional_origins(a.hourly_by_type(spark, d), horizon=24, windows=4, step_size=12, spec=SMALL)


@query("m5_baseline_evaluation", with_sql("hourly") + _WINDOWS_SQL + "SELECT * FROM eval")
def m5(spark, d):
    return _evaluated(spark, d)


@query("m6_baseline_leaderboard", with_sql("hourly") + _WINDOWS_SQL + """,
o AS (""" + _metrics_sql("model_name", "validation_window, region, timestamp_utc").replace("round(", "(").replace(" + 1e-9, 6)", ")") + """),
r AS (SELECT max(wape) FILTER (model_name = 'seasonal_naive_24h') AS r24, max(wape) FILTER (model_name = 'seasonal_naive_168h') AS r168 FROM o)
SELECT row_number() OVER (ORDER BY wape, mae, model_name) AS rank, model_name, round(mae + 1e-9, 6) AS mae, round(rmse + 1e-9, 6) AS rmse,
  round(wape + 1e-9, 6) AS wape, round(mase + 1e-9, 6) AS mase, round(bias + 1e-9, 6) AS forecast_bias,
  round((r24 - wape) / r24 + 1e-9, 6) AS improvement_vs_seasonal_24, round((r168 - wape) / r168 + 1e-9, 6) AS improvement_vs_seasonal_168 FROM o, r""")
def m6(spark, d):
    """All baselines scored and ranked."""
    overall = metrics.forecast_metrics(_evaluated(spark, d), ["model_name"])
    out = metrics.leaderboard(overall)
    return _rounded(out, [c for c in out.columns if c not in ("rank", "model_name")])


@query("m13_promotion_gate", with_sql("hourly") + _WINDOWS_SQL + """,
o AS (SELECT model_name, sum(abs(e)) / sum(abs(actual_value)) AS wape FROM both_known GROUP BY 1),
g AS (SELECT model_name, (ref - wape) / ref AS gain FROM o, (SELECT wape AS ref FROM o WHERE model_name = 'last_value'))
SELECT model_name, true AS candidate_assigned, gain >= 0.02 AS champion_promoted, round(gain + 1e-9, 6) AS improvement FROM g""")
def m13(spark, d):
    overall = metrics.forecast_metrics(_evaluated(spark, d), ["model_name"]).withColumnRenamed("bias", "forecast_bias")
    reference = overall.where("model_name = 'last_value'").select(F.col("wape").alias("reference_wape"))
    # One reference row.
    joined = overall.join(F.broadcast(reference), F.col("model_name").isNotNull())
    out = metrics.promotion_decisions(joined, reference="reference_wape", threshold=0.02).drop("reason")
    return _rounded(out, ["improvement"])


@query("a10_forecast_metrics", with_sql("hourly") + _WINDOWS_SQL + _metrics_sql("model_name", "validation_window, region, timestamp_utc"))
def a10(spark, d):
    return _rounded(metrics.forecast_metrics(_evaluated(spark, d), ["model_name"]))


@query("a10_forecast_metrics_all", with_sql("hourly") + _WINDOWS_SQL.replace("UNION ALL SELECT region, origin, validation_window, forecast_step, timestamp_utc, 'seasonal_naive_168h', v168 FROM src\n", "").replace("UNION ALL SELECT region, origin, validation_window, forecast_step, timestamp_utc, 'seasonal_naive_average_24h_168h', (v24 + v168) / 2.0::DOUBLE FROM src", "").replace("SELECT region, origin AS forecast_origin, validation_window, forecast_step, timestamp_utc, 'last_value' AS model_name, ov AS predicted_value FROM src\n  UNION ALL SELECT region, origin, validation_window, forecast_step, timestamp_utc, 'seasonal_naive_24h', v24 FROM src", "SELECT region, origin AS forecast_origin, validation_window, forecast_step, timestamp_utc, 'seasonal_naive_24h' AS model_name, v24 AS predicted_value FROM src") + _metrics_sql("", "validation_window, region, timestamp_utc"))
def a10_all(spark, d):
    """One overall slice without grouping keys."""
    rows = _evaluated(spark, d).where("model_name = 'seasonal_naive_24h'")
    return _rounded(metrics.forecast_metrics(rows))


@query("a11_metric_slices", with_sql("hourly") + _WINDOWS_SQL + "\nUNION ALL\n".join(
    f"SELECT model_name, '{s or 'overall'}' AS slice, {f'CAST({s} AS VARCHAR)' if s else chr(39) + 'all' + chr(39)} AS slice_value, n, mae, rmse, wape, mase, bias FROM ("
    + _metrics_sql("model_name" + (", " + s if s else ""), o) + ")"
    for s, o in ((None, "validation_window, region, timestamp_utc"), ("validation_window", "region, timestamp_utc"),
                 ("forecast_step", "validation_window, region"), ("region", "validation_window, timestamp_utc"))))
def a11(spark, d):
    """Overall, per window, per step and per region."""
    return _rounded(metrics.metric_slices(_evaluated(spark, d)))


@query("a12_target_metrics", with_sql("hourly") + _WINDOWS_SQL + """,
t AS (SELECT model_name, CASE WHEN actual_value < 5 THEN 0 ELSE actual_value END AS actual, greatest(predicted_value - 10, 0) AS pred,
  predicted_value - 10 < 0 AS clipped, hour(timestamp_utc) BETWEEN 6 AND 18 AS day FROM both_known)
SELECT model_name, round(avg(abs(actual - pred)) / (max(actual) - min(actual)) + 1e-9, 6) AS normalized_mae,
  round(sqrt(avg((actual - pred) * (actual - pred))) / (max(actual) - min(actual)) + 1e-9, 6) AS normalized_rmse,
  round(avg(abs(pred)) FILTER (actual = 0) + 1e-9, 6) AS zero_generation_mae, count(*) FILTER (clipped) AS forecast_clipping_count,
  round(avg(abs(actual - pred)) FILTER (day) + 1e-9, 6) AS daytime_mae FROM t GROUP BY 1""")
def a12(spark, d):
    """Range-normalised and conditional errors after clipping."""
    rows = _evaluated(spark, d).where("predicted_value IS NOT NULL AND actual_value IS NOT NULL")
    rows = rows.withColumn("actual_value", F.when(F.col("actual_value") < 5, 0.0).otherwise(F.col("actual_value")))
    rows = forecast.clip_negative(rows.withColumn("predicted_value", F.col("predicted_value") - 10))
    rows = rows.withColumn("day", F.hour("timestamp_utc").between(6, 18).cast("double"))
    out = metrics.target_metrics(rows, ["model_name"], "day")
    return _rounded(out, [c for c in out.columns if c not in ("model_name", "forecast_clipping_count")])


@query("p18_clip_negative", with_sql("hourly") + """
SELECT region, count(*) FILTER (demand_mw - 30 < 0) AS clipped_rows, round(sum(greatest(demand_mw - 30, 0)), 4) AS total FROM hourly GROUP BY 1""")
def p18(spark, d):
    rows = a.hourly_by_type(spark, d).withColumn("predicted_value", F.col("demand_mw") - 30)
    out = forecast.clip_negative(rows)
    return out.groupBy("region").agg(
        F.count_if("clipped").alias("clipped_rows"), F.round(F.sum("predicted_value"), 4).alias("total")
    )


@query("w8_step_numbers", with_sql("hourly", "forecasts") + """
SELECT region, model_name, forecast_origin, timestamp_utc,
  row_number() OVER (PARTITION BY region, model_name, forecast_origin ORDER BY timestamp_utc) AS forecast_step FROM forecasts""")
def w8(spark, d):
    rows = a.forecasts(spark, d).select("region", "model_name", "forecast_origin", "timestamp_utc")
    return forecast.number_steps(rows, ["region", "model_name", "forecast_origin"])
