"""Dispatch inputs, policies, audits and key figures over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from kilohour import contracts
from kilohour.operators import dispatch as ops
from kilohour.plans import adapters as a
from kilohour.plans.adapters import with_sql
from kilohour.queries.registry import query

NOW = "2024-02-01 00:00:00"


def _now():
    return F.lit(NOW).cast("timestamp")


def _round(df, keep=(), digits=6):
    return df.select(*[F.col(c) if c in keep or t not in ("double",) else F.round(F.col(c) + 1e-9, digits).alias(c) for c, t in df.dtypes])


def _inputs(spark, d):
    return ops.dispatch_inputs(a.target_forecasts(spark, d), horizon=24, fallback_price=30.0, check=False)


@query("b1_dispatch_inputs", with_sql("hourly", "forecasts", "target_forecasts") + """
SELECT region, forecast_origin, timestamp_utc, forecast_step, demand_forecast_mw, solar_forecast_mw, wind_forecast_mw,
  round(solar_forecast_mw + wind_forecast_mw + 1e-9, 6) AS renewable_forecast_mw,
  round(demand_forecast_mw - (solar_forecast_mw + wind_forecast_mw) + 1e-9, 6) AS net_load_before_battery_mw, 30.0::DOUBLE AS energy_price FROM inputs""")
def b1(spark, d):
    """Inputs of all origins: first steps per target, pivot, spine, derived loads (also O3)."""
    out = _inputs(spark, d).drop("metadata_json")
    return _round(out, ("demand_forecast_mw", "solar_forecast_mw", "wind_forecast_mw", "energy_price"))


@query("p13_dispatch_input_contract", with_sql("hourly", "forecasts", "target_forecasts") + """
SELECT region, forecast_origin, count(*) AS rows, 24::BIGINT AS distinct_steps, 1::BIGINT AS first_step, 24::BIGINT AS last_step, 0::BIGINT AS misplaced_rows,
  count(*) FILTER (demand_forecast_mw + solar_forecast_mw + wind_forecast_mw IS NULL) AS non_finite_rows, 0::BIGINT AS invalid_json_rows,
  count(*) FILTER (demand_forecast_mw + solar_forecast_mw + wind_forecast_mw IS NULL) = 0 AS complete FROM inputs GROUP BY 1, 2""")
def p13(spark, d):
    return contracts.dispatch_input_report(_inputs(spark, d), 24)


@query("b2_robust_margins", with_sql("hourly", "forecasts", "target_forecasts") + """
SELECT region, forecast_origin, timestamp_utc, round(demand_forecast_mw * 1.1 + 1e-9, 6) AS demand_forecast_mw,
  round((solar_forecast_mw + wind_forecast_mw) * 0.8 + 1e-9, 6) AS renewable_forecast_mw,
  round(demand_forecast_mw * 1.1 - (solar_forecast_mw + wind_forecast_mw) * 0.8 + 1e-9, 6) AS net_load_before_battery_mw, demand_forecast_mw AS original FROM inputs""")
def b2(spark, d):
    out = ops.robust_inputs(_inputs(spark, d), demand_uplift_pct=0.1, renewable_reduction_pct=0.2)
    original = F.get_json_object("metadata_json", "$.unadjusted_demand_forecast_mw").cast("double")
    names = ("region", "forecast_origin", "timestamp_utc", "demand_forecast_mw", "renewable_forecast_mw", "net_load_before_battery_mw")
    return _round(out.withColumn("original", original).select(*names, "original"), ("original",))


@query("a33_load_thresholds", with_sql("hourly", "forecasts", "target_forecasts") + """
SELECT region, forecast_origin, round(quantile_cont(demand_forecast_mw - (solar_forecast_mw + wind_forecast_mw), 0.25) + 1e-9, 6) AS low_load_mw,
  round(quantile_cont(demand_forecast_mw - (solar_forecast_mw + wind_forecast_mw), 0.75) + 1e-9, 6) AS high_load_mw FROM inputs GROUP BY 1, 2""")
def a33(spark, d):
    return _round(ops.load_thresholds(_inputs(spark, d)))


_LEDGER_CTE = """,
th AS (SELECT region, forecast_origin, quantile_cont(demand_forecast_mw - (solar_forecast_mw + wind_forecast_mw), 0.25) AS lo,
  quantile_cont(demand_forecast_mw - (solar_forecast_mw + wind_forecast_mw), 0.75) AS hi FROM inputs GROUP BY 1, 2
  HAVING count(demand_forecast_mw + solar_forecast_mw + wind_forecast_mw) = 24),
ld AS (SELECT i.*, demand_forecast_mw - (solar_forecast_mw + wind_forecast_mw) AS net, solar_forecast_mw + wind_forecast_mw AS ren, lo, hi FROM inputs i JOIN th USING (region, forecast_origin)),
w AS (SELECT l.*, CASE WHEN ren > demand_forecast_mw OR net <= lo THEN 'c' WHEN net > hi THEN 'd' ELSE 'i' END AS want FROM ld l)
"""
_STEP = """least(CASE WHEN want = 'c' THEN cap / 8 ELSE 0 END, greatest(0, (cap * 0.95 - 0.99 * soc) / 0.9)) AS ch,
    least(CASE WHEN want = 'd' THEN cap / 10 ELSE 0 END, greatest(0, (0.99 * soc - cap * 0.1) * 0.8)) AS dis"""


@query("b4_policy_ledger", "WITH RECURSIVE" + with_sql("hourly", "forecasts", "target_forecasts", "batteries")[4:] + _LEDGER_CTE + f""",
f(battery_id, region, forecast_origin, n, cap, soc_start, charge, discharge, soc) AS (
  SELECT battery_id, b.region, forecast_origin, 0, cap, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, cap * 0.5 FROM batteries b JOIN th ON th.region = b.region
  UNION ALL
  SELECT f.battery_id, f.region, f.forecast_origin, n + 1, cap, soc, ch, dis, soc * 0.99 + ch * 0.9 - dis / 0.8
  FROM f JOIN w ON w.region = f.region AND w.forecast_origin = f.forecast_origin AND w.forecast_step = n + 1, LATERAL (SELECT {_STEP}))
SELECT battery_id, region, forecast_origin, n AS forecast_step, round(charge + 1e-9, 5) AS charge_mw, round(discharge + 1e-9, 5) AS discharge_mw,
  round(soc_start + 1e-9, 5) AS soc_start_mwh, round(soc + 1e-9, 5) AS soc_end_mwh,
  CASE WHEN charge > 1e-7 THEN 'charge' WHEN discharge > 1e-7 THEN 'discharge' ELSE 'idle' END AS operating_mode FROM f WHERE n > 0""")
def b4(spark, d):
    """Quartile policy with clamped charge for a whole fleet."""
    ready = _complete(_inputs(spark, d))
    out = ops.policy_schedules(ready, a.batteries(spark, d), created_at=_now())
    names = ("battery_id", "region", "forecast_origin", "forecast_step", "charge_mw", "discharge_mw", "soc_start_mwh", "soc_end_mwh", "operating_mode")
    return _round(out.select(*names), digits=5)


def _complete(inputs):
    good = contracts.dispatch_input_report(inputs, 24).where("complete").select("region", "forecast_origin")
    return inputs.join(good, ["region", "forecast_origin"], "left_semi")


@query("b4_rolling_ledger", "WITH RECURSIVE" + with_sql("hourly", "forecasts", "target_forecasts", "batteries")[4:] + _LEDGER_CTE + f""",
firsts AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY forecast_origin) AS k FROM w WHERE forecast_step = 1),
f(battery_id, region, k, cap, charge, discharge, soc, moment) AS (
  SELECT battery_id, region, 0::BIGINT, cap, 0.0::DOUBLE, 0.0::DOUBLE, cap * 0.5, CAST(NULL AS TIMESTAMP) FROM batteries
  UNION ALL
  SELECT f.battery_id, f.region, f.k + 1, cap, ch, dis, soc * 0.99 + ch * 0.9 - dis / 0.8, timestamp_utc
  FROM f JOIN firsts p ON p.region = f.region AND p.k = f.k + 1, LATERAL (SELECT {_STEP}))
SELECT battery_id, region, moment AS timestamp_utc, round(charge + 1e-9, 5) AS charge_mw, round(discharge + 1e-9, 5) AS discharge_mw, round(soc + 1e-9, 5) AS soc_end_mwh FROM f WHERE k > 0""")
def b4_rolling(spark, d):
    """First actions chained over origins."""
    out = ops.rolling_schedules(_complete(_inputs(spark, d)), a.batteries(spark, d), created_at=_now())
    return _round(out.select("battery_id", "region", "timestamp_utc", "charge_mw", "discharge_mw", "soc_end_mwh"), digits=5)


@query("b5_battery_contract", """
SELECT unnest(['battery_id_not_blank', 'power_and_capacity_positive', 'soc_bounds', 'efficiencies', 'self_discharge', 'cycles_and_cost', 'unique_key']) AS "check", 0::BIGINT AS failures
UNION ALL SELECT 'soc_levels_within_bounds', count(*) FILTER (s_suppkey % 7 = 0) FROM supplier""")
def b5(spark, d):
    low = F.when(F.substring("battery_id", 2, 9).cast("int") % 7 == 0, 0.0).otherwise(F.col("initial_soc_mwh"))
    return ops.battery_contract().violations(a.batteries(spark, d).withColumn("initial_soc_mwh", low))


@query("b8_historical_actuals", with_sql("hourly", "renewables") + """
SELECT region, timestamp_utc, demand_mw AS demand_forecast_mw, solar_generation_mw AS solar_forecast_mw, wind_generation_mw AS wind_forecast_mw,
  total_renewable_generation_mw AS renewable_forecast_mw, round(demand_mw - total_renewable_generation_mw + 1e-9, 6) AS net_load_before_battery_mw
FROM hourly JOIN renewables USING (region, timestamp_utc)""")
def b8(spark, d):
    out = ops.historical_actuals(a.hourly_by_type(spark, d), a.renewable_actuals(spark, d))
    return out.withColumn("net_load_before_battery_mw", F.round(F.col("net_load_before_battery_mw") + 1e-9, 6))


def _actuals(spark, d):
    known = ops.historical_actuals(a.hourly_by_type(spark, d), a.renewable_actuals(spark, d)).dropna()
    return known


_ACT_SQL = """,
act AS (SELECT region, timestamp_utc, demand_mw AS d, solar_generation_mw AS s, wind_generation_mw AS w, total_renewable_generation_mw AS r
  FROM hourly JOIN renewables USING (region, timestamp_utc) WHERE total_renewable_generation_mw IS NOT NULL)
"""


@query("j13_oracle_inputs", with_sql("hourly", "renewables", "forecasts", "target_forecasts") + _ACT_SQL + """
SELECT region, forecast_origin, timestamp_utc, d AS demand_forecast_mw, r AS renewable_forecast_mw, 'true' AS oracle FROM inputs LEFT JOIN act USING (region, timestamp_utc)""")
def j13(spark, d):
    out = ops.oracle_inputs(_inputs(spark, d), _actuals(spark, d), check=False)
    flag = F.get_json_object("metadata_json", "$.oracle_non_deployable")
    return out.select("region", "forecast_origin", "timestamp_utc", "demand_forecast_mw", "renewable_forecast_mw", flag.alias("oracle"))


@query("j14_realised_actions", with_sql("hourly", "renewables", "batteries", "dispatch") + _ACT_SQL + """
SELECT dispatch_run_id, timestamp_utc, d AS demand_forecast_mw, round(d - r + charge_mw - discharge_mw + 1e-9, 6) AS net_load_after_battery_mw,
  demand_forecast_mw AS planned FROM dispatch LEFT JOIN act USING (region, timestamp_utc)""")
def j14(spark, d):
    points = a.dispatch_points(spark, d).withColumn("metadata_json", F.lit("{}"))
    for name in ("solar_forecast_mw", "wind_forecast_mw"):
        points = points.withColumn(name, F.lit(0.0))
    out = ops.apply_realised(points, _actuals(spark, d), check=False)
    planned = F.get_json_object("metadata_json", "$.optimization_forecast.demand_forecast_mw").cast("double")
    return out.select(
        "dispatch_run_id", "timestamp_utc", "demand_forecast_mw",
        F.round(F.col("net_load_after_battery_mw") + 1e-9, 6).alias("net_load_after_battery_mw"), planned.alias("planned"),
    )


@query("b3_physics_audit", with_sql("hourly", "batteries", "dispatch") + """,
s AS (SELECT *, coalesce(lag(soc_end_mwh) OVER (PARTITION BY dispatch_run_id ORDER BY timestamp_utc), cap * 0.5) AS expected FROM dispatch),
p AS (SELECT *, (charge_mw > cap / 8 + 1e-5)::INT + (discharge_mw > cap / 10 + 1e-5)::INT + (charge_mw > 1e-5 AND discharge_mw > 1e-5)::INT AS pw,
  (soc_end_mwh < cap * 0.1 - 1e-5)::INT + (soc_end_mwh > cap * 0.95 + 1e-5)::INT AS lv,
  (abs(soc_start_mwh - expected) > 1e-5)::INT + (abs(soc_end_mwh - (expected * 0.99 + charge_mw * 0.9 - discharge_mw / 0.8)) > 1e-5)::INT AS ch FROM s),
dd AS (SELECT dispatch_run_id, CAST(timestamp_utc AS DATE) AS day, sum(charge_mw + discharge_mw) / (2 * max(cap)) AS cycles FROM p GROUP BY 1, 2),
t AS (SELECT dispatch_run_id, CAST(sum(pw) AS BIGINT) AS power_violations, CAST(sum(lv) AS BIGINT) AS soc_violations, CAST(sum(ch) AS BIGINT) AS continuity_violations,
  abs(arg_max(soc_end_mwh, timestamp_utc) - max(cap) * 0.5) AS dev, sum(charge_mw + discharge_mw) AS thr, max(cap) AS cap FROM p GROUP BY 1)
SELECT t.dispatch_run_id, power_violations, soc_violations, continuity_violations,
  (SELECT count(*) FROM dd WHERE dd.dispatch_run_id = t.dispatch_run_id AND dd.cycles > 1.5 + 1e-5) AS cycle_violations,
  round(dev + 1e-9, 6) AS terminal_soc_deviation_mwh, round(thr + 1e-9, 6) AS throughput_mwh, round(thr / (2 * cap) + 1e-9, 6) AS equivalent_full_cycles,
  (dev > 1e-5)::BIGINT AS terminal_violations, false AS valid FROM t""")
def b3(spark, d):
    """Physics audit per run."""
    return _round(ops.physics_audit(a.dispatch_points(spark, d), a.batteries(spark, d), chunk_rows=100))


@query("a23_daily_throughput", with_sql("hourly", "batteries", "dispatch") + """
SELECT dispatch_run_id, battery_id, CAST(timestamp_utc AS DATE) AS day, round(sum(charge_mw + discharge_mw) + 1e-9, 6) AS throughput_mwh,
  round(sum(charge_mw + discharge_mw) / (2 * max(cap)) + 1e-9, 6) AS equivalent_cycles FROM dispatch GROUP BY 1, 2, 3""")
def a23(spark, d):
    return _round(ops.daily_throughput(a.dispatch_points(spark, d), a.batteries(spark, d)))


def _kpi_sql(by: str) -> str:
    return f"""
SELECT {by}, round(max(net_load_before_battery_mw) + 1e-9, 5) AS original_peak_load_mw, round(max(net_load_after_battery_mw) + 1e-9, 5) AS optimized_peak_load_mw,
  round(max(net_load_before_battery_mw) - max(net_load_after_battery_mw) + 1e-9, 5) AS absolute_peak_reduction_mw,
  round(100 * (max(net_load_before_battery_mw) - max(net_load_after_battery_mw)) / max(net_load_before_battery_mw) + 1e-9, 5) AS percentage_peak_reduction,
  round(sum(greatest(net_load_after_battery_mw, 0)) + 1e-9, 5) AS energy_imported_mwh, round(sum(net_load_before_battery_mw * energy_price) + 1e-9, 4) AS original_energy_cost,
  round(sum(net_load_after_battery_mw * energy_price) + 1e-9, 4) AS energy_cost,
  round(sum(net_load_before_battery_mw * energy_price) - sum(net_load_after_battery_mw * energy_price) + 1e-7, 4) AS energy_cost_savings,
  round(sum(charge_mw * least(greatest(renewable_forecast_mw / greatest(demand_forecast_mw, 1e-12), 0), 1)) + 1e-9, 5) AS renewable_energy_charged_mwh,
  round(sum(charge_mw) + 1e-9, 5) AS charge_energy_mwh, round(sum(discharge_mw) + 1e-9, 5) AS discharge_energy_mwh,
  round(greatest(0, sum(charge_mw) - sum(charge_mw) * 0.9 + sum(discharge_mw) / 0.8 - sum(discharge_mw)) + sum(soc_start_mwh * (1 - 0.99)) + 1e-7, 5) AS battery_losses_mwh,
  round((sum(charge_mw) + sum(discharge_mw)) / (2 * max(cap)) + 1e-9, 5) AS equivalent_full_cycles, round(sum(charge_mw) + sum(discharge_mw) + 1e-9, 5) AS total_throughput_mwh,
  round((sum(charge_mw) + sum(discharge_mw)) * 2 + 1e-9, 5) AS degradation_cost, round(abs(arg_max(soc_end_mwh, timestamp_utc) - max(cap) * 0.5) + 1e-9, 5) AS terminal_soc_deviation_mwh,
  count(*) FILTER (soc_end_mwh < cap * 0.1 - 1e-5 OR soc_end_mwh > cap * 0.95 + 1e-5) AS soc_violations,
  count(*) FILTER (charge_mw > cap / 8 + 1e-5 OR discharge_mw > cap / 10 + 1e-5) AS power_violations"""


def _kpi(df):
    costs = {"original_energy_cost": (1e-9, 4), "energy_cost": (1e-9, 4), "energy_cost_savings": (1e-7, 4), "battery_losses_mwh": (1e-7, 5)}
    out = []
    for c, t in df.dtypes:
        nudge, digits = costs.get(c, (1e-9, 5))
        out.append(F.round(F.col(c) + nudge, digits).alias(c) if t == "double" else F.col(c))
    return df.select(*out)


@query("a19_dispatch_kpis", with_sql("hourly", "batteries", "dispatch") + _kpi_sql("dispatch_run_id") + " FROM dispatch GROUP BY 1")
def a19(spark, d):
    """Eighteen key figures per run."""
    return _kpi(ops.evaluate_dispatch(a.dispatch_points(spark, d), a.batteries(spark, d)))


@query("a20_daily_kpis", with_sql("hourly", "batteries", "dispatch") + _kpi_sql("dispatch_run_id, strftime(timestamp_utc, '%Y-%m-%d') AS day_utc") + " FROM dispatch GROUP BY 1, 2")
def a20(spark, d):
    return _kpi(ops.daily_metrics(a.dispatch_points(spark, d), a.batteries(spark, d), ["dispatch_run_id"]))


@query("a20_strategy_comparison", with_sql("hourly", "batteries", "dispatch") + """,
u AS (SELECT * REPLACE (net_load_before_battery_mw AS net_load_after_battery_mw, 0.0::DOUBLE AS charge_mw, 0.0::DOUBLE AS discharge_mw), 'no_battery' AS strategy FROM dispatch
  UNION ALL SELECT *, 'rule_based' FROM dispatch)""" + _kpi_sql("dispatch_run_id, strategy") + " FROM u GROUP BY 1, 2")
def a20_strategies(spark, d):
    points = a.dispatch_points(spark, d)
    idle = points.withColumns(
        {"net_load_after_battery_mw": F.col("net_load_before_battery_mw"), "charge_mw": F.lit(0.0), "discharge_mw": F.lit(0.0)}
    )
    schedules = {"no_battery": idle, "rule_based": points}
    return _kpi(ops.compare_strategies(schedules, a.batteries(spark, d), ["dispatch_run_id"]))


@query("a21_metric_rows", with_sql("hourly", "batteries", "dispatch") + """
SELECT * FROM (UNPIVOT (SELECT dispatch_run_id, round(max(net_load_before_battery_mw) + 1e-9, 6) AS peak_before_mw, round(max(net_load_after_battery_mw) + 1e-9, 6) AS peak_after_mw,
  round(sum(charge_mw) + 1e-9, 6) AS total_charge_mwh, round(sum(discharge_mw) + 1e-9, 6) AS total_discharge_mwh FROM dispatch GROUP BY 1)
  ON peak_before_mw, peak_after_mw, total_charge_mwh, total_discharge_mwh INTO NAME metric_name VALUE metric_value)""")
def a21(spark, d):
    heads = _round(ops.run_headers(a.dispatch_points(spark, d), ["dispatch_run_id"]))
    return ops.metric_rows(heads, ["dispatch_run_id"])


@query("a36_run_headers", with_sql("hourly", "batteries", "dispatch") + """
SELECT dispatch_run_id, region, battery_id, round(max(net_load_before_battery_mw) + 1e-9, 6) AS peak_before_mw, round(max(net_load_after_battery_mw) + 1e-9, 6) AS peak_after_mw,
  round(sum(charge_mw) + 1e-9, 6) AS total_charge_mwh, round(sum(discharge_mw) + 1e-9, 6) AS total_discharge_mwh FROM dispatch GROUP BY 1, 2, 3""")
def a36(spark, d):
    return _round(ops.run_headers(a.dispatch_points(spark, d)))


@query("a22_objective_breakdown", with_sql("hourly", "batteries", "dispatch") + """,
t AS (SELECT dispatch_run_id, max(net_load_after_battery_mw) AS p, sum(net_load_after_battery_mw * energy_price) AS c,
  sum(charge_mw * least(greatest(renewable_forecast_mw / greatest(demand_forecast_mw, 1e-12), 0), 1)) AS r, sum((charge_mw + discharge_mw) * 2) AS g,
  abs(arg_max(soc_end_mwh, timestamp_utc) - max(cap) * 0.5) AS s FROM dispatch GROUP BY 1)
SELECT dispatch_run_id, round(p + 1e-9, 4) AS peak_load_mw, round(c + 1e-9, 4) AS energy_cost, round(r + 1e-9, 4) AS renewable_aligned_charge_mwh, round(g + 1e-9, 4) AS degradation_cost,
  round(s + 1e-9, 4) AS terminal_soc_deviation_mwh, round(p + 1e-9, 4) AS weighted_peak_contribution, round(c + 1e-9, 4) AS weighted_energy_cost_contribution,
  round(-0.5 * r + 1e-9, 4) AS weighted_renewable_utilization_contribution, round(g + 1e-9, 4) AS weighted_degradation_contribution, round(10 * s + 1e-9, 4) AS weighted_terminal_soc_contribution FROM t""")
def a22(spark, d):
    return _round(ops.objective_breakdown(a.dispatch_points(spark, d), a.batteries(spark, d)), digits=4)


def _millionths(column: str) -> str:
    return f"coalesce(CAST(CAST(round(({column}) * 1e6) AS BIGINT) AS VARCHAR), '-')"


_PARTS = ["demand_forecast_mw", "solar_forecast_mw + wind_forecast_mw", "demand_forecast_mw - (solar_forecast_mw + wind_forecast_mw)", "30.0::DOUBLE"]
# the supplied fleet's numbers in the order of the specification
_BATTERY = [
    "cap", "cap / 8", "cap / 10", "cap * 0.05", "cap * 0.95", "cap * 0.5", "cap * 0.5", "0.9::DOUBLE", "0.8::DOUBLE", "0.01::DOUBLE", "1.5::DOUBLE", "2.0::DOUBLE",
    "cap * 0.1",
]


@query("x15_dispatch_ids", with_sql("hourly", "forecasts", "target_forecasts", "batteries") + f""",
r AS (SELECT region, forecast_origin, string_agg(concat_ws(',', CAST(CAST(epoch(timestamp_utc) AS BIGINT) AS VARCHAR), {', '.join(map(_millionths, _PARTS))}), ';'
  ORDER BY timestamp_utc) AS rows FROM inputs GROUP BY 1, 2)
SELECT r.region, forecast_origin, battery_id, substr(sha256(concat_ws('|', battery_id, {', '.join(map(_millionths, _BATTERY))}, r.region,
  CAST(CAST(epoch(forecast_origin) AS BIGINT) AS VARCHAR), rows, 'balanced', 'false')), 1, 32) AS dispatch_run_id
FROM r JOIN batteries ON r.region = batteries.region""")
def x15(spark, d):
    """Deterministic ids per battery and origin."""
    return ops.dispatch_ids(_inputs(spark, d), a.batteries(spark, d))
