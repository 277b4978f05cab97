"""Rules, residuals, ensemble, alerts and label scoring over the supplied tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from kilohour.contracts import anomaly_events
from kilohour.functions import scoring, text
from kilohour.functions.ordered import exact_quantiles, walk
from kilohour.operators import alerts, backtest, ensemble, residuals
from kilohour.operators.events import event, to_events, union_events
from kilohour.operators.rules import RuleSettings, Rules
from kilohour.plans import adapters as a
from kilohour.plans import jobs
from kilohour.plans.adapters import with_sql
from kilohour.queries.registry import query
from kilohour.series import SeriesSpec
from kilohour.session import cut_lineage, shared_folder
from kilohour.streaming.keyed import alerts_of, keyed_alert_stream

CHUNK = 100
NOW = "2024-01-31 12:00:00"


def _now():
    return F.lit(NOW).cast("timestamp")


def _rules(target="demand_mw", **options):
    return Rules(target, _now(), chunk_rows=CHUNK, **options)


_BRIEF = ("anomaly_id", "region", "timestamp_utc", "anomaly_type", "anomaly_score", "severity")


def _brief(events, *more):
    rounded = [F.round(c, 6).alias(c) if c in ("anomaly_score", "observed_value", "expected_value", "residual") else F.col(c) for c in (*_BRIEF, *more)]
    return events.select(*rounded)


def _id_sql(kind: str, target: str = "'demand_mw'", detector: str = "'rules'", ts: str = "timestamp_utc") -> str:
    stamp = f"strftime({ts}, '%Y-%m-%dT%H:%M:%SZ')"
    return f"substring(sha256(region || '|' || {target} || '|' || {stamp} || '|' || {detector} || '|1|' || {kind}), 1, 32)"


def _event_sql(kind: str, score: str, severity: str, source: str, target: str = "'demand_mw'", more: str = "", ts: str = "timestamp_utc") -> str:
    return f"""SELECT {_id_sql(kind, target, ts=ts)} AS anomaly_id, region, {ts} AS timestamp_utc, {kind} AS anomaly_type,
  round(CAST({score} AS DOUBLE), 6) AS anomaly_score, {severity} AS severity{more} FROM {source}"""


_RAW_KEYS = """WITH dup AS (SELECT event_type AS region, date_trunc('hour', ts) AS timestamp_utc, event_id AS seq,
  CAST(CAST(value AS DECIMAL(18,2)) AS DOUBLE) AS demand_mw FROM events)
"""


def _duplicated(spark, d):
    """Raw readings: several per hour, in arrival order."""
    return a.events(spark, d).select(
        F.col("event_type").alias("region"), F.date_trunc("HOUR", "ts").alias("timestamp_utc"),
        F.col("event_id").alias("seq"), F.col("value").cast("decimal(18,2)").cast("double").alias("demand_mw"),
    )


@query("d1a_duplicate_timestamps", _RAW_KEYS + _event_sql("'duplicate_timestamp'", "75", "'critical'",
       "(SELECT region, timestamp_utc FROM dup GROUP BY 1, 2 HAVING count(*) > 1)"))
def d1a(spark, d):
    return _brief(_rules().duplicates(_duplicated(spark, d)))


@query("d1b_backward_arrivals", """WITH m AS (SELECT event_type AS region, event_id, date_trunc('hour', ts) - INTERVAL 1 HOUR * (user_id % 3) AS timestamp_utc FROM events),
p AS (SELECT *, lag(timestamp_utc) OVER (PARTITION BY region ORDER BY event_id) AS prev FROM m),
b AS (SELECT DISTINCT region, timestamp_utc FROM p WHERE timestamp_utc < prev)
""" + _event_sql("'non_monotonic_timestamp'", "55", "'warning'", "b"))
def d1b(spark, d):
    rows = a.events(spark, d).select(
        F.col("event_type").alias("region"), "event_id",
        F.timestamp_micros(F.unix_micros(F.date_trunc("HOUR", "ts")) - (F.col("user_id") % 3) * 3_600_000_000).alias("timestamp_utc"),
    )
    return _brief(_rules(sequence="event_id").backward_arrivals(rows))


@query("d1c_unexpected_frequency", with_sql("hourly") + """,
p AS (SELECT *, lag(timestamp_utc) OVER (PARTITION BY region ORDER BY timestamp_utc) AS prev FROM hourly)
""" + _event_sql("'unexpected_frequency'", "50", "'warning'", "p WHERE timestamp_utc - prev <> INTERVAL 1 HOUR"))
def d1c(spark, d):
    rules = _rules()
    events = rules.row_rules(rules.linked_rows(rules.unique_rows(a.hourly_by_type(spark, d))))
    return _brief(events.where("anomaly_type = 'unexpected_frequency'"))


@query("d1d_missing_timestamps", with_sql("hourly") + """,
p AS (SELECT region, timestamp_utc AS e, lag(timestamp_utc) OVER (PARTITION BY region ORDER BY timestamp_utc) AS s FROM hourly),
g AS (SELECT region, unnest(generate_series(s + INTERVAL 1 HOUR, e - INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS timestamp_utc,
  date_diff('hour', s, e) - 1 AS gap FROM p WHERE date_diff('hour', s, e) > 1)
""" + _event_sql("'missing_timestamp'", "CASE WHEN gap >= 3 THEN 80 ELSE 45 END", "CASE WHEN gap >= 3 THEN 'critical' ELSE 'warning' END", "g"))
def d1d(spark, d):
    rules = _rules()
    events = rules.row_rules(rules.linked_rows(rules.unique_rows(a.hourly_by_type(spark, d))))
    return _brief(events.where("anomaly_type = 'missing_timestamp'"))


@query("d1e_invalid_values", with_sql("hourly") + """,
b AS (SELECT region, timestamp_utc, CASE WHEN readings % 7 = 0 THEN NULL ELSE demand_mw - 20 END AS v FROM hourly)
""" + _event_sql("'invalid_value'", "90", "'critical'", "b WHERE v IS NULL OR v < 0", more=", round(v, 6) AS observed_value"))
def d1e(spark, d):
    value = F.when(F.col("readings") % 7 == 0, None).otherwise(F.col("demand_mw") - 20)
    rows = a.hourly_by_type(spark, d).withColumn("demand_mw", value)
    return _brief(_rules().invalid_values(rows), "observed_value")


@query("d1f_weather_ranges", with_sql("hourly", "regional_weather") + _event_sql("'invalid_value'", "80", "'critical'",
       "regional_weather WHERE relative_humidity_pct > 100 OR cloud_cover_pct > 100",
       more=", '{\"features\":[' || CASE WHEN cloud_cover_pct > 100 THEN '\"cloud_cover_pct\"' || CASE WHEN relative_humidity_pct > 100 THEN ',' ELSE '' END ELSE '' END"
            " || CASE WHEN relative_humidity_pct > 100 THEN '\"relative_humidity_pct\"' ELSE '' END || ']}' AS feature_summary"))
def d1f(spark, d):
    series = a.hourly_by_type(spark, d)
    return _brief(_rules().invalid_values(series, a.regional_weather(spark, d)), "feature_summary")


def _change_sql(limit: str, kinds: str, source: str = "hourly", value: str = "demand_mw") -> str:
    score = "least(abs((v - p) / abs(p)) / " + limit + ", 1) * 45 + 2.5::DOUBLE + 20.0::DOUBLE / 3 + 20.0::DOUBLE / 3 + 1"
    return f""",
c AS (SELECT region, timestamp_utc, {value} AS v, lag({value}) OVER w AS p, lag(timestamp_utc) OVER w AS pt FROM {source}
  WINDOW w AS (PARTITION BY region ORDER BY timestamp_utc)),
k AS (SELECT *, {score} AS score, {kinds} AS kind FROM c WHERE timestamp_utc - pt = INTERVAL 1 HOUR AND p <> 0)
"""


@query("d1g_demand_changes", with_sql("hourly") + _change_sql("0.2", "CASE WHEN (v - p) / abs(p) >= 0.2 THEN 'demand_spike' WHEN (v - p) / abs(p) <= -0.2 THEN 'demand_drop' END")
       + _event_sql("kind", "score", "'warning'", "k WHERE kind IS NOT NULL", more=", v AS observed_value, p AS expected_value, round(v - p, 6) AS residual"))
def d1g(spark, d):
    """Sudden demand changes with severity score and band."""
    rules = _rules()
    events = rules.row_rules(rules.linked_rows(rules.unique_rows(a.hourly_by_type(spark, d))))
    return _brief(events.where("anomaly_type LIKE 'demand%'"), "observed_value", "expected_value", "residual")


@query("d1g_wind_drops", with_sql("hourly") + _change_sql("0.3", "CASE WHEN (v - p) / abs(p) <= -0.3 THEN 'renewable_drop' END")
       + _event_sql("kind", "score", "'warning'", "k WHERE kind IS NOT NULL", "'wind_generation_mw'"))
def d1g_wind(spark, d):
    rules = _rules("wind_generation_mw")
    rows = a.target_series(spark, d, "wind_generation_mw")
    events = rules.row_rules(rules.linked_rows(rules.unique_rows(rows)))
    return _brief(events.where("anomaly_type = 'renewable_drop'"))


# The run search as recursion over rows: state is (row, anchor of the open run, its start, its length).
@query("d1h_solar_collapses", """WITH RECURSIVE""" + a.SQL["hourly"] + """,
r AS (SELECT row_number() OVER (PARTITION BY region ORDER BY timestamp_utc) AS n, region, timestamp_utc, demand_mw * 10 AS v,
  hour(timestamp_utc) BETWEEN 6 AND 18 AS day, coalesce(timestamp_utc - lag(timestamp_utc) OVER (PARTITION BY region ORDER BY timestamp_utc) = INTERVAL 1 HOUR, false) AS adj,
  lag(demand_mw * 10) OVER (PARTITION BY region ORDER BY timestamp_utc) AS p FROM hourly),
f(region, n, anchor, start, first, len, done, done_anchor, done_start, done_first, done_len) AS (
  SELECT region, n, CAST(NULL AS DOUBLE), CAST(NULL AS TIMESTAMP), CAST(NULL AS DOUBLE), 0, false, CAST(NULL AS DOUBLE), CAST(NULL AS TIMESTAMP), CAST(NULL AS DOUBLE), 0 FROM r WHERE n = 1
  UNION ALL
  SELECT r.region, r.n,
    CASE WHEN stay THEN f.anchor WHEN go THEN r.p END, CASE WHEN stay THEN f.start WHEN go THEN r.timestamp_utc END,
    CASE WHEN stay THEN f.first WHEN go THEN r.v END, CASE WHEN stay THEN f.len + 1 WHEN go THEN 1 ELSE 0 END,
    f.anchor IS NOT NULL AND NOT stay, f.anchor, f.start, f.first, f.len
  FROM f JOIN r ON r.region = f.region AND r.n = f.n + 1,
  LATERAL (SELECT coalesce(r.adj AND r.day AND f.anchor - r.v >= 100 AND (f.anchor - r.v) / f.anchor >= 0.3, false) AS stay,
    coalesce(r.adj AND r.day AND r.p >= 100 AND r.p - r.v >= 100 AND (r.p - r.v) / r.p >= 0.3, false) AS go)),
runs AS (SELECT region, done_anchor AS anchor, done_start AS start, done_first AS first, done_len AS len FROM f WHERE done
  UNION ALL SELECT region, anchor, start, first, len FROM f WHERE anchor IS NOT NULL AND n = (SELECT max(n) FROM r WHERE r.region = f.region)),
s AS (SELECT *, (anchor - first) / anchor * 45 + least(len / 6.0::DOUBLE, 1) * 15 + 20.0::DOUBLE / 3 + 20.0::DOUBLE / 3 + 1 AS score FROM runs WHERE len >= 2)
""" + _event_sql("'renewable_drop'", "score", "CASE WHEN score >= 70 THEN 'critical' WHEN score >= 30 THEN 'warning' ELSE 'info' END", "s", "'solar_generation_mw'", more=", round(first, 6) AS observed_value, round(anchor, 6) AS expected_value", ts="start"))
def d1h(spark, d):
    """Daylight runs far below the value before the drop."""
    rules = _rules("solar_generation_mw")
    rows = a.hourly_by_type(spark, d).select(
        "region", "timestamp_utc", (F.col("demand_mw") * 10).alias("solar_generation_mw"),
        a._radiation(F.hour("timestamp_utc")).alias("shortwave_radiation_wm2"),
    )
    return _brief(rules.solar_collapses(rules.unique_rows(rows)), "observed_value", "expected_value")


@query("d1i_flatlines", with_sql("hourly") + """,
q AS (SELECT region, timestamp_utc, CAST(floor(readings / 3) AS DOUBLE) AS v FROM hourly),
b AS (SELECT *, CASE WHEN abs(v - lag(v) OVER w) <= 0 AND timestamp_utc - lag(timestamp_utc) OVER w = INTERVAL 1 HOUR THEN 0 ELSE 1 END AS brk
  FROM q WINDOW w AS (PARTITION BY region ORDER BY timestamp_utc)),
g AS (SELECT *, sum(brk) OVER (PARTITION BY region ORDER BY timestamp_utc) AS run FROM b),
f AS (SELECT region, max(timestamp_utc) AS timestamp_utc, count(*) AS n, max(v) AS v FROM g GROUP BY region, run HAVING count(*) >= 4)
""" + _event_sql("'flatline'", "50", "'warning'", "f", more=", v AS observed_value"))
def d1i(spark, d):
    """Runs of unchanged consecutive values."""
    rules = _rules()
    rows = a.hourly_by_type(spark, d).withColumn("demand_mw", F.floor(F.col("readings") / 3).cast("double"))
    return _brief(rules.flatlines(rules.linked_rows(rules.unique_rows(rows))), "observed_value")


@query("d1j_stale_observations", with_sql("hourly") + """,
l AS (SELECT region, max(timestamp_utc) AS timestamp_utc FROM hourly GROUP BY 1)
""" + _event_sql("'stale_observation'", "40", "'warning'", "l WHERE TIMESTAMP '2024-01-31 12:00:00' - timestamp_utc > INTERVAL 12 HOUR"))
def d1j(spark, d):
    rules = _rules(settings=RuleSettings(stale_hours=12))
    return _brief(rules.stale(a.hourly_by_type(spark, d)))


@query("d1k_weather_coverage", with_sql("hourly", "regional_weather") + """,
u AS (SELECT region, timestamp_utc FROM hourly EXCEPT SELECT region, timestamp_utc FROM regional_weather)
""" + _event_sql("'weather_grid_mismatch'", "45", "'warning'", "u"))
def d1k(spark, d):
    rows, weather = a.hourly_by_type(spark, d), a.regional_weather(spark, d)
    return _brief(_rules().coverage(rows, weather, "weather_grid_mismatch", "no weather"))


@query("d1k_forecast_coverage", with_sql("hourly", "regional_weather", "forecasts") + """,
u AS (SELECT region, timestamp_utc FROM forecasts EXCEPT SELECT region, timestamp_utc FROM regional_weather)
""" + _event_sql("'weather_grid_mismatch'", "45", "'warning'", "u"))
def d1k_forecast(spark, d):
    return _brief(_rules().forecast_coverage(a.forecasts(spark, d), a.regional_weather(spark, d)))


def _demand_events(spark, d):
    rules = _rules()
    return rules.detect(a.hourly_by_type(spark, d), weather=a.regional_weather(spark, d), renewables=a.renewable_actuals(spark, d))


_RULE_PARTS = """,
pv AS (SELECT *, lag(timestamp_utc) OVER w AS pt, lag(demand_mw) OVER w AS p FROM hourly WINDOW w AS (PARTITION BY region ORDER BY timestamp_utc)),
ev AS (
  SELECT region, timestamp_utc, 'unexpected_frequency' AS kind, 50.0::DOUBLE AS score, 'warning' AS severity FROM pv WHERE timestamp_utc - pt <> INTERVAL 1 HOUR
  UNION ALL SELECT region, unnest(generate_series(pt + INTERVAL 1 HOUR, timestamp_utc - INTERVAL 1 HOUR, INTERVAL 1 HOUR)), 'missing_timestamp',
    CASE WHEN date_diff('hour', pt, timestamp_utc) >= 4 THEN 80 ELSE 45 END, CASE WHEN date_diff('hour', pt, timestamp_utc) >= 4 THEN 'critical' ELSE 'warning' END
    FROM pv WHERE date_diff('hour', pt, timestamp_utc) > 1
  UNION ALL SELECT region, timestamp_utc, CASE WHEN demand_mw > p THEN 'demand_spike' ELSE 'demand_drop' END, 45 + 2.5::DOUBLE + 40.0::DOUBLE / 3 + 1, 'warning'
    FROM pv WHERE timestamp_utc - pt = INTERVAL 1 HOUR AND p <> 0 AND abs(demand_mw - p) / abs(p) >= 0.2
  UNION ALL SELECT region, timestamp_utc, 'weather_grid_mismatch', 45, 'warning' FROM (SELECT region, timestamp_utc FROM hourly EXCEPT SELECT region, timestamp_utc FROM regional_weather)
  UNION ALL SELECT region, timestamp_utc, 'coverage_mismatch', 45, 'warning' FROM (SELECT region, timestamp_utc FROM hourly EXCEPT SELECT region, timestamp_utc FROM renewables)),
evid AS (SELECT *, """ + _id_sql("kind") + """ AS anomaly_id FROM ev)
"""


@query("d1_rule_detection", with_sql("hourly", "regional_weather", "renewables") + _RULE_PARTS + """
SELECT anomaly_id, region, timestamp_utc, kind AS anomaly_type, round(score, 6) AS anomaly_score, severity FROM evid""")
def d1(spark, d):
    """All rules of one target together."""
    return _brief(_demand_events(spark, d))


@query("p11_event_contract", with_sql("hourly", "regional_weather", "renewables") + _RULE_PARTS + """
SELECT unnest(['timestamp_utc_present', 'detected_at_utc_present', 'severity_known', 'score_range', 'feature_summary_json', 'metadata_json_json', 'unique_key']) AS "check", 0::BIGINT AS failures
UNION ALL SELECT 'anomaly_type_known', count(*) FROM ev WHERE kind = 'demand_drop'""")
def p11(spark, d):
    """Event contract over rule events, one type renamed to an unknown one."""
    kind = F.when(F.col("anomaly_type") == "demand_drop", "mystery").otherwise(F.col("anomaly_type"))
    return anomaly_events().violations(_demand_events(spark, d).withColumn("anomaly_type", kind))


_ALIGNED = """,
latest AS (SELECT * FROM forecasts WHERE forecast_origin < timestamp_utc
  QUALIFY row_number() OVER (PARTITION BY region, timestamp_utc ORDER BY forecast_origin DESC, model_name DESC, model_version DESC) = 1),
al AS (SELECT h.region, h.timestamp_utc, h.demand_mw, l.predicted_value, l.forecast_origin, l.model_name, h.demand_mw - l.predicted_value AS residual
  FROM hourly h JOIN latest l USING (region, timestamp_utc))
"""
_SCORED = _ALIGNED + """,
numbered AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY timestamp_utc) AS n FROM al),
past AS (SELECT a.region, a.timestamp_utc, count(b.n) AS history_rows, avg(b.residual) AS mean, stddev_samp(b.residual) AS std,
    median(b.residual) AS med, list(b.residual) FILTER (b.n IS NOT NULL) AS vals
  FROM numbered a LEFT JOIN numbered b ON b.region = a.region AND b.n BETWEEN a.n - 48 AND a.n - 1 GROUP BY 1, 2),
mads AS (SELECT *, list_aggregate(list_transform(vals, lambda v: abs(v - med)), 'median') AS mad FROM past),
scored AS (SELECT al.*, history_rows, mean, std, med, mad, (residual - mean) / nullif(std, 0) AS z, 0.6745 * (residual - med) / nullif(mad, 0) AS m
  FROM al JOIN mads USING (region, timestamp_utc))
"""
_SETTINGS = residuals.ResidualSettings(min_history=24, window=48)


@query("j7_latest_forecast", with_sql("hourly", "forecasts") + _ALIGNED + """
SELECT region, timestamp_utc, demand_mw, predicted_value, forecast_origin, model_name, round(residual, 6) AS residual FROM al""")
def j7(spark, d):
    """Newest forecast strictly before each hour."""
    aligned = residuals.latest_forecasts(a.hourly_by_type(spark, d), a.forecasts(spark, d), "demand_mw")
    return aligned.select(
        "region", "timestamp_utc", "demand_mw", "predicted_value", "forecast_origin", "model_name",
        F.round(F.col("demand_mw") - F.col("predicted_value"), 6).alias("residual"),
    )


def _scored(spark, d):
    aligned = residuals.latest_forecasts(a.hourly_by_type(spark, d), a.forecasts(spark, d), "demand_mw")
    return residuals.score_residuals(aligned, "demand_mw", _SETTINGS, CHUNK)


@query("w9_prior_residual_window", with_sql("hourly", "forecasts") + _SCORED + """
SELECT region, timestamp_utc, history_rows, round(mean + 1e-8, 5) AS rolling_residual_mean, round(std + 1e-8, 5) AS rolling_residual_std,
  round(med + 1e-8, 5) AS prior_residual_median, round(mad + 1e-8, 5) AS prior_residual_mad FROM scored""")
def w9(spark, d):
    names = ["rolling_residual_mean", "rolling_residual_std", "prior_residual_median", "prior_residual_mad"]
    return _scored(spark, d).select("region", "timestamp_utc", "history_rows", *[F.round(F.col(c) + 1e-8, 5).alias(c) for c in names])


@query("x11_residual_scores", with_sql("hourly", "forecasts") + _SCORED + """
SELECT region, timestamp_utc, round(z, 4) AS residual_zscore, round(m, 4) AS residual_mad_score, round(residual / nullif(abs(predicted_value), 0), 6) AS percentage_residual
FROM scored WHERE history_rows > 3""")
def x11(spark, d):
    return _scored(spark, d).where("history_rows > 3").select(
        "region", "timestamp_utc", F.round("residual_zscore", 4).alias("residual_zscore"),
        F.round("residual_mad_score", 4).alias("residual_mad_score"),
        F.round("percentage_residual", 6).alias("percentage_residual"),
    )


@query("d2_residual_events", with_sql("hourly", "forecasts") + _SCORED + """,
lv AS (SELECT *, greatest(abs(z) / 2.5, abs(m) / 3.5) AS level, abs(z) >= 4 OR abs(m) >= 6 AS critical FROM scored WHERE history_rows >= 24)
SELECT """ + _id_sql("CASE WHEN residual > 0 THEN 'unexpected_demand_spike' ELSE 'unexpected_demand_drop' END", detector="'residual'") + """ AS anomaly_id, region, timestamp_utc,
  CASE WHEN residual > 0 THEN 'unexpected_demand_spike' ELSE 'unexpected_demand_drop' END AS anomaly_type,
  round(CASE WHEN critical THEN least(100, 70 + 10 * (level - 1)) ELSE least(69, 30 + 20 * (level - 1)) END, 4) AS anomaly_score,
  CASE WHEN critical THEN 'critical' ELSE 'warning' END AS severity, forecast_origin, model_name FROM lv WHERE level >= 1""")
def d2(spark, d):
    """Residual events of one target."""
    events = residuals.residual_events(_scored(spark, d), "demand_mw", _now(), _SETTINGS)
    out = _brief(events, "forecast_origin", "model_name")
    return out.withColumn("anomaly_score", F.round("anomaly_score", 4))


@query("x13_residual_daylight", with_sql("hourly", "regional_weather") + """
SELECT region, timestamp_utc, coalesce(shortwave_radiation_wm2 > 0, hour(timestamp_utc) BETWEEN 6 AND 18) AS daylight
FROM hourly LEFT JOIN regional_weather USING (region, timestamp_utc)""")
def x13(spark, d):
    from kilohour.operators.joins import GRID_KEYS, left_context

    rows = left_context(a.hourly_by_type(spark, d), a.regional_weather(spark, d), GRID_KEYS, ["shortwave_radiation_wm2"])
    day = scoring.residual_daylight(F.col("shortwave_radiation_wm2"), F.col("timestamp_utc"))
    return rows.select("region", "timestamp_utc", day.alias("daylight"))


@query("x9_severity_scores", """
SELECT l_orderkey, l_linenumber, round(s, 6) AS score, CASE WHEN s >= 70 THEN 'critical' WHEN s >= 30 THEN 'warning' ELSE 'info' END AS severity FROM (
SELECT *, least(greatest(least(greatest(l_discount * 15, 0), 1) * 45 + least(greatest(l_linenumber, 1) / 6.0::DOUBLE, 1) * 15
  + least(greatest(l_suppkey % 4, 1) / 3.0::DOUBLE, 1) * 20 + least(greatest(l_tax * 30, 0), 1.5) / 1.5::DOUBLE * 10
  + least(greatest(l_partkey % 7, 1) / 5.0::DOUBLE, 1) * 5 - (1 - least(greatest(l_quantity / 50, 0), 1)) * 5, 0), 100) AS s FROM lineitem)""")
def x9(spark, d):
    """Severity score and band over line items."""
    c = F.col
    score = scoring.severity_score(
        c("l_discount") * 15, duration_hours=c("l_linenumber"), detector_count=c("l_suppkey") % 4,
        target_importance=c("l_tax") * 30, completeness=c("l_quantity") / 50, recurrence=c("l_partkey") % 7,
    )
    rows = a.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", score.alias("s"))
    return rows.select("l_orderkey", "l_linenumber", F.round("s", 6).alias("score"), scoring.severity_band(c("s")).alias("severity"))


@query("x19_alert_text", """
SELECT event_id, upper(substring(event_type, 1, 1)) || substring(event_type, 2) || ' user lane ' || CAST(user_id % 9 AS VARCHAR) || ' in ' || event_type AS title,
  printf('%.1f%%', CAST(round(CAST(value AS DECIMAL(18, 2)), 1) AS DOUBLE)) AS pct FROM events""")
def x19(spark, d):
    """Title and percent text."""
    rows = a.events(spark, d)
    kind = F.concat(F.lit("user_lane_"), (F.col("user_id") % 9).cast("string"))
    return rows.select(
        "event_id", text.alert_title(F.col("event_type"), kind, F.col("event_type")).alias("title"),
        text.percent_text(F.round(F.col("value").cast("decimal(18,2)"), 1).cast("double") / 100.0).alias("pct"),
    )


@query("e1_ensemble", with_sql("hourly", "regional_weather", "renewables") + _RULE_PARTS + """,
g AS (SELECT region, timestamp_utc, count(*) AS n, max(score) AS top, count(*) FILTER (severity IN ('warning', 'critical')) AS votes,
    bool_or(severity = 'critical') AS crit, arg_max(kind, [CASE severity WHEN 'critical' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END * 1000.0 + score, 0.0]) AS k,
    list(kind ORDER BY severity = 'critical' DESC, score DESC, kind DESC)[1] AS kind FROM ev GROUP BY 1, 2),
s AS (SELECT *, least(top / 100, 1) * 45 + 2.5::DOUBLE + 20.0::DOUBLE / 3 + 20.0::DOUBLE / 3 + 1 AS sc FROM g)
SELECT region, timestamp_utc, kind AS anomaly_type, round(sc, 6) AS anomaly_score,
  CASE WHEN crit THEN 'critical' WHEN sc >= 70 THEN 'critical' WHEN sc >= 30 OR votes >= 2 THEN 'warning' ELSE 'info' END AS severity FROM s""")
def e1(spark, d):
    """One combined event per region and hour."""
    return _brief(ensemble.combine(_demand_events(spark, d), _now())).drop("anomaly_id")


@query("e2_detection_job", with_sql("hourly", "regional_weather", "renewables") + _RULE_PARTS + """,
g AS (SELECT region, timestamp_utc, max(score) AS top, count(*) FILTER (severity IN ('warning', 'critical')) AS votes, bool_or(severity = 'critical') AS crit,
    list(kind ORDER BY severity = 'critical' DESC, score DESC, kind DESC)[1] AS kind FROM ev GROUP BY 1, 2),
s AS (SELECT *, least(top / 100, 1) * 45 + 2.5::DOUBLE + 20.0::DOUBLE / 3 + 20.0::DOUBLE / 3 + 1 AS sc FROM g)
SELECT region, timestamp_utc, kind AS anomaly_type, round(score, 6) AS anomaly_score, severity FROM ev
UNION ALL SELECT region, timestamp_utc, kind, round(sc, 6),
  CASE WHEN crit THEN 'critical' WHEN sc >= 70 THEN 'critical' WHEN sc >= 30 OR votes >= 2 THEN 'warning' ELSE 'info' END FROM s""")
def e2(spark, d):
    """The whole detection job: every rule's events and the combined ones, before alerts are made of them."""
    made = jobs.detect_and_alert(
        {"demand_mw": a.hourly_by_type(spark, d)}, start=F.lit("2000-01-01").cast("timestamp"), end=_now(),
        weather_rows=a.regional_weather(spark, d), renewables=a.renewable_actuals(spark, d), chunk_rows=CHUNK,
    )
    return _brief(made.events).drop("anomaly_id")


# Events of three detectors on the same hours: the rules, a residual detector and a forest, the latter two by reading counts.
_DETECTORS_SQL = """,
ev3 AS (SELECT region, timestamp_utc, 'rules' AS detector, kind, score, severity FROM ev
  UNION ALL SELECT region, timestamp_utc, 'residual', 'forecast_residual', 20.0::DOUBLE + readings % 75,
    CASE WHEN readings % 5 = 0 THEN 'critical' WHEN readings % 5 < 3 THEN 'warning' ELSE 'info' END FROM hourly WHERE readings % 2 = 0
  UNION ALL SELECT region, timestamp_utc, 'isolation_forest', 'multivariate_outlier', (readings * 7 % 100)::DOUBLE,
    CASE WHEN readings * 7 % 100 >= 70 THEN 'critical' WHEN readings * 7 % 100 >= 30 THEN 'warning' ELSE 'info' END FROM hourly WHERE readings % 3 = 0),
g AS (SELECT region, timestamp_utc, count(*) AS n, max(score) AS top, count(DISTINCT detector) AS k, count(*) FILTER (severity <> 'info') AS votes,
    bool_or(detector <> 'isolation_forest' AND severity = 'critical') AS crit, bool_and(detector = 'isolation_forest') AS alone,
    list(kind ORDER BY CASE severity WHEN 'critical' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END DESC, score DESC, detector DESC, kind DESC)[1] AS kind
  FROM ev3 GROUP BY 1, 2),
s AS (SELECT *, least(top / 100, 1) * 45 + 2.5::DOUBLE + 20.0::DOUBLE * least(k / 3.0::DOUBLE, 1) + 20.0::DOUBLE / 3 + 1 AS sc FROM g),
b AS (SELECT *, CASE WHEN crit OR sc >= 70 THEN 'critical' WHEN sc >= 30 THEN 'warning' ELSE 'info' END AS sev FROM s),
l AS (SELECT *, votes >= 2 AND sev = 'info' AS lifted FROM b)
"""


def _three_detectors(spark, d):
    rows = a.hourly_by_type(spark, d)
    n = F.col("readings")
    level = F.when(n % 5 == 0, "critical").when(n % 5 < 3, "warning").otherwise("info")
    missed = event(kind="forecast_residual", score=F.lit(20.0) + n % 75, severity=level, explanation="missed")
    far = (n * 7 % 100).cast("double")
    odd = event(kind="multivariate_outlier", score=far, severity=scoring.severity_band(far), explanation="odd")
    common = dict(target="demand_mw", detected_at=_now())
    return union_events(
        _demand_events(spark, d),
        to_events(rows.where(n % 2 == 0), F.array(missed), detector="residual", **common),
        to_events(rows.where(n % 3 == 0), F.array(odd), detector="isolation_forest", **common),
    )


@query("e1_ensemble_detectors", with_sql("hourly", "regional_weather", "renewables") + _RULE_PARTS + _DETECTORS_SQL + """
SELECT region, timestamp_utc, kind AS anomaly_type,
  round(CASE WHEN alone THEN least(CASE WHEN lifted THEN greatest(sc, 30) ELSE sc END, CASE WHEN top >= 50 THEN 69 ELSE 29 END)
    WHEN lifted THEN greatest(sc, 30) ELSE sc END, 6) AS anomaly_score,
  CASE WHEN alone THEN CASE WHEN top >= 50 THEN 'warning' ELSE 'info' END WHEN lifted THEN 'warning' ELSE sev END AS severity FROM l""")
def e1_detectors(spark, d):
    """Agreement of detectors, the critical override of rules and residuals, and the cap of a lone forest."""
    return _brief(ensemble.combine(_three_detectors(spark, d), _now())).drop("anomaly_id")


_ALERTS_SQL = with_sql("hourly", "regional_weather", "renewables") + _RULE_PARTS + """,
ch AS (SELECT * FROM evid),
brk AS (SELECT *, CASE WHEN timestamp_utc - lag(timestamp_utc) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM ch
  WINDOW w AS (PARTITION BY region, kind ORDER BY timestamp_utc, anomaly_id)),
isl AS (SELECT *, sum(new) OVER (PARTITION BY region, kind ORDER BY timestamp_utc, anomaly_id) AS island FROM brk),
al AS (SELECT region, kind AS anomaly_type, min(timestamp_utc) AS first_seen_utc, max(timestamp_utc) AS last_seen_utc, count(*) AS occurrence_count,
    arg_max(anomaly_id, timestamp_utc) AS latest_anomaly_id,
    ['info', 'warning', 'critical'][max(CASE severity WHEN 'critical' THEN 3 WHEN 'warning' THEN 2 ELSE 1 END)] AS severity FROM isl GROUP BY region, kind, island)
"""


@query("e3_alert_deduplication", _ALERTS_SQL + """
SELECT substring(sha256(region || '|demand_mw|' || anomaly_type || '|' || strftime(first_seen_utc, '%Y-%m-%dT%H:%M:%SZ')), 1, 32) AS alert_id,
  region, anomaly_type, severity, 'open' AS status, first_seen_utc, last_seen_utc, occurrence_count, latest_anomaly_id,
  upper(severity[1]) || severity[2:] || ' ' || replace(anomaly_type, '_', ' ') || ' in ' || region AS title FROM al""")
def e3(spark, d):
    """Alerts of an empty state: islands of events at most six hours apart."""
    batch = alerts.process_events(_demand_events(spark, d), chunk_hours=48)
    return batch.alerts.select(
        "alert_id", "region", "anomaly_type", "severity", "status", "first_seen_utc", "last_seen_utc",
        "occurrence_count", "latest_anomaly_id", "title",
    )


@query("e3_alert_escalation", _ALERTS_SQL.replace("SELECT * FROM evid", "SELECT * REPLACE (['info', 'warning', 'critical'][hour(timestamp_utc) % 3 + 1] AS severity) FROM evid") + """
SELECT region, anomaly_type, severity, first_seen_utc, last_seen_utc, occurrence_count,
  upper(severity[1]) || severity[2:] || ' ' || replace(anomaly_type, '_', ' ') || ' in ' || region AS title FROM al""")
def e3_escalation(spark, d):
    """Alerts take the highest severity of their events, from info over warning to critical."""
    level = F.element_at(F.array(F.lit("info"), F.lit("warning"), F.lit("critical")), (F.hour("timestamp_utc") % 3 + 1).cast("int"))
    batch = alerts.process_events(_demand_events(spark, d).withColumn("severity", level), chunk_hours=48)
    return batch.alerts.select("region", "anomaly_type", "severity", "first_seen_utc", "last_seen_utc", "occurrence_count", "title")


@query("e3_alert_second_batch", _ALERTS_SQL + """
SELECT region, anomaly_type, first_seen_utc, last_seen_utc, occurrence_count, latest_anomaly_id FROM al
WHERE last_seen_utc > TIMESTAMP '2024-01-15 12:00:00'""")
def e3_second(spark, d):
    """A second batch on stored state ends where one batch would have ended."""
    events = _demand_events(spark, d)
    early = alerts.process_events(events.where("timestamp_utc <= '2024-01-15 12:00:00'"), chunk_hours=48)
    batch = alerts.process_events(events, early.alerts, early.history, chunk_hours=48)
    return batch.alerts.select(
        "region", "anomaly_type", "first_seen_utc", "last_seen_utc", "occurrence_count", "latest_anomaly_id"
    )


@query("e3_alert_history", _ALERTS_SQL + """
SELECT region || '|' || kind AS series, CASE WHEN new = 1 THEN 'opened' ELSE 'occurrence' END AS change_reason, count(*) AS n,
  count(*) AS distinct_ids FROM isl GROUP BY 1, 2""")
def e3_history(spark, d):
    """One history row per event, each with an id of its own."""
    events = _demand_events(spark, d)
    batch = alerts.process_events(events, chunk_hours=48)
    named = batch.history.join(events.select("anomaly_id", "region", "anomaly_type"), "anomaly_id")
    return named.groupBy(F.concat_ws("|", "region", "anomaly_type").alias("series"), "change_reason").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("history_id").alias("distinct_ids")
    )


@query("e3_alert_stream", _ALERTS_SQL.replace("SELECT * FROM evid", "SELECT * FROM evid WHERE timestamp_utc <= (SELECT max(timestamp_utc) - INTERVAL 2 HOUR FROM evid)") + """
SELECT region, anomaly_type, severity, first_seen_utc, last_seen_utc, occurrence_count, latest_anomaly_id,
  CASE WHEN idle THEN 'resolved' ELSE 'open' END AS status, CASE WHEN idle THEN last_seen_utc + INTERVAL 24 HOUR END AS resolved_at_utc
FROM (SELECT *, (SELECT max(timestamp_utc) - INTERVAL 2 HOUR FROM evid) - last_seen_utc >= INTERVAL 24 HOUR AS idle FROM al)""")
def e3_stream(spark, d):
    """Alerts from keyed stream state after three micro-batches, idle ones resolved by timers (also E5)."""
    folder = f"{shared_folder(spark)}/kilohour-{uuid.uuid4().hex}"
    events = cut_lineage(_demand_events(spark, d))
    borders = [F.lit("2024-01-10").cast("timestamp"), F.lit("2024-01-20").cast("timestamp")]
    at = F.col("timestamp_utc")
    for part in (at < borders[0], (at >= borders[0]) & (at < borders[1]), at >= borders[1]):
        events.where(part).write.mode("append").parquet(f"{folder}/events")
        keyed_alert_stream(spark, f"{folder}/events", events.schema, f"{folder}/log", f"{folder}/checkpoint").awaitTermination()
    return alerts_of(spark.read.parquet(f"{folder}/log")).select(
        "region", "anomaly_type", "severity", "first_seen_utc", "last_seen_utc", "occurrence_count", "latest_anomaly_id", "status", "resolved_at_utc"
    )


@query("e4_status_changes", _ALERTS_SQL + """
SELECT region, anomaly_type, first_seen_utc, CASE WHEN occurrence_count % 3 = 0 THEN 'acknowledged' ELSE 'resolved' END AS status,
  CASE WHEN occurrence_count % 3 = 0 THEN TIMESTAMP '2024-01-31 12:00:00' END AS acknowledged_at_utc,
  CASE WHEN occurrence_count % 3 <> 0 THEN TIMESTAMP '2024-01-31 12:00:00' END AS resolved_at_utc
FROM al WHERE occurrence_count % 3 < 2""")
def e4(spark, d):
    state = alerts.process_events(_demand_events(spark, d), chunk_hours=48).alerts
    wanted = F.when(F.col("occurrence_count") % 3 == 0, "acknowledged").when(F.col("occurrence_count") % 3 == 1, "resolved").otherwise("open")
    moves = state.select("alert_id", wanted.alias("new_status"), _now().alias("at"))
    return alerts.change_status(state, moves).alerts.select(
        "region", "anomaly_type", "first_seen_utc", "status", "acknowledged_at_utc", "resolved_at_utc"
    )


@query("e5_auto_resolve", _ALERTS_SQL + """
SELECT region, anomaly_type, first_seen_utc, 'resolved' AS status FROM al WHERE TIMESTAMP '2024-01-31 12:00:00' - last_seen_utc >= INTERVAL 24 HOUR""")
def e5(spark, d):
    state = alerts.process_events(_demand_events(spark, d), chunk_hours=48).alerts
    return alerts.auto_resolve(state, _now()).alerts.select("region", "anomaly_type", "first_seen_utc", "status")


@query("p12_alert_contract", _ALERTS_SQL + """
SELECT unnest(['last_seen_utc_present', 'created_at_utc_present', 'updated_at_utc_present', 'metadata_json_json', 'unique_key']) AS "check", 0::BIGINT AS failures
UNION ALL SELECT 'status_known', count(*) FROM al WHERE occurrence_count % 3 = 1
UNION ALL SELECT 'severity_known', count(*) FROM al WHERE severity = 'critical'
UNION ALL SELECT 'occurrence_positive', count(*) FROM al WHERE anomaly_type = 'missing_timestamp'
UNION ALL SELECT 'first_seen_utc_present', count(*) FROM al WHERE occurrence_count = 1""")
def p12(spark, d):
    """Alert contract over all alerts, with bad status, severity, count and time planted in rows that the SQL names."""
    from kilohour.contracts import alerts as contract

    state = cut_lineage(alerts.process_events(_demand_events(spark, d), chunk_hours=48).alerts)
    n = F.col("occurrence_count")
    bad = state.withColumns({
        "status": F.when(n % 3 == 1, "lost").otherwise(F.col("status")),
        "severity": F.when(F.col("severity") == "critical", "fatal").otherwise(F.col("severity")),
        "occurrence_count": F.when(F.col("anomaly_type") == "missing_timestamp", 0).otherwise(n),
        "first_seen_utc": F.when(n > 1, F.col("first_seen_utc")),
    })
    return contract().violations(bad)


@query("o6_alert_detail", _ALERTS_SQL + """
SELECT region, kind AS anomaly_type, min(timestamp_utc) AS first_seen_utc, list(anomaly_id ORDER BY timestamp_utc, anomaly_id) AS steps FROM isl GROUP BY region, kind, island""")
def o6(spark, d):
    """Alerts with their ordered history; detection time is set to the event time here."""
    events = _demand_events(spark, d).withColumn("detected_at_utc", F.col("timestamp_utc"))
    batch = alerts.process_events(events, chunk_hours=48)
    out = alerts.alert_detail(batch.alerts, batch.history)
    return out.select("region", "anomaly_type", "first_seen_utc", F.transform("history", lambda h: h["anomaly_id"]).alias("steps"))


_LABELS_SQL = """,
lab AS (SELECT 'inj-' || region || strftime(timestamp_utc, '%d%H') AS injection_id, region, CASE WHEN readings % 2 = 0 THEN 'even' ELSE 'odd' END AS anomaly_type,
  timestamp_utc AS start_utc, timestamp_utc + INTERVAL 1 HOUR * (readings % 30) AS end_utc, CASE WHEN readings % 3 = 0 THEN 'critical' ELSE 'warning' END AS expected_severity
  FROM hourly WHERE hour(timestamp_utc) = 5),
det AS (SELECT anomaly_id, region, timestamp_utc, kind, severity FROM evid WHERE kind = 'missing_timestamp' OR (kind LIKE 'demand%' AND hour(timestamp_utc) % 6 = 0)),
hit AS (SELECT l.*, d.anomaly_id, d.timestamp_utc, d.severity FROM lab l LEFT JOIN det d ON d.region = l.region AND d.timestamp_utc BETWEEN l.start_utc AND l.end_utc
  QUALIFY row_number() OVER (PARTITION BY injection_id ORDER BY d.timestamp_utc, d.anomaly_id) = 1)
"""
_LABEL_CTE = with_sql("hourly", "regional_weather", "renewables") + _RULE_PARTS + _LABELS_SQL


def _labelled(spark, d):
    n, t = F.col("readings"), F.col("timestamp_utc")
    labels = a.hourly_by_type(spark, d).where(F.hour(t) == 5).select(
        F.concat(F.lit("inj-"), "region", F.date_format(t, "ddHH")).alias("injection_id"), "region",
        F.when(n % 2 == 0, "even").otherwise("odd").alias("anomaly_type"), t.alias("start_utc"),
        F.timestamp_micros(F.unix_micros(t) + n % 30 * 3_600_000_000).alias("end_utc"),
        F.when(n % 3 == 0, "critical").otherwise("warning").alias("expected_severity"),
    )
    kind, hour = F.col("anomaly_type"), F.hour("timestamp_utc")
    keep = (kind == "missing_timestamp") | (kind.startswith("demand") & (hour % 6 == 0))
    return _demand_events(spark, d).where(keep), labels


@query("j8_interval_match", _LABEL_CTE + """
SELECT injection_id, anomaly_type, anomaly_id IS NOT NULL AS detected, coalesce(anomaly_id, '') AS matched_anomaly_id,
  CAST(date_diff('hour', start_utc, timestamp_utc) AS DOUBLE) AS detection_delay_hours, severity = expected_severity AS severity_matches FROM hit""")
def j8(spark, d):
    """First detection inside each label interval."""
    return backtest.match_labels(*_labelled(spark, d))


@query("e7_detection_metrics", _LABEL_CTE + """,
c AS (SELECT count(*) AS l, count(anomaly_id) AS tp, (SELECT count(*) FROM det) - count(DISTINCT anomaly_id) AS fp, avg(date_diff('hour', start_utc, timestamp_utc)) AS delay,
  avg(CAST(severity = expected_severity AS INT)) AS acc FROM hit),
m AS (SELECT tp / (tp + fp) AS p, tp / l AS r, * FROM c)
SELECT round(p, 9) AS precision, round(r, 9) AS recall, round(2 * p * r / (p + r), 9) AS f1, round(fp / 30.0::DOUBLE, 9) AS false_positives_per_day,
  round(delay, 9) AS mean_detection_delay_hours, round(acc, 9) AS severity_accuracy FROM m""")
def e7(spark, d):
    """Precision, recall, F1, false positives, delay and severity accuracy."""
    found, labels = _labelled(spark, d)
    matches = backtest.match_labels(found, labels)
    start, end = F.lit("2024-01-01").cast("timestamp"), F.lit("2024-01-31").cast("timestamp")
    out = backtest.detection_metrics(found, matches, start, end)
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


@query("a17_per_type_metrics", _LABEL_CTE + """,
c AS (SELECT anomaly_type, count(*) AS injected, count(anomaly_id) AS detected FROM hit GROUP BY 1)
SELECT anomaly_type, injected, detected, detected AS true_positive, injected - detected AS false_negative, 1.0::DOUBLE AS precision,
  round(detected / injected, 9) AS recall, round(2 * (detected / injected) / (1 + detected / injected), 9) AS f1 FROM c""")
def a17(spark, d):
    out = backtest.per_type_metrics(backtest.match_labels(*_labelled(spark, d)))
    return out.withColumn("recall", F.round("recall", 9)).withColumn("f1", F.round("f1", 9))


@query("e6_injected_labels", with_sql("hourly") + """,
n AS (SELECT *, row_number() OVER (ORDER BY region, timestamp_utc) AS n, count(*) OVER () AS total FROM hourly),
p AS (SELECT * FROM n WHERE n BETWEEN 7 AND total - 6
  ORDER BY sha256(region || '|' || CAST(CAST(epoch(timestamp_utc) AS BIGINT) AS VARCHAR) || '|42') LIMIT 6),
k AS (SELECT *, row_number() OVER (ORDER BY n) AS k FROM p),
f AS (SELECT *, ['single_hour_demand_spike', 'multi_hour_demand_drop', 'flatline_sensor', 'missing_hour_sequence', 'gradual_drift',
    'contextual_unusual_hour'][k] AS kind, [1, 3, 4, 2, 5, 1][k] AS hours, [0.75, 0.6, 1.0, 1.0, 0.6, 0.9][k]::DOUBLE AS magnitude FROM k)
SELECT 'injected-42-' || lpad(CAST(k - 1 AS VARCHAR), 3, '0') AS injection_id, f.region, 'demand_mw' AS target, kind AS anomaly_type,
  f.timestamp_utc AS start_utc, n.timestamp_utc AS end_utc, magnitude, CASE WHEN magnitude >= 0.7 THEN 'critical' ELSE 'warning' END AS expected_severity,
  true AS synthetic FROM f JOIN n ON n.n = f.n + f.hours - 1""")
def e6(spark, d):
    """Planted anomalies at the positions of smallest hash."""
    rows = a.hourly_by_type(spark, d).drop("readings")
    return backtest.inject(rows, "demand_mw", kinds=backtest.DEFAULT_KINDS, chunk_rows=CHUNK)[1]


@query("e8_detection_backtest")
def e8(spark, d):
    """Plant, detect with rules, score (rows-only: positions are hash-chosen)."""
    from kilohour.plans.jobs import backtest_rules

    start, end = F.lit("2024-01-01").cast("timestamp"), F.lit("2024-01-31").cast("timestamp")
    rows = a.hourly_by_type(spark, d).drop("readings")
    return backtest_rules(rows, "demand_mw", start=start, end=end, now=_now(), chunk_rows=CHUNK).metrics


@query("w20_gap_counts", with_sql("hourly", "forecasts") + _SCORED + """
SELECT region, count(*) FILTER (timestamp_utc - p > INTERVAL 1 HOUR) AS gaps FROM
 (SELECT region, timestamp_utc, lag(timestamp_utc) OVER (PARTITION BY region ORDER BY timestamp_utc) AS p FROM scored) GROUP BY 1""")
def w20(spark, d):
    spec = SeriesSpec(chunk_rows=CHUNK)
    rows = _scored(spark, d).select("region", "timestamp_utc")
    linked = walk(rows, keys=["region"], order=["timestamp_utc"], chunk=spec.chunk())
    late = spec.steps_between(F.col("_prev.timestamp_utc"), F.col("timestamp_utc")) > 1
    return linked.groupBy("region").agg(F.count_if(late).alias("gaps"))


_PROBS = {"min": 0.0, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99, "max": 1.0}


@query("a32_score_distribution", "SELECT l_returnflag, " + ", ".join(
    f"round(quantile_cont(l_extendedprice, {p}), 6) AS {n}" for n, p in _PROBS.items()) + " FROM lineitem GROUP BY 1")
def a32(spark, d):
    """Exact interpolated quantiles per group without collecting a group."""
    rows = a.table(spark, d, "lineitem").select("l_returnflag", "l_extendedprice")
    out = exact_quantiles(rows, keys=["l_returnflag"], value="l_extendedprice", probabilities=_PROBS)
    return out.select("l_returnflag", *[F.round(n, 6).alias(n) for n in _PROBS])


@query("a34_feature_reference", with_sql("hourly") + """
SELECT region, round(avg(demand_mw) + 1e-9, 6) AS mean, round(stddev_pop(demand_mw) + 1e-9, 6) AS std FROM hourly GROUP BY 1""")
def a34(spark, d):
    return a.hourly_by_type(spark, d).groupBy("region").agg(
        F.round(F.avg("demand_mw") + 1e-9, 6).alias("mean"), F.round(F.stddev_pop("demand_mw") + 1e-9, 6).alias("std")
    )
