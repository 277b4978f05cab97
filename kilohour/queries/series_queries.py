"""Continuity, windows, features and joins over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from kilohour.operators import continuity, features, joins, windows
from kilohour.plans import adapters as a
from kilohour.plans.adapters import with_sql
from kilohour.queries.registry import query
from kilohour.series import SeriesSpec

# Chunks far smaller than production, so that the checked results cross many chunk borders.
SMALL = SeriesSpec(chunk_rows=100)


def _r(column: str, digits: int = 6):
    return F.round(F.col(column), digits).alias(column)


@query("c1_segments", with_sql("hourly", "segments") + """
SELECT region, printf('%s::%04d', region, seg) AS region_segment_id, min(timestamp_utc) AS segment_start,
  max(timestamp_utc) AS segment_end, count(*) AS row_count,
  CAST(date_diff('hour', min(timestamp_utc), max(timestamp_utc)) + 1 AS DOUBLE) AS duration_hours,
  CAST(coalesce(date_diff('hour', min(prev_ts), min(timestamp_utc)), 0) AS DOUBLE) AS gap_before_hours,
  greatest(coalesce(date_diff('hour', min(prev_ts), min(timestamp_utc)), 0) - 1, 0) AS missing_expected_hours_before
FROM segs GROUP BY region, seg""")
def c1(spark, d):
    """Segment table with bounds, size and the gap before."""
    rows = continuity.segment_rows(a.hourly_by_type(spark, d), SMALL)
    return continuity.segment_table(rows, SMALL).drop("segment_no")


@query("w1_gap_hours", with_sql("hourly") + """
SELECT region, CAST(sum(greatest(date_diff('hour', p, timestamp_utc) - 1, 0)) AS BIGINT) AS gap_hours FROM
  (SELECT *, lag(timestamp_utc) OVER (PARTITION BY region ORDER BY timestamp_utc) AS p FROM hourly) GROUP BY region""")
def w1(spark, d):
    linked = continuity.previous_times(a.hourly_by_type(spark, d), SMALL)
    return linked.groupBy("region").agg(F.sum(continuity.gap_steps(SMALL)).alias("gap_hours"))


@query("w2_segment_ids", with_sql("hourly", "segments") + """
SELECT region, timestamp_utc, demand_mw, printf('%s::%04d', region, seg) AS region_segment_id FROM segs""")
def w2(spark, d):
    rows = continuity.segment_rows(a.hourly_by_type(spark, d), SMALL)
    return rows.select("region", "timestamp_utc", "demand_mw", "region_segment_id")


def _lag_sql(k: int) -> str:
    return f"lag(demand_mw, {k}) OVER s AS demand_lag_{k}"


def _roll_sql(n: int) -> str:
    frame = f"OVER (PARTITION BY region, seg ORDER BY timestamp_utc ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    guard = f"CASE WHEN count(demand_mw) {frame} = {n} THEN"
    return ", ".join(
        f"{guard} {'round(' if f in ('avg', 'stddev_samp') else ''}{f}(demand_mw) {frame}"
        f"{', 5)' if f in ('avg', 'stddev_samp') else ''} END AS demand_rolling_{s}_{n}"
        for s, f in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max"))
    )


@query("w3_segment_lags", with_sql("hourly", "segments") + f"""
SELECT region, timestamp_utc, demand_mw, {', '.join(_lag_sql(k) for k in features.DEMAND_LAGS)}
FROM segs WINDOW s AS (PARTITION BY region, seg ORDER BY timestamp_utc)""")
def w3(spark, d):
    series = a.hourly_by_type(spark, d).drop("readings")
    return features.past_features(series, [("demand_mw", "demand")], lags=features.DEMAND_LAGS, windows=[], spec=SMALL)


@query("w4_segment_rolling", with_sql("hourly", "segments") + f"""
SELECT region, timestamp_utc, {', '.join(_roll_sql(n) for n in (3, 6, 12, 24))} FROM segs""")
def w4(spark, d):
    series = a.hourly_by_type(spark, d).drop("readings")
    out = features.past_features(series, [("demand_mw", "demand")], lags=[1], windows=[3, 6, 12, 24], spec=SMALL)
    out = out.drop("demand_mw", "demand_lag_1")
    return out.select(*[_r(c, 5) if "mean" in c or "std" in c else F.col(c) for c in out.columns])


@query("f1_training_features", with_sql("total").replace("total AS", "hourly AS") + "," + a.SQL["segments"] + f""",
feat AS (SELECT region, timestamp_utc, demand_mw,
  {', '.join(_lag_sql(k) for k in features.DEMAND_LAGS)}, {', '.join(_roll_sql(n) for n in features.DEMAND_WINDOWS)}
  FROM segs WINDOW s AS (PARTITION BY region, seg ORDER BY timestamp_utc))
SELECT *, CAST(hour(timestamp_utc) AS DOUBLE) AS hour, CAST(isodow(timestamp_utc) - 1 AS DOUBLE) AS day_of_week,
  CAST(day(timestamp_utc) AS DOUBLE) AS day_of_month, CAST(week(timestamp_utc) AS DOUBLE) AS week_of_year,
  CAST(month(timestamp_utc) AS DOUBLE) AS month, CAST(quarter(timestamp_utc) AS DOUBLE) AS quarter,
  CAST(isodow(timestamp_utc) >= 6 AS DOUBLE) AS is_weekend,
  round(sin(2 * pi() * hour(timestamp_utc) / 24), 6) AS hour_sin, round(cos(2 * pi() * hour(timestamp_utc) / 24), 6) AS hour_cos,
  round(sin(2 * pi() * (isodow(timestamp_utc) - 1) / 7), 6) AS day_of_week_sin,
  round(cos(2 * pi() * (isodow(timestamp_utc) - 1) / 7), 6) AS day_of_week_cos
FROM feat WHERE demand_lag_336 IS NOT NULL AND demand_rolling_mean_168 IS NOT NULL AND demand_rolling_std_168 IS NOT NULL""")
def f1(spark, d):
    """Complete demand training matrix of the dense series."""
    out = features.build_training(a.hourly_total(spark, d), spec=SMALL)
    fuzzy = [c for c in out.columns if "mean" in c or "std" in c]
    cyclic = [c for c in out.columns if c.endswith(("_sin", "_cos"))]
    return out.select(*[_r(c, 5) if c in fuzzy else _r(c) if c in cyclic else F.col(c) for c in out.columns])


@query("f1_feature_report", with_sql("hourly", "segments") + """,
feat AS (SELECT *, lag(demand_mw, 24) OVER s AS l24,
    count(*) OVER (PARTITION BY region, seg ORDER BY timestamp_utc ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS c12
  FROM segs WINDOW s AS (PARTITION BY region, seg ORDER BY timestamp_utc))
SELECT count(*) AS source_rows, count(*) FILTER (l24 IS NOT NULL) AS output_rows,
  count(*) FILTER (l24 IS NULL) AS removed_rows, count(*) FILTER (seg > 1 AND l24 IS NULL) AS gap_affected_rows,
  count(*) FILTER (l24 IS NULL) AS insufficient_contiguous_history_rows, 0::BIGINT AS missing_target_rows,
  CAST(sum(CASE WHEN new = 1 THEN coalesce(date_diff('hour', prev_ts, timestamp_utc) - 1, 0) ELSE 0 END) AS BIGINT)
    AS timestamp_gap_count, 24::BIGINT AS required_history FROM feat""")
def f1_report(spark, d):
    short = features.FeatureSpec(lags=(1, 24), windows=(3, 12))
    return features.feature_report(a.hourly_by_type(spark, d), short, SMALL)


@query("f2_future_row", with_sql("hourly") + """,
ctx AS (SELECT region, timestamp_utc, demand_mw FROM hourly
  WHERE timestamp_utc BETWEEN TIMESTAMP '2024-01-28 12:00:00' AND TIMESTAMP '2024-01-29 11:00:00')
SELECT region, TIMESTAMP '2024-01-29 12:00:00' AS timestamp_utc, 24 - count(*) AS missing_context_hours,
  CASE WHEN count(*) = 24 THEN max(demand_mw) FILTER (timestamp_utc = TIMESTAMP '2024-01-29 11:00:00') END AS demand_lag_1,
  CASE WHEN count(*) = 24 THEN max(demand_mw) FILTER (timestamp_utc = TIMESTAMP '2024-01-28 12:00:00') END AS demand_lag_24,
  CASE WHEN count(*) = 24 THEN round(avg(demand_mw) FILTER (timestamp_utc >= TIMESTAMP '2024-01-29 06:00:00'), 6) END AS demand_rolling_mean_6,
  CASE WHEN count(*) = 24 THEN round(stddev_samp(demand_mw) FILTER (timestamp_utc >= TIMESTAMP '2024-01-29 06:00:00'), 6) END AS demand_rolling_std_6,
  CASE WHEN count(*) = 24 THEN min(demand_mw) FILTER (timestamp_utc >= TIMESTAMP '2024-01-29 06:00:00') END AS demand_rolling_min_6,
  CASE WHEN count(*) = 24 THEN max(demand_mw) FILTER (timestamp_utc >= TIMESTAMP '2024-01-29 06:00:00') END AS demand_rolling_max_6
FROM ctx GROUP BY region""")
def f2(spark, d):
    spec = features.FeatureSpec(lags=(1, 24), windows=(6,))
    at = F.lit("2024-01-29 12:00:00").cast("timestamp")
    out = features.future_rows(a.hourly_by_type(spark, d), at, spec)
    return out.select(
        "region", "timestamp_utc", "missing_context_hours", "demand_lag_1", "demand_lag_24",
        _r("demand_rolling_mean_6"), _r("demand_rolling_std_6"), "demand_rolling_min_6", "demand_rolling_max_6",
    )


_C2 = dict(horizon=12, windows=4, step_size=12, required_history=24)


@query("c2_select_windows", """
WITH RECURSIVE total AS (SELECT 'g' || user_id % 2 AS region, date_trunc('hour', ts) AS t FROM events GROUP BY 1, 2),
runs AS (SELECT region, t, count(*) OVER (PARTITION BY region ORDER BY t RANGE BETWEEN INTERVAL 23 HOUR PRECEDING AND CURRENT ROW) AS hist,
  count(*) OVER (PARTITION BY region ORDER BY t RANGE BETWEEN INTERVAL 1 HOUR FOLLOWING AND INTERVAL 12 HOUR FOLLOWING) AS fut FROM total),
ok AS (SELECT t FROM runs WHERE hist = 24 AND fut = 12 GROUP BY t HAVING count(*) = (SELECT count(DISTINCT region) FROM total)),
picks(i, o) AS (SELECT 1, max(t) FROM ok UNION ALL
  SELECT i + 1, (SELECT max(t) FROM ok WHERE t <= o - INTERVAL 12 HOUR) FROM picks WHERE i < 4 AND o IS NOT NULL)
SELECT CAST((SELECT count(*) FROM picks WHERE o IS NOT NULL) + 1 - i AS BIGINT) AS validation_window, o AS origin,
  o + INTERVAL 1 HOUR AS validation_start, o + INTERVAL 12 HOUR AS validation_end FROM picks WHERE o IS NOT NULL""")
def c2(spark, d):
    """Backward greedy choice of rolling origins valid for all entities."""
    rows = (
        a.events(spark, d)
        .select(F.expr("concat('g', user_id % 2)").alias("region"), F.date_trunc("HOUR", "ts").alias("timestamp_utc")).distinct()
    )
    return windows.select_windows(rows, **_C2, spec=SMALL, require_all=False)


@query("c2_window_audit", """
WITH RECURSIVE h AS (SELECT 'ALL' AS region, date_trunc('hour', ts) AS t FROM events GROUP BY 1, 2 HAVING (epoch_us(t) // 3600000000) % 61 >= 2),
b AS (SELECT max(t) - INTERVAL 12 HOUR AS newest, min(t) + INTERVAL 23 HOUR AS oldest FROM h),
cal AS (SELECT unnest(generate_series(oldest, newest, INTERVAL 1 HOUR)) AS t FROM b),
stat AS (SELECT cal.t, 24 - (SELECT count(*) FROM h WHERE h.t BETWEEN cal.t - INTERVAL 23 HOUR AND cal.t) AS mh,
  12 - (SELECT count(*) FROM h WHERE h.t BETWEEN cal.t + INTERVAL 1 HOUR AND cal.t + INTERVAL 12 HOUR) AS mv FROM cal),
walk(t, acc, n) AS (
  SELECT b.newest, s.mh = 0 AND s.mv = 0, CASE WHEN s.mh = 0 AND s.mv = 0 THEN 1 ELSE 0 END FROM b JOIN stat s ON s.t = b.newest
  UNION ALL
  SELECT s.t, s.mh = 0 AND s.mv = 0, w.n + CASE WHEN s.mh = 0 AND s.mv = 0 THEN 1 ELSE 0 END
  FROM walk w JOIN stat s ON s.t = w.t - CASE WHEN w.acc THEN INTERVAL 12 HOUR ELSE INTERVAL 1 HOUR END WHERE w.n < 4)
SELECT w.t AS origin, acc AS accepted, r.reason FROM walk w JOIN stat s USING (t)
LEFT JOIN LATERAL (SELECT unnest(list_filter([
    CASE WHEN s.mh > 0 THEN 'ALL:insufficient_contiguous_history:' || s.mh || '_missing_hours' END,
    CASE WHEN s.mv > 0 THEN 'ALL:incomplete_forecast_horizon:' || s.mv || '_missing_hours' END], lambda x: x IS NOT NULL)) AS reason) r ON TRUE""")
def c2_audit(spark, d):
    """Candidates the search visits with their rejection reasons; all events, with two of 61 hours blanked out."""
    rows = (
        a.events(spark, d).select(F.lit("ALL").alias("region"), F.date_trunc("HOUR", "ts").alias("timestamp_utc")).distinct()
        .where(F.floor(F.unix_seconds("timestamp_utc") / 3600) % 61 >= 2)
    )
    return windows.window_audit(rows, **_C2, spec=SMALL)


@query("a25_continuity_summary", with_sql("hourly", "segments") + """,
t AS (SELECT region, printf('%s::%04d', region, seg) AS id, min(timestamp_utc) AS s, max(timestamp_utc) AS e, count(*) AS n,
  coalesce(date_diff('hour', min(prev_ts), min(timestamp_utc)), 0) AS gap FROM segs GROUP BY region, seg)
SELECT count(DISTINCT region) AS region_count, CAST(sum(greatest(gap - 1, 0)) AS BIGINT) AS timestamp_gap_count,
  count(*) FILTER (gap > 1) AS gap_event_count, count(*) AS contiguous_segment_count,
  max(n) AS longest_contiguous_segment_rows, CAST(max(n) AS DOUBLE) AS longest_contiguous_segment_hours,
  (SELECT id FROM t ORDER BY n DESC, s DESC, id DESC LIMIT 1) AS longest_contiguous_segment,
  (SELECT id FROM t ORDER BY e DESC, id DESC LIMIT 1) AS most_recent_contiguous_segment,
  max(e) AS most_recent_segment_end FROM t""")
def a25(spark, d):
    rows = continuity.segment_rows(a.hourly_by_type(spark, d), SMALL)
    return continuity.continuity_summary(continuity.segment_table(rows, SMALL), SMALL)


@query("o7_longest_segment", with_sql("hourly", "segments") + """,
t AS (SELECT region, printf('%s::%04d', region, seg) AS region_segment_id, min(timestamp_utc) AS segment_start,
  max(timestamp_utc) AS segment_end, count(*) AS row_count FROM segs GROUP BY region, seg)
SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY region ORDER BY row_count DESC, segment_start DESC) = 1""")
def o7(spark, d):
    rows = continuity.segment_rows(a.hourly_by_type(spark, d), SMALL)
    return continuity.longest_segments(continuity.segment_table(rows, SMALL), SMALL)


@query("w17_latest_segment", with_sql("hourly", "segments") + """,
t AS (SELECT region, printf('%s::%04d', region, seg) AS region_segment_id, min(timestamp_utc) AS segment_start,
  max(timestamp_utc) AS segment_end, count(*) AS row_count FROM segs GROUP BY region, seg)
SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY region ORDER BY segment_end DESC) = 1""")
def w17(spark, d):
    rows = continuity.segment_rows(a.hourly_by_type(spark, d), SMALL)
    return continuity.latest_segments(continuity.segment_table(rows, SMALL), SMALL)


@query("w14_missing_hours", with_sql("hourly") + """,
p AS (SELECT region, timestamp_utc AS e, lag(timestamp_utc) OVER (PARTITION BY region ORDER BY timestamp_utc) AS s FROM hourly)
SELECT region, unnest(generate_series(s + INTERVAL 1 HOUR, e - INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS timestamp_utc,
  date_diff('hour', s, e) - 1 AS gap_hours FROM p WHERE date_diff('hour', s, e) > 1""")
def w14(spark, d):
    return continuity.missing_steps(a.hourly_by_type(spark, d), SMALL)


@query("w13_irregular_steps", with_sql("hourly") + """
SELECT region, timestamp_utc, prev_time FROM (SELECT region, timestamp_utc,
  lag(timestamp_utc) OVER (PARTITION BY region ORDER BY timestamp_utc) AS prev_time FROM hourly)
WHERE timestamp_utc - prev_time <> INTERVAL 1 HOUR""")
def w13(spark, d):
    series = a.hourly_by_type(spark, d)
    return continuity.irregular_steps(series, SMALL).select("region", "timestamp_utc", "prev_time")


@query("j9_spine_alignment", with_sql("hourly") + """,
b AS (SELECT region, unnest(generate_series(min(timestamp_utc), max(timestamp_utc), INTERVAL 1 HOUR)) AS timestamp_utc
  FROM hourly GROUP BY region)
SELECT region, timestamp_utc, demand_mw, readings, readings IS NOT NULL AS is_present
FROM b LEFT JOIN hourly USING (region, timestamp_utc)""")
def j9(spark, d):
    return continuity.align_to_grid(a.hourly_by_type(spark, d), SMALL)


@query("j12_common_times", with_sql("hourly") + """
SELECT timestamp_utc FROM hourly GROUP BY 1 HAVING count(DISTINCT region) = (SELECT count(DISTINCT region) FROM hourly)""")
def j12(spark, d):
    return windows.common_times(a.hourly_by_type(spark, d))


@query("j1_aligned_inner", with_sql("hourly", "regional_weather") + """
SELECT region, timestamp_utc, demand_mw, readings, temperature_c, wind_speed_10m_kph
FROM hourly JOIN regional_weather USING (region, timestamp_utc)""")
def j1(spark, d):
    weather = a.regional_weather(spark, d).select("region", "timestamp_utc", "temperature_c", "wind_speed_10m_kph")
    return joins.aligned(a.hourly_by_type(spark, d), weather)


@query("j2_left_context", with_sql("hourly", "regional_weather") + """
SELECT region, timestamp_utc, demand_mw, readings, shortwave_radiation_wm2
FROM hourly LEFT JOIN regional_weather USING (region, timestamp_utc)""")
def j2(spark, d):
    weather = a.regional_weather(spark, d)
    return joins.left_context(a.hourly_by_type(spark, d), weather, joins.GRID_KEYS, ["shortwave_radiation_wm2"])


@query("j3_net_load_overlap", with_sql("hourly", "renewables") + """
SELECT count(h.demand_mw) AS demand_rows, count(r.region) AS renewable_rows,
  count(*) FILTER (h.region IS NOT NULL AND r.region IS NOT NULL) AS overlap_rows,
  count(*) FILTER (h.demand_mw IS NOT NULL AND r.total_renewable_generation_mw IS NOT NULL) AS net_load_available_rows,
  count(*) FILTER (h.demand_mw IS NULL OR r.total_renewable_generation_mw IS NULL) AS missing_overlap_rows
FROM hourly h FULL JOIN renewables r ON h.region = r.region AND h.timestamp_utc = r.timestamp_utc""")
def j3(spark, d):
    return joins.net_load_report(a.hourly_by_type(spark, d), a.renewable_actuals(spark, d))


@query("m14_net_load", with_sql("hourly", "renewables") + """
SELECT region, timestamp_utc, demand_mw, total_renewable_generation_mw,
  round(demand_mw - total_renewable_generation_mw, 6) AS net_load_mw
FROM hourly JOIN renewables USING (region, timestamp_utc) WHERE total_renewable_generation_mw IS NOT NULL""")
def m14(spark, d):
    """Complete-case net load (also the view S18)."""
    out = joins.create_net_load_view(a.hourly_by_type(spark, d), a.renewable_actuals(spark, d))
    return out.withColumn("net_load_mw", F.round("net_load_mw", 6))


@query("j4_history_and_future", with_sql("hourly", "regional_weather") + """,
h AS (SELECT region, timestamp_utc, temperature_c FROM regional_weather WHERE timestamp_utc < TIMESTAMP '2024-01-20'),
f AS (SELECT region, timestamp_utc, temperature_c + 1 AS temperature_c FROM regional_weather WHERE timestamp_utc >= TIMESTAMP '2024-01-19')
SELECT region, timestamp_utc, coalesce(h.temperature_c, f.temperature_c) AS temperature_c
FROM h FULL JOIN f USING (region, timestamp_utc)""")
def j4(spark, d):
    w = a.regional_weather(spark, d).select("region", "timestamp_utc", "temperature_c")
    future = w.where("timestamp_utc >= '2024-01-19'").withColumn("temperature_c", F.col("temperature_c") + 1)
    return joins.future_and_history(w.where("timestamp_utc < '2024-01-20'"), future)


@query("j5_uncovered_hours", with_sql("hourly", "regional_weather") + """
SELECT region, timestamp_utc FROM hourly EXCEPT SELECT region, timestamp_utc FROM regional_weather""")
def j5(spark, d):
    return joins.uncovered(a.hourly_by_type(spark, d), a.regional_weather(spark, d))


@query("j6_covered_rows", with_sql("hourly", "renewables") + """
SELECT * FROM hourly h WHERE EXISTS (SELECT 1 FROM renewables r WHERE r.region = h.region AND r.timestamp_utc = h.timestamp_utc)""")
def j6(spark, d):
    return joins.covered(a.hourly_by_type(spark, d), a.renewable_actuals(spark, d))


@query("j10_duplicate_keys", """
SELECT o_custkey, o_orderdate, count(*) AS copies FROM orders GROUP BY 1, 2 HAVING count(*) > 1""")
def j10(spark, d):
    """What a one-to-one join would reject."""
    return joins.duplicate_keys(a.table(spark, d, "orders"), ["o_custkey", "o_orderdate"])


@query("a35_overlap_report", with_sql("hourly", "regional_weather") + """
SELECT count(h.region) AS left_rows, count(w.region) AS right_rows,
  count(*) FILTER (h.region IS NOT NULL AND w.region IS NOT NULL) AS overlap_rows
FROM hourly h FULL JOIN regional_weather w ON h.region = w.region AND h.timestamp_utc = w.timestamp_utc""")
def a35(spark, d):
    return joins.overlap_report(a.hourly_by_type(spark, d), a.regional_weather(spark, d))


@query("p21_reserved_history", with_sql("hourly") + """
SELECT region, timestamp_utc >= TIMESTAMP '2024-01-25 01:00:00' AS is_final, count(*) AS n FROM hourly GROUP BY 1, 2""")
def p21(spark, d):
    series = a.hourly_by_type(spark, d)
    chosen = spark.sql("SELECT explode(array(timestamp'2024-01-25 01:00:00', timestamp'2024-01-26 01:00:00')) AS validation_start")
    older, final = windows.reserve_final_evaluation(series, chosen)
    both = older.withColumn("is_final", F.lit(False)).unionByName(final.withColumn("is_final", F.lit(True)))
    return both.groupBy("region", "is_final").agg(F.count(F.lit(1)).alias("n"))


@query("daily_orders_segments", """
WITH s AS (SELECT o_custkey, CAST(o_orderdate AS TIMESTAMP) AS day, count(*) AS n FROM orders GROUP BY 1, 2),
m AS (SELECT *, CASE WHEN day - lag(day) OVER w = INTERVAL 1 DAY THEN 0 ELSE 1 END AS new FROM s
  WINDOW w AS (PARTITION BY o_custkey ORDER BY day)),
g AS (SELECT *, sum(new) OVER (PARTITION BY o_custkey ORDER BY day) AS seg FROM m)
SELECT o_custkey, CAST(max(seg) AS BIGINT) AS segments, CAST(max(len) AS BIGINT) AS longest
FROM (SELECT o_custkey, seg, count(*) AS len FROM g GROUP BY 1, 2) GROUP BY 1""")
def daily_orders(spark, d):
    """The same segments for a daily step and many entities."""
    spec = SeriesSpec(entity=("o_custkey",), time="day", value="n", step_seconds=86400, chunk_rows=512)
    series = (
        a.table(spark, d, "orders")
        .groupBy("o_custkey", F.col("o_orderdate").cast("timestamp").alias("day"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    segments = continuity.segment_table(continuity.segment_rows(series, spec), spec)
    return segments.groupBy("o_custkey").agg(
        F.max("segment_no").alias("segments"), F.max("row_count").alias("longest")
    )


# Hourly series of every user: more than a thousand entities at the larger scales.
_USERS_SQL = """WITH users AS (SELECT 'u' || CAST(user_id AS VARCHAR) AS region, date_trunc('hour', ts) AS timestamp_utc,
  CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DOUBLE) AS demand_mw FROM events GROUP BY 1, 2),
m AS (SELECT *, lag(timestamp_utc) OVER w AS prev, CASE WHEN timestamp_utc - lag(timestamp_utc) OVER w = INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new
  FROM users WINDOW w AS (PARTITION BY region ORDER BY timestamp_utc)),
g AS (SELECT *, sum(new) OVER (PARTITION BY region ORDER BY timestamp_utc) AS seg FROM m)
"""


def _users(spark, d):
    key = F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("region")
    value = F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("demand_mw")
    return a.events(spark, d).groupBy(key, F.date_trunc("HOUR", "ts").alias("timestamp_utc")).agg(value)


@query("users_gap_hours", _USERS_SQL + """
SELECT region, count(*) AS rows, CAST(sum(greatest(coalesce(date_diff('hour', prev, timestamp_utc), 1) - 1, 0)) AS BIGINT) AS gap_hours,
  CAST(max(seg) AS BIGINT) AS segments FROM g GROUP BY 1""")
def users_gaps(spark, d):
    """Gap hours and segments of every user's series (W1, A25 with many entities)."""
    rows = continuity.segment_rows(_users(spark, d), SMALL)
    linked = continuity.previous_times(rows, SMALL)
    return linked.groupBy("region").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(continuity.gap_steps(SMALL)).alias("gap_hours"), F.max("segment_no").alias("segments")
    )


@query("users_segment_lags", _USERS_SQL + """
SELECT region, timestamp_utc, demand_mw, lag(demand_mw, 1) OVER s AS demand_lag_1, lag(demand_mw, 3) OVER s AS demand_lag_3
FROM g WINDOW s AS (PARTITION BY region, seg ORDER BY timestamp_utc)""")
def users_lags(spark, d):
    """Lags inside segments for every user (W3 with many entities)."""
    return features.past_features(_users(spark, d), [("demand_mw", "demand")], lags=[1, 3], windows=[], spec=SMALL)


_WEATHER_SEGMENTS = with_sql("hourly", "regional_weather") + "," + a.SQL["segments"].replace("FROM hourly", "FROM regional_weather")


def _weather_lag_sql(columns, lags, rolls) -> str:
    parts = [f"lag({c}, {k}) OVER s AS {c}_lag_{k}" for c in columns for k in lags]
    for c in columns:
        for n in rolls:
            frame = f"OVER (PARTITION BY region, seg ORDER BY timestamp_utc ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
            parts.append(f"CASE WHEN count({c}) {frame} = {n} THEN round(avg({c}) {frame} + 1e-9, 6) END AS {c}_rolling_mean_{n}")
    return ", ".join(parts)


_WIDE = features.WEATHER_COLUMNS


@query("f3_weather_features", _WEATHER_SEGMENTS + f""",
w AS (SELECT *, {_weather_lag_sql(_WIDE, features.WEATHER_LAGS, features.WEATHER_WINDOWS)} FROM segs
  WINDOW s AS (PARTITION BY region, seg ORDER BY timestamp_utc))
SELECT region, timestamp_utc, {", ".join(f"{c}_lag_{k}" for c in _WIDE for k in features.WEATHER_LAGS)},
  {", ".join(f"{c}_rolling_mean_{n}" for c in _WIDE for n in features.WEATHER_WINDOWS)} FROM w
WHERE temperature_c_lag_24 IS NOT NULL""")
def f3(spark, d):
    """Weather lags and rolling means of complete rows of the oracle mode."""
    out = features.weather_features(a.regional_weather(spark, d), mode="historical_oracle", spec=SMALL)
    lags = [f"{c}_lag_{k}" for c in _WIDE for k in features.WEATHER_LAGS]
    rolls = [f"{c}_rolling_mean_{n}" for c in _WIDE for n in features.WEATHER_WINDOWS]
    return out.select("region", "timestamp_utc", *lags, *[F.round(F.col(c) + 1e-9, 6).alias(c) for c in rolls])


@query("w6_persistence_weather", _WEATHER_SEGMENTS + """,
w AS (SELECT region, timestamp_utc, lag(temperature_c, 24) OVER s AS temperature_c, lag(wind_direction_10m_deg, 24) OVER s AS wind_direction_10m_deg FROM segs
  WINDOW s AS (PARTITION BY region, seg ORDER BY timestamp_utc))
SELECT *, 'forecast' AS weather_data_type FROM w WHERE temperature_c IS NOT NULL""")
def w6(spark, d):
    """Weather of the day before in the same segment, relabelled as a forecast."""
    out = features.persistence_weather(a.regional_weather(spark, d), spec=SMALL)
    return out.select("region", "timestamp_utc", "temperature_c", "wind_direction_10m_deg", "weather_data_type")


@query("w7_target_features", with_sql("hourly", "segments") + f"""
SELECT region, timestamp_utc, {", ".join(f"lag(demand_mw, {k}) OVER s AS target_lag_{k}" for k in (1, 24))},
  {_roll_sql(3).replace("demand_rolling", "target_rolling")}, {_roll_sql(24).replace("demand_rolling", "target_rolling")}
FROM segs WINDOW s AS (PARTITION BY region, seg ORDER BY timestamp_utc)""")
def w7(spark, d):
    """Lags and rolling statistics of the target models."""
    spec = features.FeatureSpec("target", lags=(1, 24), windows=(3, 24))
    out = features.training_matrix(a.hourly_by_type(spark, d), spec, SMALL).select("region", "timestamp_utc", *spec.history_names)
    return out.select(*[_r(c, 5) if "mean" in c or "std" in c else F.col(c) for c in out.columns])


@query("f4_target_frame", with_sql("hourly", "renewables") + """
SELECT region, timestamp_utc, demand_mw, total_renewable_generation_mw, round(demand_mw - total_renewable_generation_mw + 1e-9, 6) AS net_load_mw
FROM hourly JOIN renewables USING (region, timestamp_utc) WHERE total_renewable_generation_mw IS NOT NULL
  AND timestamp_utc BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20'""")
def f4(spark, d):
    """Rows of one target in an inclusive range (also P20)."""
    rows = joins.target_frame("net_load_mw", a.hourly_by_type(spark, d), a.renewable_actuals(spark, d), start="2024-01-10", end="2024-01-20")
    return rows.withColumn("net_load_mw", F.round(F.col("net_load_mw") + 1e-9, 6))
