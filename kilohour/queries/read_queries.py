"""Listings, summaries and reports over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from kilohour.operators import reads
from kilohour.plans import adapters as a
from kilohour.plans.adapters import with_sql
from kilohour.queries.detect_queries import _RULE_PARTS, _demand_events
from kilohour.queries.registry import query
from kilohour.sources import tables

_FULL = with_sql("hourly", "forecasts")
_SERIES = ", ".join(reads.SERIES)
_EV = with_sql("hourly", "regional_weather", "renewables") + _RULE_PARTS


@query("o2_page", """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50""")
def o2(spark, d):
    """One page in a stable order (a top-k report)."""
    rows = a.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    items, _ = reads.page(rows, [F.desc("o_totalprice"), "o_orderkey"], limit=25, offset=50, equal={"o_orderstatus": "F"})
    return items.drop("o_orderstatus")


@query("o2_page_info", """
SELECT 25::BIGINT AS "limit", 50::BIGINT AS "offset", count(*) AS total, 25::BIGINT AS returned, count(*) > 75 AS has_more FROM orders WHERE o_orderstatus = 'F'""")
def o2_info(spark, d):
    rows = a.table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    return reads.page(rows, ["o_orderkey"], limit=25, offset=50, equal={"o_orderstatus": "F"})[1]


@query("o2_deep_page", """
SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber
LIMIT 40 OFFSET (SELECT count(*) * 9 // 10 FROM lineitem)""")
def o2_deep(spark, d):
    """A page nine tenths down a listing, read from the ranges that hold it."""
    rows = a.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    listing = reads.page_directory(rows, [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber"], rows_per_part=5_000)
    return listing.page(spark, limit=40, offset=listing.total * 9 // 10)


@query("o2_listing_ranges", """
SELECT count(*) AS total, true AS ranges_keep_all_rows, true AS pages_touch_two_ranges_at_most FROM lineitem""")
def o2_ranges(spark, d):
    """A listing's ranges hold every row once, and no page shorter than a range touches more than two."""
    rows = a.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    listing = reads.page_directory(rows, [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber"], rows_per_part=5_000)
    shortest = min(n for n in listing.counts if n)
    touched = max(len(listing.touched(shortest, offset)[0]) for offset in range(0, listing.total, 997))
    return rows.agg(F.count(F.lit(1)).alias("total")).select(
        "total", (F.col("total") == listing.total).alias("ranges_keep_all_rows"), F.lit(touched <= 2).alias("pages_touch_two_ranges_at_most")
    )


_COMPLETE = f""",
n AS (SELECT *, row_number() OVER (PARTITION BY {_SERIES} ORDER BY timestamp_utc) AS n FROM forecasts),
ok AS (SELECT {_SERIES} FROM n WHERE n <= 12 GROUP BY ALL HAVING count(*) = 12 AND bool_and(timestamp_utc = forecast_origin + n * INTERVAL 1 HOUR)),
best AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY region, target ORDER BY forecast_origin DESC, model_name DESC) = 1)
"""


@query("o5_latest_horizon", _FULL + _COMPLETE + """
SELECT n.region, n.target, n.forecast_origin, n.timestamp_utc, n.predicted_value, n.model_name FROM n JOIN best b
  ON n.region = b.region AND n.target = b.target AND n.forecast_origin = b.forecast_origin AND n.model_name = b.model_name WHERE n.n <= 12""")
def o5(spark, d):
    """Newest complete horizon of every region; gapped newer ones are skipped."""
    out = reads.latest_horizons(a.forecasts(spark, d), 12)
    return out.select("region", "target", "forecast_origin", "timestamp_utc", "predicted_value", "model_name")


@query("o9_forecast_of_origin", _FULL + """
SELECT region, timestamp_utc, model_name, predicted_value FROM (SELECT * FROM forecasts WHERE region = 'click' AND forecast_origin = TIMESTAMP '2024-01-10 23:00:00' ORDER BY timestamp_utc, model_name LIMIT 24)""")
def o9(spark, d):
    rows = a.forecasts(spark, d).where("region = 'click'")
    out = reads.forecast_of_origin(rows, F.lit("2024-01-10 23:00:00").cast("timestamp"), 24)
    return out.select("region", "timestamp_utc", "model_name", "predicted_value")


@query("o10_point_lookup", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 77")
def o10(spark, d):
    rows = a.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return tables.by_id(rows, "o_orderkey", 77)


@query("u6_options", "SELECT DISTINCT o_orderpriority AS value FROM orders")
def u6(spark, d):
    return reads.options(a.table(spark, d, "orders"), "o_orderpriority")


@query("a13_inspect", with_sql("hourly") + """
SELECT count(*) AS row_count, min(timestamp_utc) AS start_time, max(timestamp_utc) AS end_time, count(*) FILTER (readings % 5 = 0) AS missing_values, list_sort(list(DISTINCT region)) AS entities FROM hourly""")
def a13(spark, d):
    rows = a.hourly_by_type(spark, d)
    holes = rows.withColumn("demand_mw", F.when(F.col("readings") % 5 == 0, None).otherwise(F.col("demand_mw")))
    return reads.inspect_table(holes)


@query("a14_anomaly_rates", _EV + """,
t AS (SELECT count(*) AS evaluated_rows FROM hourly)
SELECT 'demand_mw' AS target, 'rules' AS detector_name, kind AS anomaly_type, severity, strftime(timestamp_utc, '%Y-%m-%d') AS day_utc, count(*) AS event_count,
  any_value(evaluated_rows) AS evaluated_rows, round(count(*) / any_value(evaluated_rows), 9) AS anomaly_rate FROM ev, t GROUP BY ALL""")
def a14(spark, d):
    evaluated = a.hourly_by_type(spark, d).groupBy(F.lit("demand_mw").alias("target")).agg(F.count(F.lit(1)).alias("evaluated_rows"))
    out = reads.anomaly_rates(_demand_events(spark, d), evaluated)
    return out.withColumn("anomaly_rate", F.round("anomaly_rate", 9))


@query("a15_frequency", _EV + "SELECT kind AS label, count(*) AS n FROM ev GROUP BY 1")
def a15(spark, d):
    return reads.frequency(_demand_events(spark, d), "anomaly_type")


@query("a26_forecast_summary", _FULL + """
SELECT region, target, count(*) AS row_count, min(timestamp_utc) AS start_time, max(timestamp_utc) AS end_time, max(forecast_origin) AS latest_forecast_origin, list(DISTINCT model_version) AS model_versions
FROM forecasts GROUP BY 1, 2""")
def a26(spark, d):
    return reads.forecast_summary(a.forecasts(spark, d))


@query("a27_anomaly_summary", _EV + """
SELECT 'demand_mw' AS target, 'rules' AS detector_name, kind AS anomaly_type, severity, CAST(timestamp_utc AS DATE) AS day, count(*) AS event_count,
  round(count(*) / 24.0, 9) AS hourly_opportunity_rate FROM ev GROUP BY ALL""")
def a27(spark, d):
    out = reads.anomaly_summary(_demand_events(spark, d))
    return out.withColumn("hourly_opportunity_rate", F.round("hourly_opportunity_rate", 9))


@query("a27_calibration_warnings", _EV + """,
s AS (SELECT count(*) / 24.0 AS r FROM ev GROUP BY kind, severity, CAST(timestamp_utc AS DATE))
SELECT count(*) AS groups, count(*) FILTER (r > 0.1) AS over, CASE WHEN count(*) FILTER (r > 0.1) > 0 THEN 'On some days more hours are flagged than the thresholds should allow.' END AS warning FROM s""")
def a27_warnings(spark, d):
    return reads.calibration_warnings(reads.anomaly_summary(_demand_events(spark, d)))


@query("a28_detector_agreement", """
WITH g AS (SELECT user_id % 5 AS r, date_trunc('hour', ts) AS t, count(DISTINCT event_type) AS n FROM events GROUP BY 1, 2)
SELECT count(*) AS timestamp_groups, count(*) FILTER (n > 1) AS agreed_groups, (SELECT count(DISTINCT event_type) FROM events) AS distinct_detectors FROM g""")
def a28(spark, d):
    rows = a.events(spark, d).select(
        (F.col("user_id") % 5).alias("region"), F.lit("x").alias("target"),
        F.date_trunc("HOUR", "ts").alias("timestamp_utc"), F.col("event_type").alias("detector_name"),
    )
    return reads.detector_agreement(rows)


@query("a29_dispatch_summary", with_sql("hourly", "batteries", "dispatch") + """
SELECT dispatch_run_id, round(max(net_load_before_battery_mw) - max(net_load_after_battery_mw) + 1e-9, 6) AS peak_reduction_mw, min(soc_start_mwh) AS minimum_soc_mwh, max(soc_end_mwh) AS maximum_soc_mwh,
  round(sum(charge_mw + discharge_mw) * 0.5 + 1e-9, 6) AS total_throughput_mwh, round(sum(charge_mw + discharge_mw) * 0.5 / 160 + 1e-9, 6) AS equivalent_cycles FROM dispatch GROUP BY 1""")
def a29(spark, d):
    from kilohour.operators.dispatch import run_headers

    points = a.dispatch_points(spark, d)
    runs = run_headers(points).withColumn("configuration_json", F.lit('{"battery": {"capacity_mwh": 80}, "step_hours": 0.5}'))
    out = reads.dispatch_summary(points, runs)
    fuzzy = ("peak_reduction_mw", "total_throughput_mwh", "equivalent_cycles")
    return out.select(*[F.round(F.col(c) + 1e-9, 6).alias(c) if c in fuzzy else F.col(c) for c in out.columns])


@query("a30_effective_rate", _EV + """
SELECT round(least(count(*) / (date_diff('hour', min(timestamp_utc), max(timestamp_utc)) + 1), 1), 9) AS effective_anomaly_rate FROM ev WHERE kind = 'missing_timestamp'""")
def a30(spark, d):
    out = reads.effective_rate(_demand_events(spark, d).where("anomaly_type = 'missing_timestamp'"))
    return out.select(F.round("effective_anomaly_rate", 9).alias("effective_anomaly_rate"))


@query("a31_daily_counts", "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, count(*) AS n FROM events GROUP BY 1")
def a31(spark, d):
    return reads.daily_counts(a.events(spark, d), "ts")


@query("a37_horizon_cards", _FULL + f"""
SELECT {_SERIES}, count(*) AS points, count(*) = 24 AND count(DISTINCT timestamp_utc) = 24 AS complete, arg_min(predicted_value, timestamp_utc) AS first_value,
  round(avg(predicted_value) + 1e-9, 6) AS mean_value, max(predicted_value) AS max_value FROM forecasts GROUP BY ALL""")
def a37(spark, d):
    out = reads.horizon_cards(a.forecasts(spark, d), 24)
    return out.withColumn("mean_value", F.round(F.col("mean_value") + 1e-9, 6))
