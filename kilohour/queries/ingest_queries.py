"""Cleaning, contracts, weather aggregation and keyed merging over the supplied tables."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Window
from pyspark.sql import functions as F

from kilohour import contracts
from kilohour.functions import calendar, text, time
from kilohour.functions.ordered import keep_last, walk
from kilohour.operators import clean, weather
from kilohour.plans import adapters as a
from kilohour.plans.adapters import with_sql
from kilohour.queries.registry import query
from kilohour.series import SeriesSpec
from kilohour.session import shared_folder
from kilohour.sources import pages, tables

SMALL = SeriesSpec(chunk_rows=100)


def _now():
    return F.lit("2024-02-01").cast("timestamp")


def _page_texts(spark, d):
    """Page texts rebuilt from measurement rows: one page per region and hour."""
    m = a.measurements(spark, d)
    record = F.struct(
        "period", "respondent", "type", F.col("type_name").alias("type-name"), "value", F.col("_ingest_seq").alias("n")
    )
    rows = F.sort_array(F.collect_list(F.struct("_ingest_seq", record.alias("r"))))
    data = F.transform(rows, lambda x: x["r"])
    return m.groupBy("respondent", "period").agg(data.alias("data")).select(
        F.concat_ws("/", "respondent", "period").alias("page"),
        F.to_json(F.struct(F.struct(F.size("data").cast("string").alias("total"), "data").alias("response"))).alias("value"),
    )


@query("s1_page_records", with_sql("measurements") + """
SELECT respondent, period, type, type_name, value, count(*) AS copies FROM measurements GROUP BY ALL""")
def s1(spark, d):
    """Pages to records through the page parser."""
    records = pages.page_records(pages.parse_pages(_page_texts(spark, d)))
    return records.groupBy("respondent", "period", "type", "type_name", "value").agg(F.count(F.lit(1)).alias("copies"))


@query("s3_page_completeness", with_sql("measurements") + """
SELECT respondent AS request, count(*) AS received, max(n) AS announced, count(*) >= max(n) AS complete
FROM (SELECT respondent, period, count(*) OVER (PARTITION BY respondent, period) AS n FROM measurements) GROUP BY 1""")
def s3(spark, d):
    parsed = pages.parse_pages(_page_texts(spark, d))
    return pages.page_completeness(parsed, F.element_at(F.split("page", "/"), 1))


def _weather_pages(spark, d):
    """Weather payloads rebuilt from location rows: one page per location and day."""
    rows = a.location_weather(spark, d)
    day = F.to_date("timestamp_utc")
    fields = pages.WEATHER_FIELDS
    packed = F.sort_array(F.collect_list(F.struct("timestamp_utc", *fields.values())))
    grouped = rows.groupBy("region", "location_name", "latitude", "longitude", day.alias("day")).agg(packed.alias("p"))
    hourly = F.struct(
        F.transform("p", lambda x: F.date_format(x["timestamp_utc"], "yyyy-MM-dd'T'HH:mm")).alias("time"),
        *[F.col("p")[o].alias(t) for t, o in fields.items() if t != "cloud_cover"],
        F.when(F.day("day") % 10 == 0, F.slice("p.cloud_cover_pct", 2, 30)).otherwise(F.col("p.cloud_cover_pct")).alias("cloud_cover"),
    )
    options = {"ignoreNullFields": "false"}
    return grouped.select(
        "region", "location_name", F.col("day").cast("string").alias("page"),
        F.to_json(F.struct("latitude", "longitude", hourly.alias("hourly")), options).alias("value"),
    )


@query("s4_weather_payload_check", with_sql("location_weather") + """
SELECT day(timestamp_utc) % 10 <> 0 AS accepted, count(DISTINCT location_name || CAST(CAST(timestamp_utc AS DATE) AS VARCHAR)) AS pages
FROM location_weather GROUP BY 1""")
def s4(spark, d):
    good, bad = pages.split_weather_pages(pages.parse_pages(_weather_pages(spark, d), pages.WEATHER_SCHEMA))
    both = good.withColumn("accepted", F.lit(True)).unionByName(bad.withColumn("accepted", F.lit(False)))
    return both.groupBy("accepted").agg(F.count(F.lit(1)).alias("pages"))


@query("s5_weather_rows", with_sql("location_weather") + """
SELECT timestamp_utc, location_name, latitude, longitude, location_weight / 10 AS location_weight, temperature_c,
  apparent_temperature_c, relative_humidity_pct, precipitation_mm, cloud_cover_pct, wind_speed_10m_kph,
  wind_direction_10m_deg, shortwave_radiation_wm2, direct_radiation_wm2, diffuse_radiation_wm2
FROM location_weather WHERE day(timestamp_utc) % 10 <> 0""")
def s5(spark, d):
    """Weather payload arrays to rows, with the normalised location table."""
    parsed = pages.parse_pages(_weather_pages(spark, d), pages.WEATHER_SCHEMA)
    good, _ = pages.split_weather_pages(parsed)
    columns = ["region", "location_name", "latitude", "longitude", "location_weight"]
    places = pages.region_locations(a.location_weather(spark, d).select(*columns).distinct())
    rows = pages.weather_rows(good, places, "historical", _now(), "landed_pages")
    return rows.drop("region", "ingestion_timestamp_utc", "data_source", "weather_data_type")


@query("s6_region_locations", """
WITH w AS (SELECT DISTINCT 'ALL' AS region, user_id % 4 AS loc FROM events)
SELECT region, 'loc' || CAST(loc AS VARCHAR) AS location_name, (loc + 1) / sum(loc + 1) OVER () AS location_weight FROM w""")
def s6(spark, d):
    columns = ["region", "location_name", "location_weight"]
    return pages.region_locations(a.location_weather(spark, d).select(*columns).distinct())


@query("p1_measurement_codes", with_sql("measurements", "mapped") + """
SELECT respondent AS region, upper(mtype) AS measurement_type, c.measure, CAST(sum(copies) AS BIGINT) AS n
FROM raw LEFT JOIN codes c ON upper(mtype) = c.code GROUP BY 1, 2, 3""")
def p1(spark, d):
    rows = clean.measurement_rows(a.measurements(spark, d))
    measure = clean._lookup(clean.MEASUREMENT_CODES, F.upper("measurement_type"))
    keys = ["region", F.upper("measurement_type").alias("measurement_type"), measure.alias("measure")]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


_FUEL_SQL = with_sql("hourly") + """,
f AS (SELECT event_type AS region, date_trunc('hour', ts) AS timestamp_utc,
    CASE WHEN user_id % 2 = 0 THEN 'solar_generation_mw' ELSE 'wind_generation_mw' END AS measure,
    CAST(sum(CAST(value AS DECIMAL(18,2))) - 20 AS DOUBLE) AS number FROM events GROUP BY 1, 2, 3),
fuels AS (SELECT region, timestamp_utc, measure, CASE WHEN number > 100 THEN NULL ELSE number END AS value FROM f),
wide AS (SELECT region, timestamp_utc, max(value) FILTER (measure = 'solar_generation_mw') AS solar_generation_mw,
    max(value) FILTER (measure = 'wind_generation_mw') AS wind_generation_mw FROM fuels GROUP BY 1, 2),
valid AS (SELECT *, solar_generation_mw + wind_generation_mw AS total_renewable_generation_mw FROM wide
  WHERE NOT coalesce(solar_generation_mw < 0, false) AND NOT coalesce(wind_generation_mw < 0, false))
"""


@query("p2_fuel_rows", _FUEL_SQL + "SELECT region, timestamp_utc, measure, value FROM fuels")
def p2(spark, d):
    """Fuel code mapping with lenient casts."""
    return clean.fuel_rows(a.fuel_records(spark, d))


@query("p3_typed_measurements", with_sql("measurements", "mapped") + """
SELECT region, timestamp_utc, measure, v AS value, count(*) AS copies FROM mapped GROUP BY ALL""")
def p3(spark, d):
    """Strict casts of distinct raw rows."""
    raw = clean.measurement_rows(a.measurements(spark, d)).distinct()
    rows = clean.mapped_measurements(raw)
    return rows.groupBy("region", "timestamp_utc", "measure", "value").agg(F.count(F.lit(1)).alias("copies"))


@query("p5_raw_contract", """
SELECT * FROM (VALUES ('timestamp_present', 0::BIGINT), ('region_present', 0)) v("check", failures) UNION ALL
SELECT 'measurement_type_present', 0""")
def p5(spark, d):
    return contracts.raw_measurements().violations(clean.measurement_rows(a.measurements(spark, d)))


@query("p6_canonical_contract", with_sql("hourly") + """
SELECT 'demand_mw_present' AS "check", count(*) FILTER (readings % 5 = 0) AS failures FROM hourly UNION ALL
SELECT 'demand_mw_not_negative', count(*) FILTER (readings % 5 <> 0 AND demand_mw < 40) FROM hourly UNION ALL
SELECT 'unique_key', count(*) FILTER (readings % 11 = 0) FROM hourly UNION ALL
SELECT unnest(['timestamp_utc_present', 'region_present', 'ingestion_timestamp_utc_present']), 0""")
def p6(spark, d):
    series = a.hourly_by_type(spark, d)
    copies = F.explode(F.when(F.col("readings") % 11 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    broken = series.select(
        "region", "timestamp_utc",
        F.when(F.col("readings") % 5 == 0, None).otherwise(F.col("demand_mw") - 40).alias("demand_mw"),
        _now().alias("ingestion_timestamp_utc"), "readings", copies.alias("c"),
    )
    # The second copy only trips the key check.
    checks = contracts.canonical_grid().violations(broken.where("c = 1")).where("check <> 'unique_key'")
    return checks.unionByName(contracts.canonical_grid().violations(broken).where("check = 'unique_key'"))


@query("p7_location_weather_contract", with_sql("location_weather") + """
SELECT unnest(['timestamp_utc_present','region_present','location_name_present','ingestion_timestamp_utc_present',
  'data_source_present','latitude_range','longitude_range','location_weight_positive','precipitation_mm_not_negative','wind_speed_10m_kph_not_negative',
  'shortwave_radiation_wm2_not_negative','direct_radiation_wm2_not_negative','diffuse_radiation_wm2_not_negative',
  'weather_data_type_known','unique_key']) AS "check", 0::BIGINT AS failures
UNION ALL SELECT 'relative_humidity_pct_range', count(*) FILTER (relative_humidity_pct > 100) FROM location_weather
UNION ALL SELECT 'cloud_cover_pct_range', count(*) FILTER (cloud_cover_pct > 100) FROM location_weather
UNION ALL SELECT 'wind_direction_10m_deg_range', count(*) FILTER (wind_direction_10m_deg + 30 > 360) FROM location_weather""")
def p7(spark, d):
    rows = a.location_weather(spark, d).withColumn("wind_direction_10m_deg", F.col("wind_direction_10m_deg") + 30)
    return contracts.location_weather().violations(rows)


@query("p8_renewable_contract", with_sql("hourly", "renewables") + """
SELECT unnest(['timestamp_utc_present','region_present','ingestion_timestamp_utc_present','wind_generation_mw_not_negative',
  'total_renewable_generation_mw_not_negative','unique_key']) AS "check", 0::BIGINT AS failures
UNION ALL SELECT 'solar_generation_mw_not_negative', count(*) FILTER (solar_generation_mw < 5) FROM renewables""")
def p8(spark, d):
    rows = a.renewable_actuals(spark, d).withColumn("ingestion_timestamp_utc", _now())
    shifted = rows.withColumn("solar_generation_mw", F.col("solar_generation_mw") - 5)
    return contracts.renewable_generation().violations(shifted)


@query("p9_forecast_contract", with_sql("hourly", "forecasts") + """
SELECT unnest(['forecast_origin_present','timestamp_utc_present','created_at_utc_present','target_supported','unique_key']) AS "check",
  0::BIGINT AS failures
UNION ALL SELECT 'predicted_value_finite', count(*) FILTER (predicted_value > 90) FROM forecasts""")
def p9(spark, d):
    value = F.when(F.col("predicted_value") > 90, F.lit(float("inf"))).otherwise(F.col("predicted_value"))
    return contracts.target_forecasts().violations(a.forecasts(spark, d).withColumn("predicted_value", value))


@query("p10_prediction_contract", with_sql("hourly", "forecasts") + """
SELECT unnest(['forecast_origin_present','timestamp_utc_present','region_present','prediction_finite']) AS "check",
  0::BIGINT AS failures
UNION ALL SELECT 'unique_key', count(*) - count(DISTINCT (region, timestamp_utc)) FROM forecasts
UNION ALL SELECT 'prediction_not_negative', count(*) FILTER (predicted_value < 20) FROM forecasts""")
def p10(spark, d):
    rows = a.forecasts(spark, d)
    return contracts.batch_predictions().violations(rows.withColumn("predicted_demand_mw", F.col("predicted_value") - 20))


@query("p14_missing_demand_split", with_sql("measurements", "mapped") + """,
wide AS (SELECT region, timestamp_utc, max(v) FILTER (measure = 'demand_mw') AS demand_mw FROM mapped GROUP BY 1, 2)
SELECT demand_mw IS NOT NULL AS retained, count(*) AS n FROM wide GROUP BY 1""")
def p14(spark, d):
    """Rows kept and rows quarantined for lack of demand."""
    rows = clean.mapped_measurements(clean.measurement_rows(a.measurements(spark, d)))
    kept, absent = clean.apply_missing_demand_policy(clean.pivot_measures(rows, clean.MEASURES), "drop")
    both = kept.withColumn("retained", F.lit(True)).unionByName(absent.withColumn("retained", F.lit(False)))
    return both.groupBy("retained").agg(F.count(F.lit(1)).alias("n"))


@query("p15_negative_quarantine", _FUEL_SQL + """
SELECT region, timestamp_utc, solar_generation_mw, wind_generation_mw FROM wide
WHERE coalesce(solar_generation_mw < 0, false) OR coalesce(wind_generation_mw < 0, false)""")
def p15(spark, d):
    return clean.split_renewables(a.fuel_records(spark, d), _now())[1]


@query("a9_renewable_rows", _FUEL_SQL + """
SELECT region, timestamp_utc, solar_generation_mw, wind_generation_mw, round(total_renewable_generation_mw, 6)
  AS total_renewable_generation_mw FROM valid""")
def a9(spark, d):
    valid = clean.split_renewables(a.fuel_records(spark, d), _now())[0].drop("ingestion_timestamp_utc")
    return valid.withColumn("total_renewable_generation_mw", F.round("total_renewable_generation_mw", 6))


@query("a8_renewable_report", _FUEL_SQL + """,
g AS (SELECT greatest(date_diff('hour', lag(timestamp_utc) OVER (PARTITION BY region ORDER BY timestamp_utc), timestamp_utc) - 1, 0) AS gap FROM valid)
SELECT (SELECT count(*) FROM fuels) AS raw_measurement_rows, (SELECT count(*) FROM wide) AS hourly_rows,
  (SELECT count(*) FROM wide) - (SELECT count(*) FROM valid) AS quarantined_rows, count(*) AS retained_rows,
  count(*) - count(solar_generation_mw) AS missing_solar_rows, count(*) - count(wind_generation_mw) AS missing_wind_rows,
  count(*) - count(total_renewable_generation_mw) AS missing_total_rows,
  (SELECT CAST(sum(gap) AS BIGINT) FROM g) AS renewable_target_gap_count FROM valid""")
def a8(spark, d):
    records = a.fuel_records(spark, d)
    valid, bad = clean.split_renewables(records, _now())
    return clean.renewable_report(records, valid, bad, SMALL)


@query("a1_conflicting_measurements", with_sql("measurements", "mapped") + """
SELECT region, timestamp_utc, measure, count(*) AS copies, min(v) AS low, max(v) AS high
FROM (SELECT m.* FROM mapped m JOIN (SELECT 1) ON true) GROUP BY 1, 2, 3
HAVING count(DISTINCT v) + CASE WHEN count(*) > count(v) THEN 1 ELSE 0 END > 1""")
def a1(spark, d):
    """Keys with several values; missing counts as a value."""
    rows = clean.measurement_rows(a.measurements(spark, d)).distinct()
    return clean.conflicts(clean.mapped_measurements(rows))


@query("a2_pivot_measures", with_sql("measurements", "mapped") + """
SELECT region, timestamp_utc, max(v) FILTER (measure = 'demand_mw') AS demand_mw,
  max(v) FILTER (measure = 'forecast_demand_mw') AS forecast_demand_mw,
  max(v) FILTER (measure = 'net_generation_mw') AS net_generation_mw,
  max(v) FILTER (measure = 'total_interchange_mw') AS total_interchange_mw FROM mapped GROUP BY 1, 2""")
def a2(spark, d):
    rows = clean.mapped_measurements(clean.measurement_rows(a.measurements(spark, d)))
    return clean.pivot_measures(rows, clean.MEASURES)


@query("a3_quality_report", with_sql("hourly") + """,
q AS (SELECT region, timestamp_utc, CASE WHEN readings % 5 = 0 THEN NULL ELSE demand_mw END AS demand_mw,
  demand_mw - 50 AS net_generation_mw FROM hourly),
g AS (SELECT greatest(date_diff('hour', lag(timestamp_utc) OVER (PARTITION BY region ORDER BY timestamp_utc), timestamp_utc) - 1, 0) AS gap FROM q)
SELECT count(*) AS row_count, min(timestamp_utc) AS range_start, max(timestamp_utc) AS range_end,
  count(DISTINCT region) AS region_count, list_sort(list(DISTINCT region)) AS regions, 0::BIGINT AS duplicate_count,
  count(*) FILTER (net_generation_mw < 0) AS negative_value_count, (SELECT CAST(sum(gap) AS BIGINT) FROM g) AS timestamp_gap_count,
  count(*) - count(demand_mw) AS missing_demand_mw, 0::BIGINT AS missing_net_generation_mw,
  (count(*) - count(demand_mw)) * 100.0::DOUBLE / count(*) AS missing_pct_demand_mw, 0.0::DOUBLE AS missing_pct_net_generation_mw,
  (SELECT sum(gap) = 0 FROM g) AS expected_hourly_frequency FROM q""")
def a3(spark, d):
    series = a.hourly_by_type(spark, d).select(
        "region", "timestamp_utc",
        F.when(F.col("readings") % 5 == 0, None).otherwise(F.col("demand_mw")).alias("demand_mw"),
        (F.col("demand_mw") - 50).alias("net_generation_mw"),
    )
    return clean.quality_report(series, ("demand_mw", "net_generation_mw"), SMALL)


@query("a3_quality_report_null_keys", with_sql("hourly") + """,
q AS (SELECT CASE WHEN readings % 7 = 0 THEN NULL ELSE region END AS region, CASE WHEN readings % 5 = 0 THEN NULL ELSE timestamp_utc END AS timestamp_utc, demand_mw FROM hourly),
g AS (SELECT greatest(date_diff('hour', lag(timestamp_utc) OVER (PARTITION BY region ORDER BY timestamp_utc), timestamp_utc) - 1, 0) AS gap
  FROM (SELECT DISTINCT region, timestamp_utc FROM q WHERE region IS NOT NULL AND timestamp_utc IS NOT NULL))
SELECT count(*) AS row_count, min(timestamp_utc) AS range_start, max(timestamp_utc) AS range_end, count(DISTINCT region) AS region_count,
  list_sort(list(DISTINCT region) FILTER (region IS NOT NULL)) AS regions,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT region, timestamp_utc FROM q)) AS duplicate_count,
  count(*) FILTER (demand_mw < 0) AS negative_value_count, (SELECT CAST(coalesce(sum(gap), 0) AS BIGINT) FROM g) AS timestamp_gap_count,
  count(*) - count(demand_mw) AS missing_demand_mw, (count(*) - count(demand_mw)) * 100.0::DOUBLE / count(*) AS missing_pct_demand_mw,
  (SELECT coalesce(sum(gap), 0) = 0 FROM g) AND count(*) = (SELECT count(*) FROM (SELECT DISTINCT region, timestamp_utc FROM q)) AS expected_hourly_frequency
FROM q""")
def a3_null_keys(spark, d):
    """Rows without region or time are reported, not lost."""
    series = a.hourly_by_type(spark, d).select(
        F.when(F.col("readings") % 7 != 0, F.col("region")).alias("region"),
        F.when(F.col("readings") % 5 != 0, F.col("timestamp_utc")).alias("timestamp_utc"), "demand_mw",
    )
    return clean.quality_report(series, ("demand_mw",), SMALL)


@query("a4_reconciliation", with_sql("measurements", "mapped") + """,
wide AS (SELECT region, timestamp_utc, max(v) FILTER (measure = 'demand_mw') AS demand_mw FROM mapped GROUP BY 1, 2),
spine AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-02', TIMESTAMP '2024-02-01 23:00:00', INTERVAL 1 HOUR)) AS t),
seen AS (SELECT DISTINCT timestamp_utc AS t FROM wide)
SELECT (SELECT count(*) FROM measurements) AS raw_measurement_rows, (SELECT count(*) FROM raw) AS unique_source_records,
  (SELECT count(*) FROM (SELECT 1 FROM mapped GROUP BY region, timestamp_utc, measure
    HAVING count(DISTINCT v) + CASE WHEN count(*) > count(v) THEN 1 ELSE 0 END > 1)) AS conflicting_duplicates,
  count(*) AS materialized_pivoted_timestamp_rows, count(*) - count(demand_mw) AS missing_demand_rows,
  count(*) FILTER (demand_mw < 0) AS other_invalid_rows, count(demand_mw) AS retained_rows,
  (SELECT count(*) FROM spine) AS expected_hourly_timestamps,
  (SELECT count(*) FROM spine WHERE t NOT IN (SELECT t FROM seen)) AS missing_source_timestamp_rows,
  (SELECT count(*) FROM seen WHERE t NOT IN (SELECT t FROM spine)) AS unexpected_timestamp_rows,
  (SELECT count(*) FROM measurements) - (SELECT count(*) FROM raw) AS exact_duplicates_removed,
  count(*) + (SELECT count(*) FROM measurements) - (SELECT count(*) FROM raw) AS pivoted_timestamp_rows,
  0::BIGINT AS unexplained_difference FROM wide""")
def a4(spark, d):
    """Raw rows to retained rows with missing and unexpected hours."""
    records = a.measurements(spark, d)
    wide = clean.pivot_measures(clean.mapped_measurements(clean.measurement_rows(records)), clean.MEASURES)
    kept, _ = clean.apply_missing_demand_policy(wide, "drop")
    return clean.reconciliation(records, wide, kept, "2024-01-02", "2024-02-01")


@query("u2_hour_differences", with_sql("total") + """,
spine AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-02', TIMESTAMP '2024-02-01 23:00:00', INTERVAL 1 HOUR)) AS t)
SELECT coalesce(t, timestamp_utc) AS timestamp_utc,
  CASE WHEN timestamp_utc IS NULL THEN 'missing' WHEN t IS NULL THEN 'unexpected' ELSE 'both' END AS side
FROM spine FULL JOIN total ON t = timestamp_utc""")
def u2(spark, d):
    """Time-set differences and intersection."""
    return clean.hour_differences(a.hourly_total(spark, d), "2024-01-02", "2024-02-01")


_REGIONAL_SQL = with_sql("location_weather") + """,
agg AS (SELECT region, timestamp_utc, weather_data_type, count(*) AS n, count(relative_humidity_pct) AS nh,
    sum(location_weight) AS w,
    sum(temperature_c * location_weight) AS t, sum(relative_humidity_pct * location_weight) AS h,
    sum(sin(radians(wind_direction_10m_deg)) * location_weight) AS s, sum(cos(radians(wind_direction_10m_deg)) * location_weight) AS c,
    min(temperature_c) AS tmin, max(temperature_c) AS tmax, max(wind_speed_10m_kph) - min(wind_speed_10m_kph) AS spread
  FROM location_weather GROUP BY 1, 2, 3)
"""


@query("a5_regional_weather", _REGIONAL_SQL + """
SELECT region, timestamp_utc, round(t / w, 6) AS temperature_c, CASE WHEN nh = n THEN round(h / w, 6) END AS relative_humidity_pct,
  tmin AS temperature_min_c, tmax AS temperature_max_c, round(tmax - tmin, 6) AS temperature_spread_c,
  round(spread, 6) AS wind_speed_spread_kph FROM agg WHERE n = 4""")
def a5(spark, d):
    rows = a.location_weather(spark, d)
    out = weather.regional_weather(rows, rows.select("region", "location_name").distinct(), require_all_locations=False)
    return out.select(
        "region", "timestamp_utc", F.round("temperature_c", 6).alias("temperature_c"),
        F.round("relative_humidity_pct", 6).alias("relative_humidity_pct"), "temperature_min_c", "temperature_max_c",
        F.round("temperature_spread_c", 6).alias("temperature_spread_c"),
        F.round("wind_speed_spread_kph", 6).alias("wind_speed_spread_kph"),
    )


@query("a6_circular_wind", _REGIONAL_SQL + """
SELECT timestamp_utc, round(s / w, 5) + 0.0 AS wind_direction_sin, round(c / w, 5) + 0.0 AS wind_direction_cos,
  round((degrees(atan2(s / w, c / w)) + 360) % 360, 4) AS wind_direction_10m_deg FROM agg WHERE n = 4 AND s * s + c * c > 1e-6""")
def a6(spark, d):
    rows = a.location_weather(spark, d)
    out = weather.regional_weather(rows, rows.select("region", "location_name").distinct(), require_all_locations=False)
    keep = F.pow("wind_direction_sin", F.lit(2)) + F.pow("wind_direction_cos", F.lit(2)) > 1e-8
    return out.where(keep).select(
        "timestamp_utc", (F.round("wind_direction_sin", 5) + 0.0).alias("wind_direction_sin"),
        (F.round("wind_direction_cos", 5) + 0.0).alias("wind_direction_cos"),
        F.round("wind_direction_10m_deg", 4).alias("wind_direction_10m_deg"),
    )


@query("a7_weather_report", with_sql("location_weather") + """,
whole AS (SELECT timestamp_utc FROM location_weather GROUP BY 1 HAVING count(*) = 4),
g AS (SELECT greatest(date_diff('hour', lag(timestamp_utc) OVER (ORDER BY timestamp_utc), timestamp_utc) - 1, 0) AS gap FROM whole)
SELECT count(*) AS location_rows, 0::BIGINT AS duplicate_rows, ['historical'] AS weather_data_types,
  count(*) - count(relative_humidity_pct) AS missing_relative_humidity_pct, count(*) - count(temperature_c) AS missing_temperature_c,
  (SELECT count(*) FROM whole) AS regional_rows, (SELECT CAST(sum(gap) AS BIGINT) FROM g) AS timestamp_gap_count FROM location_weather""")
def a7(spark, d):
    rows = a.location_weather(spark, d)
    regional = weather.regional_weather(rows, rows.select("region", "location_name").distinct(), require_all_locations=False)
    columns = ["region", "location_name", "timestamp_utc", "weather_data_type", "temperature_c", "relative_humidity_pct"]
    return weather.weather_report(rows.select(*columns), regional, SMALL)


@query("w16_keep_last", """
SELECT o_custkey, o_orderpriority, max(o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice
FROM orders GROUP BY 1, 2""")
def w16(spark, d):
    """One row per key, newest wins."""
    rows = a.table(spark, d, "orders").select("o_custkey", "o_orderpriority", "o_orderkey", "o_totalprice")
    return keep_last(rows, ["o_custkey", "o_orderpriority"], ["o_orderkey"])


@query("w12_backward_arrivals", """
WITH m AS (SELECT event_type AS region, event_id, ts - INTERVAL 1 HOUR * (user_id % 3) AS t FROM events),
p AS (SELECT *, lag(t) OVER (PARTITION BY region ORDER BY event_id) AS prev FROM m)
SELECT region, event_id, t AS timestamp_utc FROM p WHERE t < prev""")
def w12(spark, d):
    """Rows that arrive after a later time was already seen just before them."""
    rows = a.events(spark, d).select(
        F.col("event_type").alias("region"), "event_id",
        F.timestamp_micros(F.unix_micros("ts") - (F.col("user_id") % 3) * 3_600_000_000).alias("timestamp_utc"),
    )
    linked = walk(
        rows, keys=["region"], order=["event_id"], chunk=F.floor(F.col("event_id") / 1000), carry=["timestamp_utc"]
    )
    return linked.where(F.col("timestamp_utc") < F.col("_prev.timestamp_utc")).drop("_prev")


@query("s13_keyed_upsert", """
WITH e AS (SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey % 3 > 0),
i AS (SELECT o_orderkey, o_custkey, o_totalprice + 1 AS o_totalprice FROM orders WHERE o_orderkey % 2 = 0)
SELECT * FROM e WHERE o_orderkey NOT IN (SELECT o_orderkey FROM i) UNION ALL SELECT * FROM i""")
def s13(spark, d):
    """Delete by key and insert, as anti-join and union."""
    rows = a.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    incoming = rows.where("o_orderkey % 2 = 0").withColumn("o_totalprice", F.col("o_totalprice") + 1)
    return tables.merge_rows(rows.where("o_orderkey % 3 > 0"), incoming, ["o_orderkey"])


@query("s14_append_absent", """
SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 3 = 0""")
def s14(spark, d):
    rows = a.table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return tables.append_absent(rows.where("o_orderkey % 3 > 0"), rows.where("o_orderkey % 2 = 0"), "o_orderkey")


@query("s15_replace_runs", """
SELECT o_custkey, o_orderkey, o_totalprice + 5 AS o_totalprice FROM orders WHERE o_custkey % 2 = 0 UNION ALL
SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE o_custkey % 2 = 1""")
def s15(spark, d):
    """All rows of an incoming run replace the stored run."""
    rows = a.table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    incoming = rows.where("o_custkey % 2 = 0").withColumn("o_totalprice", F.col("o_totalprice") + 5)
    return tables.replace_runs(rows, incoming, "o_custkey")


@query("s17_range_read", """
SELECT o_orderkey, o_custkey AS region, CAST(o_orderdate AS TIMESTAMP) AS timestamp_utc, o_orderpriority FROM orders
WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-06-30' AND o_orderpriority = '2-HIGH'""")
def s17(spark, d):
    """Filtered inclusive range read."""
    rows = a.table(spark, d, "orders").select(
        "o_orderkey", F.col("o_custkey").alias("region"), F.col("o_orderdate").cast("timestamp").alias("timestamp_utc"),
        "o_orderpriority",
    )
    return tables.read_range(rows, start="1996-01-01", end="1997-06-30", equal={"o_orderpriority": "2-HIGH", "region": None})


@query("s21_listing_export", with_sql("hourly") + """
SELECT region, strftime(timestamp_utc, '%Y-%m-%dT%H:%M:%SZ') AS timestamp_utc, demand_mw FROM hourly""")
def s21(spark, d):
    """Timestamps rendered as ISO text with Z."""
    return clean.listing(a.hourly_by_type(spark, d).drop("readings"))


@query("s12_report_json", with_sql("hourly") + """
SELECT '{"region":"' || region || '","hours":' || count(*) || ',"bad":null,"last":"' ||
  strftime(max(timestamp_utc), '%Y-%m-%dT%H:%M:%SZ') || '"}' AS value FROM hourly GROUP BY region""")
def s12(spark, d):
    """Reports as JSON text with NaN as null."""
    report = a.hourly_by_type(spark, d).groupBy("region").agg(
        F.count(F.lit(1)).alias("hours"), F.lit(float("nan")).alias("bad"), F.max("timestamp_utc").alias("last")
    )
    stamped = report.withColumn("last", time.iso_z("last"))
    return tables.report_json(stamped)


@query("s23_json_records", """
SELECT '{"event_id":' || event_id || ',"ts":"' || strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%SZ') || '","props":{"k":'
  || json_extract_string(props, '$.k') || '}}' AS record FROM events""")
def s23(spark, d):
    rows = a.events(spark, d).select("event_id", F.date_trunc("SECOND", "ts").alias("ts"), F.col("props").alias("props_json"))
    return tables.json_records(rows.withColumn("ts", time.iso_z("ts")))


@query("x20_redaction", """
SELECT event_id, 'GET /v2?frequency=hourly&api_key=[REDACTED]&offset=' || event_id AS line,
  '{"api_key": "[REDACTED]", "n": ' || event_id || ', "echo": "[REDACTED]"}' AS body FROM events""")
def x20(spark, d):
    """Credentials removed from text and JSON."""
    n = F.col("event_id").cast("string")
    line = F.concat(F.lit("GET /v2?frequency=hourly&api_key=k"), n, F.lit("&offset="), n)
    body = F.concat(F.lit('{"api_key": "k'), n, F.lit('", "n": '), n, F.lit(', "echo": "s3cr%2Bt"}'))
    return a.events(spark, d).select("event_id", text.redact(line).alias("line"), text.redact(body, ("s3cr+t",)).alias("body"))


@query("x4_calendar", """
SELECT event_id, CAST(hour(ts) AS DOUBLE) AS hour, CAST(isodow(ts) - 1 AS DOUBLE) AS day_of_week, CAST(day(ts) AS DOUBLE) AS day_of_month,
  CAST(week(ts) AS DOUBLE) AS week_of_year, CAST(month(ts) AS DOUBLE) AS month, CAST(quarter(ts) AS DOUBLE) AS quarter,
  CAST(isodow(ts) >= 6 AS DOUBLE) AS is_weekend, round(sin(2 * pi() * hour(ts) / 24), 9) AS hour_sin, round(cos(2 * pi() * hour(ts) / 24), 9) AS hour_cos,
  round(sin(2 * pi() * (isodow(ts) - 1) / 7), 9) AS day_of_week_sin, round(cos(2 * pi() * (isodow(ts) - 1) / 7), 9) AS day_of_week_cos FROM events""")
def x4(spark, d):
    """Calendar features with cycles."""
    columns = calendar.calendar_features("ts")
    out = [F.round(c, 9).alias(n) if n.endswith(("sin", "cos")) else c.alias(n) for n, c in columns.items()]
    return a.events(spark, d).select("event_id", *out)


@query("x6_solar_features", with_sql("hourly", "regional_weather") + """
SELECT region, timestamp_utc, CAST(shortwave_radiation_wm2 > 0 AS DOUBLE) AS daylight_indicator,
  round(sin(2 * pi() * hour(timestamp_utc) / 24), 9) AS hour_sin_solar, round(cos(2 * pi() * hour(timestamp_utc) / 24), 9) AS hour_cos_solar,
  round(sin(2 * pi() * month(timestamp_utc) / 12), 9) AS month_sin_solar, round(cos(2 * pi() * month(timestamp_utc) / 12), 9) AS month_cos_solar
FROM regional_weather""")
def x6(spark, d):
    out = [F.round(c, 9).alias(n) for n, c in calendar.solar_features().items()]
    return a.regional_weather(spark, d).select("region", "timestamp_utc", *out)


@query("x7_wind_features", with_sql("hourly", "regional_weather") + """
SELECT region, timestamp_utc, round(wind_speed_10m_kph * wind_speed_10m_kph, 6) AS wind_speed_squared,
  CAST((month(timestamp_utc) - 1) // 3 AS DOUBLE) AS season FROM regional_weather""")
def x7(spark, d):
    columns = calendar.wind_features()
    return a.regional_weather(spark, d).select(
        "region", "timestamp_utc", F.round(columns["wind_speed_squared"], 6).alias("wind_speed_squared"),
        columns["season"].alias("season"),
    )


@query("x8_weather_derivations", with_sql("hourly", "regional_weather") + """
SELECT region, timestamp_utc, round(temperature_c * temperature_c, 6) AS temperature_squared,
  round(greatest(temperature_c - 18, 0), 6) AS cooling_degree, round(greatest(18 - temperature_c, 0), 6) AS heating_degree,
  round(temperature_c * hour(timestamp_utc), 6) AS temperature_hour_interaction,
  round(temperature_c * CAST(isodow(timestamp_utc) >= 6 AS DOUBLE), 6) + 0.0 AS temperature_weekend_interaction,
  round(apparent_temperature_c - temperature_c, 6) AS apparent_temperature_difference,
  round(relative_humidity_pct * temperature_c, 6) AS humidity_temperature_interaction,
  round(wind_speed_10m_kph * wind_speed_10m_kph, 6) AS wind_speed_squared,
  round(sin(2 * pi() * month(timestamp_utc) / 12), 6) AS month_sin, round(cos(2 * pi() * month(timestamp_utc) / 12), 6) AS month_cos,
  CAST((month(timestamp_utc) - 1) // 3 AS DOUBLE) AS season, CAST(shortwave_radiation_wm2 > 0 AS DOUBLE) AS solar_radiation_daylight,
  round(sin(radians(wind_direction_10m_deg)), 6) AS wind_direction_sin, round(cos(radians(wind_direction_10m_deg)), 6) AS wind_direction_cos
FROM regional_weather""")
def x8(spark, d):
    columns = {**calendar.weather_derivations(), **calendar.wind_direction_parts()}
    out = [(F.round(c, 6) + 0.0).alias(n) for n, c in columns.items()]
    return a.regional_weather(spark, d).select("region", "timestamp_utc", *out)


@query("x25_data_age", with_sql("hourly") + """
SELECT region, timestamp_utc, CASE WHEN h <= 2 THEN 'fresh' WHEN h <= 24 THEN 'aging' ELSE 'stale' END AS band
FROM (SELECT *, date_diff('hour', timestamp_utc, TIMESTAMP '2024-01-30 23:00:00') AS h FROM hourly)""")
def x25(spark, d):
    now = F.lit("2024-01-30 23:00:00").cast("timestamp")
    return a.hourly_by_type(spark, d).select(
        "region", "timestamp_utc", time.data_age_band(F.col("timestamp_utc"), now).alias("band")
    )


def _folder(spark, what):
    return f"{shared_folder(spark).rstrip('/')}/{what}-{uuid4().hex}"


@query("s9_stored_months", with_sql("hourly") + """
SELECT region, timestamp_utc, CASE WHEN readings % 3 = 0 THEN demand_mw + 1 ELSE demand_mw END AS demand_mw FROM hourly WHERE readings % 2 = 0 OR readings % 3 = 0""")
def s9(spark, d):
    """Two batches merged into a table on disk, months checked, then read back."""
    rows = a.hourly_by_type(spark, d).select("region", "timestamp_utc", "demand_mw", "readings")
    path = _folder(spark, "stored-months")
    first, second = rows.where("readings % 2 = 0"), rows.where("readings % 3 = 0").withColumn("demand_mw", F.col("demand_mw") + 1)
    for batch in (first, second):
        tables.upsert_table(spark, path, batch.drop("readings"), ["region", "timestamp_utc"])
    tables.check_table(spark, path)
    return tables.read_table(spark, path, rows.drop("readings").schema).select("region", "timestamp_utc", "demand_mw")


@query("s20_artifacts", """
SELECT o_orderpriority, count(*) AS n, round(CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE), 2) AS total,
  CAST(row_number() OVER (ORDER BY sum(CAST(o_totalprice AS DECIMAL(18, 2))) DESC, o_orderpriority) AS INTEGER) AS rank FROM orders GROUP BY o_orderpriority""")
def s20(spark, d):
    """Result frames exported as Parquet, a ranking as CSV, and the ranking read again by its schema."""
    orders = a.table(spark, d, "orders")
    price = F.col("o_totalprice").cast("decimal(18,2)")
    board = orders.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(price).cast("double"), 2).alias("total"))
    ranked = board.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("total"), "o_orderpriority")))
    path = _folder(spark, "artifacts")
    tables.export_artifacts(path, frames={"predictions": orders.select("o_orderkey", "o_totalprice")}, tables_csv={"leaderboard": ranked})
    return tables.read_leaderboard(spark, f"{path}/leaderboard", ranked.schema)
