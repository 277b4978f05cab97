"""Projections of the supplied tables into the series shapes the operators expect.

Each Spark adapter has a SQL common table expression of the same content in ``SQL``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _money(column: str) -> Column:
    return F.col(column).cast("decimal(18,2)")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def hourly_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly series per event type; gappy at small scale."""
    return (
        events(spark, sf_dir)
        .groupBy(F.col("event_type").alias("region"), F.date_trunc("HOUR", "ts").alias("timestamp_utc"))
        .agg(F.sum(_money("value")).cast("double").alias("demand_mw"), F.count(F.lit(1)).alias("readings"))
    )


def hourly_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One dense hourly series over all events."""
    return (
        events(spark, sf_dir)
        .groupBy(F.lit("ALL").alias("region"), F.date_trunc("HOUR", "ts").alias("timestamp_utc"))
        .agg(F.sum(_money("value")).cast("double").alias("demand_mw"), F.count(F.lit(1)).alias("readings"))
    )


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long measurement rows: region, hour, code, value and arrival sequence."""
    code = F.element_at(F.array(*[F.lit(c) for c in ("d", " DF", "zz", "TI")]), (F.col("user_id") % 4 + 1).cast("int"))
    name = F.when(F.col("user_id") % 8 == 2, "Net generation").when(F.col("user_id") % 8 == 6, "Coal")
    return events(spark, sf_dir).select(
        F.date_format(F.date_trunc("HOUR", "ts"), "yyyy-MM-dd'T'HH").alias("period"),
        F.col("event_type").alias("respondent"),
        code.alias("type"),
        name.alias("type_name"),
        F.when(F.col("event_id") % 97 == 0, None)
        .otherwise(F.date_format("ts", "mm").cast("int") % 3 + F.col("user_id") % 4)
        .cast("string")
        .alias("value"),
        F.col("event_id").alias("_ingest_seq"),
    )


def fuel_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long fuel rows, one value per (region, hour, fuel)."""
    fuel = F.when(F.col("user_id") % 3 == 0, "sun").when(F.col("user_id") % 3 == 1, "WND").otherwise("WIND ")
    return (
        events(spark, sf_dir)
        .groupBy(
            F.date_format(F.date_trunc("HOUR", "ts"), "yyyy-MM-dd'T'HH").alias("period"),
            F.col("event_type").alias("respondent"),
            F.when(F.col("user_id") % 2 == 0, "SUN").otherwise("WND").alias("fueltype"),
        )
        .agg((F.sum(_money("value")) - 20).cast("double").alias("number"), F.max("event_id").alias("_ingest_seq"))
        .select(
            "period", "respondent",
            F.when(F.col("number") > 60, None).otherwise(F.col("fueltype")).alias("fueltype"),
            F.lit(None).cast("string").alias("type"),
            F.when(F.col("fueltype") == "SUN", "Solar").otherwise("wind generation").alias("type_name"),
            F.when(F.col("number") > 100, None).otherwise(F.col("number")).cast("string").alias("value"),
            "_ingest_seq",
        )
    )


def location_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Location weather rows: four locations of one region, hourly."""
    amount = F.col("v")
    base = (
        events(spark, sf_dir)
        .groupBy(F.date_trunc("HOUR", "ts").alias("timestamp_utc"), (F.col("user_id") % 4).alias("loc"))
        .agg(F.sum(_money("value")).cast("double").alias("v"))
    )
    return base.select(
        "timestamp_utc",
        F.lit("ALL").alias("region"),
        F.concat(F.lit("loc"), F.col("loc").cast("string")).alias("location_name"),
        (F.col("loc") + 40).cast("double").alias("latitude"),
        (F.col("loc") - 80).cast("double").alias("longitude"),
        (F.col("loc") + 1).cast("double").alias("location_weight"),
        (amount % 35 - 5).alias("temperature_c"),
        (amount % 35 - 6).alias("apparent_temperature_c"),
        F.when(amount > 200, None).otherwise(amount % 101).alias("relative_humidity_pct"),
        (amount % 4).alias("precipitation_mm"),
        (amount * 3 % 101).alias("cloud_cover_pct"),
        (amount % 41).alias("wind_speed_10m_kph"),
        (amount * 10 % 360).alias("wind_direction_10m_deg"),
        _radiation(F.hour("timestamp_utc")).alias("shortwave_radiation_wm2"),
        (_radiation(F.hour("timestamp_utc")) * 0.5).alias("direct_radiation_wm2"),
        (_radiation(F.hour("timestamp_utc")) * 0.25).alias("diffuse_radiation_wm2"),
        F.lit("2024-02-01").cast("timestamp").alias("ingestion_timestamp_utc"),
        F.lit("landed_pages").alias("data_source"),
        F.lit("historical").alias("weather_data_type"),
    )


def _radiation(hour: Column) -> Column:
    return F.when(hour.between(6, 18), 600.0 - 80.0 * F.abs(hour - 12)).otherwise(0.0)


def regional_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regional weather aligned to the event-type series; every seventh reading count is absent."""
    d = F.col("demand_mw")
    hour = F.hour("timestamp_utc")
    return (
        hourly_by_type(spark, sf_dir)
        .where(F.col("readings") % 7 != 0)
        .select(
            "timestamp_utc", "region",
            F.lit("historical").alias("weather_data_type"),
            (d % 35 - 5).alias("temperature_c"),
            (d % 35 - 6).alias("apparent_temperature_c"),
            (d * 3 % 110).alias("relative_humidity_pct"),
            (d % 4).alias("precipitation_mm"),
            (d * 3 % 101).alias("cloud_cover_pct"),
            (d % 41).alias("wind_speed_10m_kph"),
            (d * 10 % 360).alias("wind_direction_10m_deg"),
            _radiation(hour).alias("shortwave_radiation_wm2"),
            (_radiation(hour) * 0.5).alias("direct_radiation_wm2"),
            (_radiation(hour) * 0.25).alias("diffuse_radiation_wm2"),
        )
    )


def target_series(spark: SparkSession, sf_dir: str, target: str) -> DataFrame:
    return hourly_by_type(spark, sf_dir).withColumnRenamed("demand_mw", target).drop("readings")


def renewable_actuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Solar and wind actuals derived from the type series, with holes."""
    d, n = F.col("demand_mw"), F.col("readings")
    solar = F.when(n % 5 == 0, None).otherwise(d * 0.25)
    wind = F.when(n % 6 == 0, None).otherwise(d * 0.125)
    return (
        hourly_by_type(spark, sf_dir)
        .where(n % 4 != 1)
        .select(
            "region", "timestamp_utc", solar.alias("solar_generation_mw"), wind.alias("wind_generation_mw"),
            (solar + wind).alias("total_renewable_generation_mw"),
        )
    )


def forecasts(spark: SparkSession, sf_dir: str, target: str = "demand_mw") -> DataFrame:
    """Two daily origins per hour: the value of the day before, issued at 23:00 one or two days earlier."""
    series = hourly_by_type(spark, sf_dir).select("region", "timestamp_utc", "demand_mw")
    day = F.expr("timestamp_utc + interval 24 hours")
    source = series.select("region", day.alias("timestamp_utc"), F.col("demand_mw").alias("predicted_value"))
    midnight = F.date_trunc("DAY", "timestamp_utc")
    origins = F.array(
        F.struct((midnight - F.expr("interval 1 hour")).alias("o"), F.lit("seasonal_a").alias("m")),
        F.struct((midnight - F.expr("interval 25 hours")).alias("o"), F.lit("seasonal_b").alias("m")),
    )
    step = (F.unix_micros("timestamp_utc") - F.unix_micros("forecast_origin")) / F.lit(3_600_000_000)
    return (
        series.select("region", "timestamp_utc")
        .join(source, ["region", "timestamp_utc"])
        .withColumn("_o", F.explode(origins))
        .select(
            "region", F.lit(target).alias("target"), F.col("_o.o").alias("forecast_origin"), "timestamp_utc",
            "predicted_value", F.col("_o.m").alias("model_name"), F.lit("1").alias("model_version"),
            F.lit("run").alias("run_id"), F.lit("none").alias("weather_mode"),
        )
        .withColumn("forecast_step", step.cast("int"))
        .withColumn("created_at_utc", F.col("forecast_origin"))
    )


def dispatch_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dispatch schedules: one run per battery of the fleet, arithmetic over the hourly series of its region.

    Hours and batteries are small tables but their pairs are many rows of few regions. So batteries are dealt into
    shares, and the tasks of both repartitions take some shares each, whichever side of the join is broadcast. Their
    key is not in the order of the distinct one: Spark would take its few, coalesced partitions for theirs.
    """
    d, n = F.col("demand_mw"), F.col("readings")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    share = ["_share", "region"]
    fleet = batteries(spark, sf_dir).select("region", "battery_id", F.pmod(F.xxhash64("battery_id"), F.lit(4 * tasks)).alias("_share"))
    hours = hourly_by_type(spark, sf_dir).join(fleet.select("region", "_share").distinct(), "region")
    charge = F.when(n % 3 == 0, n * 2.0).otherwise(0.0)
    discharge = F.when(n % 3 == 1, n * 1.5).otherwise(0.0)
    return (
        hours.repartition(tasks, *share)
        .join(fleet.repartition(tasks, *share), share)
        .select(
            F.concat(F.lit("run-"), F.col("battery_id")).alias("dispatch_run_id"), "region", "battery_id",
            F.lit("2024-01-01").cast("timestamp").alias("forecast_origin"), "timestamp_utc",
            d.alias("demand_forecast_mw"), (d * 0.25).alias("renewable_forecast_mw"),
            (d * 0.75).alias("net_load_before_battery_mw"),
            charge.alias("charge_mw"), discharge.alias("discharge_mw"),
            (F.lit(50.0) + (n % 5) * 10.0).alias("soc_start_mwh"),
            (F.lit(50.0) + ((n + 1) % 5) * 10.0).alias("soc_end_mwh"),
            (d * 0.75 + charge - discharge).alias("net_load_after_battery_mw"),
            (F.lit(20.0) + F.hour("timestamp_utc")).alias("energy_price"),
            F.lit(2.0).alias("marginal_degradation_cost"),
        )
    )


def batteries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A battery fleet: one battery per supplier, placed in the region of an event type."""
    k = F.col("s_suppkey")
    types = F.array(*[F.lit(t) for t in ("click", "error", "purchase", "signup", "view")])
    size = F.lit(40.0) + k % 20
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("b"), k.cast("string")).alias("battery_id"),
        F.element_at(types, (k % 5 + 1).cast("int")).alias("region"),
        size.alias("capacity_mwh"), (size / 8).alias("max_charge_mw"), (size / 10).alias("max_discharge_mw"),
        (size * 0.05).alias("min_soc_mwh"), (size * 0.95).alias("max_soc_mwh"), (size * 0.5).alias("initial_soc_mwh"),
        (size * 0.5).alias("terminal_soc_target_mwh"), F.lit(0.9).alias("charge_efficiency"),
        F.lit(0.8).alias("discharge_efficiency"), F.lit(0.01).alias("self_discharge_rate"),
        F.lit(1.5).alias("maximum_daily_cycles"), F.lit(2.0).alias("degradation_cost_per_mwh"),
        (size * 0.1).alias("reserve_soc_mwh"),
    )


def target_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Demand and solar forecasts of every origin; wind at even days only, some hours cut out."""
    base = forecasts(spark, sf_dir).where("model_name = 'seasonal_a'")
    v = F.col("predicted_value")
    parts = F.array(
        F.struct(F.lit("demand_mw").alias("t"), v.alias("v")),
        F.struct(F.lit("solar_generation_mw").alias("t"), (v * 0.25).alias("v")),
        F.struct(F.lit("wind_generation_mw").alias("t"), (v * 0.125).alias("v")),
    )
    rows = base.withColumn("_p", F.explode(parts)).withColumn("target", F.col("_p.t")).withColumn("predicted_value", F.col("_p.v"))
    return rows.where("target <> 'wind_generation_mw' OR day(forecast_origin) % 2 = 0").drop("_p")


_HOURLY = """
hourly AS (SELECT event_type AS region, date_trunc('hour', ts) AS timestamp_utc,
  CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS demand_mw, count(*) AS readings
  FROM events GROUP BY 1, 2)"""

_RAD = "CASE WHEN hour(timestamp_utc) BETWEEN 6 AND 18 THEN 600.0 - 80.0 * abs(hour(timestamp_utc) - 12) ELSE 0.0 END"

SQL = {
    "hourly": _HOURLY,
    "total": """
total AS (SELECT 'ALL' AS region, date_trunc('hour', ts) AS timestamp_utc,
  CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS demand_mw, count(*) AS readings
  FROM events GROUP BY 1, 2)""",
    "segments": """
marked AS (SELECT *, CASE WHEN lag(timestamp_utc) OVER w IS NULL
    OR timestamp_utc - lag(timestamp_utc) OVER w <> INTERVAL 1 HOUR THEN 1 ELSE 0 END AS new,
    lag(timestamp_utc) OVER w AS prev_ts
  FROM hourly WINDOW w AS (PARTITION BY region ORDER BY timestamp_utc)),
segs AS (SELECT *, sum(new) OVER (PARTITION BY region ORDER BY timestamp_utc) AS seg FROM marked)""",
    "measurements": """
measurements AS (SELECT strftime(date_trunc('hour', ts), '%Y-%m-%dT%H') AS period, event_type AS respondent,
  ['d', ' DF', 'zz', 'TI'][user_id % 4 + 1] AS type,
  CASE WHEN user_id % 8 = 2 THEN 'Net generation' WHEN user_id % 8 = 6 THEN 'Coal' END AS type_name,
  CASE WHEN event_id % 97 = 0 THEN NULL ELSE CAST(minute(ts) % 3 + user_id % 4 AS VARCHAR) END AS value,
  event_id AS seq FROM events)""",
    "mapped": """
codes(code, measure) AS (VALUES ('D','demand_mw'),('DEMAND','demand_mw'),('DF','forecast_demand_mw'),
  ('DEMAND FORECAST','forecast_demand_mw'),('NG','net_generation_mw'),('NET GENERATION','net_generation_mw'),
  ('TI','total_interchange_mw'),('TOTAL INTERCHANGE','total_interchange_mw')),
raw AS (SELECT period, respondent,
    CASE WHEN upper(trim(type)) IN (SELECT code FROM codes) THEN upper(trim(type))
      WHEN coalesce(upper(trim(type_name)), '') <> '' THEN upper(trim(type_name)) ELSE type END AS mtype,
    value, max(seq) AS seq, count(*) AS copies FROM measurements GROUP BY ALL),
mapped AS (SELECT respondent AS region, CAST(period || ':00:00' AS TIMESTAMP) AS timestamp_utc, measure,
    CAST(value AS DOUBLE) AS v, seq FROM raw JOIN codes ON upper(mtype) = code)""",
    "renewables": """
renewables AS (SELECT region, timestamp_utc,
    CASE WHEN readings % 5 = 0 THEN NULL ELSE demand_mw * 0.25 END AS solar_generation_mw,
    CASE WHEN readings % 6 = 0 THEN NULL ELSE demand_mw * 0.125 END AS wind_generation_mw,
    CASE WHEN readings % 5 = 0 OR readings % 6 = 0 THEN NULL ELSE demand_mw * 0.25 + demand_mw * 0.125 END
      AS total_renewable_generation_mw
  FROM hourly WHERE readings % 4 <> 1)""",
    "regional_weather": f"""
regional_weather AS (SELECT timestamp_utc, region, 'historical' AS weather_data_type,
    demand_mw % 35 - 5 AS temperature_c, demand_mw % 35 - 6 AS apparent_temperature_c,
    demand_mw * 3 % 110 AS relative_humidity_pct, demand_mw % 4 AS precipitation_mm,
    demand_mw * 3 % 101 AS cloud_cover_pct, demand_mw % 41 AS wind_speed_10m_kph,
    demand_mw * 10 % 360 AS wind_direction_10m_deg,
    CAST({_RAD} AS DOUBLE) AS shortwave_radiation_wm2, CAST({_RAD} AS DOUBLE) * 0.5 AS direct_radiation_wm2,
    CAST({_RAD} AS DOUBLE) * 0.25 AS diffuse_radiation_wm2
  FROM hourly WHERE readings % 7 <> 0)""",
    "location_weather": f"""
loc_base AS (SELECT date_trunc('hour', ts) AS timestamp_utc, user_id % 4 AS loc,
    CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS v FROM events GROUP BY 1, 2),
location_weather AS (SELECT timestamp_utc, 'ALL' AS region, 'loc' || CAST(loc AS VARCHAR) AS location_name,
    CAST(loc + 40 AS DOUBLE) AS latitude, CAST(loc - 80 AS DOUBLE) AS longitude,
    CAST(loc + 1 AS DOUBLE) AS location_weight, v % 35 - 5 AS temperature_c, v % 35 - 6 AS apparent_temperature_c,
    CASE WHEN v > 200 THEN NULL ELSE v % 101 END AS relative_humidity_pct, v % 4 AS precipitation_mm,
    v * 3 % 101 AS cloud_cover_pct, v % 41 AS wind_speed_10m_kph, v * 10 % 360 AS wind_direction_10m_deg,
    CAST({_RAD} AS DOUBLE) AS shortwave_radiation_wm2, CAST({_RAD} AS DOUBLE) * 0.5 AS direct_radiation_wm2,
    CAST({_RAD} AS DOUBLE) * 0.25 AS diffuse_radiation_wm2, 'historical' AS weather_data_type
  FROM loc_base)""",
    "forecasts": """
forecasts AS (SELECT s.region, 'demand_mw' AS target, date_trunc('day', s.timestamp_utc) - o.back AS forecast_origin,
    s.timestamp_utc, p.demand_mw AS predicted_value, o.m AS model_name, '1' AS model_version, 'run' AS run_id,
    'none' AS weather_mode,
    date_diff('hour', date_trunc('day', s.timestamp_utc) - o.back, s.timestamp_utc) AS forecast_step
  FROM hourly s JOIN hourly p ON p.region = s.region AND p.timestamp_utc + INTERVAL 24 HOUR = s.timestamp_utc,
  (VALUES (INTERVAL 1 HOUR, 'seasonal_a'), (INTERVAL 25 HOUR, 'seasonal_b')) AS o(back, m))""",
    "batteries": """
batteries AS (SELECT 'b' || CAST(s_suppkey AS VARCHAR) AS battery_id, ['click','error','purchase','signup','view'][s_suppkey % 5 + 1] AS region,
    40.0::DOUBLE + s_suppkey % 20 AS cap FROM supplier)""",
    "target_forecasts": """
tf AS (SELECT f.region, f.forecast_origin, f.timestamp_utc, p.t AS target, f.predicted_value * p.k AS predicted_value
  FROM forecasts f, (VALUES ('demand_mw', 1.0::DOUBLE), ('solar_generation_mw', 0.25::DOUBLE), ('wind_generation_mw', 0.125::DOUBLE)) p(t, k)
  WHERE f.model_name = 'seasonal_a' AND (p.t <> 'wind_generation_mw' OR day(f.forecast_origin) % 2 = 0)),
heads AS (SELECT region, forecast_origin, bool_or(target = 'wind_generation_mw') AS has_wind FROM tf GROUP BY 1, 2),
inputs AS (SELECT h.region, h.forecast_origin, h.forecast_origin + s * INTERVAL 1 HOUR AS timestamp_utc, s AS forecast_step,
    max(predicted_value) FILTER (target = 'demand_mw') AS demand_forecast_mw,
    max(predicted_value) FILTER (target = 'solar_generation_mw') AS solar_forecast_mw,
    CASE WHEN any_value(has_wind) THEN max(predicted_value) FILTER (target = 'wind_generation_mw') ELSE 0 END AS wind_forecast_mw
  FROM heads h CROSS JOIN range(1, 25) r(s)
  LEFT JOIN tf ON tf.region = h.region AND tf.forecast_origin = h.forecast_origin AND tf.timestamp_utc = h.forecast_origin + s * INTERVAL 1 HOUR
  GROUP BY 1, 2, 3, 4)""",
    "dispatch": """
dispatch AS (SELECT 'run-' || battery_id AS dispatch_run_id, region, battery_id, cap, timestamp_utc, demand_mw AS demand_forecast_mw,
    demand_mw * 0.25 AS renewable_forecast_mw, demand_mw * 0.75 AS net_load_before_battery_mw,
    CASE WHEN readings % 3 = 0 THEN readings * 2.0::DOUBLE ELSE 0.0::DOUBLE END AS charge_mw,
    CASE WHEN readings % 3 = 1 THEN readings * 1.5::DOUBLE ELSE 0.0::DOUBLE END AS discharge_mw,
    50.0::DOUBLE + (readings % 5) * 10.0::DOUBLE AS soc_start_mwh,
    50.0::DOUBLE + ((readings + 1) % 5) * 10.0::DOUBLE AS soc_end_mwh,
    demand_mw * 0.75 + CASE WHEN readings % 3 = 0 THEN readings * 2.0::DOUBLE ELSE 0.0::DOUBLE END
      - CASE WHEN readings % 3 = 1 THEN readings * 1.5::DOUBLE ELSE 0.0::DOUBLE END AS net_load_after_battery_mw,
    20.0::DOUBLE + hour(timestamp_utc) AS energy_price, 2.0::DOUBLE AS marginal_degradation_cost
  FROM hourly JOIN batteries USING (region))""",
}


def with_sql(*names: str) -> str:
    """WITH clause made of the named expressions, in order."""
    return "WITH " + ",".join(SQL[name] for name in names) + "\n"
