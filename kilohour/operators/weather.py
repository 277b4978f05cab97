"""Location weather to regional weather."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilohour.contracts import REGION_WEATHER_COLUMNS
from kilohour.errors import ContractViolation
from kilohour.functions.ordered import side_by_side
from kilohour.operators.continuity import gap_steps, previous_times
from kilohour.operators.features import WEATHER_COLUMNS
from kilohour.series import HOURLY, SeriesSpec

WEATHER_KEY = ("region", "timestamp_utc", "weather_data_type")


def regional_weather(
    rows: DataFrame, locations: DataFrame, *, require_all_locations: bool = True
) -> DataFrame:
    """Weighted means, circular wind direction and spreads per region and hour.

    Weights are renormalised per hour. A missing value at one location leaves the regional mean
    unknown, while minimum and maximum skip it. Hours without the region's whole location set are
    an error, or skipped.
    """
    weight = F.col("location_weight")
    angle = F.radians("wind_direction_10m_deg")

    def weighted(value):
        known = F.count(value) == F.count(F.lit(1))
        return F.when(known, F.sum(value * weight) / F.sum(weight))

    expected = locations.groupBy("region").agg(F.array_sort(F.collect_set("location_name")).alias("_expected"))
    grouped = rows.groupBy(*WEATHER_KEY).agg(
        F.array_sort(F.collect_set("location_name")).alias("_present"),
        *[weighted(F.col(c)).alias(c) for c in WEATHER_COLUMNS],
        weighted(F.sin(angle)).alias("wind_direction_sin"),
        weighted(F.cos(angle)).alias("wind_direction_cos"),
        F.min("temperature_c").alias("temperature_min_c"),
        F.max("temperature_c").alias("temperature_max_c"),
        (F.max("temperature_c") - F.min("temperature_c")).alias("temperature_spread_c"),
        (F.max("wind_speed_10m_kph") - F.min("wind_speed_10m_kph")).alias("wind_speed_spread_kph"),
        F.max("ingestion_timestamp_utc").alias("ingestion_timestamp_utc"),
        F.max("data_source").alias("data_source"),
    )
    checked = grouped.join(expected, "region", "left")
    whole = F.coalesce(F.col("_present") == F.col("_expected"), F.lit(False))
    if require_all_locations:
        bad = checked.where(~whole).select("region", "timestamp_utc", "_present").limit(3).collect()
        if bad:
            raise ContractViolation(f"incomplete location sets such as {[tuple(r) for r in bad]}")
    direction = F.pmod(
        F.degrees(F.atan2("wind_direction_sin", "wind_direction_cos")), F.lit(360.0)
    )
    kept = checked.where(whole).withColumn("wind_direction_10m_deg", direction)
    return kept.select(*REGION_WEATHER_COLUMNS)


def weather_report(location_rows: DataFrame, regional: DataFrame, spec: SeriesSpec = HOURLY) -> DataFrame:
    """Row counts, duplicates, gap hours, missing values and the data types present."""
    key = ["region", "location_name", "timestamp_utc", "weather_data_type"]
    columns = [c for c in location_rows.columns if c not in key]
    per_key = location_rows.groupBy(*key).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count_if(F.col(c).isNull()).alias(f"_m_{c}") for c in columns],
    )
    left = per_key.agg(
        F.sum("_n").alias("location_rows"),
        F.sum(F.col("_n") - 1).alias("duplicate_rows"),
        F.sort_array(F.collect_set("weather_data_type")).alias("weather_data_types"),
        *[F.sum(f"_m_{c}").alias(f"missing_{c}") for c in columns],
    )
    # rows with a null key count, though they belong to no series
    right = regional.agg(F.count(F.lit(1)).alias("regional_rows"))
    linked = previous_times(regional.select(*spec.key, "weather_data_type"), spec, ("weather_data_type",))
    return side_by_side(left, right, linked.agg(F.coalesce(F.sum(gap_steps(spec)), F.lit(0)).alias("timestamp_gap_count")))
