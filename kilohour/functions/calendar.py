"""Calendar, solar, wind and weather derivations as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_HOURS = 24
WEEK_DAYS = 7
COMFORT_BASE_C = 18.0

CALENDAR_FEATURES = (
    "hour", "day_of_week", "day_of_month", "week_of_year", "month", "quarter", "is_weekend",
    "hour_sin", "hour_cos", "day_of_week_sin", "day_of_week_cos",
)


def _cycle(column: Column, period: int) -> Column:
    return F.lit(2.0) * F.pi() * column / F.lit(period)


def calendar_features(time: str = "timestamp_utc") -> dict[str, Column]:
    stamp = F.col(time)
    hour = F.hour(stamp).cast("double")
    weekday = F.weekday(stamp).cast("double")
    return {
        "hour": hour,
        "day_of_week": weekday,
        "day_of_month": F.day(stamp).cast("double"),
        "week_of_year": F.weekofyear(stamp).cast("double"),
        "month": F.month(stamp).cast("double"),
        "quarter": F.quarter(stamp).cast("double"),
        "is_weekend": (F.weekday(stamp) >= 5).cast("double"),
        "hour_sin": F.sin(_cycle(hour, DAY_HOURS)),
        "hour_cos": F.cos(_cycle(hour, DAY_HOURS)),
        "day_of_week_sin": F.sin(_cycle(weekday, WEEK_DAYS)),
        "day_of_week_cos": F.cos(_cycle(weekday, WEEK_DAYS)),
    }


def season(time: str = "timestamp_utc") -> Column:
    return F.floor((F.month(time) - 1) / 3).cast("double")


def solar_features(time: str = "timestamp_utc") -> dict[str, Column]:
    hour, month = F.hour(time), F.month(time)
    return {
        "daylight_indicator": (F.col("shortwave_radiation_wm2") > 0).cast("double"),
        "hour_sin_solar": F.sin(_cycle(hour, 24)),
        "hour_cos_solar": F.cos(_cycle(hour, 24)),
        "month_sin_solar": F.sin(_cycle(month, 12)),
        "month_cos_solar": F.cos(_cycle(month, 12)),
    }


def wind_features(time: str = "timestamp_utc") -> dict[str, Column]:
    return {"wind_speed_squared": F.pow("wind_speed_10m_kph", F.lit(2.0)), "season": season(time)}


def weather_derivations(time: str = "timestamp_utc") -> dict[str, Column]:
    temperature = F.col("temperature_c")
    month = F.month(time)
    return {
        "temperature_squared": temperature * temperature,
        "cooling_degree": F.greatest(temperature - COMFORT_BASE_C, F.lit(0.0) * temperature),
        "heating_degree": F.greatest(F.lit(COMFORT_BASE_C) - temperature, F.lit(0.0) * temperature),
        "temperature_hour_interaction": temperature * F.hour(time),
        "temperature_weekend_interaction": temperature * (F.weekday(time) >= 5).cast("double"),
        "apparent_temperature_difference": F.col("apparent_temperature_c") - temperature,
        "humidity_temperature_interaction": F.col("relative_humidity_pct") * temperature,
        "wind_speed_squared": F.pow("wind_speed_10m_kph", F.lit(2.0)),
        "month_sin": F.sin(_cycle(month, 12)),
        "month_cos": F.cos(_cycle(month, 12)),
        "season": season(time),
        "solar_radiation_daylight": (F.coalesce(F.col("shortwave_radiation_wm2"), F.lit(0.0)) > 0).cast("double"),
    }


def wind_direction_parts() -> dict[str, Column]:
    angle = F.radians("wind_direction_10m_deg")
    return {"wind_direction_sin": F.sin(angle), "wind_direction_cos": F.cos(angle)}
