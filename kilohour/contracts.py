"""Table contracts: columns, row checks and a unique key, all failures counted together."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilohour.errors import ContractViolation
from kilohour.functions.scoring import SEVERITIES, finite
from kilohour.functions.text import valid_json


@dataclass(frozen=True)
class Contract:
    """``checks`` maps a name to a predicate that must hold; null counts as failing."""

    name: str
    columns: tuple[str, ...]
    checks: Mapping[str, Column] = field(default_factory=dict)
    key: tuple[str, ...] = ()

    def violations(self, df: DataFrame) -> DataFrame:
        """Rows (check, failures). Row checks share one aggregate; keys take one more."""
        names = list(self.checks)
        sums = [F.count_if(~F.coalesce(self.checks[n], F.lit(False))).alias(n) for n in names]
        parts = []
        if names:
            parts.append(df.agg(*sums).unpivot([], names, "check", "failures"))
        if self.key:
            repeated = df.groupBy(*self.key).agg((F.count(F.lit(1)) - 1).alias("n"))
            parts.append(
                repeated.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("failures")).select(
                    F.lit("unique_key").alias("check"), "failures"
                )
            )
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def enforce(self, df: DataFrame) -> DataFrame:
        """The contract's columns, or an error that lists every failing check."""
        missing = [c for c in self.columns if c not in df.columns]
        unknown = [c for c in df.columns if c not in self.columns]
        if missing or unknown:
            raise ContractViolation(f"{self.name}: missing columns {missing}, unknown columns {unknown}")
        failed = [(r["check"], r["failures"]) for r in self.violations(df).where("failures > 0").collect()]
        if failed:
            raise ContractViolation(f"{self.name}: " + ", ".join(f"{c}={n}" for c, n in sorted(failed)))
        return df.select(*self.columns)


def _known(*names: str) -> dict[str, Column]:
    return {f"{n}_present": F.col(n).isNotNull() for n in names}


def _within(low: float, high: float, *names: str, nullable: bool = True) -> dict[str, Column]:
    out = {}
    for n in names:
        inside = F.col(n).between(low, high)
        out[f"{n}_range"] = inside | F.col(n).isNull() if nullable else inside
    return out


def _not_negative(*names: str) -> dict[str, Column]:
    return {f"{n}_not_negative": F.col(n).isNull() | (F.col(n) >= 0) for n in names}


# Column lists and enumerations of the stored tables.
CANONICAL_COLUMNS = (
    "timestamp_utc", "region", "demand_mw", "forecast_demand_mw", "net_generation_mw", "total_interchange_mw",
    "ingestion_timestamp_utc",
)
MEASURES = ("demand_mw", "forecast_demand_mw", "net_generation_mw", "total_interchange_mw")
TARGETS = (
    "demand_mw", "solar_generation_mw", "wind_generation_mw", "total_renewable_generation_mw", "net_load_mw",
)
WEATHER_VALUES = (
    "temperature_c", "apparent_temperature_c", "relative_humidity_pct", "precipitation_mm", "cloud_cover_pct",
    "wind_speed_10m_kph", "wind_direction_10m_deg", "shortwave_radiation_wm2", "direct_radiation_wm2",
    "diffuse_radiation_wm2",
)
LOCATION_WEATHER_COLUMNS = (
    "timestamp_utc", "region", "location_name", "latitude", "longitude", "location_weight", *WEATHER_VALUES,
    "ingestion_timestamp_utc", "data_source", "weather_data_type",
)
REGION_WEATHER_COLUMNS = (
    "timestamp_utc", "region", "weather_data_type", "temperature_c", "apparent_temperature_c", "relative_humidity_pct",
    "precipitation_mm", "cloud_cover_pct", "wind_speed_10m_kph", "wind_direction_10m_deg", "wind_direction_sin",
    "wind_direction_cos", "shortwave_radiation_wm2", "direct_radiation_wm2", "diffuse_radiation_wm2", "temperature_min_c",
    "temperature_max_c", "temperature_spread_c", "wind_speed_spread_kph", "ingestion_timestamp_utc", "data_source",
)
RENEWABLE_COLUMNS = (
    "timestamp_utc", "region", "solar_generation_mw", "wind_generation_mw", "total_renewable_generation_mw",
    "ingestion_timestamp_utc",
)
FORECAST_COLUMNS = (
    "region", "target", "forecast_origin", "timestamp_utc", "forecast_step", "predicted_value", "model_name",
    "model_version", "run_id", "weather_mode", "created_at_utc",
)
FORECAST_KEY = (
    "region", "target", "forecast_origin", "timestamp_utc", "model_name", "model_version", "weather_mode",
)
PREDICTION_COLUMNS = (
    "region", "timestamp_utc", "forecast_origin", "predicted_demand_mw", "model_name", "model_version", "run_id",
    "created_at_utc",
)
ANOMALY_TYPES = (
    "missing_timestamp", "duplicate_timestamp", "non_monotonic_timestamp", "unexpected_frequency", "invalid_value",
    "demand_spike", "demand_drop", "renewable_drop", "flatline", "forecast_residual", "unexpected_demand_spike",
    "unexpected_demand_drop", "solar_underproduction", "wind_generation_drop", "abnormal_net_load",
    "multivariate_outlier", "weather_grid_mismatch", "coverage_mismatch", "stale_observation",
)
ANOMALY_COLUMNS = (
    "anomaly_id", "region", "target", "timestamp_utc", "detector_name", "detector_version", "anomaly_type",
    "anomaly_score", "severity", "observed_value", "expected_value", "residual", "threshold", "feature_summary",
    "explanation", "forecast_origin", "model_name", "model_version", "run_id", "detected_at_utc", "metadata_json",
)
ALERT_STATUSES = ("open", "acknowledged", "resolved", "suppressed")
ALERT_COLUMNS = (
    "alert_id", "region", "target", "anomaly_type", "severity", "status", "first_seen_utc", "last_seen_utc",
    "occurrence_count", "latest_anomaly_id", "title", "summary", "acknowledged_at_utc", "resolved_at_utc",
    "created_at_utc", "updated_at_utc", "metadata_json",
)
HISTORY_COLUMNS = (
    "history_id", "alert_id", "status", "severity", "changed_at_utc", "change_reason", "anomaly_id", "metadata_json",
)
DISPATCH_INPUT_COLUMNS = (
    "region", "forecast_origin", "timestamp_utc", "forecast_step", "demand_forecast_mw", "solar_forecast_mw",
    "wind_forecast_mw", "renewable_forecast_mw", "net_load_before_battery_mw", "energy_price", "metadata_json",
)
DISPATCH_POINT_COLUMNS = (
    "dispatch_run_id", "region", "battery_id", "forecast_origin", "timestamp_utc", "forecast_step",
    "demand_forecast_mw", "solar_forecast_mw", "wind_forecast_mw", "renewable_forecast_mw",
    "net_load_before_battery_mw", "charge_mw", "discharge_mw", "net_battery_power_mw", "soc_start_mwh", "soc_end_mwh",
    "net_load_after_battery_mw", "energy_price", "marginal_degradation_cost", "operating_mode", "solver_status",
    "created_at_utc", "metadata_json",
)

GRID_KEY = ("region", "timestamp_utc")


def raw_measurements() -> Contract:
    columns = ("timestamp", "region", "measurement_type", "value")
    return Contract("raw measurements", columns, _known("timestamp", "region", "measurement_type"))


def canonical_grid() -> Contract:
    checks = {**_known("timestamp_utc", "region", "demand_mw", "ingestion_timestamp_utc"), **_not_negative("demand_mw")}
    return Contract("hourly grid data", CANONICAL_COLUMNS, checks, GRID_KEY)


def location_weather() -> Contract:
    checks = {
        **_known("timestamp_utc", "region", "location_name", "ingestion_timestamp_utc", "data_source"),
        **_within(-90, 90, "latitude", nullable=False),
        **_within(-180, 180, "longitude", nullable=False),
        "location_weight_positive": F.col("location_weight") > 0,
        **_within(0, 100, "relative_humidity_pct", "cloud_cover_pct"),
        **_within(0, 360, "wind_direction_10m_deg"),
        **_not_negative(
            "precipitation_mm", "wind_speed_10m_kph", "shortwave_radiation_wm2", "direct_radiation_wm2",
            "diffuse_radiation_wm2",
        ),
        "weather_data_type_known": F.col("weather_data_type").isin("historical", "forecast"),
    }
    key = ("region", "location_name", "timestamp_utc", "weather_data_type")
    return Contract("location weather", LOCATION_WEATHER_COLUMNS, checks, key)


def renewable_generation() -> Contract:
    values = ("solar_generation_mw", "wind_generation_mw", "total_renewable_generation_mw")
    checks = {**_known("timestamp_utc", "region", "ingestion_timestamp_utc"), **_not_negative(*values)}
    return Contract("renewable generation", RENEWABLE_COLUMNS, checks, GRID_KEY)


def target_forecasts() -> Contract:
    checks = {
        **_known("forecast_origin", "timestamp_utc", "created_at_utc"),
        "target_supported": F.col("target").isin(*TARGETS),
        "predicted_value_finite": finite(F.col("predicted_value")),
    }
    return Contract("target forecasts", FORECAST_COLUMNS, checks, FORECAST_KEY)


def batch_predictions() -> Contract:
    value = F.col("predicted_demand_mw")
    checks = {
        **_known("region", "timestamp_utc", "forecast_origin"),
        "prediction_finite": finite(value),
        "prediction_not_negative": value >= 0,
    }
    return Contract("batch predictions", PREDICTION_COLUMNS, checks, GRID_KEY)


def anomaly_events() -> Contract:
    checks = {
        **_known("timestamp_utc", "detected_at_utc"),
        "severity_known": F.col("severity").isin(*SEVERITIES),
        "anomaly_type_known": F.col("anomaly_type").isin(*ANOMALY_TYPES),
        "score_range": finite(F.col("anomaly_score")) & F.col("anomaly_score").between(0, 100),
        "feature_summary_json": valid_json(F.col("feature_summary")),
        "metadata_json_json": valid_json(F.col("metadata_json")),
    }
    return Contract("anomaly events", ANOMALY_COLUMNS, checks, ("anomaly_id",))


def alerts() -> Contract:
    checks = {
        **_known("first_seen_utc", "last_seen_utc", "created_at_utc", "updated_at_utc"),
        "status_known": F.col("status").isin(*ALERT_STATUSES),
        "severity_known": F.col("severity").isin(*SEVERITIES),
        "occurrence_positive": F.col("occurrence_count") >= 1,
        "metadata_json_json": valid_json(F.col("metadata_json")),
    }
    return Contract("alerts", ALERT_COLUMNS, checks, ("alert_id",))


def dispatch_input_report(df: DataFrame, horizon: int, step_hours: float = 1.0) -> DataFrame:
    """Horizon checks of every (region, origin) at once; ``complete`` tells whether all hold."""
    numbers = ("demand_forecast_mw", "solar_forecast_mw", "wind_forecast_mw", "renewable_forecast_mw",
               "net_load_before_battery_mw", "energy_price")
    usable = F.lit(True)
    for name in numbers:
        usable = usable & finite(F.col(name))
    step_us = int(step_hours * 3_600_000_000)
    expected = F.timestamp_micros(F.unix_micros("forecast_origin") + F.col("forecast_step") * F.lit(step_us))
    report = df.groupBy("region", "forecast_origin").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("forecast_step").alias("distinct_steps"),
        F.min("forecast_step").alias("first_step"),
        F.max("forecast_step").alias("last_step"),
        F.count_if(~F.coalesce(F.col("timestamp_utc") == expected, F.lit(False))).alias("misplaced_rows"),
        F.count_if(~usable).alias("non_finite_rows"),
        F.count_if(~valid_json(F.col("metadata_json"))).alias("invalid_json_rows"),
    )
    complete = (
        (F.col("rows") == horizon) & (F.col("distinct_steps") == horizon) & (F.col("first_step") == 1)
        & (F.col("last_step") == horizon) & (F.col("misplaced_rows") == 0) & (F.col("non_finite_rows") == 0)
        & (F.col("invalid_json_rows") == 0)
    )
    return report.withColumn("complete", complete)


def enforce_dispatch_input(df: DataFrame, horizon: int, step_hours: float = 1.0) -> DataFrame:
    missing = [c for c in DISPATCH_INPUT_COLUMNS if c not in df.columns]
    if missing:
        raise ContractViolation(f"dispatch input: missing columns {missing}")
    bad = dispatch_input_report(df, horizon, step_hours).where(~F.col("complete")).limit(5).collect()
    if bad:
        raise ContractViolation(f"dispatch input: incomplete horizons such as {[r.asDict() for r in bad]}")
    return df.select(*DISPATCH_INPUT_COLUMNS)
