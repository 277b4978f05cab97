"""Severity, residual scores and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Component weights and bands of the operational severity score.
WEIGHTS = {"magnitude": 45.0, "duration": 15.0, "agreement": 20.0, "importance": 10.0, "recurrence": 5.0, "gap": 5.0}
CRITICAL_FROM = 70.0
WARNING_FROM = 30.0
SEVERITIES = ("info", "warning", "critical")
ROBUST_FACTOR = 0.6745


def clamp(column: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(column, F.lit(low)), F.lit(high))


def _num(value: Column | float) -> Column:
    return value.cast("double") if isinstance(value, Column) else F.lit(float(value))


def severity_score(
    magnitude: Column | float,
    *,
    duration_hours: Column | float = 1,
    detector_count: Column | float = 1,
    target_importance: Column | float = 1.0,
    completeness: Column | float = 1.0,
    recurrence: Column | float = 1,
) -> Column:
    """Weighted 0-100 score."""
    total = (
        clamp(_num(magnitude), 0.0, 1.0) * WEIGHTS["magnitude"]
        + F.least(F.greatest(_num(duration_hours), F.lit(1.0)) / 6.0, F.lit(1.0)) * WEIGHTS["duration"]
        + F.least(F.greatest(_num(detector_count), F.lit(1.0)) / 3.0, F.lit(1.0)) * WEIGHTS["agreement"]
        + clamp(_num(target_importance), 0.0, 1.5) / 1.5 * WEIGHTS["importance"]
        + F.least(F.greatest(_num(recurrence), F.lit(1.0)) / 5.0, F.lit(1.0)) * WEIGHTS["recurrence"]
        - (F.lit(1.0) - clamp(_num(completeness), 0.0, 1.0)) * WEIGHTS["gap"]
    )
    return clamp(total, 0.0, 100.0)


def severity_band(score: Column) -> Column:
    return F.when(score >= CRITICAL_FROM, "critical").when(score >= WARNING_FROM, "warning").otherwise("info")


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "critical", 2).when(severity == "warning", 1).otherwise(0)


def severity_of_rank(rank: Column) -> Column:
    return F.when(rank >= 2, "critical").when(rank == 1, "warning").otherwise("info")


def scaled_deviation(value: Column, center: Column, scale: Column, factor: float = 1.0) -> Column:
    """(value - center) / scale; without a positive scale 0 if equal, else signed infinity."""
    usable = scale.isNotNull() & ~F.isnan(scale) & (scale > 0) & (scale < float("inf"))
    flat = (
        F.when(value == center, F.lit(0.0))
        .when(value > center, F.lit(float("inf")))
        .when(value < center, F.lit(float("-inf")))
    )
    return F.when(usable, F.lit(factor) * F.try_divide(value - center, scale)).otherwise(flat)


def residual_label(target: Column, residual: Column) -> Column:
    return (
        F.when(target == "demand_mw", F.when(residual > 0, "unexpected_demand_spike").otherwise("unexpected_demand_drop"))
        .when(target == "solar_generation_mw", "solar_underproduction")
        .when(target == "wind_generation_mw", "wind_generation_drop")
        .when(target == "net_load_mw", "abnormal_net_load")
        .otherwise("forecast_residual")
    )


def residual_daylight(radiation: Column | None, stamp: Column, start: int = 6, end: int = 18) -> Column:
    by_hour = F.hour(stamp).between(start, end)
    return by_hour if radiation is None else F.coalesce(radiation > 0, by_hour)


def rule_daylight(radiation: Column, flag: Column | None = None, threshold: float = 25.0) -> Column:
    bright = F.coalesce(radiation >= threshold, F.lit(False))
    return bright if flag is None else bright & ~F.coalesce(flag.cast("boolean") == F.lit(False), F.lit(False))


def relative_improvement(model: Column, baseline: Column) -> Column:
    """(baseline - model) / baseline; null when undefined."""
    usable = finite(model) & finite(baseline)
    return F.when(usable, F.try_divide(baseline - model, baseline))


def finite(column: Column) -> Column:
    return column.isNotNull() & ~F.isnan(column) & (F.abs(column) < float("inf"))
