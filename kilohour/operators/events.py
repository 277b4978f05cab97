"""Anomaly events in their stored form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilohour.contracts import ANOMALY_COLUMNS
from kilohour.functions.ordered import keep_last
from kilohour.functions.scoring import clamp, finite
from kilohour.functions.text import anomaly_id


def event(
    *,
    kind: Column | str,
    score: Column | float,
    severity: Column | str,
    explanation: Column | str,
    observed: Column | None = None,
    expected: Column | None = None,
    residual: Column | None = None,
    threshold: Column | float | None = None,
    feature_summary: Column | None = None,
    metadata: Column | None = None,
    at: Column | str = "timestamp_utc",
) -> Column:
    """The varying part of an event as a struct; several can be exploded from one row."""

    def text(value):
        return value if isinstance(value, Column) else F.lit(value)

    def number(value):
        if value is None:
            return F.lit(None).cast("double")
        column = value.cast("double") if isinstance(value, Column) else F.lit(float(value))
        return F.when(finite(column), column)

    return F.struct(
        (at if isinstance(at, Column) else F.col(at)).alias("timestamp_utc"),
        text(kind).alias("anomaly_type"),
        clamp(score.cast("double") if isinstance(score, Column) else F.lit(float(score)), 0.0, 100.0).alias("anomaly_score"),
        text(severity).alias("severity"),
        number(observed).alias("observed_value"),
        number(expected).alias("expected_value"),
        number(residual).alias("residual"),
        number(threshold).alias("threshold"),
        (feature_summary if feature_summary is not None else F.lit("{}")).alias("feature_summary"),
        text(explanation).alias("explanation"),
        (metadata if metadata is not None else F.lit("{}")).alias("metadata_json"),
    )


def to_events(
    df: DataFrame,
    events: Column,
    *,
    target: Column | str,
    detector: str,
    detected_at: Column,
    version: str = "1",
    region: str = "region",
    lineage: bool = False,
) -> DataFrame:
    """Explode an array of ``event`` structs into the event contract.

    With ``lineage`` the rows bring forecast_origin, model_name, model_version and run_id.
    """
    passed = ["forecast_origin", "model_name", "model_version", "run_id"]
    kept = [F.col(c) for c in passed] if lineage else []
    goal = target if isinstance(target, Column) else F.lit(target)
    flat = df.select(F.col(region).alias("region"), goal.alias("target"), *kept, F.inline(events))
    if not lineage:
        flat = flat.withColumns(
            {
                "forecast_origin": F.lit(None).cast("timestamp"),
                "model_name": F.lit(""),
                "model_version": F.lit(""),
                "run_id": F.lit(""),
            }
        )
    name = F.lit(detector)
    return flat.withColumns(
        {
            "detector_name": name,
            "detector_version": F.lit(version),
            "detected_at_utc": detected_at,
            "anomaly_id": anomaly_id(
                F.col("region"), F.col("target"), F.col("timestamp_utc"), name, F.col("anomaly_type"), F.lit(version)
            ),
        }
    ).select(*ANOMALY_COLUMNS)


def union_events(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def one_per_id(events: DataFrame) -> DataFrame:
    """One row per event id, the highest score."""
    return keep_last(events, ["anomaly_id"], ["anomaly_score"])
