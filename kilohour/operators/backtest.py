"""Planted anomalies and the scoring of detections against their labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kilohour.errors import InsufficientHistory
from kilohour.functions.ordered import side_by_side, walk
from kilohour.series import SeriesSpec

# Kinds of planted anomalies, the rows each touches and its magnitude.
INJECTIONS = {
    "single_hour_demand_spike": (1, 0.75),
    "multi_hour_demand_drop": (3, 0.60),
    "solar_generation_collapse": (3, 1.0),
    "wind_generation_spike": (1, 1.0),
    "flatline_sensor": (4, 1.0),
    "missing_hour_sequence": (2, 1.0),
    "weather_value_corruption": (1, 1.0),
    "gradual_drift": (5, 0.60),
    "contextual_unusual_hour": (1, 0.90),
}
MARGIN = 6


# Kinds planted for each target.
DEFAULT_KINDS = (
    "single_hour_demand_spike", "multi_hour_demand_drop", "flatline_sensor", "missing_hour_sequence", "gradual_drift",
    "contextual_unusual_hour",
)
KINDS_BY_TARGET = {
    "solar_generation_mw": (
        "solar_generation_collapse", "flatline_sensor", "missing_hour_sequence", "gradual_drift",
    ),
    "wind_generation_mw": ("wind_generation_spike", "flatline_sensor", "missing_hour_sequence", "gradual_drift"),
}


def inject(
    rows: DataFrame, target: str, *, seed: int = 42, kinds: Sequence[str] = tuple(INJECTIONS), chunk_rows: int = 4096
) -> tuple[DataFrame, DataFrame]:
    """Changed rows and labels. Positions are the rows with the smallest SHA-256 of region, time and seed.

    At most one anomaly per kind is planted, so positions and effects are a handful of rows and the
    change is a join on row numbers.
    """
    unknown = set(kinds) - set(INJECTIONS)
    if unknown:
        raise ValueError(f"unknown injection kinds {sorted(unknown)}")
    spec = SeriesSpec(value=target, chunk_rows=chunk_rows)
    chunked = rows.withColumn("_chunk", spec.chunk())
    numbered = walk(
        chunked, keys=[], order=["region", "timestamp_utc"], chunk=["region", "_chunk"], carry=[target], row="_n"
    ).drop("_chunk")
    total = numbered.count()
    if total < max(24, len(kinds) * MARGIN):
        raise InsufficientHistory("too few rows to keep planted anomalies apart")
    inside = numbered.where(F.col("_n").between(MARGIN + 1, total - MARGIN))
    chance = F.sha2(F.concat_ws("|", "region", F.unix_seconds("timestamp_utc").cast("string"), F.lit(str(seed))), 256)
    picked = inside.orderBy(chance, "_n").limit(len(kinds))
    ranked = picked.withColumn("_k", F.row_number().over(Window.orderBy("_n")))
    kind = F.element_at(F.array(*[F.lit(k) for k in kinds]), F.col("_k"))
    plan = F.create_map(*[x for k, (n, _) in INJECTIONS.items() for x in (F.lit(k), F.lit(n))])
    chosen = ranked.select(
        "_n", "_k", kind.alias("kind"), F.col(f"_prev.{target}").alias("_held"), "region", "timestamp_utc"
    ).withColumn("_rows", plan[F.col("kind")])
    effects = chosen.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_rows") - 1))).select(
        (F.col("_n") + F.col("_o")).alias("_n"), F.struct("kind", "_o", "_held").alias("_e")
    )
    effects = effects.groupBy("_n").agg(F.collect_list("_e").alias("_effects"))
    # At most one position per kind and five rows per position: proven small.
    touched = numbered.join(F.broadcast(effects), "_n", "left")
    changed = _apply(touched, target)
    labels = _labels(chosen, numbered, target, rows.columns, seed)
    return changed.select(*rows.columns), labels


def _apply(touched: DataFrame, target: str) -> DataFrame:
    def effect(kind: str) -> Column:
        return F.try_element_at(F.filter("_effects", lambda e: e["kind"] == kind), F.lit(1))

    solar = "solar_generation_mw" if "solar_generation_mw" in touched.columns else target
    wind = "wind_generation_mw" if "wind_generation_mw" in touched.columns else target
    humid = "relative_humidity_pct" if "relative_humidity_pct" in touched.columns else target
    changes = [
        ("single_hour_demand_spike", target, lambda v, e: v * 1.75),
        ("multi_hour_demand_drop", target, lambda v, e: v * 0.40),
        ("solar_generation_collapse", solar, lambda v, e: F.lit(0.0)),
        ("wind_generation_spike", wind, lambda v, e: v * 2.0),
        ("flatline_sensor", target, lambda v, e: e["_held"]),
        ("weather_value_corruption", humid, lambda v, e: F.lit(250.0)),
        ("gradual_drift", target, lambda v, e: v * (F.lit(1.1) + e["_o"] * 0.125)),
        ("contextual_unusual_hour", target, lambda v, e: v * 1.9),
    ]
    out = touched
    for kind, column, change in changes:
        hit = effect(kind)
        out = out.withColumn(column, F.when(hit.isNotNull(), change(F.col(column), hit)).otherwise(F.col(column)))
    return out.where(effect("missing_hour_sequence").isNull())


def _labels(chosen: DataFrame, numbered: DataFrame, target: str, columns: Sequence[str], seed: int) -> DataFrame:
    ends = chosen.withColumn("_last", F.col("_n") + F.col("_rows") - 1)
    times = numbered.select(F.col("_n").alias("_last"), F.col("timestamp_utc").alias("end_utc"))
    magnitude = F.create_map(*[x for k, (_, m) in INJECTIONS.items() for x in (F.lit(k), F.lit(m))])[F.col("kind")]
    weather = "relative_humidity_pct" if "relative_humidity_pct" in columns else target
    goal = (
        F.when(F.col("kind") == "solar_generation_collapse", "solar_generation_mw")
        .when(F.col("kind") == "wind_generation_spike", "wind_generation_mw")
        .when(F.col("kind") == "weather_value_corruption", weather)
        .otherwise(target)
    )
    return times.join(F.broadcast(ends), "_last").select(
        F.format_string(f"injected-{seed}-%03d", F.col("_k") - 1).alias("injection_id"),
        "region",
        goal.alias("target"),
        F.col("kind").alias("anomaly_type"),
        F.col("timestamp_utc").alias("start_utc"),
        "end_utc",
        magnitude.alias("magnitude"),
        F.when(magnitude >= 0.7, "critical").otherwise("warning").alias("expected_severity"),
        F.lit(True).alias("synthetic"),
    )


def match_labels(detections: DataFrame, labels: DataFrame, bucket_hours: int = 24) -> DataFrame:
    """Every label with its first detection inside [start, end] of the same region, if any.

    Both sides meet on (region, time bucket), so neither a long label nor a busy region is compared
    with everything. Target and type do not matter.
    """
    width = bucket_hours * 3_600_000_000
    bucket = lambda c: F.floor(F.unix_micros(c) / F.lit(width))
    spans = labels.withColumn("_b", F.explode(F.sequence(bucket("start_utc"), bucket("end_utc"))))
    found = detections.select(
        "region", "timestamp_utc", "anomaly_id", F.col("severity").alias("found_severity"),
        F.coalesce("target", F.lit("")).alias("_t"), F.coalesce("detector_name", F.lit("")).alias("_d"),
        bucket("timestamp_utc").alias("_b"),
    )
    hits = spans.join(found, ["region", "_b"]).where("timestamp_utc BETWEEN start_utc AND end_utc")
    order = F.struct("timestamp_utc", "_t", "_d", "anomaly_id")
    first = hits.groupBy("injection_id").agg(
        F.min_by(F.struct("anomaly_id", "timestamp_utc", "found_severity"), order).alias("_f")
    )
    delay = (F.unix_micros("_f.timestamp_utc") - F.unix_micros("start_utc")) / F.lit(3_600_000_000.0)
    return labels.join(first, "injection_id", "left").select(
        "injection_id",
        "anomaly_type",
        F.col("_f").isNotNull().alias("detected"),
        F.coalesce("_f.anomaly_id", F.lit("")).alias("matched_anomaly_id"),
        delay.alias("detection_delay_hours"),
        (F.col("_f.found_severity") == F.col("expected_severity")).alias("severity_matches"),
    )


def detection_metrics(detections: DataFrame, matches: DataFrame, start: Column, end: Column) -> DataFrame:
    """Precision, recall, F1, false positives per day, mean delay and severity accuracy."""
    hit = F.col("detected")
    days = F.greatest((F.unix_micros(end) - F.unix_micros(start)) / F.lit(86_400_000_000.0), F.lit(1 / 24))
    left = matches.agg(
        F.count(F.lit(1)).alias("labels"),
        F.count_if(hit).alias("true_positive"),
        F.count_distinct(F.when(hit, F.col("matched_anomaly_id"))).alias("_matched"),
        F.coalesce(F.avg("detection_delay_hours"), F.lit(0.0)).alias("mean_detection_delay_hours"),
        F.coalesce(F.avg(F.col("severity_matches").cast("double")), F.lit(0.0)).alias("severity_accuracy"),
    )
    right = detections.agg(F.count(F.lit(1)).alias("_detections"))
    row = side_by_side(left, right).withColumn(
        "false_positive", F.greatest(F.col("_detections") - F.col("_matched"), F.lit(0))
    )
    tp, fp = F.col("true_positive"), F.col("false_positive")
    row = row.withColumns(
        {
            "precision": F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0)),
            "recall": F.coalesce(F.try_divide(tp, F.col("labels")), F.lit(0.0)),
            "false_positives_per_day": fp / days,
        }
    )
    f1 = F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return row.withColumn("f1", F.coalesce(f1, F.lit(0.0))).select(
        "precision", "recall", "f1", "false_positives_per_day", "mean_detection_delay_hours", "severity_accuracy"
    )


def per_type_metrics(matches: DataFrame) -> DataFrame:
    grouped = matches.groupBy("anomaly_type").agg(
        F.count(F.lit(1)).alias("injected"), F.count_if("detected").alias("detected")
    )
    p = (F.col("detected") > 0).cast("double")
    r = F.col("detected") / F.col("injected")
    return grouped.select(
        "anomaly_type", "injected", "detected",
        F.col("detected").alias("true_positive"),
        (F.col("injected") - F.col("detected")).alias("false_negative"),
        p.alias("precision"), r.alias("recall"),
        F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"),
    )
