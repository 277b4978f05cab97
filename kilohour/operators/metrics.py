"""Forecast accuracy, leaderboards and the promotion gate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kilohour.functions.ordered import walk
from kilohour.functions.scoring import finite, relative_improvement
from kilohour.session import cut_lineage

NAMES = ("mae", "rmse", "wape", "mase", "bias")
ORDER = ("validation_window", "region", "timestamp_utc")


def forecast_metrics(
    predictions: DataFrame,
    by: Sequence[str] = (),
    *,
    order: Sequence[str] = ORDER,
    actual: str = "actual_value",
    predicted: str = "predicted_value",
    mase_scale: Column | float | None = None,
) -> DataFrame:
    """MAE, RMSE, WAPE, MASE and bias per slice over rows that have both values.

    Without a given scale, MASE is scaled by the mean absolute step of the actuals in ``order``,
    across borders of windows and regions as well. Each (slice, window, region) is one chunk of the
    ordered walk, so even the overall slice spreads over tasks.
    """
    by = list(by)
    rows = predictions.where(
        F.col(actual).isNotNull() & F.col(predicted).isNotNull() & ~F.isnan(actual) & ~F.isnan(predicted)
    )
    error = F.col(predicted) - F.col(actual)
    measures = [
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.try_divide(F.sum(F.abs(error)), F.sum(F.abs(F.col(actual)))).alias("wape"),
        F.avg(error).alias("bias"),
    ]
    if mase_scale is None:
        inner = [c for c in order if c not in by]
        linked = walk(rows, keys=by, order=inner, chunk=inner[:-1] or [*by], carry=[actual])
        grouped = linked.groupBy(*by).agg(*measures, F.avg(F.abs(F.col(actual) - F.col("_prev")[actual])).alias("_scale"))
    else:
        scale = mase_scale if isinstance(mase_scale, Column) else F.lit(float(mase_scale))
        grouped = rows.groupBy(*by).agg(*measures, F.max(scale).alias("_scale"))
    mase = F.when(F.col("_scale") > 0, F.col("mae") / F.col("_scale"))
    return grouped.withColumn("mase", mase).select(*by, "n", *NAMES)


def metric_slices(predictions: DataFrame, series: Sequence[str] = ("model_name",), **options) -> DataFrame:
    """Overall, per-window, per-step and per-region metrics in one long table; the predictions are made once."""
    predictions = cut_lineage(predictions)
    parts = []
    for name in (None, "validation_window", "forecast_step", "region"):
        out = forecast_metrics(predictions, [*series, *([name] if name else [])], **options)
        label = F.lit(name or "overall").alias("slice")
        value = (F.col(name).cast("string") if name else F.lit("all")).alias("slice_value")
        parts.append(out.select(*series, label, value, "n", *NAMES))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def target_metrics(predictions: DataFrame, by: Sequence[str] = ("target",), daylight: str | None = None) -> DataFrame:
    """Range-normalised errors, zero-generation MAE, clip count and daytime MAE."""
    actual, predicted = F.col("actual_value"), F.col("predicted_value")
    error = F.abs(actual - predicted)
    spread = F.max(actual) - F.min(actual)
    columns = [
        F.try_divide(F.avg(error), spread).alias("normalized_mae"),
        F.try_divide(F.sqrt(F.avg(error * error)), spread).alias("normalized_rmse"),
        F.avg(F.when(actual == 0, F.abs(predicted))).alias("zero_generation_mae"),
    ]
    if "clipped" in predictions.columns:
        columns.append(F.count_if("clipped").alias("forecast_clipping_count"))
    if daylight is not None:
        columns.append(F.avg(F.when(F.col(daylight) > 0, error)).alias("daytime_mae"))
    return predictions.groupBy(*by).agg(*columns)


def leaderboard(overall: DataFrame, primary: str = "wape") -> DataFrame:
    """Models ranked by the primary metric, with improvement over both seasonal baselines.

    One row per model, so the ranking is tiny.
    """
    references = overall.agg(
        *[
            F.max(F.when(F.col("model_name") == f"seasonal_naive_{lag}h", F.col(primary))).alias(f"_ref_{lag}")
            for lag in (24, 168)
        ]
    )
    ranked = overall.join(F.broadcast(references), F.col("model_name").isNotNull())  # one reference row
    order = Window.orderBy(F.col(primary).asc_nulls_last(), "mae", "model_name")
    return ranked.select(
        F.row_number().over(order).alias("rank"),
        "model_name",
        "mae",
        "rmse",
        "wape",
        "mase",
        F.col("bias").alias("forecast_bias"),
        *[
            relative_improvement(F.col(primary), F.col(f"_ref_{lag}")).alias(f"improvement_vs_seasonal_{lag}")
            for lag in (24, 168)
        ],
    )


def promotion_decisions(candidates: DataFrame, *, primary: str = "wape", reference: str, threshold: float) -> DataFrame:
    """Every candidate gets the candidate alias; champion only if all gates pass."""
    gain = relative_improvement(F.col(primary), F.col(reference))
    usable = finite(F.col(primary)) & finite(F.col("forecast_bias"))
    passed = usable & F.coalesce(gain >= threshold, F.lit(False))
    reason = (
        F.when(~usable, "a metric of the candidate is missing or infinite")
        .when(gain.isNull(), "the baseline offers nothing to compare with")
        .when(~passed, F.format_string(f"gain %.6f falls short of {threshold:.6f}", gain))
        .otherwise(F.format_string("all gates passed, gain %.6f", gain))
    )
    return candidates.select(
        "model_name",
        F.lit(True).alias("candidate_assigned"),
        passed.alias("champion_promoted"),
        gain.alias("improvement"),
        reason.alias("reason"),
    )
