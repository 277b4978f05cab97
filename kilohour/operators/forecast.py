"""Baseline forecasts at rolling origins, for all entities and origins in one plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kilohour.errors import InsufficientHistory
from kilohour.functions.ordered import walk
from kilohour.series import HOURLY, SeriesSpec

LAST_VALUE = "last_value"
SEASONAL_AVERAGE = "seasonal_naive_average_24h_168h"


def seasonal_name(lag: int) -> str:
    return f"seasonal_naive_{lag}h"


ALL_BASELINES = (LAST_VALUE, seasonal_name(24), seasonal_name(168), SEASONAL_AVERAGE)


def end_origins(history: DataFrame, spec: SeriesSpec = HOURLY) -> DataFrame:
    """The last row of every entity as its forecast origin."""
    last = history.groupBy(*spec.entity).agg(F.max_by(F.struct(spec.time, spec.value), F.col(spec.time)).alias("_l"))
    return last.select(
        *spec.entity, F.col(f"_l.{spec.time}").alias("origin"), F.col(f"_l.{spec.value}").alias("origin_value")
    )


def origins_at(history: DataFrame, windows: DataFrame, spec: SeriesSpec = HOURLY) -> DataFrame:
    """Entity origins at chosen windows: the rows of the history at those times.

    ``windows`` has one row per requested window, so broadcasting it is bounded by that parameter.
    """
    chosen = windows.select("validation_window", "origin")
    rows = history.select(*spec.entity, F.col(spec.time).alias("origin"), F.col(spec.value).alias("origin_value"))
    return rows.join(F.broadcast(chosen), "origin")


def positional_origins(
    history: DataFrame, *, horizon: int, windows: int, step_size: int, spec: SeriesSpec = HOURLY
) -> DataFrame:
    """Expanding-window origins by row position, counted back from each entity's last row."""
    if min(horizon, windows, step_size) <= 0:
        raise ValueError("horizon, windows and step_size must be positive")
    rows = history.select(*spec.key, spec.value)
    numbered = walk(rows, keys=spec.entity, order=[spec.time], chunk=spec.chunk(), row="_n").drop("_prev")
    totals = rows.groupBy(*spec.entity).agg(F.count(F.lit(1)).alias("_total"))
    # The first validation row follows position total - horizon - (windows - 1) * step.
    offset = F.col("_n") - (F.col("_total") - horizon - (windows - 1) * step_size)
    placed = numbered.join(totals, list(spec.entity)).withColumn("_offset", offset)
    hit = (F.col("_offset") >= 0) & (F.col("_offset") <= (windows - 1) * step_size) & (F.col("_offset") % step_size == 0)
    return placed.where(hit).select(
        *spec.entity,
        F.col(spec.time).alias("origin"),
        F.col(spec.value).alias("origin_value"),
        (F.col("_offset") / step_size + 1).cast("long").alias("validation_window"),
    )


def baseline_forecasts(
    history: DataFrame,
    origins: DataFrame,
    *,
    horizon: int,
    models: Sequence[str] = ALL_BASELINES,
    spec: SeriesSpec = HOURLY,
) -> DataFrame:
    """One row per entity, origin, model and step.

    A seasonal forecast further ahead than its lag repeats its own output, so its source is the
    last season before the origin: step - lag * ceil(step / lag). All sources of all models come
    from one join with the history. A missing source leaves a null prediction.
    """
    if horizon <= 0:
        raise ValueError("horizon must be positive")
    unknown = set(models) - set(ALL_BASELINES) - {m for m in models if m.startswith("seasonal_naive_")}
    if unknown:
        raise ValueError(f"unknown models {sorted(unknown)}")
    keep = [c for c in ("validation_window",) if c in origins.columns]
    steps = origins.withColumn("forecast_step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    step = F.col("forecast_step")
    lags: set[int] = set()
    for model in models:
        lags |= {24, 168} if model == SEASONAL_AVERAGE else set() if model == LAST_VALUE else {_lag_of(model)}
    rows = steps.withColumn(spec.time, spec.shift("origin", step))
    id_cols = [*spec.entity, "origin", *keep, "forecast_step", spec.time, "origin_value"]
    if lags:
        sources = F.array(
            *[F.struct(F.lit(lag).alias("lag"), (step - lag * F.ceil(step / lag)).alias("back")) for lag in sorted(lags)]
        )
        asked = rows.withColumn("_s", F.explode(sources)).withColumn("_from", spec.shift("origin", F.col("_s.back")))
        known = history.select(*spec.entity, F.col(spec.time).alias("_from"), F.col(spec.value).alias("_v"))
        found = asked.join(known, [*spec.entity, "_from"], "left")
        # Steps of one origin meet again in one partial aggregate; pivot has a fixed list of lags.
        rows = found.groupBy(*id_cols).agg(
            *[F.max(F.when(F.col("_s.lag") == lag, F.col("_v"))).alias(f"_lag_{lag}") for lag in sorted(lags)]
        )
    made = F.array(*[F.struct(F.lit(m).alias("m"), _prediction(m).alias("v")) for m in models])
    return rows.select(*[c for c in id_cols if c != "origin_value"], F.explode(made).alias("_p")).select(
        *spec.entity,
        F.col("origin").alias("forecast_origin"),
        *keep,
        "forecast_step",
        spec.time,
        F.col("_p.m").alias("model_name"),
        F.col("_p.v").alias("predicted_value"),
    )


def _lag_of(model: str) -> int:
    return int(model.removeprefix("seasonal_naive_").removesuffix("h"))


def _prediction(model: str) -> Column:
    if model == LAST_VALUE:
        return F.col("origin_value")
    if model == SEASONAL_AVERAGE:
        return (F.col("_lag_24") + F.col("_lag_168")) / 2.0
    return F.col(f"_lag_{_lag_of(model)}")


def require_complete(forecasts: DataFrame) -> DataFrame:
    """Every forecast step must have found its source."""
    bad = forecasts.where(F.col("predicted_value").isNull()).limit(1).collect()
    if bad:
        raise InsufficientHistory(f"no source hour for {bad[0].asDict()}")
    return forecasts


def attach_actuals(forecasts: DataFrame, history: DataFrame, spec: SeriesSpec = HOURLY) -> DataFrame:
    """Forecast rows with the value that was observed, one-to-one on entity and time."""
    actual = history.select(*spec.key, F.col(spec.value).alias("actual_value"))
    return forecasts.join(actual, spec.key, "left")


def evaluate_baselines(
    history: DataFrame, windows: DataFrame, *, horizon: int, models: Sequence[str] = ALL_BASELINES, spec: SeriesSpec = HOURLY
) -> DataFrame:
    """Predictions and actuals of all baselines over all windows and entities."""
    origins = origins_at(history, windows, spec)
    return attach_actuals(baseline_forecasts(history, origins, horizon=horizon, models=models, spec=spec), history, spec)


def clip_negative(forecasts: DataFrame, value: str = "predicted_value") -> DataFrame:
    """Forecasts floored at zero, with a marker of what was clipped."""
    raw = F.col(value)
    return forecasts.withColumn("clipped", F.coalesce(raw < 0, F.lit(False))).withColumn(value, F.greatest(raw, F.lit(0.0)))


def number_steps(forecasts: DataFrame, series: Sequence[str], time: str = "timestamp_utc") -> DataFrame:
    """Step numbers 1.. per series in time order; a series is one horizon, so windows are short."""
    return forecasts.withColumn("forecast_step", F.row_number().over(Window.partitionBy(*series).orderBy(time)))

