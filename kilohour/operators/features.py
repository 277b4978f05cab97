"""Past-only lag and rolling features and the matrices built from them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kilohour.errors import InsufficientHistory
from kilohour.functions.calendar import CALENDAR_FEATURES, calendar_features, weather_derivations, wind_direction_parts
from kilohour.functions.ordered import side_by_side, with_lookback
from kilohour.operators.continuity import segment_rows, segment_table
from kilohour.series import HOURLY, SeriesSpec

# Default lags, windows and statistics of the feature contracts.
DEMAND_LAGS = (1, 2, 3, 6, 12, 24, 48, 72, 168, 336)
DEMAND_WINDOWS = (3, 6, 12, 24, 72, 168)
TARGET_LAGS = (1, 24, 168)
TARGET_WINDOWS = (3, 24, 168)
WEATHER_LAGS = (1, 3, 6, 12, 24)
WEATHER_WINDOWS = (3, 6, 12, 24)
STATISTICS = ("mean", "std", "min", "max")
WEATHER_COLUMNS = (
    "temperature_c", "apparent_temperature_c", "relative_humidity_pct", "precipitation_mm", "cloud_cover_pct",
    "wind_speed_10m_kph", "shortwave_radiation_wm2", "direct_radiation_wm2", "diffuse_radiation_wm2",
)

_STATS = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}


@dataclass(frozen=True)
class FeatureSpec:
    """Names and windows of one feature matrix."""

    prefix: str = "demand"
    lags: tuple[int, ...] = DEMAND_LAGS
    windows: tuple[int, ...] = DEMAND_WINDOWS
    statistics: tuple[str, ...] = STATISTICS
    extra: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if not self.lags or min(self.lags) <= 0:
            raise ValueError("lags must be positive")
        if not self.windows or min(self.windows) <= 1:
            raise ValueError("rolling windows must be greater than one")

    @property
    def required_history(self) -> int:
        return max(*self.lags, *self.windows)

    @property
    def history_names(self) -> list[str]:
        lags = [f"{self.prefix}_lag_{k}" for k in self.lags]
        return lags + [f"{self.prefix}_rolling_{s}_{n}" for n in self.windows for s in self.statistics]

    @property
    def names(self) -> list[str]:
        return [*CALENDAR_FEATURES, *self.history_names, *self.extra]


DEMAND_FEATURES = FeatureSpec()
TARGET_FEATURES = FeatureSpec("target", TARGET_LAGS, TARGET_WINDOWS)


def past_features(
    df: DataFrame,
    values: Sequence[tuple[str, str]],
    *,
    lags: Sequence[int],
    windows: Sequence[int],
    statistics: Sequence[str] = STATISTICS,
    spec: SeriesSpec = HOURLY,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Lags and rolling statistics over previous rows of the same contiguous segment.

    ``values`` holds (column, name prefix). One shuffle: rows are spread by (entity, chunk) with a
    look-back copy, and the position inside the unbroken run says which lags exist.
    """
    reach = max([*lags, *windows])
    spread = with_lookback(df, index=spec.grid(), chunk_rows=spec.chunk_rows, lookback=reach)
    order = Window.partitionBy(*spec.entity, *keys, "_chunk").orderBy(spec.time)
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    stamp = F.unix_micros(spec.time)
    starts = F.coalesce(stamp - F.lag(stamp).over(order) != spec.step_us, F.lit(True))
    placed = (
        spread.withColumn("_n", F.row_number().over(order))
        .withColumn("_starts", starts)
        .withColumn("_pos", F.col("_n") - F.max(F.when(F.col("_starts"), F.col("_n"))).over(so_far))
    )
    new: dict[str, Column] = {}
    for column, prefix in values:
        for k in lags:
            new[f"{prefix}_lag_{k}"] = F.when(F.col("_pos") >= k, F.lag(column, k).over(order))
        for n in windows:
            frame = order.rowsBetween(-n, -1)
            full = (F.col("_pos") >= n) & (F.count(column).over(frame) == n)
            for name in statistics:
                new[f"{prefix}_rolling_{name}_{n}"] = F.when(full, _STATS[name](F.col(column)).over(frame))
    kept = placed.select("*", *[column.alias(name) for name, column in new.items()])
    return kept.where("_own").drop("_chunk", "_own", "_n", "_starts", "_pos")


def complete_cases(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(columns))


def training_matrix(df: DataFrame, features: FeatureSpec = DEMAND_FEATURES, spec: SeriesSpec = HOURLY) -> DataFrame:
    """Calendar and past features of every row, incomplete rows included."""
    columns = [*spec.key, spec.value, *features.extra]
    built = past_features(
        df.select(*columns),
        [(spec.value, features.prefix)],
        lags=features.lags,
        windows=features.windows,
        statistics=features.statistics,
        spec=spec,
    )
    return built.withColumns(calendar_features(spec.time))


def build_training(df: DataFrame, features: FeatureSpec = DEMAND_FEATURES, spec: SeriesSpec = HOURLY) -> DataFrame:
    """Complete training rows; an empty result is an error raised when the caller checks it."""
    matrix = training_matrix(df, features, spec)
    return complete_cases(matrix, [*features.names, spec.value])


def require_rows(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise InsufficientHistory(f"no rows remain: {what}")
    return df


def feature_report(df: DataFrame, features: FeatureSpec = DEMAND_FEATURES, spec: SeriesSpec = HOURLY) -> DataFrame:
    """Loss accounting of a training matrix in one row.

    A row is gap-affected if it is incomplete and lies in a later segment than its entity's first;
    only (entity, time) and the first segment's end are needed to tell.
    """
    segments = segment_table(segment_rows(df.select(*spec.key), spec), spec)
    gaps = segments.agg(F.sum("missing_expected_hours_before").alias("timestamp_gap_count"))
    firsts = segments.where("segment_no = 1").select(*spec.entity, F.col("segment_end").alias("_first_end"))
    matrix = training_matrix(df, features, spec).join(firsts, list(spec.entity), "left")
    lacking = _any_null(features.names)
    target_missing = F.col(spec.value).isNull()
    counts = matrix.agg(
        F.count(F.lit(1)).alias("source_rows"),
        F.count_if(~lacking & ~target_missing).alias("output_rows"),
        F.count_if(lacking | target_missing).alias("removed_rows"),
        F.count_if((F.col(spec.time) > F.col("_first_end")) & (lacking | target_missing)).alias("gap_affected_rows"),
        F.count_if(lacking & ~target_missing).alias("insufficient_contiguous_history_rows"),
        F.count_if(target_missing).alias("missing_target_rows"),
    )
    return side_by_side(counts, gaps).withColumn("required_history", F.lit(features.required_history))


def _any_null(names: Sequence[str]) -> Column:
    missing = F.lit(False)
    for name in names:
        missing = missing | F.col(name).isNull()
    return missing


def future_rows(
    history: DataFrame, at: Column, features: FeatureSpec = DEMAND_FEATURES, spec: SeriesSpec = HOURLY
) -> DataFrame:
    """Features of the hour ``at`` for every entity, from earlier rows only.

    The context is the last ``required_history`` steps, so the collected array is bounded. Entities
    lacking a step keep ``missing_context_hours`` > 0 and null features.
    """
    context = context_arrays(history, at, features.required_history, spec)
    return features_from_context(context, features, spec)


def context_arrays(history: DataFrame, at: Column, length: int, spec: SeriesSpec = HOURLY) -> DataFrame:
    """Per entity the values of the ``length`` steps before ``at``, oldest first."""
    age = spec.steps_between(F.col(spec.time), at)
    recent = history.select(*spec.key, spec.value).withColumn("_age", age).where(F.col("_age").between(1, length))
    on_grid = recent.where((F.col("_age") == F.floor("_age")) & F.col(spec.value).isNotNull())
    packed = on_grid.groupBy(*spec.entity).agg(
        F.sort_array(F.collect_list(F.struct(spec.time, F.col(spec.value).alias("v")))).alias("_pairs")
    )
    return packed.select(
        *spec.entity,
        at.alias(spec.time),
        (F.lit(length) - F.size("_pairs")).cast("long").alias("missing_context_hours"),
        F.transform("_pairs", lambda p: p["v"]).alias("_context"),
    )


def features_from_context(context: DataFrame, features: FeatureSpec, spec: SeriesSpec = HOURLY) -> DataFrame:
    """Lag and rolling columns out of the ``_context`` array of each row."""
    whole = F.col("missing_context_hours") == 0
    new: dict[str, Column] = {}
    for k in features.lags:
        new[f"{features.prefix}_lag_{k}"] = F.when(whole, F.try_element_at("_context", F.lit(-k)))
    for n in features.windows:
        part = F.slice("_context", -n, n)
        total = F.aggregate(part, F.lit(0.0), lambda a, v: a + v)
        mean = total / n
        squares = F.aggregate(part, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean))  # noqa: B023
        stats = {
            "mean": mean,
            "std": F.sqrt(squares / (n - 1)),
            "min": F.array_min(part),
            "max": F.array_max(part),
        }
        for name in features.statistics:
            new[f"{features.prefix}_rolling_{name}_{n}"] = F.when(whole, stats[name])
    return context.withColumns(new).withColumns(calendar_features(spec.time))


def weather_mode_rows(weather: DataFrame, mode: str) -> DataFrame:
    """Forecast rows for the realistic mode, historical rows for the oracle mode."""
    wanted = {"realistic_forecast": "forecast", "historical_oracle": "historical"}[mode]
    return weather.where(F.col("weather_data_type") == wanted)


def weather_feature_names() -> list[str]:
    derived = [*weather_derivations(), "wind_direction_sin", "wind_direction_cos"]
    lags = [f"{c}_lag_{k}" for c in WEATHER_COLUMNS for k in WEATHER_LAGS]
    rolls = [f"{c}_rolling_mean_{n}" for c in WEATHER_COLUMNS for n in WEATHER_WINDOWS]
    return [*WEATHER_COLUMNS, *derived, *lags, *rolls]


def weather_features(
    weather: DataFrame,
    *,
    mode: str = "realistic_forecast",
    lags: Sequence[int] = WEATHER_LAGS,
    windows: Sequence[int] = WEATHER_WINDOWS,
    drop_incomplete: bool = True,
    spec: SeriesSpec = HOURLY,
) -> DataFrame:
    """Contemporaneous, derived and gap-isolated past weather features of one weather mode."""
    rows = weather_mode_rows(weather, mode)
    built = past_features(
        rows, [(c, c) for c in WEATHER_COLUMNS], lags=lags, windows=windows, statistics=("mean",), spec=spec
    ).withColumns(weather_derivations(spec.time))
    if "wind_direction_sin" not in built.columns:
        built = built.withColumns(wind_direction_parts())
    names = [n for n in weather_feature_names() if n in built.columns]
    return complete_cases(built, names) if drop_incomplete else built


def persistence_weather(historical: DataFrame, *, lag_steps: int = 24, spec: SeriesSpec = HOURLY) -> DataFrame:
    """Weather forecast that repeats what was observed ``lag_steps`` earlier in the same segment."""
    shifted = [
        c
        for c in (*WEATHER_COLUMNS, "wind_direction_10m_deg", "wind_direction_sin", "wind_direction_cos",
                  "temperature_min_c", "temperature_max_c", "temperature_spread_c", "wind_speed_spread_kph")
        if c in historical.columns
    ]
    rows = historical.where(F.col("weather_data_type") == "historical")
    lagged = past_features(
        rows, [(c, c) for c in shifted], lags=[lag_steps], windows=[], statistics=(), spec=spec
    )
    out = [
        F.col(f"{c}_lag_{lag_steps}").alias(c)
        if c in shifted
        else (F.lit("forecast").alias(c) if c == "weather_data_type" else F.col(c))
        for c in historical.columns
    ]
    return complete_cases(lagged.select(*out), [c for c in WEATHER_COLUMNS if c in shifted])


def multivariate_features(target: DataFrame, weather: DataFrame | None, value: str, spec: SeriesSpec = HOURLY) -> DataFrame:
    """Target with six weather columns and the hour cycle."""
    from kilohour.operators.joins import left_context

    result = target.select(*spec.key, value)
    useful = [
        "temperature_c", "apparent_temperature_c", "relative_humidity_pct", "cloud_cover_pct",
        "wind_speed_10m_kph", "shortwave_radiation_wm2",
    ]
    if weather is not None:
        present = [c for c in useful if c in weather.columns]
        result = left_context(result, weather, spec.key, present)
    cycles = calendar_features(spec.time)
    return result.withColumns({"hour_sin": cycles["hour_sin"], "hour_cos": cycles["hour_cos"]})


