"""Global tree models: fitting, recursive forecasts, rolling evaluation, tuning and importance."""

from __future__ import annotations

import random
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from multiprocessing.pool import ThreadPool

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import SQLTransformer, StringIndexer, TargetEncoder, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from kilohour.contracts import FORECAST_COLUMNS
from kilohour.errors import InsufficientHistory
from kilohour.functions.calendar import CALENDAR_FEATURES, calendar_features
from kilohour.operators.features import FeatureSpec, context_arrays, training_matrix
from kilohour.operators.forecast import attach_actuals
from kilohour.operators.trees import path_contributions, stepwise, with_level
from kilohour.series import HOURLY, SeriesSpec
from kilohour.session import cut_lineage


@dataclass(frozen=True)
class ModelSettings:
    """Boosted trees with absolute-error loss."""

    name: str = "gbt"
    version: str = "unregistered"
    run_id: str = ""
    iterations: int = 120
    step: float = 0.05
    depth: int = 7
    subsample: float = 1.0
    min_rows: int = 1
    bins: int = 64
    region_smoothing: float = 10.0
    seed: int = 42


@dataclass(frozen=True)
class FittedModel:
    """A fitted pipeline with the feature contract it was fitted on."""

    pipeline: PipelineModel
    features: FeatureSpec
    spec: SeriesSpec
    settings: ModelSettings
    columns: tuple[str, ...]

    def predict(self, rows: DataFrame) -> DataFrame:
        out = self.pipeline.transform(rows)
        return out.drop("region_index", "region_mean", "region_level", "_vector").withColumnRenamed("prediction", "_prediction")

    def save(self, path: str) -> None:
        self.pipeline.write().overwrite().save(path)


def fit_model(
    matrix: DataFrame,
    features: FeatureSpec,
    settings: ModelSettings | None = None,
    *,
    spec: SeriesSpec = HOURLY,
    validation: Column | None = None,
) -> FittedModel:
    """One model over all regions from a feature matrix; ``validation`` marks rows for early stopping.

    The region enters as the smoothed mean of its target over the fitting rows, whatever the number of
    regions, so the pipeline and its bins are the same at every size; an unseen region gets the overall mean.
    """
    s = settings or ModelSettings()
    names = features.names
    rows = matrix.select("region", spec.time, spec.value, *names).dropna()
    if rows.isEmpty():
        raise InsufficientHistory("no complete training rows")
    indexer = StringIndexer(inputCol="region", outputCol="region_index", handleInvalid="keep")
    encoder = TargetEncoder(
        inputCols=["region_index"], outputCols=["region_mean"], labelCol=spec.value, targetType="continuous",
        smoothing=s.region_smoothing, handleInvalid="keep",
    )
    # the encoder passes the region's category marks on; a sum is a plain number
    number = SQLTransformer(statement="SELECT *, region_mean + 0.0D AS region_level FROM __THIS__")
    columns = ["region_level", *names]
    assembler = VectorAssembler(inputCols=columns, outputCol="_vector")
    trees = GBTRegressor(
        featuresCol="_vector", labelCol=spec.value, lossType="absolute", maxIter=s.iterations, stepSize=s.step,
        maxDepth=s.depth, subsamplingRate=s.subsample, minInstancesPerNode=s.min_rows, seed=s.seed, maxBins=s.bins,
    )
    learning = rows
    if validation is not None:
        rows = rows.withColumn("_validation", validation)  # from region, time, value or features
        trees = trees.setValidationIndicatorCol("_validation")
        learning = rows.where("not _validation")
    rows = rows.persist()  # boosting reads the training rows many times
    try:
        # regions are encoded from the rows that are learned from, never from validation rows
        coded = indexer.fit(learning)
        regional = encoder.fit(coded.transform(learning))
        fitted = Pipeline(stages=[coded, regional, number, assembler, trees]).fit(rows)
    finally:
        rows.unpersist()
    return FittedModel(fitted, features, spec, s, tuple(columns))


def fit_target_model(
    frame: DataFrame, features: FeatureSpec, settings: ModelSettings | None = None, *, spec: SeriesSpec = HOURLY
) -> FittedModel:
    """Fit on the rows of a target frame; ``features.extra`` names its weather columns."""
    return fit_model(training_matrix(frame.where(F.col(spec.value).isNotNull()), features, spec), features, settings, spec=spec)


def recursive_forecast(
    model: FittedModel,
    history: DataFrame,
    *,
    horizon: int,
    created_at: Column,
    future: DataFrame | None = None,
    nonnegative: bool = True,
    weather_mode: str = "none",
) -> DataFrame:
    """Forecast all regions step by step; each prediction becomes the newest value of its region.

    The state is one row per region: the last ``required_history`` values and, for weather-aware models, the
    weather of the coming steps, all bounded by the feature contract and the horizon. The trees are compiled to
    arrays, so one stage carries a region through all steps. Region names must be the model's ``region`` column.
    """
    spec, features = model.spec, model.features
    known = history.where(F.col(spec.value).isNotNull())
    ends = known.groupBy(*spec.entity).agg(F.max(spec.time).alias("_end")).agg(
        F.min("_end").alias("first"), F.max("_end").alias("last")
    ).first()
    if ends["first"] is None or ends["first"] != ends["last"]:
        raise InsufficientHistory("all regions must end at the same forecast origin")
    origin = F.lit(ends["last"])
    state = context_arrays(known, spec.shift(origin, 1), features.required_history, spec)
    if not state.where("missing_context_hours > 0").isEmpty():
        raise InsufficientHistory("a region lacks contiguous history before the origin")
    state = state.drop("missing_context_hours", spec.time)
    if features.extra:
        ahead = F.transform("_weather", lambda w: F.array(*[w[c].cast("double") for c in features.extra])).alias("_ahead")
        state = state.join(_future_arrays(future, origin, horizon, features, spec).select(*spec.entity, ahead), list(spec.entity))
    steps = history.sparkSession.range(1, horizon + 1).select("id", spec.shift(origin, F.col("id")).alias(spec.time))
    days = steps.select("id", *[c.alias(n) for n, c in calendar_features(spec.time).items()]).orderBy("id").collect()
    out = stepwise(model, with_level(model, state), [[d[n] for n in CALENDAR_FEATURES] for d in days], nonnegative)
    s = model.settings
    raw = out.select(*spec.entity, F.posexplode("_out").alias("_i", "_raw"))
    value = F.greatest(F.col("_raw"), F.lit(0.0)) if nonnegative else F.col("_raw")
    return raw.select(
        *spec.entity,
        F.lit(spec.value).alias("target"),
        origin.alias("forecast_origin"),
        spec.shift(origin, F.col("_i") + 1).alias("timestamp_utc"),
        (F.col("_i") + 1).alias("forecast_step"),
        value.alias("predicted_value"),
        F.lit(s.name).alias("model_name"),
        F.lit(s.version).alias("model_version"),
        F.lit(s.run_id).alias("run_id"),
        F.lit(weather_mode).alias("weather_mode"),
        created_at.alias("created_at_utc"),
        (F.col("_raw") < 0).alias("clipped"),
    ).select(*FORECAST_COLUMNS, "clipped")


def _future_arrays(future: DataFrame | None, origin: Column, horizon: int, features: FeatureSpec, spec: SeriesSpec) -> DataFrame:
    """Weather of exactly origin+1 .. origin+horizon per region, as an ordered array."""
    if future is None:
        raise InsufficientHistory("a weather-aware model needs future weather")
    ahead = spec.steps_between(origin, F.col(spec.time))
    rows = future.where(ahead.between(1, horizon) & (ahead == F.floor(ahead))).dropna(subset=list(features.extra))
    packed = rows.groupBy(*spec.entity).agg(
        F.sort_array(F.collect_list(F.struct(spec.time, *features.extra))).alias("_weather"),
        F.count_distinct(spec.time).alias("_hours"),
    )
    short = packed.where(F.col("_hours") != horizon).limit(1).collect()
    if short:
        raise InsufficientHistory(f"future weather covers {short[0]['_hours']} of {horizon} hours: {short[0][0]}")
    return packed.drop("_hours")


def evaluate_model(
    frame: DataFrame,
    windows: DataFrame,
    fit: Callable[[DataFrame], FittedModel],
    *,
    horizon: int,
    created_at: Column,
    spec: SeriesSpec = HOURLY,
    future: DataFrame | None = None,
    nonnegative: bool = True,
) -> DataFrame:
    """Refit at every window's origin, forecast recursively and attach what was observed.

    The loop runs over the few requested windows; fitting and forecasting are distributed.
    """
    chosen = windows.select("validation_window", "origin").orderBy("validation_window").collect()
    parts = []
    for window in chosen:
        past = frame.where(F.col(spec.time) <= F.lit(window["origin"]))
        made = recursive_forecast(
            fit(past), past, horizon=horizon, created_at=created_at, future=future, nonnegative=nonnegative
        )
        # Forecasts cost far more than storing them: several metric slices read them afterwards.
        parts.append(cut_lineage(made).withColumn("validation_window", F.lit(window["validation_window"])))
    predictions = parts[0]
    for part in parts[1:]:
        predictions = predictions.unionByName(part)
    return attach_actuals(predictions, frame, spec)


def draw_settings(base: ModelSettings, trials: int, seed: int) -> list[ModelSettings]:
    """Seeded random draws from the search space."""
    pick = random.Random(seed)
    return [
        replace(
            base,
            iterations=pick.randint(80, 300),
            step=0.02 * (0.15 / 0.02) ** pick.random(),
            depth=pick.randint(4, 10),
            min_rows=pick.randint(10, 50),
            subsample=pick.uniform(0.7, 1.0),
        )
        for _ in range(trials)
    ]


@dataclass(frozen=True)
class Tuning:
    """The winner, and one row per fit: rung, candidate (its place in the list), origin, wape, kept (goes on to the next rung)."""

    winner: ModelSettings
    fits: DataFrame


def tune_model(
    frame: DataFrame,
    windows: DataFrame,
    final_start: object,
    features: FeatureSpec,
    candidates: Sequence[ModelSettings],
    *,
    horizon: int,
    created_at: Column,
    spec: SeriesSpec = HOURLY,
    at_once: int = 4,
) -> Tuning:
    """Successive halving on windows that end before the final evaluation, the oldest first.

    Each rung adds one window: every candidate that is left is fitted on the rows up to its origin and forecasts it. The
    better half goes on (at least one); a candidate's score is the WAPE over all its windows so far, ties go to the earlier
    candidate. The last rung's best wins. All fits read one stored feature matrix; ``at_once`` of them run at a time.
    """
    last = windows.agg(F.max("validation_end")).first()[0]
    if last >= final_start:
        raise ValueError("tuning windows overlap the final evaluation")
    older = cut_lineage(frame.where((F.col(spec.time) < F.lit(final_start)) & F.col(spec.value).isNotNull()))
    matrix = cut_lineage(training_matrix(older, features, spec))
    origins = [r["origin"] for r in windows.select("origin").orderBy("origin").collect()]
    future = older.select(*spec.key, *features.extra) if features.extra else None

    def tried(settings: ModelSettings, origin: object) -> tuple[float, float]:
        known = F.col(spec.time) <= F.lit(origin)
        model = fit_model(matrix.where(known), features, settings, spec=spec)
        made = recursive_forecast(model, older.where(known), horizon=horizon, created_at=created_at, future=future)
        seen = attach_actuals(made, older, spec).where(F.col("actual_value").isNotNull())
        sums = seen.agg(F.sum(F.abs(F.col("predicted_value") - F.col("actual_value"))), F.sum(F.abs("actual_value"))).first()
        return sums[0] or 0.0, sums[1] or 0.0

    left, totals, fits = list(range(len(candidates))), {i: (0.0, 0.0) for i in range(len(candidates))}, []
    wape = lambda pair: pair[0] / pair[1] if pair[1] else float("inf")
    with ThreadPool(max(1, at_once)) as pool:
        for rung, origin in enumerate(origins, 1):
            results = pool.map(inheritable_thread_target(older.sparkSession)(lambda i, o=origin: tried(candidates[i], o)), left)
            for i, (error, size) in zip(left, results, strict=True):
                totals[i] = (totals[i][0] + error, totals[i][1] + size)
            ranked = sorted(left, key=lambda i: (wape(totals[i]), i))
            going = ranked[: max(1, len(ranked) // 2)] if rung < len(origins) else ranked[:1]
            fits += [(rung, i, origin, wape(totals[i]), i in going) for i in left]
            left = sorted(going)
    schema = "rung int, candidate int, origin timestamp, wape double, kept boolean"
    return Tuning(candidates[left[0]], older.sparkSession.createDataFrame(fits, schema))


# -- importance -------------------------------------------------------------------------------


def feature_importance(model: FittedModel) -> list[tuple[str, float]]:
    """Split-gain importance of every feature, largest first."""
    weights = model.pipeline.stages[-1].featureImportances.toArray()
    return sorted(zip(model.columns, map(float, weights)), key=lambda item: (-item[1], item[0]))


def permutation_importance(
    model: FittedModel, matrix: DataFrame, *, sample_rows: int | None = None, seed: int = 42, bucket_rows: int = 100_000
) -> DataFrame:
    """Rise of the mean absolute error when one feature is shuffled among the rows.

    All rows are scored unless the caller asks for a sample. A row's partner is the next one in a seeded hash
    order inside its hash bucket of about ``bucket_rows`` rows, so no task orders all rows; the last row of a
    bucket takes the first one. All features are shuffled in one frame and scored together.
    """
    names, value = model.features.names, model.spec.value
    picked = matrix.select(*model.spec.key, value, *names).dropna()
    order = F.xxhash64(*model.spec.key, F.lit(seed))
    if sample_rows is not None:
        picked = picked.orderBy(order, *model.spec.key).limit(sample_rows)
    total = picked.count()
    buckets = max(1, -(-total // bucket_rows))
    rows = picked.withColumn("_row", order).withColumn("_bucket", F.pmod(F.xxhash64("_row"), F.lit(buckets)))
    inside = Window.partitionBy("_bucket").orderBy("_row", *model.spec.key)
    other = F.coalesce(F.lead(F.struct(*names)).over(inside), F.first(F.struct(*names)).over(inside))
    sample = cut_lineage(rows.withColumn("_other", other).drop("_bucket"))
    base = sample.select("_row", *names, "region", value)
    plain = base.withColumn("feature", F.lit(None).cast("string"))
    mixed = sample.withColumn("feature", F.explode(F.array(*[F.lit(n) for n in names])))
    swapped = mixed.select(
        "_row", "region", value, "feature",
        *[F.when(F.col("feature") == n, F.col("_other")[n]).otherwise(F.col(n)).alias(n) for n in names],
    )
    scored = model.predict(plain.unionByName(swapped.select(*plain.columns)))
    errors = scored.groupBy("feature").agg(F.avg(F.abs(F.col("_prediction") - F.col(value))).alias("mae"))
    reference = errors.where("feature IS NULL").select(F.col("mae").alias("base_mae"))
    rows = errors.where("feature IS NOT NULL").crossJoin(F.broadcast(reference))  # one row
    return rows.select("feature", (F.col("mae") - F.col("base_mae")).alias("mae_increase")).orderBy(
        F.desc("mae_increase"), "feature"
    )


def local_contributions(model: FittedModel, rows: DataFrame, *, top: int = 10) -> DataFrame:
    """The features that add most to each row's prediction, by size; all of them add up to it (see ``path_contributions``)."""
    found = path_contributions(model, rows)
    return found.withColumn("contributions", F.slice("contributions", 1, top))
