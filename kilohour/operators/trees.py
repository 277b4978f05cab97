"""Boosted trees as plain arrays: scoring, whole forecasts in one stage, and what each feature adds to a prediction.

A fitted ensemble is flattened once. Its size follows from the settings (iterations times nodes of a tree of the given depth),
not from the data, so tasks get it whole. A batch of rows then walks all trees level by level in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import TYPE_CHECKING
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kilohour.functions.calendar import CALENDAR_FEATURES
from kilohour.operators.features import FeatureSpec
from kilohour.session import shared_folder

if TYPE_CHECKING:
    from kilohour.operators.models import FittedModel


@dataclass(frozen=True)
class Ensemble:
    """Nodes of all trees one after another; ``feature`` is -1 in a leaf, children are positions."""

    roots: np.ndarray
    weights: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def _walk(self, x: np.ndarray, root: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Level by level the rows that go on, the nodes they leave and the ones they come to."""
        rows, at = np.arange(len(x)), np.full(len(x), root)
        while len(rows):
            split = self.feature[at]
            going = split >= 0
            rows, at, split = rows[going], at[going], split[going]
            following = np.where(x[rows, split] <= self.threshold[at], self.left[at], self.right[at])
            yield rows, at, following
            at = following

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for root, weight in zip(self.roots, self.weights, strict=True):
            at = np.full(len(x), root)
            for rows, _, following in self._walk(x, root):
                at[rows] = following
            out += weight * self.value[at]
        return out

    def contributions(self, x: np.ndarray) -> tuple[float, np.ndarray]:
        """Prediction of an empty path, and per row and feature the changes of node means where that feature splits."""
        base, out = 0.0, np.zeros(x.shape)
        for root, weight in zip(self.roots, self.weights, strict=True):
            base += weight * self.value[root]
            for rows, at, following in self._walk(x, root):
                np.add.at(out, (rows, self.feature[at]), weight * (self.value[following] - self.value[at]))
        return base, out


def exported_nodes(model: FittedModel) -> DataFrame:
    """(tree, weight, node, prediction, feature, feature_index, threshold, left_child, right_child), a row per node.

    ``feature`` is null in a leaf. Values at most the threshold go left. The model is written to the shared folder.
    """
    trees, spark = model.pipeline.stages[-1], SparkSession.builder.getOrCreate()
    path = f"{shared_folder(spark).rstrip('/')}/trees-{uuid4().hex}"
    trees.write().save(path)
    weights = F.array(*[F.lit(float(w)) for w in trees.treeWeights])
    names = F.array(*[F.lit(c) for c in model.columns])
    split = F.col("nodeData.split")
    inner = F.col("nodeData.leftChild") >= 0
    return spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), F.element_at(weights, F.col("treeID") + 1).alias("weight"), F.col("nodeData.id").alias("node"),
        F.col("nodeData.prediction").alias("prediction"), F.when(inner, F.get(names, split["featureIndex"])).alias("feature"),
        F.when(inner, split["featureIndex"]).otherwise(-1).alias("feature_index"), F.get(split["leftCategoriesOrThreshold"], F.lit(0)).alias("threshold"),
        F.col("nodeData.leftChild").alias("left_child"), F.col("nodeData.rightChild").alias("right_child"),
    )


def compiled(model: FittedModel) -> Ensemble:
    """The model's trees as arrays."""
    nodes = exported_nodes(model).orderBy("tree", "node").collect()
    place = {(n["tree"], n["node"]): i for i, n in enumerate(nodes)}
    child = lambda side: np.array([place.get((n["tree"], n[side]), -1) for n in nodes])
    return Ensemble(
        np.array([i for i, n in enumerate(nodes) if n["node"] == 0]), np.array([n["weight"] for n in nodes if n["node"] == 0]),
        np.array([n["feature_index"] for n in nodes]), np.array([np.nan if n["threshold"] is None else n["threshold"] for n in nodes]),
        child("left_child"), child("right_child"), np.array([n["prediction"] for n in nodes]),
    )


def with_level(model: FittedModel, rows: DataFrame) -> DataFrame:
    """Rows with ``region_level``, the number that stands for their region."""
    return PipelineModel(stages=model.pipeline.stages[:3]).transform(rows).drop("region_index", "region_mean")


def history_matrix(context: np.ndarray, features: FeatureSpec) -> np.ndarray:
    """Lags and rolling statistics of the step after each row of values (oldest first), in the order of the contract.

    Sums run in the order of time, as in the column form.
    """
    columns = [context[:, -k] for k in features.lags]
    for n in features.windows:
        part = context[:, -n:]
        mean = part.cumsum(axis=1)[:, -1] / n
        squares = ((part - mean[:, None]) ** 2).cumsum(axis=1)[:, -1]
        made = {"mean": mean, "std": np.sqrt(squares / (n - 1)), "min": part.min(axis=1), "max": part.max(axis=1)}
        columns += [made[s] for s in features.statistics]
    return np.stack(columns, axis=1)


def stepwise(model: FittedModel, state: DataFrame, calendar: Sequence[Sequence[float]], nonnegative: bool) -> DataFrame:
    """Entity columns and ``_out``, the raw predictions of all steps, from one stage over the state.

    ``state`` has a row per entity with ``region_level``, ``_context`` (the last values, oldest first) and, for models with
    weather, ``_ahead`` array<array<double>> by step. ``calendar`` has a row per step.
    """
    ensemble, features, entity = compiled(model), model.features, list(model.spec.entity)
    if tuple(model.columns) != ("region_level", *features.names) or features.names[: len(CALENDAR_FEATURES)] != list(CALENDAR_FEATURES):
        raise ValueError("the model was fitted on other columns")
    days, weather = np.array(calendar, float), bool(features.extra)
    types = dict(state.dtypes)
    source = state.select(*entity, "region_level", "_context", *(["_ahead"] if weather else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            context = np.array(batch.column("_context").to_pylist(), float)
            level = batch.column("region_level").to_numpy(zero_copy_only=False).reshape(n, 1)
            ahead = np.array(batch.column("_ahead").to_pylist(), float) if weather else None
            raw = np.empty((n, len(days)))
            for step, day in enumerate(days):
                x = np.hstack([level, np.tile(day, (n, 1)), history_matrix(context, features), *([ahead[:, step]] if weather else [])])
                raw[:, step] = ensemble.predict(x)
                value = np.maximum(raw[:, step], 0.0) if nonnegative else raw[:, step]
                context = np.hstack([context[:, 1:], value[:, None]])
            out = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * len(days), pa.int32()), pa.array(raw.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in entity), out], [*entity, "_out"])

    return source.mapInArrow(run, ", ".join([*(f"`{c}` {types[c]}" for c in entity), "_out array<double>"]))


def path_contributions(model: FittedModel, rows: DataFrame) -> DataFrame:
    """What each feature adds to a row's prediction along the paths through the trees.

    Columns: the key, prediction, base, contributions array<struct<size, feature, contribution>>, largest size first (ties: by
    feature). The contributions of a row add up to its prediction less the base, the same for all rows. Rows that lack a
    feature have no path and are left out.
    """
    ensemble, key, columns = compiled(model), list(model.spec.key), list(model.columns)
    source = with_level(model, rows.select(*key, *model.features.names).dropna()).select(
        *key, F.array(*[F.col(c).cast("double") for c in columns]).alias("_x")
    )
    types = dict(source.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, f = batch.num_rows, len(columns)
            if not n:
                continue
            x = np.array(batch.column("_x").to_pylist(), float)
            base, parts = ensemble.contributions(x)
            made = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * f, pa.int32()), pa.array(parts.ravel()))
            prediction = pa.array(ensemble.predict(x))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in key), prediction, pa.array(np.full(n, base)), made], [*key, "prediction", "base", "_parts"])

    schema = ", ".join([*(f"`{c}` {types[c]}" for c in key), "prediction double", "base double", "_parts array<double>"])
    names = F.array(*[F.lit(c) for c in columns])
    pairs = F.zip_with("_parts", names, lambda p, c: F.struct((-F.abs(p)).alias("less"), c.alias("feature"), p.alias("contribution")))
    ranked = F.transform(F.array_sort(pairs), lambda p: F.struct((-p["less"]).alias("size"), p["feature"].alias("feature"), p["contribution"].alias("contribution")))
    return source.mapInArrow(run, schema).select(*key, "prediction", "base", ranked.alias("contributions"))
