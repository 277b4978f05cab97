"""Isolation forests per region: fitted on bounded samples, scored in bounded slices."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilohour.errors import InsufficientHistory
from kilohour.functions.ordered import exact_quantiles, side_by_side
from kilohour.operators.continuity import previous_times
from kilohour.operators.events import event, to_events
from kilohour.series import SeriesSpec
from kilohour.session import cut_lineage

DETECTOR = "isolation_forest"
RESOLUTION = 1 << 30
# Quantiles of the score report.
DISTRIBUTION = {"min": 0.0, "p25": 0.25, "p50": 0.50, "p75": 0.75, "p95": 0.95, "p99": 0.99, "max": 1.0}

_TREE = "region string, tree int, feature array<int>, threshold array<double>, child array<int>, size array<int>, sample int"


@dataclass(frozen=True)
class ForestSettings:
    """``max_samples`` rows at most grow a tree, as the method defines; all rows are scored."""

    contamination: float = 0.01
    seed: int = 42
    min_training_rows: int = 336
    trees: int = 100
    score_quantile: float = 0.995
    extreme_quantile: float = 0.9995
    maximum_rate: float = 0.10
    max_samples: int = 256
    slice_rows: int = 65_536


@dataclass(frozen=True)
class Forest:
    """Per-region reference, trees and score thresholds."""

    features: tuple[str, ...]
    settings: ForestSettings
    reference: DataFrame
    trees: DataFrame
    thresholds: DataFrame
    training_scores: DataFrame


def fit_forest(history: DataFrame, features: Sequence[str], settings: ForestSettings | None = None) -> Forest:
    """Scaler, trees and thresholds per region from complete rows.

    A tree sees at most ``max_samples`` rows. Rows are chosen by a hash per (row, tree): one narrow pass keeps
    about twice the sample of each tree, so the groups handed to Python are small whatever the
    region's size, and the choice does not depend on partitioning.
    """
    s = settings or ForestSettings()
    names = list(features)
    clean = history.select("region", "timestamp_utc", *[F.col(f).cast("double").alias(f) for f in names]).dropna()
    reference = clean.groupBy("region").agg(
        F.count(F.lit(1)).alias("training_rows"),
        F.max("timestamp_utc").alias("training_end"),
        F.array(*[F.avg(f) for f in names]).alias("_mean"),
        F.array(*[F.stddev_pop(f) for f in names]).alias("_std"),
    )
    short = reference.where(F.col("training_rows") < s.min_training_rows).limit(1).collect()
    if short:
        raise InsufficientHistory(f"{short[0]['region']}: {short[0]['training_rows']} training rows")
    scaled = _scaled(clean, reference, names)
    draw = lambda t: F.pmod(F.xxhash64("region", "timestamp_utc", t, F.lit(s.seed)), F.lit(RESOLUTION))
    share = F.least(F.lit(2.0 * s.max_samples) / F.col("training_rows"), F.lit(1.0)) * RESOLUTION
    wanted = F.filter(F.sequence(F.lit(0), F.lit(s.trees - 1)), lambda t: draw(t) < share)
    sampled = scaled.withColumn("tree", F.explode(wanted)).select(
        "region", "tree", draw(F.col("tree")).alias("draw"), "timestamp_utc", "_x"
    )
    seed, most = s.seed, s.max_samples

    def grow(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        chosen = rows.sort_values(["draw", "timestamp_utc"]).head(most)
        x = np.array(chosen["_x"].tolist(), dtype=float)
        state = np.random.default_rng([seed, int(key[1]), *key[0].encode("utf-8")])
        tree = _grow_tree(x, state)
        return pd.DataFrame([{"region": key[0], "tree": key[1], "sample": len(x), **tree}])

    # Every later step reads the trees; they are bounded by regions, trees and sample size.
    trees = cut_lineage(sampled.groupBy("region", "tree").applyInPandas(grow, _TREE))
    scores = cut_lineage(_score(scaled, trees, s))  # read several times for thresholds
    levels = {"score_threshold": s.score_quantile, "extreme_threshold": s.extreme_quantile, "_offset": 1.0 - s.contamination}
    thresholds = cut_lineage(
        exact_quantiles(scores, keys=["region"], value="isolation_score", probabilities=levels)
    )
    return Forest(tuple(names), s, reference, trees, thresholds, scores)


def _scaled(rows: DataFrame, reference: DataFrame, names: Sequence[str]) -> DataFrame:
    """Standardised feature vector ``_x``; a constant feature is only centred."""
    joined = rows.join(reference, "region")
    parts = []
    for i, f in enumerate(names):
        std = F.col("_std")[i]
        parts.append((F.col(f) - F.col("_mean")[i]) / F.when(std > 0, std).otherwise(1.0))
    return joined.withColumn("_x", F.array(*parts))


def _grow_tree(x: np.ndarray, state: np.random.Generator) -> dict[str, list]:
    """Random splits down to the usual depth limit, as flat arrays; children are neighbours."""
    feature, threshold, child, size = [], [], [], []
    limit = int(np.ceil(np.log2(max(len(x), 2))))
    feature.append(-1), threshold.append(0.0), child.append(-1), size.append(len(x))
    todo = [(0, np.arange(len(x)), 0)]
    while todo:
        node, rows, depth = todo.pop()
        spread = np.ptp(x[rows], axis=0) if len(rows) else np.zeros(x.shape[1])
        usable = np.flatnonzero(spread > 0)
        if depth >= limit or len(rows) <= 1 or not len(usable):
            continue
        f = int(state.choice(usable))
        low = x[rows, f].min()
        cut = low + spread[f] * state.random()
        left = x[rows, f] <= cut
        first = len(feature)
        feature[node], threshold[node], child[node] = f, float(cut), first
        for part in (rows[left], rows[~left]):
            feature.append(-1), threshold.append(0.0), child.append(-1), size.append(len(part))
        todo.append((first, rows[left], depth + 1))
        todo.append((first + 1, rows[~left], depth + 1))
    return {"feature": feature, "threshold": threshold, "child": child, "size": size}


def _expected_depth(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search among n rows."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 3.0)
    long = 2.0 * (np.log(safe - 1.0) + np.euler_gamma) - 2.0 * (safe - 1.0) / safe
    return np.where(n > 2, long, np.where(n == 2, 1.0, 0.0))


def _score(scaled: DataFrame, trees: DataFrame, s: ForestSettings) -> DataFrame:
    """Isolation score of every row.

    Rows of a region are cut into time slices; each slice meets a copy of its region's trees, so a
    large region is scored by many tasks and no model is broadcast.
    """
    spec = SeriesSpec(chunk_rows=s.slice_rows)
    rows = scaled.withColumn("_slice", spec.chunk()).select("region", "timestamp_utc", "_slice", "_x")
    slices = rows.select("region", "_slice").distinct().toDF("region", "_slice")
    copies = slices.join(trees, "region")
    copies = copies.toDF(*copies.columns)  # names of its own, apart from the rows it is derived from

    def run(key, part: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        if part.empty or model.empty:
            return pd.DataFrame({"region": [], "timestamp_utc": [], "isolation_score": []})
        x = np.array(part["_x"].tolist(), dtype=float)
        depth = np.zeros(len(x))
        for tree in model.sort_values("tree").itertuples():
            depth += _tree_depth(x, tree)
        mean = depth / len(model)
        usual = _expected_depth(model["sample"].to_numpy()).mean()
        score = np.power(2.0, -mean / max(usual, 1e-12))
        return pd.DataFrame({"region": part["region"], "timestamp_utc": part["timestamp_utc"], "isolation_score": score})

    schema = "region string, timestamp_utc timestamp, isolation_score double"
    return rows.groupBy("region", "_slice").cogroup(copies.groupBy("region", "_slice")).applyInPandas(run, schema)


def _tree_depth(x: np.ndarray, tree) -> np.ndarray:
    feature, cut = np.asarray(tree.feature), np.asarray(tree.threshold)
    child, size = np.asarray(tree.child), np.asarray(tree.size)
    at, depth = np.zeros(len(x), dtype=int), np.zeros(len(x))
    live = np.arange(len(x))
    while len(live):
        inner = child[at[live]] >= 0
        live = live[inner]
        node = at[live]
        right = x[live, feature[node]] > cut[node]
        at[live] = child[node] + right
        depth[live] += 1
    return depth + _expected_depth(size[at])


def score_forest(forest: Forest, rows: DataFrame, target: str, *, check: bool = True) -> DataFrame:
    """Complete rows with score, decision, outlier flags and the five largest deviations."""
    names, s = list(forest.features), forest.settings
    extra = [target] if target in rows.columns and target not in names else []
    numeric = rows.select("region", "timestamp_utc", *[F.col(f).cast("double").alias(f) for f in [*names, *extra]])
    if check:
        known = numeric.join(forest.reference.select("region", "training_end"), "region", "left")
        early = known.where(F.col("training_end").isNull() | (F.col("timestamp_utc") <= F.col("training_end")))
        bad = early.limit(1).collect()
        if bad:
            raise InsufficientHistory(f"{bad[0]['region']}: scoring rows must follow known training data")
    scaled = _scaled(numeric.dropna(subset=names), forest.reference, names)
    scores = _score(scaled, forest.trees, s)
    deviations = []
    for i, f in enumerate(names):
        std = F.col("_std")[i]
        z = F.when(std > 0, (F.col(f) - F.col("_mean")[i]) / std).otherwise(0.0)
        deviations.append(F.struct(F.abs(z).alias("size"), F.lit(f).alias("feature"), z.alias("standard_deviations")))
    top = F.slice(F.sort_array(F.array(*deviations), asc=False), 1, 5)
    flagged = scaled.withColumn("deviations", top).join(scores, ["region", "timestamp_utc"]).join(forest.thresholds, "region")
    score = F.col("isolation_score")
    return flagged.select(
        "region", "timestamp_utc", *names, *extra, score, (F.col("_offset") - score).alias("isolation_decision"),
        (score >= F.col("score_threshold")).alias("is_outlier"),
        (score >= F.col("extreme_threshold")).alias("is_extreme_outlier"),
        "score_threshold", "extreme_threshold", "deviations",
    )


def forest_events(scored: DataFrame, target: str, detected_at: Column) -> DataFrame:
    """Outliers as information, extreme ones as warnings."""
    over = (F.col("isolation_score") - F.col("score_threshold")) / F.greatest(F.abs("score_threshold"), F.lit(1e-12))
    excess = F.greatest(over, F.lit(0.0)) * 100.0
    extreme = F.col("is_extreme_outlier")
    score = F.when(extreme, F.least(50.0 + excess, F.lit(69.0))).otherwise(F.least(15.0 + excess, F.lit(29.0)))
    summary = F.to_json(
        F.map_from_entries(
            F.transform("deviations", lambda d: F.struct(d["feature"], F.struct(d["standard_deviations"].alias("standard_deviations"))))
        )
    )
    details = F.to_json(
        F.struct(
            F.col("isolation_decision").alias("decision_function"), F.col("isolation_score").alias("outlier_score"),
            F.col("score_threshold").alias("selected_score_threshold"),
            F.col("extreme_threshold").alias("extreme_score_threshold"), extreme.alias("standalone_extreme"),
        )
    )
    made = event(
        kind="multivariate_outlier", score=score, severity=F.when(extreme, "warning").otherwise("info"),
        observed=F.col(target) if target in scored.columns else None,
        explanation="The isolation forest flagged a joint feature pattern; deviations are associative, not causal.",
        feature_summary=summary, metadata=details,
    )
    return to_events(scored.where("is_outlier"), F.array(made), target=target, detector=DETECTOR, detected_at=detected_at)


def calibration(forest: Forest, rows: DataFrame, scored: DataFrame) -> DataFrame:
    """Score distributions, effective rate and gap count in one row."""
    scored = cut_lineage(scored)
    fitted = exact_quantiles(forest.training_scores, keys=[], value="isolation_score", probabilities=DISTRIBUTION)
    seen = exact_quantiles(scored, keys=[], value="isolation_score", probabilities=DISTRIBUTION)
    counts = scored.agg(
        F.count(F.lit(1)).alias("evaluated_row_count"), F.count_if("is_outlier").alias("flagged_row_count")
    )
    spec = SeriesSpec()
    linked = previous_times(rows.select("region", "timestamp_utc"), spec)
    gaps = linked.agg(
        F.count_if(spec.steps_between(F.col("prev_time"), F.col("timestamp_utc")) > 1.0).alias("gap_count"),
        F.count(F.lit(1)).alias("_rows"),
    )
    row = side_by_side(
        fitted.select(F.struct(*DISTRIBUTION).alias("fitted_score_distribution")),
        seen.select(F.struct(*DISTRIBUTION).alias("scoring_score_distribution")),
        counts,
        gaps,
    )
    rate = F.coalesce(F.try_divide("flagged_row_count", "evaluated_row_count"), F.lit(0.0))
    return row.withColumns(
        {
            "excluded_rows": F.col("_rows") - F.col("evaluated_row_count"),
            "effective_anomaly_percentage": rate * 100.0,
            "exceeds_maximum_rate": rate > forest.settings.maximum_rate,
        }
    ).drop("_rows")
