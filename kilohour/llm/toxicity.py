"""Toxicity by a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text's features are the hashed n-grams (2 to 6 code points, lower case) that occur in it. Over the labelled training rows
the documents of either class that hold an n-gram are counted; its ratio is the log of its smoothed share among toxic
documents over that among the others. Features whose ratio is beyond ``least_z`` standard errors stay, scaled by their
ratio, and a logistic regression is fitted on them. Every whole text is then scored from a table of weights.

Bounds, all parameters: the classifier is fitted on ``max_labelled`` labelled rows at most, those of smallest id hash, which
are joined by a broadcast of that size; ``1 << bits`` buckets; ``max_features`` features. Scoring covers all rows.

Defined results: a null text is empty and gets the score of a text without features. Without training rows of both classes
every score is 0. Labels that are null or not 0 or 1 are not used; of several labels of a document the largest counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilohour.llm.common import decoded, discard, held_out, placed, quoted, sized_batches, stored, unmade
from kilohour.llm.ngrams import buckets, laid_out

BLOCKS = 64
TRAINING_PARTS = 8


@dataclass(frozen=True)
class Settings:
    orders: tuple[int, ...] = (2, 3, 4, 5, 6)
    bits: int = 22
    max_labelled: int = 20_000
    max_features: int = 1 << 14
    least_z: float = 3.0
    smoothing: float = 1.0
    penalty: float = 1e-3
    threshold: float = 0.3


@dataclass(frozen=True)
class Model:
    """Weight per chosen bucket, and the intercept; no features and no intercept: every score is 0."""

    settings: Settings
    chosen: np.ndarray
    weights: np.ndarray
    intercept: float | None


def _held(texts: list[str], settings: Settings, flags: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text number, bucket) pairs, of all buckets or only of flagged ones."""
    codes, begin = laid_out(texts)
    owner = np.repeat(np.arange(len(texts), dtype=np.int64), np.diff(begin))
    pairs = []
    for n, bucket in buckets(codes, settings.orders, settings.bits):
        inside = owner[: len(bucket)] == owner[n - 1 :]
        if flags is not None:
            inside &= flags[bucket]
        at = np.flatnonzero(inside)
        pairs.append(owner[at] << settings.bits | bucket[at])
    both = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
    return both >> settings.bits, both & ((1 << settings.bits) - 1)


def training_rows(docs: DataFrame, labels: DataFrame, settings: Settings) -> DataFrame:
    """text and toxic of the labelled rows to learn from, none of them held out."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.max_labelled)
    return docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").repartition(TRAINING_PARTS, "doc_id").select("text", "toxic")


def _features(rows: DataFrame, settings: Settings) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Chosen buckets, their ratios, and the number of documents of either class.

    Documents per bucket and class are counted by task and summed by block of buckets; each block's features are judged
    where they are summed, so the driver gets ``max_features`` rows at most.
    """
    size, a = 1 << settings.bits, settings.smoothing

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = np.zeros((2, size), np.int32), np.zeros(2, np.int64)
        for batch in sized_batches(batches, "text", 1 << 18):
            label = np.array(batch.column("toxic").to_pylist(), np.int64)
            number, bucket = _held(decoded(batch.column("text")), settings, None)
            seen += np.bincount(label, minlength=2)
            for c in (0, 1):
                np.add.at(table[c], bucket[label[number] == c], 1)
        blocks = table.reshape(2, BLOCKS, -1)
        for k in range(BLOCKS):
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([blocks[:, k].tobytes()]), pa.array([seen.tolist()])], ["block", "counts", "seen"])

    def judge(group: pd.DataFrame) -> pd.DataFrame:
        clean, toxic = sum(np.frombuffer(c, np.int32).astype(np.int64) for c in group["counts"]).reshape(2, -1)
        n_clean, n_toxic = np.sum([list(s) for s in group["seen"]], axis=0)
        ratio = np.log((toxic + a) / (n_toxic + 2 * a)) - np.log((clean + a) / (n_clean + 2 * a))
        z = np.abs(ratio) / np.sqrt(1 / (toxic + a) + 1 / (clean + a))
        at = np.flatnonzero(z > settings.least_z) if n_clean and n_toxic else np.zeros(0, np.int64)
        return pd.DataFrame({"bucket": at + int(group["block"].iloc[0]) * (size // BLOCKS), "ratio": ratio[at], "z": z[at]})

    classes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    made = rows.mapInArrow(count, "block long, counts binary, seen array<long>").groupBy("block").applyInPandas(judge, "bucket long, ratio double, z double")
    best = sorted((r["bucket"], r["ratio"]) for r in made.orderBy(F.desc("z"), "bucket").limit(settings.max_features).collect())
    return np.array([b for b, _ in best], np.int64), np.array([r for _, r in best], np.float64), classes.get(1, 0), classes.get(0, 0)


def fit(docs: DataFrame, labels: DataFrame, settings: Settings | None = None) -> Model:
    """Learn from the labelled rows that are not held out."""
    settings = settings or Settings()
    rows = stored(training_rows(docs, labels, settings))
    chosen, ratio, n_toxic, n_clean = _features(rows, settings)
    if not n_toxic or not n_clean:
        return Model(settings, np.zeros(0, np.int64), np.zeros(0, np.float32), None)
    if not len(chosen):
        a = settings.smoothing
        return Model(settings, chosen, np.zeros(0, np.float32), float(np.log((n_toxic + a) / (n_clean + a))))
    flags = np.zeros(1 << settings.bits, bool)
    flags[chosen] = True

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized_batches(batches, "text", 1 << 20):
            number, bucket = _held(decoded(batch.column("text")), settings, flags)
            edges = np.searchsorted(number, np.arange(batch.num_rows + 1))
            names = pa.array(bucket.astype(str).tolist(), pa.string())
            lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), names)
            yield pa.RecordBatch.from_arrays([lists, batch.column("toxic")], ["grams", "toxic"])

    counted = CountVectorizerModel.from_vocabulary([str(b) for b in chosen], "grams", "held")
    counted.setBinary(True).setMinTF(1.0)
    scaled = ElementwiseProduct(scalingVec=Vectors.dense(ratio), inputCol="held", outputCol="scaled")
    vectors = scaled.transform(counted.transform(stored(rows.mapInArrow(features, "grams array<string>, toxic int"))))
    learner = LogisticRegression(featuresCol="scaled", labelCol="toxic", regParam=settings.penalty, standardization=False, maxIter=60)
    fitted = learner.fit(vectors.select("scaled", "toxic"))
    discard(rows)
    return Model(settings, chosen, (fitted.coefficients.toArray() * ratio).astype(np.float32), float(fitted.intercept))


def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """The kept columns with score and predicted of every row; they replace kept columns of these names."""
    settings, spark = model.settings, docs.sparkSession
    given = spark.sparkContext.broadcast((model.chosen, model.weights))  # max_features numbers at most
    keep = unmade(keep, ("score", "predicted"))
    given_columns = keep if text in keep else [*keep, text]
    source, body = docs.select(placed(given_columns)), f"c{given_columns.index(text)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen, weights = given.value
        flags = np.zeros(1 << settings.bits, bool)
        flags[chosen] = True
        for batch in sized_batches(batches, body, 1 << 20):
            if model.intercept is None:
                scores = np.zeros(batch.num_rows)
            else:
                number, bucket = _held(decoded(batch.column(body)), settings, flags)
                total = np.bincount(number, weights=weights[np.searchsorted(chosen, bucket)] if len(chosen) else None, minlength=batch.num_rows)
                scores = 1 / (1 + np.exp(-np.clip(total + model.intercept, -500, 500)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array(scores, pa.float64()), pa.array((scores >= settings.threshold).astype(np.int32), pa.int32())],
                [*keep, "score", "predicted"],
            )

    types = dict(source.dtypes)
    return source.mapInArrow(run, ", ".join([*(f"{quoted(c)} {types[f'c{i}']}" for i, c in enumerate(keep)), "score double, predicted int"]))
