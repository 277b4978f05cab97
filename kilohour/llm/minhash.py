"""Near-duplicate documents by one-permutation hashing with optimal densification, banded buckets and star-shaped edges.

A document's set holds the 64-bit hashes of its distinct shingles. The hash range is cut into ``bins``; a bin's value is
its smallest hash, and an empty bin copies a bin that a fixed random walk of its own reaches first. ``rows`` bins make a
band; documents that agree in a band meet in its bucket.

1. Documents with equal sets are one class, whatever their number; only its smallest document goes on.
2. In each bucket every member gets one edge, to the smallest member: as many edges as members, not all pairs.
3. Edges are confirmed on full sets; confirmed links give components.
4. Buckets whose members are still in several components are open: a link may hide between members that the star did
   not join. Their members meet once more by prefixes: with shingles ordered from rare to common, two sets that are
   similar enough share one of their first few shingles. Only pairs of different components that do, and whose sizes
   and positions allow the similarity, are confirmed. This filter is exact, so no link that a bucket holds is lost, and
   groups of loosely similar documents give few pairs instead of all.

A pair of similarity 0.85 shares no bucket of 32 bands of 5 with probability (1 - 0.85^5)^32 = 7e-9, one
of 0.8 with 3e-6.

Words are runs of anything but U+0020 and U+0009 to U+000D, A-Z in lower case. Defined results: fewer than five words are
one shingle; without words a document has the empty set and is linked with nothing; rows without doc_id are linked with
nothing and have no component; rows that share a doc_id are one document, linked by any of their texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kilohour.llm.common import discard, raw, sized_batches, stored
from kilohour.llm.graph import components


@dataclass(frozen=True)
class Settings:
    words: int = 5
    percent: int = 85
    bands: int = 32
    rows: int = 5

    @property
    def bins(self) -> int:
        return self.bands * self.rows


_RANDOM = np.random.default_rng(20_240_229)
_BYTE = _RANDOM.integers(0, 1 << 64, 256, np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))
_NEXT = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the number of words of each text."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(np.r_[True, blank].astype(np.int8)))
    first, last = edge[0::2], edge[1::2]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * _powers(_STEP, len(data)), dtype=np.uint64)])
    hashes = mix((sums[last] - sums[first]) * _powers(_BACK, len(data) + 1)[first])
    ends = np.cumsum([len(t) + 1 for t in texts])
    return hashes, np.diff(np.searchsorted(first, np.r_[0, ends]))


def shingle_sets(texts: list[bytes], words: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    if not texts:
        return []
    hashes, counts = word_hashes(texts)
    n = len(hashes)
    total = np.zeros(max(0, n - words + 1), np.uint64)
    for j, factor in enumerate(_powers(_NEXT, words)):
        total += hashes[j : j + len(total)] * factor
    total = mix(total)
    out, at = [], 0
    for count in counts.tolist():
        if count >= words:
            out.append(np.unique(total[at : at + count - words + 1]))
        elif count:
            whole = (hashes[at : at + count] * _powers(_NEXT, count)).sum(dtype=np.uint64) + np.full(1, count, np.uint64)
            out.append(mix(whole))
        else:
            out.append(np.zeros(0, np.uint64))
        at += count
    return out


class Sketcher:
    """Band hashes of shingle sets."""

    def __init__(self, settings: Settings):
        self.settings, k = settings, settings.bins
        self.edges = (np.arange(k, dtype=np.float64) * (2.0**64 / k)).astype(np.uint64)
        walk = np.random.default_rng(k)
        self.walks = [walk.integers(0, k, (k, 64)), walk.integers(0, k, (k, 4096))]
        self.factor = walk.integers(0, 1 << 63, (settings.bands, settings.rows), np.uint64) | np.uint64(1)
        self.band = walk.integers(0, 1 << 63, settings.bands, np.uint64)

    def bins(self, items: np.ndarray) -> np.ndarray:
        """A value per bin; the set must not be empty."""
        at = np.searchsorted(items, self.edges)
        filled = np.diff(np.r_[at, len(items)]) > 0
        values = items[np.minimum(at, len(items) - 1)]
        empty = np.flatnonzero(~filled)
        for walk in self.walks:
            if not len(empty):
                break
            there = filled[walk[empty]]
            hit = there.argmax(1)
            found = there[np.arange(len(empty)), hit]
            values[empty[found]] = values[walk[empty[found], hit[found]]]
            empty = empty[~found]
        if len(empty):  # less than once in 10^11 sets
            values[empty] = values[np.flatnonzero(filled)[0]]
        return values

    def bands(self, items: np.ndarray) -> np.ndarray:
        values = self.bins(items).reshape(self.settings.bands, self.settings.rows)
        return mix((values * self.factor).sum(1, dtype=np.uint64) + self.band).view(np.int64)


def described(docs: DataFrame, settings: Settings) -> DataFrame:
    """doc_id, n_shingles, digest of the set and band hashes of every document, without texts."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher(settings)
        for batch in sized_batches(batches, "text"):
            sets = shingle_sets([t or b"" for t in raw(batch.column("text"))], settings.words)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.sha256(s.tobytes()).digest()[:16] for s in sets], pa.binary()),
                    pa.array([sketcher.bands(s).tolist() if len(s) else [] for s in sets], pa.list_(pa.int64())),
                ],
                ["doc_id", "n_shingles", "digest", "bands"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles long, digest binary, bands array<long>")


def full_sets(docs: DataFrame, wanted: DataFrame, settings: Settings) -> DataFrame:
    """node and items (the sorted set as bytes) of wanted documents."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized_batches(batches, "text"):
            sets = shingle_sets([t or b"" for t in raw(batch.column("text"))], settings.words)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "items"])

    rows = docs.select("doc_id", "text").join(wanted.select(F.col("node").alias("doc_id")).hint("shuffle_hash"), "doc_id", "left_semi")
    return rows.mapInArrow(run, f"node {kind}, items binary")


def confirmed(edges: DataFrame, sets: DataFrame, settings: Settings) -> DataFrame:
    """Edges (a, b) whose full sets are similar enough."""
    kind = dict(edges.dtypes)["a"]
    rows = edges.select("a", "b").join(sets.select(F.col("node").alias("a"), F.col("items").alias("left")), "a")
    rows = rows.join(sets.select(F.col("node").alias("b"), F.col("items").alias("right")), "b").select("a", "b", "left", "right")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for one, two in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist(), strict=True):
                x, y = np.frombuffer(one, np.uint64), np.frombuffer(two, np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                shared = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(x) else 0
                good.append(shared > 0 and 100 * shared >= settings.percent * (len(x) + len(y) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return rows.mapInArrow(run, f"a {kind}, b {kind}")


def across_components(members: DataFrame, sets: DataFrame, settings: Settings) -> DataFrame:
    """Pairs (a, b) of members (node, label) with different labels that may be similar enough, by prefix filtering.

    Shingles that one member alone holds come first in its order and match nothing, so only their number matters. The
    shorter set of a pair is looked up by the prefix that suffices for sets not shorter than itself.
    """
    kind, percent = dict(members.dtypes)["node"], settings.percent

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = [np.frombuffer(x, np.int64) for x in batch.column("items").to_pylist()]
            for start in range(0, len(items), 256):
                part = items[start : start + 256]
                sizes = np.array([len(x) for x in part], np.int64)
                rows = pa.array(np.repeat(np.arange(start, start + len(part)), sizes))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(rows) for c in ("node", "label", "part")), pa.array(np.repeat(sizes, sizes)), pa.array(np.concatenate(part))],
                    ["node", "label", "part", "n", "token"],
                )

    whole = members.join(sets, "node").select("node", "label", F.xxhash64("items").alias("part"), "items")
    tokens = stored(whole.mapInArrow(spread, f"node {kind}, label {kind}, part long, n long, token long"))
    common = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    own = Window.partitionBy("node", "part")
    ranked = tokens.join(common, "token").withColumn("at", F.row_number().over(own.orderBy("df", "token")) - 1 + F.col("n") - F.count("*").over(own))
    ceiling = lambda x, y: F.floor((x + (y - 1)) / y)
    ranked = stored(ranked.where(F.col("at") <= F.col("n") - ceiling(percent * F.col("n"), 100)).select("token", "node", "label", "n", "at"))
    short = ranked.where(F.col("at") <= F.col("n") - ceiling(2 * percent * F.col("n"), 100 + percent))
    short = short.select("token", F.col("node").alias("a"), F.col("label").alias("la"), F.col("n").alias("na"), F.col("at").alias("i"))
    long = ranked.select("token", F.col("node").alias("b"), F.col("label").alias("lb"), F.col("n").alias("nb"), F.col("at").alias("j"))
    need = ceiling(percent * (F.col("na") + F.col("nb")), 100 + percent)
    shorter = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    fits = shorter & (100 * F.col("na") >= percent * F.col("nb")) & (F.least(F.col("na") - F.col("i"), F.col("nb") - F.col("j")) >= need)
    pairs = stored(short.join(long, "token").where((F.col("la") != F.col("lb")) & fits).select("a", "b").distinct())
    for done in (tokens, ranked):
        discard(done)
    return pairs


def near_duplicates(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest document it reaches) and kept, a row per row."""
    settings = settings or Settings()
    facts = stored(described(docs, settings))
    linkable = facts.where("doc_id is not null and n_shingles > 0")
    classes = stored(linkable.groupBy("digest").agg(F.min("doc_id").alias("node")))
    heads = linkable.join(classes.select("digest", F.col("node").alias("doc_id")), ["digest", "doc_id"], "left_semi")
    spread = heads.select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket"))
    centres = spread.groupBy("bucket").agg(F.min(F.struct("node", "n")).alias("centre"), F.count("*").alias("members")).where("members > 1")
    shared = stored(spread.join(centres.select("bucket", "centre"), "bucket").select("bucket", "node", "n", F.col("centre.node").alias("to"), F.col("centre.n").alias("m")))
    fits = lambda n, m: 100 * F.least(n, m) >= settings.percent * F.greatest(n, m)  # noqa: E731  no link otherwise
    edges = stored(shared.where((F.col("node") != F.col("to")) & fits(F.col("n"), F.col("m"))).select(F.col("node").alias("a"), F.col("to").alias("b")).distinct())
    sets = stored(full_sets(docs, shared.select("node").distinct(), settings))
    links = stored(confirmed(edges, sets, settings))
    labels = components(links)

    placed = shared.select("bucket", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    open_ = placed.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    members = placed.join(open_.select("bucket"), "bucket", "left_semi").select("node", "label").distinct()
    across = across_components(members, sets, settings)
    tested = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    more = stored(confirmed(across.join(tested, ["a", "b"], "left_anti"), sets, settings))
    if not more.isEmpty():
        labels = components(links.unionByName(more))
    for done in (shared, edges, sets, across):
        discard(done)
    found = classes.join(labels, "node", "left").select("digest", F.coalesce("label", "node").alias("component_id"))
    # a document with several texts is reached by the smallest of them
    out = facts.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("digest")).alias("digest")).join(found, "digest", "left")
    alone = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", alone.alias("component_id"), F.coalesce(alone == F.col("doc_id"), F.lit(True)).alias("kept"))
