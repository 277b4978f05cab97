"""Incremental line deduplication: sharded cuckoo filters backed by exact reference counts.

State is three stored tables: ``postings`` (shard, key, doc_id) with a row per line key and document, ``counts`` (shard,
key, refs, first_doc) with the exact number of documents and the smallest document of every key, and ``filters`` (shard,
slots) with a cuckoo filter of the keys per shard. Inserting a batch asks the filters first: a key they do not know is
new and needs no look at the stored counts; a key they may know is merged with its exact count. Deleting documents
takes their postings back, recounts the keys concerned and takes keys without documents out of the filters, so the
state is the one that the remaining documents alone would give.

A line's key is the line without white space (U+0020, U+0009 to U+000D) at both ends, A-Z in lower case. Keys shorter
than ``least`` code points are never counted. Keys are held as the first 16 bytes of their SHA-256.

Scale: counts are partial aggregates, so a line that stands in a third of all documents is combined before the shuffle;
filters are built from distinct keys, whose shards are even; documents meet their dropped lines in a join on doc_id.
The number of shards follows the number of keys, ``SHARD_KEYS`` each at most on average, and doubles when a batch would
overfill them; filters are then rebuilt from the counts.

Defined results: a null or empty text is one empty line. Rows without doc_id keep all lines and are not counted. Rows
that share a doc_id are one document to the counts; each keeps or loses lines by the same rule.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilohour.llm.common import BLANKS, discard, free, placed, quoted, raw, sized_batches, stored, unmade

BUCKET = 4
BUCKETS = 1 << 16
# A shard is split before its filter is three quarters full, well below the load at which insertion fails.
SHARD_KEYS = BUCKETS * BUCKET * 3 // 4
LEAST = 10
KEY_BYTES = 16


def line_key(line: bytes, least: int = LEAST) -> bytes | None:
    """Digest of a line's key; None where the key is too short to count."""
    key = line.strip(BLANKS)
    if len(key) < least or (len(key) < 4 * least and len(key.decode("utf-8", "replace")) < least):
        return None
    return hashlib.sha256(key.lower()).digest()[:KEY_BYTES]


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; 0 is an empty slot.

    The second bucket is the first one exclusive-or a hash of the fingerprint, so a fingerprint can move and be deleted
    without its key. Whole arrays of keys are inserted at once: in each round every waiting fingerprint that finds a free
    slot takes it, and the others push an occupant out.
    """

    def __init__(self, slots: np.ndarray):
        self.slots = slots

    @classmethod
    def new(cls) -> CuckooFilter:
        return cls(np.zeros((BUCKETS, BUCKET), np.uint16))

    @classmethod
    def load(cls, data: bytes) -> CuckooFilter:
        return cls(np.frombuffer(data, np.uint16).reshape(-1, BUCKET).copy())

    def dump(self) -> bytes:
        return self.slots.tobytes()

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprint and first bucket of 64-bit parts of keys."""
        prints = ((keys >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
        return prints, (keys & np.uint64(len(self.slots) - 1)).astype(np.int64)

    def other(self, prints: np.ndarray, at: np.ndarray) -> np.ndarray:
        return at ^ ((prints.astype(np.int64) * 0x5BD1E995 >> 7) & (len(self.slots) - 1))

    def has(self, keys: np.ndarray) -> np.ndarray:
        prints, at = self.places(keys)
        there = (self.slots[at] == prints[:, None]).any(1)
        return there | (self.slots[self.other(prints, at)] == prints[:, None]).any(1)

    def insert(self, keys: np.ndarray, rounds: int = 5000) -> CuckooFilter:
        prints, at = self.places(keys)
        pick = np.random.default_rng(7)
        for step in range(rounds):
            if not len(prints):
                return self
            for second in (False, True) if step == 0 else (False,):
                place = self.other(prints, at) if second else at
                order = np.argsort(place, kind="stable")
                place, prints, at = place[order], prints[order], at[order]
                begin = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
                turn = np.arange(len(place)) - np.repeat(begin, np.diff(np.r_[begin, len(place)]))
                free = self.slots[place] == 0
                fits = turn < free.sum(1)
                # the turn-th free slot of the bucket
                slot = np.argmax(np.cumsum(free, 1) > turn[:, None], 1)
                self.slots[place[fits], slot[fits]] = prints[fits]
                prints, at = prints[~fits], at[~fits]
                if not len(prints):
                    return self
            # one waiting fingerprint a bucket pushes an occupant out; the others wait for the next round
            at = np.where(pick.random(len(at)) < 0.5, at, self.other(prints, at))
            _, one = np.unique(at, return_index=True)
            slot = pick.integers(0, BUCKET, len(one))
            out = self.slots[at[one], slot]
            self.slots[at[one], slot] = prints[one]
            at[one] = np.where(out > 0, self.other(out, at[one]), at[one])
            prints = prints.copy()
            prints[one] = out
            at, prints = at[prints > 0], prints[prints > 0]
        raise ValueError("the filter is too full")

    def delete(self, keys: np.ndarray) -> None:
        """Take one copy of each key's fingerprint out; the keys must have been inserted."""
        for p, a in zip(*self.places(keys), strict=True):
            for b in (a, int(self.other(np.array([p], np.uint16), np.array([a]))[0])):
                if len(hit := np.flatnonzero(self.slots[b] == p)):
                    self.slots[b, hit[0]] = 0
                    break


def _halves(keys: pd.Series | list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(keys), np.uint64)[1::2].copy()


def postings(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """A row per counted line key and document: key, doc_id."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized_batches(batches, "text"):
            keys, owners = [], []
            for row, text in enumerate(raw(batch.column("text"))):
                found = {line_key(line, least) for line in text.split(b"\n")} - {None} if text else ()
                keys.extend(found)
                owners.extend([row] * len(found))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()), batch.column("doc_id").take(pa.array(owners, pa.int64()))], ["key", "doc_id"]
            )

    return docs.select("doc_id", "text").where(F.col("doc_id").isNotNull()).mapInArrow(run, f"key binary, doc_id {kind}")


def _shard(shards: int):
    # eight hex digits of the key; bytes 8 to 15 are what the filters use, so shard and place are independent
    return (F.conv(F.substring(F.hex("key"), 1, 8), 16, 10).cast("long") % shards).cast("int")


@dataclass(frozen=True)
class LineIndex:
    """The stored state. Every change returns a new index and leaves the old tables as they are."""

    postings: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int
    keys: int

    @staticmethod
    def empty(spark, doc_type: str = "bigint") -> LineIndex:
        return LineIndex(
            spark.createDataFrame([], f"key binary, doc_id {doc_type}"),
            spark.createDataFrame([], f"key binary, refs long, first_doc {doc_type}"),
            spark.createDataFrame([], "shard int, slots binary"),
            1,
            0,
        )

    def insert(self, batch: DataFrame) -> LineIndex:
        """Add the postings of documents that are not in the index yet (``postings(docs)``, stored)."""
        new = stored(batch.groupBy("key").agg(F.countDistinct("doc_id").alias("refs"), F.min("doc_id").alias("first_doc")))
        base = self._wide_enough(self.keys + new.count())
        probed = stored(base._asked(new))
        # only keys that a filter may know read the exact counts
        old = base.counts.select("key", F.col("refs").alias("_refs"), F.col("first_doc").alias("_first"))
        merged = stored(probed.where("maybe").join(old, "key", "left"))
        total = F.col("refs") + F.coalesce("_refs", F.lit(0))
        changed = merged.select("key", total.alias("refs"), F.least("first_doc", "_first").alias("first_doc"))
        fresh = probed.where("not maybe").select("key", "refs", "first_doc")
        counts = stored(base.counts.join(changed, "key", "left_anti").unionByName(changed).unionByName(fresh))
        # a false alarm is a new key like any other: its own fingerprint goes in, so that deletion stays exact
        unseen = fresh.select("key").unionByName(merged.where("_refs is null").select("key"))
        filters = stored(base._changed(unseen, "insert"))
        for done in (new, probed, merged):
            discard(done)
        return LineIndex(self.postings.unionByName(batch), counts, filters, base.shards, counts.count())

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """Take documents (a column doc_id) out again."""
        gone = self.postings.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi")
        left = stored(self.postings.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_anti"))
        touched = gone.select("key").distinct()
        again = left.join(touched, "key", "left_semi").groupBy("key").agg(F.countDistinct("doc_id").alias("refs"), F.min("doc_id").alias("first_doc"))
        counts = stored(self.counts.join(touched, "key", "left_anti").unionByName(again))
        lost = stored(touched.join(again, "key", "left_anti"))
        filters = stored(self._changed(lost, "delete"))
        return LineIndex(left, counts, filters, self.shards, self.keys - lost.count())

    def repeated(self) -> DataFrame:
        """Keys that more than one document holds, with the document that keeps them."""
        return self.counts.where("refs > 1").select("key", "first_doc")

    # -- filters: a task holds one shard, that is a filter and about SHARD_KEYS distinct keys

    def _wide_enough(self, keys: int) -> LineIndex:
        shards = self.shards
        while shards * SHARD_KEYS < keys:
            shards *= 2
        if shards == self.shards:
            return self
        wide = replace(self, filters=self.filters.limit(0), shards=shards)
        return replace(wide, filters=stored(wide._changed(self.counts.select("key"), "insert")))

    def _with_filters(self, keys: DataFrame):
        sharded = keys.withColumn("shard", _shard(self.shards))
        return sharded.groupBy("shard").cogroup(self.filters.groupBy("shard"))

    def _asked(self, keys: DataFrame) -> DataFrame:
        """Adds ``maybe``: the filters may know the key."""

        def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            out = left[["key", "refs", "first_doc"]].copy()
            out["maybe"] = CuckooFilter.load(right["slots"].iloc[0]).has(_halves(out["key"])) if len(out) and len(right) else False
            return out

        kind = dict(keys.dtypes)["first_doc"]
        return self._with_filters(keys).applyInPandas(run, f"key binary, refs long, first_doc {kind}, maybe boolean")

    def _changed(self, keys: DataFrame, how: str) -> DataFrame:
        """Filters after inserting or deleting distinct keys."""

        def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            shard = int((left if len(left) else right)["shard"].iloc[0])
            filled = CuckooFilter.load(right["slots"].iloc[0]) if len(right) else CuckooFilter.new()
            getattr(filled, how)(_halves(left["key"]))
            return pd.DataFrame({"shard": [shard], "slots": [filled.dump()]})

        return self._with_filters(keys).applyInPandas(run, "shard int, slots binary")


def drop_lines(docs: DataFrame, index: LineIndex, text: str = "kept_text", least: int = LEAST, digest: bool = False) -> DataFrame:
    """All columns of the documents and the text without lines that an earlier document holds.

    Adds n_lines (before dropping), n_dropped and the kept text, or with ``digest`` its SHA-256 as kept_sha256 instead of
    all columns but doc_id. Columns of the documents that bear one of these names are replaced. The index must hold the
    documents' postings.
    """
    result = "kept_sha256" if digest else text
    names = [] if digest else [c for c in unmade(docs.columns, ("n_lines", "n_dropped", result)) if c != "doc_id"]
    lost = free("_drops", docs.columns)
    drops = (
        index.postings.join(index.repeated(), "key").where("doc_id <> first_doc").groupBy("doc_id").agg(F.collect_list("key").alias(lost))
    )
    source = ["doc_id", "text", *(c for c in names if c != "text")]
    rows = docs.select([quoted(c) for c in source]).join(drops.hint("shuffle_hash"), "doc_id", "left").select(*placed(source), lost)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized_batches(batches, "c1"):
            n_lines, n_dropped, out = [], [], []
            for value, gone in zip(raw(batch.column("c1")), batch.column(lost).to_pylist(), strict=True):
                value = value or b""
                count = value.count(b"\n") + 1
                dropped = 0
                if gone:
                    gone = set(gone)
                    kept = [line for line in value.split(b"\n") if line_key(line, least) not in gone]
                    dropped, value = count - len(kept), b"\n".join(kept)
                n_lines.append(count)
                n_dropped.append(dropped)
                out.append(hashlib.sha256(value).hexdigest() if digest else value)
            made = pa.array(out, pa.string()) if digest else pa.array(out, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("c0"), *(batch.column(f"c{source.index(c)}") for c in names), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), made],
                ["doc_id", *names, "n_lines", "n_dropped", result],
            )

    types = dict(docs.dtypes)
    schema = [f"doc_id {types['doc_id']}", *(f"{quoted(c)} {types[c]}" for c in names), "n_lines long", "n_dropped long", f"`{result}` string"]
    return rows.mapInArrow(run, ", ".join(schema))


def indexed(docs: DataFrame, arrivals: int = 2, least: int = LEAST) -> LineIndex:
    """An index of the documents, inserted as several arrivals, so that later ones go through the filters."""
    lines = stored(postings(docs, least))
    index = LineIndex.empty(docs.sparkSession, dict(docs.dtypes)["doc_id"])
    for k in range(arrivals):
        index = index.insert(lines.where(F.pmod(F.xxhash64("doc_id"), F.lit(arrivals)) == k))
    return index
