"""Benchmark decontamination by n-gram windows, in DataFrame functions only.

Words are runs of U+0030 to U+0039, a to z and everything from U+0080 on, after A-Z became a-z. A window is ``width``
consecutive words of an item; an item of fewer words, but not none, is one window. The distinct windows form a hash set
with the items that hold them. A document's words become an array of hashes, its windows of every width that occurs
become one hash per position, and these are looked up in the set; a hit is verified word by word.

The set is broadcast while it has at most ``most_broadcast`` windows, about 1 kB each; beyond that Spark chooses the join
from sizes (then positions are shuffled by window hash). Positions are exploded inside the scan's stage and only hits
and one marker row per document reach the single shuffle, which is by document.

Defined results: null and empty texts have no words and are not contaminated; items without words are never found;
items with the same windows are all named. Rows that share doc_id and text give one result each; rows that share a
doc_id with different texts are judged apart; a null doc_id is kept as null.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kilohour.llm.common import free, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Settings:
    width: int = 13
    most_broadcast: int = 200_000
    share: int = 20  # contaminated if share * hit words >= words


def words(text: str | Column) -> Column:
    column = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(F.translate(F.coalesce(column, F.lit("")), UPPER, LOWER), SEPARATORS), "")


def _hashes(column: str | Column) -> Column:
    return F.transform(column, lambda w: F.xxhash64(w))


def windows(items: DataFrame, width: int) -> DataFrame:
    """Distinct windows: size, hash, words and the items that hold them."""
    w = items.select("item_id", words("text").alias("words")).where(F.size("words") > 0)
    w = w.withColumn("size", F.least(F.size("words"), F.lit(width)))
    starts = F.sequence(F.lit(1), F.size("words") - F.col("size") + 1)
    w = w.select("item_id", "size", F.explode(F.transform(starts, lambda i: F.slice("words", i, F.col("size")))).alias("window"))
    return w.groupBy("size", "window").agg(F.collect_set(F.col("item_id").cast("string")).alias("items")).withColumn("hash", F.xxhash64(_hashes("window")))


def _places(size: int) -> Column:
    """Position, size and hash of every run of ``size`` words."""
    starts = F.when(F.size("words") >= size, F.sequence(F.lit(1), F.size("words") - (size - 1)))
    runs = F.transform(starts, lambda i: F.struct(i.alias("at"), F.lit(size).alias("n"), F.xxhash64(F.slice("hashes", i, size)).alias("h")))
    return F.coalesce(runs, F.array().cast("array<struct<at:int,n:int,h:bigint>>"))


def hits(docs: DataFrame, items: DataFrame, settings: Settings | None = None) -> DataFrame:
    """A marker row (begin is null) with n_words per document row, and a row per verified occurrence of a window.

    Columns: doc_id, text_hash, n_words, begin (word position from 0), end, items.
    """
    settings = settings or Settings()
    found = stored(windows(items, settings.width))
    sizes = sorted(r["size"] for r in found.select("size").distinct().collect())  # at most ``width`` numbers
    if found.count() <= settings.most_broadcast:
        found = F.broadcast(found)
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words("text").alias("words"))
    rows = rows.withColumn("hashes", _hashes("words"))
    none = F.struct(F.lit(0).alias("at"), F.lit(0).alias("n"), F.lit(None).cast("long").alias("h"))
    lists = [F.array(none), *(_places(size) for size in sizes)]
    places = F.concat(*lists) if len(lists) > 1 else lists[0]
    at = rows.select("doc_id", "text_hash", "words", F.explode(places).alias("p"))
    at = at.select("doc_id", "text_hash", "words", F.col("p.at").alias("at"), F.col("p.n").alias("n"), F.col("p.h").alias("h"))
    # one long as key; the words are compared after the join, for positions whose hash is in the set only
    joined = at.join(found.select("hash", "window", "items"), F.col("h") == F.col("hash"), "left")
    kept = joined.where((F.col("n") == 0) | (F.col("hash").isNotNull() & (F.slice("words", F.greatest("at", F.lit(1)), F.col("n")) == F.col("window"))))
    marker = F.col("n") == 0
    return kept.select(
        "doc_id", "text_hash", F.when(marker, F.size("words")).alias("n_words"), F.when(~marker, F.col("at") - 1).alias("begin"),
        F.when(~marker, F.col("at") - 1 + F.col("n")).alias("end"), "items",
    )


def judged(docs: DataFrame, items: DataFrame, settings: Settings | None = None) -> DataFrame:
    """doc_id, text_hash, n_words, n_hit, n_items, items_sha256 and contaminated, a row per document row."""
    settings = settings or Settings()
    key = ["doc_id", "text_hash"]
    before = Window.partitionBy(*key).orderBy(F.col("begin").asc_nulls_first(), "end").rowsBetween(Window.unboundedPreceding, -1)
    # the part of an occurrence that no earlier one covers
    rows = hits(docs, items, settings).withColumn("covered", F.coalesce(F.max("end").over(before), F.lit(0)))
    new = F.greatest(F.col("end") - F.greatest("begin", "covered"), F.lit(0))
    named = F.array_sort(F.array_distinct(F.flatten(F.collect_set("items"))))
    total = rows.groupBy(*key).agg(
        F.max("n_words").cast("long").alias("n_words"), F.coalesce(F.sum(new), F.lit(0)).alias("n_hit"), named.alias("named"), F.count("n_words").alias("copies")
    )
    total = total.select(
        *key, "n_words", "n_hit", F.size("named").cast("long").alias("n_items"), F.sha2(F.array_join("named", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (settings.share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "copies",
    )
    return total.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies", "copy")


def clean_documents(docs: DataFrame, items: DataFrame, settings: Settings | None = None) -> DataFrame:
    """The rows that are not contaminated, with all their columns, whatever their names."""
    name, print_ = free("_id", docs.columns), free("_hash", docs.columns)
    bad = judged(docs, items, settings).where("contaminated").select(F.col("doc_id").alias(name), F.col("text_hash").alias(print_)).distinct()
    return docs.join(bad.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col(name)) & (F.xxhash64("text") == F.col(print_)), "left_anti")
