import hashlib

import numpy as np
from pyspark.sql import functions as F

from kilohour.llm import line_dedup as L


def test_cuckoo_filter_inserts_finds_and_deletes():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 230_000).astype(np.uint64)  # 88 % of the slots
    table = L.CuckooFilter.new().insert(keys[:100_000]).insert(keys[100_000:])
    table = L.CuckooFilter.load(table.dump())
    assert table.has(keys).all() and (table.slots > 0).sum() == len(keys)
    table.delete(keys[:1000])
    assert table.has(keys[1000:]).all() and table.has(keys[:1000]).mean() < 0.01
    other = np.random.default_rng(2).integers(0, 1 << 63, 50_000).astype(np.uint64)
    assert table.has(other).mean() < 0.001


def brute(rows):
    """Kept text by row, straight from the rule."""
    def key(line):
        k = line.strip(" \t\n\x0b\x0c\r")
        k = "".join(c.lower() if "A" <= c <= "Z" else c for c in k)
        return k if len(k) >= 10 else None

    holders = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if i is not None and key(line):
                holders.setdefault(key(line), set()).add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if i is None or not key(x) or len(holders[key(x)]) < 2 or min(holders[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


ROWS = [
    (1, "A shared line here\nown line of one\n\nshort"), (2, "  a SHARED line here\t\nown line of two, twice\nown line of two, twice"),
    (3, None), (4, ""), (5, "Äöüäöüäöüä same\n" * 3), (6, "Äöüäöüäöüä same\nÄÖÜäöüäöüä same"), (7, "äöüäöüäöü\nshort"), (8, "äöüäöüäöü"),
    (9, "a shared line here"), (9, "a shared line here"), (None, "a shared line here"), (10, "x" * 200_000 + "\n" + "own line of one"),
]
SCHEMA = "doc_id long, text string"


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_matches_brute_force_and_is_reversible(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    index = L.indexed(docs, arrivals=3)
    assert got(L.drop_lines(docs, index, digest=True)) == brute(ROWS)
    # without documents 1, 5 and 9 the index is as if they had never come
    left = [r for r in ROWS if r[0] not in (1, 5, 9)]
    rest = spark.createDataFrame(left, SCHEMA)
    shrunk = index.delete(spark.createDataFrame([(1,), (5,), (9,), (77,)], "doc_id long"))
    assert got(L.drop_lines(rest, shrunk, digest=True)) == brute(left)
    fresh = L.indexed(rest, arrivals=1)
    assert got(shrunk.counts.select("key", "refs", "first_doc")) == got(fresh.counts.select("key", "refs", "first_doc"))
    load = lambda i: sum(int((np.frombuffer(r["slots"], np.uint16) > 0).sum()) for r in i.filters.collect())
    assert load(shrunk) == load(fresh) == fresh.keys == shrunk.keys
    again = shrunk.insert(L.postings(docs.where("doc_id in (1, 5, 9)")))
    assert got(again.counts.select("key", "refs", "first_doc")) == got(index.counts.select("key", "refs", "first_doc"))


def test_shards_split(spark, monkeypatch):
    monkeypatch.setattr(L, "SHARD_KEYS", 40)
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.concat(F.lit("line number "), (F.col("id") % 150).cast("string")).alias("text"))
    index = L.indexed(docs, arrivals=2)
    assert index.shards in (4, 8) and index.keys == 150
    assert L.drop_lines(docs, index).where("n_dropped = 1").count() == 50


def test_other_columns_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "one line of text", "x", 5), (2, "one line of text", "y", 6)], "doc_id long, text string, n_chars string, key int")
    out = L.drop_lines(docs, L.indexed(docs)).orderBy("doc_id").collect()
    assert [(r["kept_text"], r["n_chars"], r["key"], r["n_dropped"]) for r in out] == [("one line of text", "x", 5, 0), ("", "y", 6, 1)]
    assert L.drop_lines(docs.limit(0), L.indexed(docs.limit(0))).count() == 0
