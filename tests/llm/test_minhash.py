import random
import re

import numpy as np
from pyspark.sql import functions as F

from kilohour.llm import minhash
from kilohour.llm.graph import components

pick = random.Random(3)
VOCABULARY = [f"word{i}" for i in range(3000)]


def text(n):
    return " ".join(pick.choice(VOCABULARY) for _ in range(n))


def changed(t, edits):
    w = t.split(" ")
    for _ in range(edits):
        w[pick.randrange(len(w))] = pick.choice(VOCABULARY)
    return " ".join(w)


def corpus():
    docs = [None, "", "  \n", "one two", "ONE  two", "one two three", "É a b c d", "é a b c d", "a\x0bb c\td e\nf", "a b c d e f"]
    for _ in range(12):
        base = text(pick.choice([8, 40, 150, 400]))
        docs += [base, base.upper().replace(" ", "  "), base + " tail"]
        for _ in range(12):  # chains of variants on both sides of the threshold
            base = changed(base, pick.choice([0, 1, 1, 2, 3]))
            docs.append(base)
    docs += [text(30) for _ in range(30)] + ["same passage " * 40] * 5
    return docs


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(docs):
    sets = {i: shingles(t) for i, t in docs}
    label = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return {i: (len(sets[i]), label[i], label[i] == i) for i in sets}


def test_matches_all_pairs(spark):
    docs = list(enumerate(corpus()))
    order = pick.sample(docs, len(docs))
    df = spark.createDataFrame([(i, t, 1) for i, t in order], "doc_id long, text string, n int")
    got = {r["doc_id"]: tuple(r)[1:] for r in minhash.near_duplicates(df).collect()}
    assert got == brute(docs)


def test_null_id_repeated_rows_long_text_and_empty_table(spark):
    long = text(120_000)
    df = spark.createDataFrame([(None, "a b c d e f"), (2, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (5, long), (6, long + " x")], "doc_id long, text string")
    got = sorted((tuple(r) for r in minhash.near_duplicates(df).collect()), key=repr)
    assert [(r[0], r[2], r[3]) for r in got] == [(1, 1, True), (1, 1, True), (2, 1, False), (5, 5, True), (6, 5, False), (None, None, True)]
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_densified_bins_estimate_similarity():
    sketcher = minhash.Sketcher(minhash.Settings())
    pick = np.random.default_rng(0)
    for n in (3, 30, 3000):
        rate = []
        for _ in range(60):
            both = np.unique(pick.integers(0, 1 << 64, n * 9 // 10 or 1, np.uint64))
            one, two = (np.unique(np.r_[both, pick.integers(0, 1 << 64, max(1, n // 20), np.uint64)]) for _ in "ab")
            share = len(np.intersect1d(one, two)) / len(np.union1d(one, two))
            rate.append((sketcher.bins(one) == sketcher.bins(two)).mean() - share)
        assert abs(np.mean(rate)) < 0.06


def test_components_of_a_long_path_and_a_star(spark):
    path = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    star = spark.range(1001, 1200).select(F.lit(1000).cast("long").alias("a"), F.col("id").alias("b"))
    got = components(path.unionByName(star)).groupBy("label").count().collect()
    assert sorted(map(tuple, got)) == [(0, 301), (1000, 200)]
    assert components(path.limit(0)).count() == 0
