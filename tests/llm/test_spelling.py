import itertools
import random
import re
import zlib
from collections import Counter

import pytest

from kilohour.llm import spelling


def apart_by_one(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain(counts, ratio=5):
    near = {w: [v for v in counts if apart_by_one(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None)
    return out


def got(df):
    rows = df.collect()
    out = {r["word"]: tuple(r[c] for c in ("form", "root", "n", "n_near", "form_n")) for r in rows}
    assert len(out) == len(rows)
    return out


def test_variants_match_all_pairs(spark):
    pick = random.Random(3)
    base = ["".join(pick.choice("abcé") for _ in range(pick.randint(2, 9))) for _ in range(40)] + ["aaaaaa", "aaaaaaa", "abababab", "éééééé", "éééééa"]
    words = set(base)
    for w in base:
        for _ in range(6):
            i, c = pick.randrange(len(w)), pick.choice("abcé÷")
            words.add(pick.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :], w + c, c + w]))
    counts = {w: pick.choice([5, 5, 25, 125, 700, 5000]) for w in words if len(w) >= 2}
    df = spark.createDataFrame([(w, n, "x") for w, n in counts.items()], "word string, n long, root string")
    assert got(spelling.variants(df)) == plain(counts)


def test_every_single_edit_is_found(spark):
    for size in range(2, 13):
        w = "abcdefghijklm"[:size]
        edits = {w[:i] + c + w[i:] for i in range(size + 1) for c in "az"} | {w[:i] + w[i + 1 :] for i in range(size)} | {w[:i] + "z" + w[i + 1 :] for i in range(size)}
        edits = {e for e in edits if len(e) >= 2}
        df = spark.createDataFrame([(x, 5) for x in edits | {w}], "word string, n long")
        assert {r["other"] for r in spelling.near_pairs(df).where(f"word = '{w}'").collect()} == edits


def test_long_chain_of_forms(spark):
    counts = {"a" * (6 + i): 5 * 6**i for i in range(9)}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert got(spelling.variants(df)) == plain(counts)


def test_documents_to_words(spark):
    texts = ["Grüße an ALLE! Straße × naïve÷ve l'été", None, "", "x1y2 " * 3, "Éa É́ İstanbul KELVINK", "wort " * 500 + "Wörterbuch"]
    rows = [(i, t, "w", 1) for i, t in enumerate(texts)] + [(5, texts[5], "w", 1), (None, "ohne Kennung", "w", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, word string, n long")
    want = Counter()
    for i, t, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(str.maketrans(spelling.UPPER, spelling.LOWER))
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            want[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 7 == 0 else run] += 1
    words = spelling.misspelt(spelling.runs(df), 7)
    assert {r["word"]: r["n"] for r in spelling.vocabulary(words, 0, 1).collect()} == want
    assert {r["word"] for r in spelling.vocabulary(words, 4, 2).collect()} == {w for w, n in want.items() if len(w) >= 4 and n >= 2}


def test_empty_tables_and_settings(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(spelling.vocabulary(spelling.misspelt(spelling.runs(none)))).count() == 0
    one = spark.createDataFrame([("a", 9), ("", 9), ("b", 900)], "word string, n long")
    assert {w: v[3] for w, v in got(spelling.variants(one)).items()} == {"a": 0, "": 0, "b": 0}
    with pytest.raises(ValueError):
        spelling.variants(none, ratio=1)


def test_a_key_leaves_a_quarter_open(spark):
    """Words that share one half only do not meet: pairs that share a key stay few in a full grid of halves."""
    halves = ["".join(p) for p in itertools.product("abcdefgh", repeat=3)]
    df = spark.createDataFrame([("mnop" + h + g, 5) for h in halves[:64] for g in halves[::64]], "word string, n long")
    keys = df.selectExpr("word", "length(word) AS size").select("word", spelling.F.explode(spelling._keys(spelling.F.col("word"), spelling.F.col("size"))).alias("k"))
    assert keys.groupBy("k").count().agg({"count": "max"}).first()[0] <= 64
