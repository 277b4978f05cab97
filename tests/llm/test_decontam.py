import hashlib
import re

from kilohour.llm import decontam

ITEM = " ".join(f"w{i}" for i in range(20))
ITEMS = [(1, ITEM), (2, "Only Three Words"), (3, None), (4, ""), (5, "..."), (10, ITEM), (6, "É ok 7")]
DOCS = [
    (1, "x " * 50 + ITEM.upper().replace(" ", ", ") + " y"), (2, "so, ONLY\nthree-words here"), (3, None), (4, ""), (5, "é ok 7"), (6, "É ok 7 " * 3), (7, "clean text"),
    (8, "a " * 400 + "only three words"), (9, " ".join(ITEM.split()[:12])), (9, "clean text"), (7, "clean text"), (None, "only three words"), (11, "z " * 100_000 + ITEM),
]


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(text):
    w, hit, items = words(text), set(), set()
    for item, body in ITEMS:
        b = words(body)
        n = min(13, len(b))
        grams = {tuple(b[k : k + n]) for k in range(len(b) - n + 1)} if n else set()
        for k in range(len(w) - n + 1):
            if grams and tuple(w[k : k + n]) in grams:
                hit |= set(range(k, k + n))
                items.add(str(item))
    named = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
    return len(w), len(hit), len(items), named, len(hit) > 0 and 20 * len(hit) >= len(w)


def test_matches_brute_force_with_either_join(spark):
    docs = spark.createDataFrame([(i, t, "n") for i, t in DOCS], "doc_id long, text string, n_words string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = sorted(((i, *brute(t)) for i, t in DOCS), key=repr)
    for most in (200_000, 0):
        rows = decontam.judged(docs, items, decontam.Settings(most_broadcast=most)).drop("text_hash").collect()
        assert sorted((tuple(r) for r in rows), key=repr) == want
    kept = decontam.clean_documents(docs, items)
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted(((i, t) for i, t in DOCS if not brute(t)[4]), key=repr)


def test_no_items_and_no_documents(spark):
    docs = spark.createDataFrame([(1, "some words here")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert tuple(decontam.judged(docs, none).drop("text_hash").first())[:4] == (1, 3, 0, 0)
    assert decontam.judged(docs.limit(0), spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0


def test_main_path_has_no_python(spark):
    docs = spark.createDataFrame([(1, "some words here")], "doc_id long, text string")
    plan = decontam.judged(docs, spark.createDataFrame(ITEMS, "item_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and "BroadcastHashJoin" in plan
