import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from kilohour.llm import langid, toxicity
from kilohour.llm.common import held_out

pick = random.Random(11)
WORDS = {
    "en": "the and of that with this from have which their would there about other".split(),
    "de": "der und nicht ist mit eine auch werden können über zwischen größe".split(),
    "ru": "и не что это как его для был которые между после".split(),
}


def prose(lang, n):
    return " ".join(pick.choice(WORDS[lang]) + pick.choice(["", "", "s", "e"]) for _ in range(n))


def test_toxicity_learns_hidden_words_and_ignores_other_columns(spark):
    rows, labels = [], []
    for i in range(400):
        bad = i % 5 == 0
        words = prose("en", 40).split()
        if bad:
            words.insert(pick.randrange(len(words)), pick.choice(["vilefool", "nastyoaf"]))
        rows.append((i, " ".join(words), "en", 0.5, 7))
        # held-out labels are wrong on purpose: learning from them would show
        labels.append((i, 1, int(bad) if zlib.crc32(str(i).encode()) % 4 != 2 else int(not bad)))
    rows += [(1000, None, None, None, None), (1001, "", "en", 1.0, 1), (1002, "vilefool " * 30_000, "en", 1.0, 1), (None, "no id", "en", 1.0, 1), (1001, "", "en", 1.0, 1)]
    labels += [(5000, 1, 1), (None, 1, 1), (1, 1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, predicted int")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, marks)
    got = toxicity.score(docs.drop("score", "predicted"), model, ["doc_id", "lang"]).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    wrong = sum(r["predicted"] != int(r["doc_id"] % 5 == 0) for r in got if r["doc_id"] is not None and r["doc_id"] < 400)
    assert wrong <= 4
    by_id = {r["doc_id"]: r["predicted"] for r in got}
    assert by_id[1002] == 1 and by_id[1000] == by_id[1001] == by_id[None] == 0
    # against a plain scorer
    texts = {r[0]: r[1] for r in rows}
    weight = dict(zip(model.chosen.tolist(), model.weights.tolist(), strict=True))
    for r in got[:30]:
        low = f" {(texts[r['doc_id']] or '').lower()} "
        codes = [ord(c) for c in low]
        held = set()
        for n in model.settings.orders:
            for k in range(len(codes) - n + 1):
                h = 0
                for c in codes[k : k + n]:
                    h = (h * 0x100000001B3 + c) % (1 << 64)
                held.add(((h + n) * 0x9E3779B97F4A7C15 % (1 << 64)) >> (64 - model.settings.bits))
        total = model.intercept + sum(weight.get(b, 0.0) for b in held)
        assert abs(r["score"] - 1 / (1 + np.exp(-total))) < 1e-6


def test_toxicity_without_both_classes(spark):
    docs = spark.createDataFrame([(1, "text")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(docs, none)
    assert tuple(toxicity.score(docs, model, ["doc_id"]).first()) == (1, 0.0, 0)
    assert toxicity.score(docs.limit(0), model, ["doc_id", "text"]).count() == 0


def test_held_out_rule(spark):
    df = spark.range(200).select("id", held_out("id").alias("h"))
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 4 == 2) for r in df.collect())


def plain_viterbi(scores, penalty):
    value, back = list(scores[0]), []
    for row in scores[1:]:
        step = [max(range(len(row)), key=lambda k, j=j: (value[k] - (penalty if k != j else 0), k == j)) for j in range(len(row))]
        value = [value[step[j]] - (penalty if step[j] != j else 0) + row[j] for j in range(len(row))]
        back.append(step)
    path = [max(range(len(value)), key=value.__getitem__)]
    for step in reversed(back):
        path.append(step[path[-1]])
    return value, path[::-1]


def test_best_path_against_a_plain_viterbi():
    draw = np.random.default_rng(4)
    counts = [0, 5, 1, 40, 0, 17]
    scores = draw.normal(size=(sum(counts), 3)) * 3
    owner = np.repeat(np.arange(len(counts)), counts)
    got = langid.best_path(scores, owner, len(counts), 2.0)
    total = lambda s, p: sum(s[k][p[k]] for k in range(len(p))) - 2.0 * sum(a != b for a, b in zip(p, p[1:]))
    for i in range(len(counts)):
        mine = scores[owner == i].tolist()
        if mine:
            value, path = plain_viterbi(mine, 2.0)
            assert abs(total(mine, got[owner == i].tolist()) - max(value)) < 1e-9 and abs(total(mine, path) - max(value)) < 1e-9


def test_language_of_mixed_and_odd_texts(spark):
    rows = [(i, prose(lang, 30), lang) for i in range(300) for lang in [pick.choice(list(WORDS))]]
    odd = [(900, None, "en"), (901, "", None), (902, "123 !?", "de"), (903, prose("de", 40_000), "de"), (904, "日本", None), (None, prose("ru", 9), None), (902, "123 !?", "de")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert model.languages == ("de", "en", "ru")
    got = langid.predict(docs, model, ["doc_id", "lang"]).collect()
    assert len(got) == len(rows) + len(odd) and sum(r["lang"] == r["lang_pred"] for r in got if r["doc_id"] is not None and r["doc_id"] < 300) >= 297
    by_id = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got}
    assert by_id[900] == by_id[901] == by_id[902] == ("und", 0.0) and by_id[903][0] == "de" and by_id[None][0] == "ru" and by_id[904][0] in model.languages
    parts = [prose("en", 20), prose("ru", 15), prose("de", 25)]
    mixed = spark.createDataFrame([(1, ". ".join(parts), 0)], "doc_id long, text string, begin int")
    spans = langid.spans(mixed, model, ["doc_id"]).orderBy("begin").collect()
    assert [s["span_lang"] for s in spans] == ["en", "ru", "de"]
    assert abs(spans[1]["begin"] - len(parts[0]) - 2) < 12 and spans[-1]["end"] == len(". ".join(parts))
    assert langid.predict(docs.limit(0), model, ["doc_id"]).count() == 0
    empty = langid.fit(docs.where("lang is null"))
    assert langid.predict(docs.where(F.col("doc_id") == 1), empty, ["doc_id"]).first()["lang_pred"] == "und"


def test_texts_without_letters_have_no_language(spark):
    """Marks, symbols and keycaps are no letters; a mark counts only behind a letter."""
    train = [(i, prose(lang, 20), lang) for i, lang in enumerate(["de", "en", "ru"] * 20)]
    model = langid.fit(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    none = ["❤️", "́", "1️⃣", " ̀́ . ⃝", "👍🏽", "̀ 1́"]
    some = ["á", "́a", "1́ b"]
    df = spark.createDataFrame(list(enumerate(none + some)), "doc_id long, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(df, model, ["doc_id"]).collect()}
    assert all(got[i] == ("und", 0.0) for i in range(len(none))) and all(got[i][0] != "und" for i in range(len(none), len(got)))
    assert langid.in_words(np.array([ord(c) for c in "́á́b 1́c"], np.uint32)).tolist() == [False, True, True, True, True, False, False, False, True]
    assert len({langid.script_of()[ord(c)] for c in "કಕമසខලကདአᏣ"}) >= 9


def test_every_language_is_learned(spark):
    """300 language tags, each with words of its own: none is dropped, and the table stays within its bytes."""
    tags = [f"x{i:03d}" for i in range(300)]
    word = {t: "".join(chr(97 + (i * 7 + k * (3 + i % 23)) % 26) for k in range(9)) for i, t in enumerate(tags)}
    rows = [(n * 300 + i, " ".join([word[t]] * 12), t) for i, t in enumerate(tags) for n in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    small = langid.Settings(table_bytes=1 << 24)
    model = langid.fit(docs, small)
    assert model.table.nbytes <= 1 << 24 and set(model.languages) <= set(tags)
    learned = {r["lang"] for r in docs.where(~held_out("doc_id")).select("lang").distinct().collect()}
    assert set(model.languages) == learned and len(learned) > 256
    got = langid.predict(docs, model, ["doc_id", "lang"]).collect()
    known = [r for r in got if r["lang"] in learned]
    assert sum(r["lang"] == r["lang_pred"] for r in known) > 0.95 * len(known)
