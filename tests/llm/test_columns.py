"""Columns of the documents that bear the names operators make or use inside."""

from kilohour.llm import decontam, langid, line_dedup, toxicity
from kilohour.llm.common import free, quoted, unmade

INSIDE = ["_drops", "_id", "_hash", "n_words", "copies", "words", "key", "a.b", "tick`s"]
MADE = ["N_Lines", "n_dropped", "kept_text", "score", "predicted", "lang_pred", "begin", "END"]


def documents(spark, names):
    schema = "doc_id long, text string, " + ", ".join(f"{quoted(c)} string" for c in names)
    texts = ["one line of text", "one line of text", None, "the other line here and more of it"]
    return spark.createDataFrame([(i, t, *(f"{c}{i}" for c in names)) for i, t in enumerate(texts)], schema)


def test_names():
    assert unmade(["a", "Score", "score_"], ["score"]) == ["a", "score_"]
    assert free("_id", ["_ID", "_id_"]) == "_id__" and free("_id", ["x"]) == "_id"
    assert quoted("a`b") == "`a``b`"


def test_line_dedup(spark):
    docs = documents(spark, INSIDE + MADE)
    rows = {r["doc_id"]: r for r in line_dedup.drop_lines(docs, line_dedup.indexed(docs.select("doc_id", "text"))).collect()}
    assert [(rows[i]["n_lines"], rows[i]["n_dropped"]) for i in range(4)] == [(1, 0), (1, 1), (1, 0), (1, 0)]
    assert rows[0]["kept_text"] == "one line of text" and rows[1]["kept_text"] == "" and rows[2]["text"] is None
    for i in range(4):
        assert all(rows[i][c] == f"{c}{i}" for c in INSIDE + ["score", "predicted", "begin"])
        assert "N_Lines" not in rows[i].asDict()


def test_decontamination(spark):
    docs = documents(spark, INSIDE + MADE)
    items = spark.createDataFrame([(1, "one line of text")], "item_id long, text string")
    out = decontam.clean_documents(docs, items)
    assert out.columns == docs.columns
    assert {tuple(r) for r in out.collect()} == {tuple(r) for r in docs.where("doc_id >= 2").collect()}


def test_classifiers(spark):
    docs = documents(spark, INSIDE + MADE)
    labels = spark.createDataFrame([(0, 1), (1, 0), (3, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs.select("doc_id", "text"), labels)
    out = toxicity.score(docs, model, docs.columns)
    assert [c.lower() for c in out.columns].count("score") == 1 and dict(out.dtypes)["score"] == "double"
    assert all(r[c] == f"{c}{r['doc_id']}" for r in out.collect() for c in INSIDE + ["lang_pred", "begin"])
    speech = langid.fit(docs.select("doc_id", "text").selectExpr("*", "'en' AS lang"))
    out = langid.predict(docs, speech, docs.columns)
    assert dict(out.dtypes)["score"] == "double" and {r["doc_id"]: r["lang_pred"] for r in out.collect()}[2] == "und"
    assert all(r[c] == f"{c}{r['doc_id']}" for r in out.collect() for c in [*INSIDE, "predicted", "END"])
    out = langid.spans(docs, speech, docs.columns)
    assert dict(out.dtypes)["end"] == "bigint" and "END" not in out.columns and out.where("doc_id = 2").count() == 0
