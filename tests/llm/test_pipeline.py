import re

import corpus_pipeline as P
from pyspark.sql import functions as F
from kilohour.llm import bpe, decontam, line_dedup, minhash, toxicity
from kilohour.llm.common import stored, table
from test_minhash import corpus, shingles

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_keep_columns_and_take_effect(spark):
    docs = table(spark, SF, "documents")
    seen = [docs]
    for _, stage in P.STAGES[:-1]:
        seen.append(stored(stage(spark, seen[-1], SF)))
        assert seen[-1].columns == COLUMNS and seen[-1].schema == docs.select(COLUMNS).schema
    ids = [{r[0] for r in d.select("doc_id").collect()} for d in seen]
    scored = toxicity.score(seen[0], toxicity.fit(seen[0], table(spark, SF, "labels")), ["doc_id"])
    assert ids[1] == {r[0] for r in scored.where("predicted = 0").collect()}
    assert ids[2] == ids[1]
    want = {r["doc_id"]: r["kept_text"] for r in line_dedup.drop_lines(seen[1], line_dedup.indexed(seen[1])).collect()}
    assert {r["doc_id"]: r["text"] for r in seen[2].collect()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in seen[2].collect())
    assert ids[3] == {r["doc_id"] for r in minhash.near_duplicates(seen[2]).where("kept").collect()}
    bad = decontam.judged(seen[3], table(spark, SF, "benchmark")).where("contaminated")
    assert ids[4] == ids[3] - {r["doc_id"] for r in bad.collect()}
    last = P.STAGES[-1][1](spark, seen[-1], SF)
    assert {r["doc_id"] for r in last.collect()} == ids[4] and set(last.columns) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}


def test_stages_on_an_empty_table_and_nulls(spark):
    schema = table(spark, SF, "documents").select(COLUMNS).schema
    for rows in ([], [(1, None, None, None, None), (None, "x", None, None, None), (2, "", "en", "s", 0)]):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in P.STAGES:
            out = stage(spark, docs, SF)
            assert out.count() == len(rows)


def test_stages_keep_further_columns_of_any_name(spark):
    names = ["n_lines", "_drops", "kept_text", "_id", "_hash", "score", "predicted", "a b.c", "text_hash"]
    docs = table(spark, SF, "documents").limit(40)
    more = docs.select("*", *[F.concat(F.lit(f"{i}:"), F.col("doc_id").cast("string")).alias(n) for i, n in enumerate(names)])
    more = stored(more.select(*[F.col(f"`{c}`") for c in reversed(more.columns)]))
    plain = stored(docs)
    for _, stage in P.STAGES[:-1]:
        plain, more = stored(stage(spark, plain, SF)), stored(stage(spark, more, SF))
        assert more.columns == [*reversed(names), *reversed(COLUMNS)]
        assert sorted(map(tuple, more.select(COLUMNS).collect())) == sorted(map(tuple, plain.collect()))
        assert all(r[n] == f"{i}:{r['doc_id']}" for r in more.collect() for i, n in enumerate(names))


def test_near_dedup_stage_against_all_pairs_at_four_fifths(spark):
    words = [f"w{i}" for i in range(105)]
    near = [*words[:30], "x", *words[31:70], "y", *words[71:]]  # 91 of 111 shingles
    docs = list(enumerate([" ".join(words), " ".join(near), *corpus()]))
    sets = {i: shingles(t) for i, t in docs}
    label = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    rows = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], table(spark, SF, "documents").select(COLUMNS).schema)
    got = {r["doc_id"] for r in P.drop_near_copies(spark, rows, SF).collect()}
    assert 1 not in got and got == {i for i in sets if label[i] == i}


def test_entry_lists_one_query_per_operator():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(re.match(rf"op{n}_", q) for q in names) for n in range(1, 14))
    assert bpe.BYTE_BASE > 0
