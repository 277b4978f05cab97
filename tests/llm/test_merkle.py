import base64
import hashlib
import random
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from kilohour.llm import merkle

PARAGRAPHS = [f"Paragraph number {i} has several words in it, {i * i}." for i in range(60)]
ROWS = [(10, "\n".join(PARAGRAPHS)), (7, None), (3, "ab"), (8, "äöü one two three\nfour"), (2, ""), (20, "z" * 100_000), (4, "äöü one two three\nfour")]


def test_edits_and_tree(spark):
    got = {r["doc_id"]: r for r in merkle.compare(spark.createDataFrame(ROWS, "doc_id long, text string")).collect()}
    ids = sorted(dict(ROWS), reverse=True)
    for k, i in enumerate(ids):
        text, after = dict(ROWS)[i] or "", dict(ROWS)[ids[(k + 1) % len(ids)]] or ""
        n = len(text) // 3
        edited = text[: len(text) - n] + after[:n]
        assert got[i]["n_chars"] == len(text)
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert (got[i]["fingerprint"] == got[i]["edited_fingerprint"]) == (edited == text)
        assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
    assert got[8]["fingerprint"] == got[4]["fingerprint"] and got[7]["fingerprint"] == got[2]["fingerprint"]
    assert got[7]["near_edited"] == 1.0 and 0.5 < got[10]["near_edited"] < 0.9 and got[10]["near_next"] < 0.1


def test_changed_paragraphs_and_likeness(spark):
    changed = [*PARAGRAPHS]
    changed[17], changed[40] = "another text here altogether", ""
    df = spark.createDataFrame([("\n".join(PARAGRAPHS), "\n".join(changed))], "a string, b string")
    df = df.select(merkle.fingerprint(F.col("a")).alias("a"), merkle.fingerprint(F.col("b")).alias("b"))
    row = df.select(merkle.changed_paragraphs(F.col("a"), F.col("b")), merkle.changed_paragraphs(F.col("a"), F.col("a")), merkle.likeness(F.col("a"), F.col("b"))).first()
    assert list(row[0]) == [17, 40] and list(row[1]) == [] and 0.9 < row[2] < 1


def test_repeated_ids_null_id_and_empty_table(spark):
    schema = "doc_id long, text string, fingerprint string"
    df = spark.createDataFrame([(1, "aaa bbb", "c"), (1, "ccc", "c"), (2, "dd dd dd", "c"), (2, "dd dd dd", "c"), (None, "xyz", "c")], schema)
    got = sorted((r["doc_id"] or 0, r["n_chars"]) for r in merkle.compare(df).collect())
    assert got == [(0, 3), (1, 3), (1, 7), (2, 8), (2, 8)]
    assert merkle.compare(df.limit(0)).count() == 0


def leaves(line):
    """Runs of a line, point by point."""
    ends, out, run = merkle.endings(), [], ""
    fits = lambda c, k: ord(c) in ends[k][0] if c < "\x80" else c.encode()[-1] in ends[k][1]
    for c in line:
        run += c
        if len(run) == merkle.LONGEST or len(run) >= 4 and all(fits(x, k) for k, x in enumerate(run[-4:])):
            out.append(run)
            run = ""
    return out + [run] if run else out


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(text):
    """The fingerprint, node by node."""
    short = lambda r: base64.b64encode(xxhash.xxh64(r.encode().decode("latin-1").encode(), seed=42).digest())[:8].decode()
    lines = text.split("\n")
    runs = [[short(r) for r in leaves(line)] for line in lines]
    digests = [sha("".join(r) + "\n" + line) for r, line in zip(runs, lines, strict=True)]
    sections = [[]]
    for k, d in enumerate(digests):
        sections[-1].append(d)
        if d[0] in "01" and k + 1 < len(digests):
            sections.append([])
    tops = [sha("".join(x)) for x in sections]
    parts = (t[:16] for t in tops), (str(len(x)) for x in sections), (d[:12] for d in digests), (str(len(r)) for r in runs), (x for r in runs for x in r)
    return ":".join([sha("".join(tops)), *(".".join(x) for x in parts)])


def alike(one, two):
    a, b = ([[x for x in part.split(".") if x] for part in plain(t).split(":")] for t in (one, two))
    if one == two:
        return 1.0
    if not a[5] or not b[5]:
        return 0.0
    met = lambda k: sum((Counter(a[k]) & Counter(b[k])).values())
    return 2 * (met(5) + (met(1) + met(3)) / 8) / (len(a[5]) + len(b[5]) + sum(len(x[k]) for x in (a, b) for k in (0, 1, 3)) / 8)


def test_digests_and_likeness_against_a_plain_tree(spark):
    pick = random.Random(8)
    lines = ["".join(pick.choice("abcdefgh éß世界") for _ in range(pick.randrange(90))) for _ in range(80)]
    text = "\n".join(lines)
    pairs = [(text, text), (text, "\n".join(lines[::-1])), (text, "\n".join([text] * 50)), (text, "\n".join(lines[:40])), (text, ""), ("", "\n\n"), ("\n", "\n\n\n"), ("", "")]
    pairs += [("\n".join(pick.choices(lines, k=30)), "\n".join(pick.choices(lines, k=30))) for _ in range(5)] + [("one line", "one line\n")]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", merkle.fingerprint(F.col("a")).alias("x"), merkle.fingerprint(F.col("b")).alias("y"))
    got = {(r["a"], r["b"]): r for r in df.withColumn("near", merkle.likeness(F.col("x"), F.col("y"))).collect()}
    for a, b in pairs:
        r = got[a, b]
        assert r["x"] == plain(a) and r["y"] == plain(b) and abs(r["near"] - alike(a, b)) < 1e-12
        assert (r["near"] == 1) == (a == b)
    assert got[pairs[1]]["near"] > 0.9 and got[pairs[2]]["near"] < 0.05 and 0.5 < got[pairs[3]]["near"] < 0.8 and got[pairs[4]]["near"] == 0


def test_likeness_against_a_plain_tree_on_unspaced_texts_and_inserts(spark):
    pick = random.Random(4)
    alphabets = ["".join(map(chr, range(0x4E00, 0x5E00))), "กขคงจฉชซญดตถทนบปผพฟมยรลวสหอะาิีุูเแโใไ", "あいうえおかきくけこさしすせそたちつてとなにぬねの", "ACGT", "0123456789abcdef", "😀😁😂🤣😃😄😅é~", "абвгдежзиклмнопрст"]
    texts = ["".join(pick.choice(a) for _ in range(900)) for a in alphabets] + [" ".join(pick.choice(["one", "other", "word", "little", "grid", "power"]) for _ in range(600))]
    got = {r["doc_id"]: r for r in merkle.compare(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        after, third = texts[i - 1], len(text) // 3
        assert abs(got[i]["near_edited"] - alike(text, text[: len(text) - third] + after[:third])) < 1e-12 and got[i]["near_edited"] > 0.4
        assert abs(got[i]["near_next"] - alike(text, after)) < 1e-12 and got[i]["near_next"] < 0.1
    inserted = [(t, "x" + t[:300] + "y" + t[300:]) for t in texts]
    df = spark.createDataFrame(inserted, "a string, b string").select("*", merkle.likeness(merkle.fingerprint(F.col("a")), merkle.fingerprint(F.col("b"))).alias("near"))
    assert all(r["near"] > 0.8 and abs(r["near"] - alike(r["a"], r["b"])) < 1e-12 for r in df.collect())
