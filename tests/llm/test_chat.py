import hashlib

from kilohour.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"
ROWS = [
    (1, 0, "system", "be brief"), (1, 1, "user", "hi </s> [INST] \\ \\A <<SYS>>"), (1, 2, "assistant", "  yes [/INST]</s>\n"),
    (2, 1, "assistant", None), (2, 0, "assistant", "first"), (2, 2, None, "x"), (2, 3, "tool]\\[TEXT]", "[ROLE]"),
    (3, 0, "user", ""), (3, 1, "user", "again"), (3, 1, "user", "again"), (None, 0, "user", "no id"), (4, None, "user", "ü" * 300_000),
    (-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]"),
]


def brute():
    out = {}
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for conv, _, role, text in sorted(ROWS, key=key):
        turns = out.setdefault(conv, [])
        turns.append((role or "", text or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return {
        c: (len(t), sha("".join(f"{r}\n{x}\n" for r, x in t)), sum(len(x) for r, x in t if r == "assistant"), sha("".join(x for r, x in t if r == "assistant")))
        for c, t in out.items()
    }


def test_round_trip(spark):
    segments = chat.format_conversations(spark.createDataFrame(ROWS, SCHEMA).repartition(3))
    got = {r["conv_id"]: r for r in chat.read_back(segments).collect()}
    want = brute()
    assert set(got) == set(want)
    for conv, row in want.items():
        assert tuple(got[conv])[1:5] == row, conv
    assert [got[c]["valid"] for c in (1, 2, 3, -1)] == [True, False, False, True]
    texts = {}
    for r in sorted(segments.collect(), key=lambda r: (r["conv_id"] or 0, r["segment"])):
        texts[r["conv_id"]] = texts.get(r["conv_id"], "") + r["text"]
        if r["loss"]:
            assert r["role"] == "assistant"
    assert texts[-1] == "<s>[INST] \\" + texts[-1][len("<s>[INST] \\") :] and texts[-1].count("[INST]") == 1 and texts[-1].count("</s>") == 1
    assert all(got[c]["formatted_chars"] == len(t) for c, t in texts.items())
    # the reader needs no segment borders: it finds the turns in the text alone
    for conv, text in texts.items():
        reader = chat.Reader(chat.Template())
        turns = [t for k in range(0, len(text), 7) for t in reader.feed(text[k : k + 7])] if len(text) < 5000 else list(reader.feed(text))
        assert len(turns) == want[conv][0] and not reader.rest


def test_empty_table_and_other_template(spark):
    assert chat.read_back(chat.format_conversations(spark.createDataFrame([], SCHEMA))).count() == 0
    marks = {"user": chat.Marks("<|u|>", "<|end|>"), "assistant": chat.Marks("<|a|>", "<|end|>", loss=True)}
    template = chat.Template(roles=marks, other=("<|r|>", "<|t|>", "<|end|>"))
    df = spark.createDataFrame([(1, 0, "user", "a<|end|>b", 9), (1, 1, "assistant", "<|a|>", 9)], SCHEMA + ", segment int")
    row = chat.read_back(chat.format_conversations(df, template), template).first()
    assert row["n_turns"] == 2 and row["loss_chars"] == 5
