import base64
import hashlib
import random

import public_tokenizers
import regex
import tiktoken

from kilohour.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TEXTS = [
    None, "", " ", "\n\n  x", "it's we've 'll d'd !'s  's", "a" * 50_000, " " * 3000 + "end", "日本語テキスト 中文", "😀👍🏽 é", "١٢٣ ½ x²", "\x1c\x1d\x85　x",
    "<unk> </s> ▁", "The quick brown fox. " * 2000, "\x00\x01", "tab\tand\r\nline\n", "The quick brown fox. " * 2000,
]


def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_matches_tiktoken_on_random_texts():
    coder, want = bpe.ByteBpe(bpe.read_ranks(PATH), public_tokenizers.PATTERN), reference()
    pick = random.Random(5)
    alphabet = ["a", "Zq", " ", "  ", "\n", "'s", "'", "'ve", "é", "ß", "中", "😀", "́", "1", "½", "!", "​", " ", "\x1c", "\x85"]
    for _ in range(200):
        texts = ["".join(pick.choice(alphabet) for _ in range(pick.choice([0, 1, 3, 25]))) for _ in range(pick.randint(1, 6))]
        assert [x.tolist() for x in coder.encode_all(texts)] == [want.encode_ordinary(t) for t in texts]
        words, counts = coder.cut(texts)
        cut = [w.decode() for w in words.to_pylist()]
        assert cut == [w for t in texts for w in regex.findall(public_tokenizers.PATTERN, t)] and counts.sum() == len(cut)


def test_other_patterns_go_through_the_engine():
    coder = bpe.ByteBpe(bpe.read_ranks(PATH), r"\p{L}+|[^\p{L}]+")
    assert coder.decode(coder.encode("zwei Wörter, 3")) == "zwei Wörter, 3".encode()


def test_query_shape(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "no id", "y")], "doc_id long, text string, n_tokens string")
    want = reference()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    got = {r["doc_id"]: r for r in bpe.digests(df, PATH, public_tokenizers.PATTERN).collect()}
    for i, text in enumerate(TEXTS):
        ids = want.encode_ordinary(text or "")
        assert tuple(got[i])[1:] == (len(ids), sha(",".join(map(str, ids)).encode()), sha((text or "").encode()))
    coded = bpe.encode_texts(df, PATH, public_tokenizers.PATTERN, keep=["doc_id", "n_tokens"]).collect()
    assert {r["doc_id"]: list(r["ids"]) for r in coded}[3] == want.encode_ordinary(TEXTS[3]) and len(coded) == len(TEXTS) + 1
    assert bpe.digests(df.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
