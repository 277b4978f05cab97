import hashlib
import os
import random

import numpy as np
import public_tokenizers
import pytest

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

from tokenizers import Tokenizer  # noqa: E402

from kilohour.llm import chunk_bpe  # noqa: E402
from kilohour.llm.chunk_bpe import Codec, Joiner, Run, Settings  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")
TINY = Settings(bits=2, window=4, least=1, most=9, head=6, block=40)
SMALL = Settings(bits=4, window=8, least=4, most=64, head=12, block=500)
ALPHABET = [
    "a", "Zq", " ", "  ", "\n", "'s", "'", "'ve", "'r", "e", "'l", "l", "é", "ß", "中", "😀", "́", "1", "½", "!", "​", "　", "\x1c", "\x85", "<|endoftext|>", "<|endof",
    "text|>", "Wort ", " the", "\t\t", "\U0001e5fa", "\U00010d40",
]
TEXTS = [
    None, "", " ", "\n\n  x", "it's we've 'll d'd !'s  's", "a" * 30_000, " " * 3000 + "end", "日本語テキスト 中文" * 300, "<|endoftext|>", "a<|endoftext|><|endoftext|> b",
    "The quick brown fox. " * 2000, "\x00\x01", "tab\tand\r\nline\n", "The quick brown fox. " * 2000, "x <|endoftext|>" + "Once upon a time. " * 400,
    "Once upon a time. " * 400 + "'" * 500 + "s" * 3 + " \n" * 900,
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def through_chunks(codec, text):
    """Ids of one text, each of its chunks encoded alone and packed, then joined."""
    joiner = Joiner(codec, False)
    joiner.begin("x")
    for chunk, joined in codec.chunks(text):
        joiner.add(codec.unpacked(*codec.packed(codec.encode([chunk])[0])), joined)
    joiner.finish()
    ((_, (n, ids, back)),) = joiner.take()
    assert n == len(ids)
    return ids, back


def test_joins_equal_the_whole_text_on_random_texts(library):
    pick = random.Random(6)
    codecs = [Codec(PATH, s) for s in (TINY, SMALL)]
    for _ in range(400):
        text = "".join(pick.choice(ALPHABET) for _ in range(pick.choice([0, 1, 3, 12, 60, 300])))
        want = library.encode(text, add_special_tokens=False).ids
        for codec in codecs:
            assert through_chunks(codec, text) == (want, library.decode(want, skip_special_tokens=False)), text


def test_every_cut_of_a_text_is_repaired(library):
    codec = Codec(PATH, SMALL)
    for text in ("it's  \n\n we've!!'re  12½x\t'll ", "   \n  'l'll aa''s ... 中文 '", "x" * 20 + " " * 9 + "y'"):
        want = library.encode(text, add_special_tokens=False).ids
        for a in range(1, len(text)):
            for b in range(a, len(text)):
                run = Run(codec.encode([t for t in (text[:a], text[a:b], text[b:]) if t]))
                codec.resolve([run])
                assert np.concatenate(run.out).tolist() == want, (text, a, b)


def test_chunks_depend_on_content_alone():
    codec = Codec(PATH, Settings(bits=6, window=8, least=16, most=400))
    pick = random.Random(2)
    passage = " ".join("".join(pick.choice("etaoinsr") for _ in range(pick.randint(2, 9))) for _ in range(900))
    one, two = ({c for c, _ in codec.chunks(t)} for t in (passage, "Another beginning. " + passage))
    assert "".join(c for c, _ in codec.chunks(passage)) == passage and len(one & two) > 0.9 * len(one) > 20
    assert max(len(c) for c, _ in codec.chunks("z" * 5000)) <= 400
    long = "".join(pick.choice("abc d") for _ in range((1 << 20) + 5000))
    slabs = [c for c, _ in codec.chunks(long)]
    assert "".join(slabs) == long and {c for c, _ in codec.chunks(long[1000:])} >= set(slabs[200:])


def test_character_classes_are_the_librarys(library):
    codec = Codec(PATH, SMALL)
    codes = [*range(0x20, 0x3000, 7), *range(0x10000, 0x1F000, 211), 0x85, 0xA0, 0x3000, 0x1C89, 0xA7CB]
    for code in codes:
        text = f"a{chr(code)}1{chr(code)} {chr(code)}!"
        words, _, _ = codec.cut([text])
        want = [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)]
        assert [w.decode() for w in words.to_pylist()] == want, hex(code)


def test_filter_has_no_false_misses(spark):
    pick = np.random.default_rng(1)
    held, other = (pick.integers(-(2**63), 2**63 - 1, (n, 2)) for n in (3000, 20_000))
    df = spark.createDataFrame([tuple(map(int, r)) for r in held], "d1 long, d2 long")
    bits = chunk_bpe.repeated_filter(df, 1 << 20)
    split = lambda a: (np.ascontiguousarray(a[:, 0]), np.ascontiguousarray(a[:, 1]))
    assert chunk_bpe.may_hold(bits, *split(held)).all() and chunk_bpe.may_hold(bits, *split(other)).mean() < 0.02
    tight = chunk_bpe.repeated_filter(df, 1 << 10)
    assert tight.nbytes <= 1 << 10 and chunk_bpe.may_hold(tight, *split(held)).all()
    assert not chunk_bpe.may_hold(chunk_bpe.repeated_filter(df.limit(0), 1 << 20), *split(other)).any()


def test_query_equals_the_library(spark, library):
    rows = [(i, t, "x", 3) for i, t in enumerate(TEXTS)] + [(None, "no id " * 40, "y", 1), (3, TEXTS[3], "x", 3), (10, TEXTS[10], "x", 3), (10, "other " * 50, "x", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    for settings in (Settings(), SMALL):
        got = [tuple(r) for r in chunk_bpe.encoded(df, PATH, digests=True, settings=settings).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    full = chunk_bpe.encoded(df, PATH, settings=SMALL)
    assert full.columns == ["doc_id", "n_tokens", "ids", "decoded"]
    assert sorted((r["decoded"] for r in full.collect())) == sorted(t or "" for _, t, *_ in rows)
    assert chunk_bpe.encoded(df.limit(0), PATH, digests=True).count() == 0


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        Codec(public_tokenizers.path("word_bpe_49k.json"), SMALL)
