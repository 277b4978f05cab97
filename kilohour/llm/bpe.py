"""Byte-level BPE through a sentencepiece model that is serialised straight from a rank file.

Every byte is mapped to one printable character, so a vocabulary entry becomes a piece of text. A piece's score is its
negative rank: the best scored merge is the one of lowest rank, which is the order byte-level BPE merges in. The model
normalises nothing, adds no prefix and escapes no white space. Pre-tokens are cut by the pattern and encoded one by one;
decoding looks pieces up and maps characters back to bytes. No training takes place.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import accumulate, chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from kilohour.llm.common import decoded, sized_batches

# First code point of the 256 characters that stand for bytes; they lie outside white space and sentencepiece's marker.
BYTE_BASE = 0x4E00
# Pre-tokens remembered per task; the memory is emptied when full, which changes nothing in the results.
REMEMBERED = 400_000


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by rank from a file of base64 and rank per line."""
    ranks = {}
    for line in Path(path).read_bytes().splitlines():
        if line.strip():
            token, rank = line.split()
            ranks[int(rank)] = base64.b64decode(token)
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks must run from 0 without gaps")
    return [ranks[i] for i in range(len(ranks))]


def mapped(token: bytes) -> str:
    return "".join(chr(BYTE_BASE + b) for b in token)


def unmapped(piece: str) -> bytes:
    return bytes(ord(c) - BYTE_BASE for c in piece)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _bytes(field: int, value: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(value)) + value


def _single(field: int, value: float) -> bytes:
    return _varint(field << 3 | 5) + struct.pack("<f", value)


def serialise_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece ModelProto with piece id = rank; the unknown piece comes after the last rank.

    Fields of the public protocol: pieces = 1 (piece 1, score 2, type 3), trainer_spec = 2 (model_type 3 with BPE = 2,
    vocab_size 4, unk_id 40, bos_id 41, eos_id 42, pad_id 43), normalizer_spec = 3 (name 1, add_dummy_prefix 3,
    remove_extra_whitespaces 4, escape_whitespaces 5).
    """
    none = (1 << 64) - 1  # -1 as a 64-bit varint: the piece is not defined
    out = [_bytes(1, _bytes(1, mapped(t).encode()) + _single(2, -float(rank)) + _number(3, 1)) for rank, t in enumerate(tokens)]
    out.append(_bytes(1, _bytes(1, b"<unk>") + _single(2, -float(len(tokens))) + _number(3, 2)))
    spec = _number(3, 2) + _number(4, len(tokens) + 1) + _number(40, len(tokens)) + b"".join(_number(f, none) for f in (41, 42, 43))
    out.append(_bytes(2, spec))
    out.append(_bytes(3, _bytes(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)))
    return b"".join(out)


# The code points with the White_Space property.
WHITE_SPACE = (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
# The pattern that public byte-level vocabularies cut text by, and the endings it splits off.
RUN_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
LETTER, NUMBER, OTHER, SPACE = range(4)


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Letter, number, white space or other, by code point."""
    of = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((of.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    out[list(WHITE_SPACE)] = SPACE
    return out


def run_starts(codes: np.ndarray, first: np.ndarray, kind: np.ndarray | None = None) -> np.ndarray:
    """Where the pre-tokens of RUN_PATTERN start, for texts laid end to end; ``first`` marks each text's first character.

    A token is a run of one class. A run of white space gives its last character up: to the next token if that is a
    blank, otherwise as a token of its own; at the end of a text it stays whole. An apostrophe that starts a token takes
    an ending with it, and the letters behind the ending start the next token. ``kind`` gives other character classes.
    """
    kind = classes()[codes] if kind is None else kind
    start = first.copy()
    start[1:] |= kind[1:] != kind[:-1]
    after = np.flatnonzero((kind[1:] != SPACE) & (kind[:-1] == SPACE) & ~first[1:]) + 1
    start[after - 1] = True
    start[after[codes[after - 1] == 0x20]] = False
    padded = np.concatenate([codes, np.zeros(3, codes.dtype)])
    ends = np.concatenate([first, np.ones(3, bool)])
    quotes = np.flatnonzero(start & (codes == 0x27))
    for ending in ENDINGS:
        fits = np.ones(len(quotes), bool)
        for k, letter in enumerate(ending, 1):
            fits &= (padded[quotes + k] == ord(letter)) & ~ends[quotes + k]
        at = quotes[fits]
        start[at + 1] = False
        behind = at + len(ending) + 1
        start[behind[behind < len(start)]] = True
    return start


class ByteBpe:
    """Encoder and decoder over one serialised model."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens = tokens
        self.by_runs = pattern == RUN_PATTERN
        self.find = regex.compile(pattern).findall
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(tokens))
        self.bytes_of = [unmapped(self.model.id_to_piece(i)) for i in range(len(tokens))]
        self.text_of = [str(i) for i in range(len(tokens))]
        self.known: dict[bytes, list[int]] = {}

    def cut(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """All pre-tokens in order, and how many each text has."""
        if not self.by_runs:
            words = [self.find(t) for t in texts]
            return pa.array([w.encode() for found in words for w in found], pa.binary()), np.array([len(w) for w in words], np.int64)
        data = "".join(texts)
        codes = np.frombuffer(data.encode("utf-32-le"), np.uint32)
        lengths = np.array([len(t) for t in texts], np.int64)
        if not len(codes):
            return pa.array([], pa.binary()), np.zeros(len(texts), np.int64)
        begin = np.concatenate([[0], np.cumsum(lengths)])
        first = np.zeros(len(codes), bool)
        first[begin[:-1][lengths > 0]] = True
        starts = run_starts(codes, first)
        width = 1 + (codes > 0x7F).astype(np.int8) + (codes > 0x7FF) + (codes > 0xFFFF)
        offset = np.concatenate([[0], np.cumsum(width, dtype=np.int64)])
        at = np.flatnonzero(starts)
        edges = np.append(offset[at], offset[-1]).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(edges), pa.py_buffer(data.encode("utf-8"))])
        running = np.concatenate([[0], np.cumsum(starts, dtype=np.int64)])
        return words, np.diff(running[begin])

    def look_up(self, words: list[bytes]) -> list[list[int]]:
        """Ids of distinct pre-tokens; those not met before go through the model together."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = [w for w in words if w not in self.known]
        if new:
            data = (np.frombuffer(b"".join(new), np.uint8).astype(np.uint32) + BYTE_BASE).tobytes().decode("utf-32-le")
            edges = [0, *accumulate(map(len, new))]
            pieces = [data[a:b] for a, b in zip(edges, edges[1:], strict=False)]
            self.known.update(zip(new, self.model.encode(pieces, num_threads=1), strict=True))
        return [self.known[w] for w in words]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        words, counts = self.cut(texts)
        coded = words.dictionary_encode()
        ids = self.look_up(coded.dictionary.to_pylist())
        sizes = np.array([len(x) for x in ids], np.int64)
        flat = np.array(list(chain.from_iterable(ids)), np.int32)
        where = coded.indices.to_numpy(zero_copy_only=False)
        each = sizes[where]
        total = np.concatenate([[0], np.cumsum(each)])
        begins = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        out = flat[np.repeat(begins[where] - total[:-1], each) + np.arange(total[-1])] if len(where) else flat
        edges = total[np.concatenate([[0], np.cumsum(counts)])]
        return [out[a:b] for a, b in zip(edges, edges[1:], strict=False)]

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def listed(self, ids: Iterable[int]) -> str:
        """Decimal ids joined by commas."""
        return ",".join(map(self.text_of.__getitem__, ids))


@lru_cache(maxsize=2)
def coder(rank_path: str, pattern: str) -> ByteBpe:
    """One coder per worker process."""
    return ByteBpe(read_ranks(rank_path), pattern)


def shipped(spark, rank_path: str) -> str:
    """Hand the rank file to all executors; returns the name to open it by."""
    spark.sparkContext.addFile(rank_path)
    return Path(rank_path).name


def encode_texts(df: DataFrame, rank_path: str, pattern: str, text: str = "text", keep: Iterable[str] = ()) -> DataFrame:
    """Token ids of every whole text, a row per row: the kept columns and ``ids array<int>``.

    Null and empty texts give no ids. Repeated rows stay. A kept column may have any name but ``ids``.
    """
    keep = list(keep)
    if "ids" in keep:
        raise ValueError("a kept column may not be named ids")
    name = shipped(df.sparkSession, rank_path)
    source = df.select(*keep, df[text].alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(SparkFiles.get(name), pattern)
        for batch in sized_batches(batches, "_text"):
            ids = bpe.encode_all(decoded(batch.column("_text")))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(ids, pa.list_(pa.int32()))], [*keep, "ids"])

    types = dict(source.dtypes)
    return source.mapInArrow(run, ", ".join([*(f"`{c}` {types[c]}" for c in keep), "ids array<int>"]))


def digests(df: DataFrame, rank_path: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Encode each text, decode its ids, and return counts and digests of both.

    Columns: the key, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256. Encoding and decoding share one
    pass so that ids are never shuffled or stored. Null texts count as empty.
    """
    name = shipped(df.sparkSession, rank_path)
    source = df.select(df[key].alias("_key"), df[text].alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(SparkFiles.get(name), pattern)
        for batch in sized_batches(batches, "_text"):
            counts, coded, back = [], [], []
            for ids in map(np.ndarray.tolist, bpe.encode_all(decoded(batch.column("_text")))):
                counts.append(len(ids))
                coded.append(hashlib.sha256(bpe.listed(ids).encode()).hexdigest())
                back.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("_key"), pa.array(counts, pa.int64()), pa.array(coded, pa.string()), pa.array(back, pa.string())],
                [key, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return source.mapInArrow(run, f"`{key}` {dict(source.dtypes)['_key']}, n_tokens long, ids_sha256 string, decoded_sha256 string")
