"""Byte-level BPE that encodes content-defined chunks once and repairs their joins.

A rolling hash over the last code points cuts each text into chunks, so texts that share a passage share most of its chunks.
Chunks that occur more than once are encoded once for the whole corpus: their texts meet under their digests, every occurrence
takes the ids from there. Texts without such a chunk stay where they are and are encoded chunk by chunk. A Bloom filter of the
repeated digests, of bounded size, tells the two apart; a false hit only sends a text along that would not have had to go.

A chunk's own pre-tokens need not be the text's: a word or a run of blanks may cross the join. At each join the text from the
last sure pre-token of the left chunk into the right one is cut and encoded again until both agree on where a pre-token
starts; from there on the right chunk's ids are the text's. Chunks that never agree are encoded as one. The result equals the
library's on the whole text. Pre-tokens follow the library's own character classes, and words go through its model.
"""

from __future__ import annotations

import hashlib
import json
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kilohour.llm.bpe import LETTER, NUMBER, OTHER, SPACE, run_starts, shipped
from kilohour.llm.common import decoded, discard, sized_batches, stored

# A pre-token is sure if so many code points behind its end are known; the endings after an apostrophe look two ahead.
LOOK = 3
# Words remembered per task; the memory is emptied when full, which changes nothing in the results.
REMEMBERED = 400_000
UNKNOWN = 255


@dataclass(frozen=True)
class Settings:
    """Chunks end where the hash of the last ``window`` code points has ``bits`` zero bits, but hold ``least`` to ``most``."""

    bits: int = 10
    window: int = 16
    least: int = 64
    most: int = 8192
    head: int = 32  # code points of the right chunk that a join looks at first
    block: int = 1 << 20  # code points that are encoded and joined at a time
    filter_bytes: int = 1 << 26  # most bytes of the broadcast filter


def _byte_letters() -> list[str]:
    """The character that stands for each byte: printable ones for themselves, the others from U+0100 on, in order."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


@dataclass
class Piece:
    """An encoded chunk: its text and ids, and where its pre-tokens begin, counted in tokens and in code points."""

    text: str
    ids: np.ndarray
    at_token: np.ndarray
    at_char: np.ndarray

    def sure(self) -> int:
        """Index of the last pre-token whose begin does not hang on what follows the chunk; -1 if none."""
        return int(np.searchsorted(self.at_char, len(self.text) - LOOK, "right")) - 1


@dataclass
class Run:
    """Chunks in a row. The first one's pre-tokens hold from code point ``start`` on; ``closed`` if the text ends with the last."""

    pieces: list[Piece]
    start: int = 0
    closed: bool = True
    out: list[np.ndarray] = field(default_factory=list)


class Codec:
    """The tokenizer of a file: pre-tokens of many chunks at once, ids of words, joins."""

    def __init__(self, path: str, settings: Settings):
        self.settings = settings
        library = Tokenizer.from_file(path)
        spec = json.loads(library.to_str())
        cutter, added = spec["pre_tokenizer"] or {}, spec["added_tokens"]
        plain = not any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized"))
        fits = cutter.get("type") == "ByteLevel" and not cutter["add_prefix_space"] and cutter["use_regex"]
        if not (fits and plain) or spec["normalizer"] or spec["model"]["type"] != "BPE" or (spec["decoder"] or {}).get("type") != "ByteLevel":
            raise ValueError("only byte-level BPE without a normalizer is read")
        self.model, self.cutter = library.model, library.pre_tokenizer
        letters = _byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        self.letters = str.maketrans({b: c for b, c in enumerate(letters)})
        self.added = {t["content"]: t["id"] for t in added}
        names = sorted(self.added, key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, names))) if names else None
        vocabulary = library.get_vocab(with_added_tokens=True)
        self.bytes_of = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_of[i] = token.encode() if token in self.added else bytes(byte_of[c] for c in token)
        self.text_of = [str(i) for i in range(len(self.bytes_of))]
        self.chars_of = np.array([sum(b & 0xC0 != 0x80 for b in t) for t in self.bytes_of], np.int64)
        self.id_type = "<u2" if len(self.bytes_of) <= 1 << 16 else "<u4"
        self.kinds = np.full(0x110000, UNKNOWN, np.uint8)
        self.known: dict[bytes, list[int]] = {}

    # chunks

    def segments(self, text: str) -> Iterator[tuple[str, bool]]:
        """The text between added tokens, and those (flagged); ids never join across their borders."""
        at = 0
        for found in self.special.finditer(text) if self.special else ():
            if found.start() > at:
                yield text[at : found.start()], False
            yield found.group(), True
            at = found.end()
        if at < len(text):
            yield text[at:], False

    def ends(self, text: str) -> Iterator[int]:
        """Where the chunks of a segment end. The hash is rolled over slabs, so a long text takes no more memory than they do."""
        s = self.settings
        slab, last = 1 << 20, 0
        for start in range(0, len(text), slab):
            before = max(0, start - s.window + 1)
            codes = np.frombuffer(text[before : start + slab].encode("utf-32-le"), np.uint32).astype(np.uint64)
            hashes = rolled(codes, s.window)[start - before :]
            for end in (np.flatnonzero(hashes >> np.uint64(64 - s.bits) == 0) + start + 1).tolist():
                while end - last > s.most:
                    last += s.most
                    yield last
                if end - last >= s.least:
                    last = end
                    yield end
        while len(text) - last > s.most:
            last += s.most
            yield last
        if last < len(text):
            yield len(text)

    def chunks(self, text: str) -> Iterator[tuple[str, bool]]:
        """Chunks in order, and whether each continues the one before."""
        for segment, special in self.segments(text):
            if special:
                yield segment, False
                continue
            last = 0
            for end in self.ends(segment):
                yield segment[last:end], last > 0
                last = end

    # ids

    def kind(self, codes: np.ndarray) -> np.ndarray:
        """Letter, number, white space or other, as the library's own cutter treats each code point."""
        found = self.kinds[codes]
        if (found == UNKNOWN).any():
            for code in np.unique(codes[found == UNKNOWN]).tolist():
                beside = [len(self.cutter.pre_tokenize_str(c + chr(code))) == 1 for c in "a1!"]
                self.kinds[code] = (LETTER, NUMBER, OTHER)[beside.index(True)] if any(beside) else SPACE
            found = self.kinds[codes]
        return found

    def cut(self, texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """All pre-tokens, where each begins in its text, and how many each text has."""
        data = "".join(texts)
        if not data:
            return pa.array([], pa.binary()), np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        codes = np.frombuffer(data.encode("utf-32-le"), np.uint32)
        lengths = np.array([len(t) for t in texts], np.int64)
        begin = np.concatenate([[0], np.cumsum(lengths)])
        first = np.zeros(len(codes), bool)
        first[begin[:-1][lengths > 0]] = True
        at = np.flatnonzero(run_starts(codes, first, self.kind(codes)))
        width = 1 + (codes > 0x7F).astype(np.int8) + (codes > 0x7FF) + (codes > 0xFFFF)
        offset = np.concatenate([[0], np.cumsum(width, dtype=np.int64)])
        edges = np.append(offset[at], offset[-1]).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(edges), pa.py_buffer(data.encode("utf-8"))])
        counts = np.diff(np.searchsorted(at, begin))
        return words, at - np.repeat(begin[:-1], counts), counts

    def look_up(self, words: list[bytes]) -> list[list[int]]:
        """Ids of words; those not met before go through the library's model."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        for w in words:
            if w not in known:
                known[w] = [t.id for t in self.model.tokenize(w.decode("latin-1").translate(self.letters))]
        return [known[w] for w in words]

    def encode(self, texts: list[str]) -> list[Piece]:
        """Each text as a chunk of its own; an added token by itself is that token."""
        words, at_char, counts = self.cut([t if t not in self.added else "" for t in texts])
        coded = words.dictionary_encode()
        ids = self.look_up(coded.dictionary.to_pylist())
        sizes = np.array([len(x) for x in ids], np.int64)
        flat = np.array(list(chain.from_iterable(ids)), np.int32)
        where = coded.indices.to_numpy(zero_copy_only=False)
        total = np.concatenate([[0], np.cumsum(sizes[where])])
        begins = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        tokens = flat[np.repeat(begins[where] - total[:-1], sizes[where]) + np.arange(total[-1])] if len(where) else flat
        edges = np.concatenate([[0], np.cumsum(counts)])
        zero, out = np.zeros(1, np.int64), []
        for text, a, b in zip(texts, edges.tolist(), edges[1:].tolist(), strict=False):
            if text in self.added:
                out.append(Piece(text, np.array([self.added[text]], np.int32), zero, zero))
            else:
                out.append(Piece(text, tokens[total[a] : total[b]], total[a:b] - total[a], at_char[a:b]))
        return out

    def packed(self, piece: Piece) -> tuple[bytes, bytes]:
        """Ids, and one bit per token that begins a pre-token."""
        starts = np.zeros(len(piece.ids), bool)
        starts[piece.at_token] = True
        return piece.ids.astype(self.id_type).tobytes(), np.packbits(starts).tobytes()

    def unpacked(self, ids: bytes, starts: bytes) -> Piece:
        """The piece again; byte-level ids give its text back exactly."""
        found = np.frombuffer(ids, self.id_type).astype(np.int32)
        at = np.flatnonzero(np.unpackbits(np.frombuffer(starts, np.uint8), count=len(found)))
        chars = np.concatenate([[0], np.cumsum(self.chars_of[found])])
        return Piece(b"".join(map(self.bytes_of.__getitem__, found.tolist())).decode("utf-8"), found, at, chars[at])

    # joins

    def resolve(self, runs: list[Run]) -> None:
        """Move the final ids of all runs to ``out``. Of an open run the last chunk stays, with where its pre-tokens hold."""
        todo = runs
        while todo:
            borders = [(run, i) for run in todo for i in range(len(run.pieces) - 1)]
            windows, tails = [], []
            for run, i in borders:
                left, right = run.pieces[i], run.pieces[i + 1]
                sure = left.sure()
                tail = left.text[left.at_char[sure] :] if sure >= 0 else left.text
                windows.append(tail + right.text[: self.settings.head])
                tails.append((sure, len(tail)))
            words, at_char, counts = self.cut(windows)
            edges = np.concatenate([[0], np.cumsum(counts)]).tolist()
            synced = {}
            for k, (run, i) in enumerate(borders):
                sure, tail = tails[k]
                right = run.pieces[i + 1]
                whole = run.closed and i + 2 == len(run.pieces) and len(right.text) <= self.settings.head
                most = len(right.text) if whole else min(len(right.text), self.settings.head) - LOOK
                own = right.at_char[: self.settings.head].tolist()
                found = None
                for j, p in enumerate(at_char[edges[k] : edges[k + 1]].tolist()):
                    if p >= tail and sure >= 0:
                        at = p - tail
                        if at > most:
                            break
                        here = bisect_left(own, at)
                        if here < len(own) and own[here] == at:
                            found = (sure, here, edges[k], edges[k] + j)
                            break
                synced[id(run), i] = found
            taken = [synced[id(run), i] for run, i in borders]
            spans = [range(x[2], x[3]) for x in taken if x]
            needed = words.take(pa.array(list(chain.from_iterable(spans)), pa.int64())).to_pylist() if spans else []
            ids, at = self.look_up(needed), 0
            between = {}
            for (run, i), x in zip(borders, taken, strict=True):
                if x:
                    n = x[3] - x[2]
                    between[id(run), i] = np.array(list(chain.from_iterable(ids[at : at + n])), np.int32)
                    at += n
            todo = [run for run in todo if not self._settle(run, synced, between)]

    def _settle(self, run: Run, synced: dict, between: dict) -> bool:
        """Take a run's ids if all its joins agree; otherwise encode the chunks that do not as one and say so."""
        pieces, start, parts = run.pieces, run.start, []
        loose, broken = [False] * len(pieces), False  # chunks to be one with the next
        for i, piece in enumerate(pieces[:-1]):
            found = synced[id(run), i]
            if found is None or (not broken and piece.at_char[found[0]] < start):
                loose[i] = broken = True
            if broken:  # the run is tried again; later joins only say whether they agree
                continue
            sure, here = found[:2]
            parts += [piece.ids[piece.at_token[np.searchsorted(piece.at_char, start)] : piece.at_token[sure]], between[id(run), i]]
            start = int(pieces[i + 1].at_char[here])
        if not broken:
            last = pieces[-1]
            run.out += parts
            if run.closed:
                first = int(np.searchsorted(last.at_char, start))
                run.out.append(last.ids[last.at_token[first] :] if first < len(last.at_token) else last.ids[:0])
                run.pieces = []
            else:
                run.pieces, run.start = [last], start
            return True
        groups: list[list[Piece]] = [[]]
        for piece, more in zip(pieces, loose, strict=True):
            groups[-1].append(piece)
            if not more:
                groups.append([])
        groups = [g for g in groups if g]
        fresh = iter(self.encode(["".join(p.text for p in g) for g in groups if len(g) > 1]))
        run.pieces = [next(fresh) if len(g) > 1 else g[0] for g in groups]
        return False


def rolled(codes: np.ndarray, window: int) -> np.ndarray:
    """Hash of the last ``window`` (a power of two) values at each position, by doubling the window."""
    base, hashes, n = np.uint64(0x9E3779B97F4A7C15), codes, 1
    with np.errstate(over="ignore"):
        while n < window:
            longer = hashes.copy()
            longer[n:] += hashes[:-n] * base
            hashes, base, n = longer, base * base, n * 2
        return hashes * np.uint64(0xD6E8FEB86659FD93)


def digest(text: str) -> tuple[int, int]:
    """128 bits of a text as two signed numbers."""
    both = hashlib.blake2b(text.encode(), digest_size=16).digest()
    return int.from_bytes(both[:8], "little", signed=True), int.from_bytes(both[8:], "little", signed=True)


class Gathered:
    """What becomes of a document's ids: counts and digests, or the ids and the decoded text themselves."""

    def __init__(self, codec: Codec, digests: bool):
        self.codec, self.digests = codec, digests
        self.n, self.ids, self.back = 0, hashlib.sha256(), hashlib.sha256()
        self.all: list[np.ndarray] = []

    def add(self, parts: Iterable[np.ndarray]) -> None:
        for part in parts:
            if not len(part):
                continue
            if self.digests:
                listed = part.tolist()
                self.ids.update((("," if self.n else "") + ",".join(map(self.codec.text_of.__getitem__, listed))).encode())
                self.back.update(b"".join(map(self.codec.bytes_of.__getitem__, listed)))
            else:
                self.all.append(part)
            self.n += len(part)

    def row(self) -> tuple:
        if self.digests:
            return self.n, self.ids.hexdigest(), self.back.hexdigest()
        ids = np.concatenate(self.all).tolist() if self.all else []
        return self.n, ids, b"".join(map(self.codec.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


class Joiner:
    """Joins the chunks of documents that come one after another, a block of code points at a time."""

    def __init__(self, codec: Codec, digests: bool):
        self.codec, self.digests = codec, digests
        self.runs: list[tuple[Gathered, Run]] = []
        self.done: list[tuple[object, Gathered]] = []
        self.open: tuple[object, Gathered] | None = None
        self.held = 0

    def begin(self, name: object) -> None:
        self.finish()
        self.open = name, Gathered(self.codec, self.digests)

    def add(self, piece: Piece, joined: bool) -> None:
        if not joined:
            self.close()
            self.runs.append((self.open[1], Run([], closed=False)))
        self.runs[-1][1].pieces.append(piece)
        self.held += len(piece.text)
        if self.held > self.codec.settings.block:
            self.flush()

    def close(self) -> None:
        if self.runs and not self.runs[-1][1].closed:
            self.runs[-1][1].closed = True

    def finish(self) -> None:
        """The document at hand has ended."""
        self.close()
        if self.open:
            self.done.append(self.open)
            self.open = None

    def flush(self) -> None:
        self.codec.resolve([run for _, run in self.runs])
        for gathered, run in self.runs:
            gathered.add(run.out)
            run.out = []
        self.runs = [x for x in self.runs if not x[1].closed]
        self.held = sum(len(p.text) for _, run in self.runs for p in run.pieces)

    def take(self) -> list[tuple[object, tuple]]:
        """Names and rows of documents that are complete."""
        self.flush()
        done, self.done = self.done, []
        return [(name, gathered.row()) for name, gathered in done]


@lru_cache(maxsize=2)
def codec(path: str, settings: Settings) -> Codec:
    """One codec per worker process."""
    return Codec(path, settings)


# The filter: slices by the first digest, four places in a slice from both.
SLICES, PLACES = 64, 4


def _places(d1: np.ndarray, d2: np.ndarray, bits: int) -> np.ndarray:
    a, b = d1.astype(np.uint64) // np.uint64(SLICES) | np.uint64(1), d2.astype(np.uint64)
    with np.errstate(over="ignore"):
        return np.stack([(b + a * np.uint64(j)) % np.uint64(bits) for j in range(PLACES)]).astype(np.int64)


def repeated_filter(repeated: DataFrame, most_bytes: int) -> np.ndarray:
    """Bits of a Bloom filter of (d1, d2), a row per slice, built in tasks; the driver gets ``most_bytes`` at most."""
    count = repeated.count()
    bits = 1 << max(10, (16 * count // SLICES).bit_length())
    bits = min(bits, most_bytes * 8 // SLICES)

    def build(found: pa.Table) -> pa.Table:
        d1, d2 = (found.column(c).to_numpy() for c in ("d1", "d2"))
        mine = np.zeros(bits, bool)
        mine[_places(d1.view(np.uint64), d2.view(np.uint64), bits).ravel()] = True
        return pa.table({"slice": [int(d1.view(np.uint64)[0] % SLICES)], "bits": [np.packbits(mine).tobytes()]})

    out = np.zeros((SLICES, bits // 8), np.uint8)
    slices = repeated.groupBy(F.pmod("d1", F.lit(SLICES)).alias("_slice")).applyInArrow(build, "slice long, bits binary")
    for row in slices.collect():
        out[row["slice"]] = np.frombuffer(row["bits"], np.uint8)
    return out


def may_hold(filter_bits: np.ndarray, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
    a, b = d1.view(np.uint64), d2.view(np.uint64)
    rows, out = (a % np.uint64(SLICES)).astype(np.int64), np.ones(len(a), bool)
    for place in _places(a, b, filter_bits.shape[1] * 8):
        out &= (filter_bits[rows, place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1).astype(bool)
    return out


def encoded(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", digests: bool = False, settings: Settings = Settings()) -> DataFrame:
    """Every text encoded by the tokenizer file and decoded again, a row per row.

    Columns: the key, n_tokens, then ids array<int> and decoded string, or with ``digests`` ids_sha256 (decimal ids joined by
    commas) and decoded_sha256. Added tokens inside a text are recognised, as the library does; none are put in. Null counts as
    empty: no ids. Repeated rows give a row each; keys may be null or repeated. Other columns of ``df`` play no part.
    """
    spark = df.sparkSession
    name = shipped(spark, path)
    source = df.select(df[key].alias("_key"), df[text].alias("_text"))
    kind = dict(source.dtypes)["_key"]
    block = settings.block

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(SparkFiles.get(name), settings)
        for batch in sized_batches(batches, "_text"):
            counts: dict[tuple[int, int], int] = {}
            for one in decoded(batch.column("_text")):
                for chunk, _ in own.chunks(one):
                    found = digest(chunk)
                    counts[found] = counts.get(found, 0) + 1
            columns = [[d[0] for d in counts], [d[1] for d in counts], list(counts.values())]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["d1", "d2", "n"])

    counted = source.select("_text").mapInArrow(occurrences, "d1 long, d2 long, n long")
    repeated = stored(counted.groupBy("d1", "d2").agg(F.sum("n").alias("n")).where("n > 1").select("d1", "d2"))
    known = spark.sparkContext.broadcast(repeated_filter(repeated, settings.filter_bytes))
    discard(repeated)
    out_types = ("string", "string") if digests else ("array<int>", "string")
    arrow = [pa.int64(), *((pa.string(), pa.string()) if digests else (pa.list_(pa.int32()), pa.string()))]
    names = ["n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded"))]
    result = f"_key {kind}, n_tokens long, {names[1]} {out_types[0]}, {names[2]} {out_types[1]}"
    chunk_fields = [("t1", pa.int64()), ("t2", pa.int64()), ("seq", pa.int64()), ("joined", pa.bool_()), ("d1", pa.int64()), ("d2", pa.int64()), ("chunk", pa.string())]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Results of texts that share no chunk, and the chunks of those that may."""
        own = codec(SparkFiles.get(name), settings)
        for batch in sized_batches(batches, "_text"):
            keys, texts = batch.column("_key"), decoded(batch.column("_text"))
            lists = [list(own.chunks(t)) or [("", False)] for t in texts]
            marks = np.array([digest(c) for chunks in lists for c, _ in chunks], np.int64).reshape(-1, 2)
            hit = may_hold(known.value, np.ascontiguousarray(marks[:, 0]), np.ascontiguousarray(marks[:, 1]))
            edges = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
            shares = np.add.reduceat(hit, edges[:-1]) > 0
            joiner, rows, at = Joiner(own, digests), [], []
            waiting: list[tuple[str, bool, int]] = []

            def encode() -> None:
                for (_, joined, i), piece in zip(waiting, own.encode([c for c, _, _ in waiting]), strict=True):  # noqa: B023
                    if not joiner.open or joiner.open[0] != i:  # noqa: B023
                        joiner.begin(i)  # noqa: B023
                    joiner.add(piece, joined)  # noqa: B023
                waiting.clear()  # noqa: B023

            held = 0
            for i in np.flatnonzero(~shares).tolist():
                for chunk, joined in lists[i]:
                    waiting.append((chunk, joined, i))
                    held += len(chunk)
                    if held > block:
                        encode()
                        held = 0
            encode()
            joiner.finish()
            done = joiner.take()
            at = pa.array([i for i, _ in done], pa.int64())
            fields = [pa.array([row[k] for _, row in done], t) for k, t in enumerate(arrow)]
            empty = [pa.nulls(len(done), t) for _, t in chunk_fields]
            yield pa.RecordBatch.from_arrays([keys.take(at), *fields, *empty], ["_key", *names, *(n for n, _ in chunk_fields)])
            for i in np.flatnonzero(shares).tolist():
                t1, t2 = digest(texts[i])
                spot = edges[i]
                rows += [(i, t1, t2, s, joined, *marks[spot + s].tolist(), c) for s, (c, joined) in enumerate(lists[i])]
            for start in range(0, len(rows), 4096):
                columns = list(zip(*rows[start : start + 4096], strict=True))
                some = [pa.array(c, t) for c, (_, t) in zip(columns[1:], chunk_fields, strict=True)]
                none = [pa.nulls(len(columns[0]), t) for t in arrow]
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(columns[0], pa.int64())), *none, *some], ["_key", *names, *(n for n, _ in chunk_fields)])

    passed = stored(source.mapInArrow(part, f"{result}, t1 long, t2 long, seq long, joined boolean, d1 long, d2 long, chunk string"))
    pieces = passed.where("seq is not null")
    once = pieces.groupBy("d1", "d2").agg(F.first("chunk").alias("chunk"))
    met = pieces.select("_key", "t1", "t2", "seq", "joined", "d1", "d2").join(once.hint("merge"), ["d1", "d2"])

    def encode_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Occurrences of a chunk come one after another; its ids are made once."""
        own = codec(SparkFiles.get(name), settings)
        last: dict[tuple[int, int], tuple[bytes, bytes]] = {}
        for batch in sized_batches(batches, "chunk"):
            marks = list(zip(batch.column("d1").to_pylist(), batch.column("d2").to_pylist(), strict=True))
            chunks = dict(zip(marks, batch.column("chunk").to_pylist(), strict=True))
            new = [m for m in chunks if m not in last]
            fresh = {m: own.packed(p) for m, p in zip(new, own.encode([chunks[m] for m in new]), strict=True)}
            found = [fresh.get(m) or last[m] for m in marks]
            last = {marks[-1]: found[-1]}
            both = [pa.array([f[k] for f in found], pa.binary()) for k in (0, 1)]
            kept = ["_key", "t1", "t2", "seq", "joined"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *both], [*kept, "ids", "starts"])

    coded = met.mapInArrow(encode_chunks, f"_key {kind}, t1 long, t2 long, seq long, joined boolean, ids binary, starts binary")
    order = ["_key", "t1", "t2"]

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents from their chunks in order; rows that repeat key and text repeat every chunk."""
        own = codec(SparkFiles.get(name), settings)
        joiner, copies, at, seen = Joiner(own, digests), {}, None, -1
        key_type = None

        def rows() -> pa.RecordBatch:
            done = [(n[0], row) for n, row in joiner.take() for _ in range(copies.pop(n))]
            fields = [pa.array([row[k] for _, row in done], t) for k, t in enumerate(arrow)]
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], key_type), *fields], ["_key", *names])

        for batch in sized_batches(batches, "ids"):
            key_type = batch.schema.field("_key").type
            columns = [batch.column(c).to_pylist() for c in ("_key", "t1", "t2", "seq", "joined", "ids", "starts")]
            for k, t1, t2, seq, joined, ids, starts in zip(*columns, strict=True):
                if (k, t1, t2) != at:
                    at, seen = (k, t1, t2), -1
                    copies[at] = 0
                    joiner.begin(at)
                copies[at] += seq == 0
                if seq > seen:
                    joiner.add(own.unpacked(ids, starts), joined)
                    seen = seq
            yield rows()
        joiner.finish()
        if key_type is not None:
            yield rows()

    together = coded.repartition(*order).sortWithinPartitions(*order, "seq").mapInArrow(assemble, result)
    alone = passed.where("seq is null").select("_key", *names)
    return alone.unionByName(together).withColumnRenamed("_key", key)
