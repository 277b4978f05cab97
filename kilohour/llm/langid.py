"""Language identification with spans: script ranges, per-word scores, and Viterbi with a switching penalty.

A word is a run of letters, with the marks that follow them, in lower case. The script of its first letter leaves the languages whose training
texts use that script. Per-word scores are sums of log-probabilities of the word's hashed character n-grams (1 to 4, with
a blank at either end). Viterbi over a text's words pays ``penalty`` for each change of language, so a run of words gets one
label and mixed texts fall into spans. A text's language is the one with the most letters.

Bounds, all parameters: the tables are learned from about ``max_per_language`` texts of each language, chosen by id hash;
``1 << bits`` buckets a language, fewer where all languages together would take more than ``table_bytes``. Every language
that occurs is learned. Labelling covers all rows and whole texts.

Defined results: null texts and texts without letters are ``und`` with score 0 and no spans; without training texts every
text is ``und``. Ties go to the language that sorts first.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilohour.llm.common import decoded, held_out, placed, quoted, sized_batches, unmade
from kilohour.llm.ngrams import buckets

# First and last code point of the ranges of scripts, in the order of the code charts.
SCRIPTS = (
    ("latin", 0x0041, 0x024F), ("greek", 0x0370, 0x03FF), ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F),
    ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x06FF), ("syriac", 0x0700, 0x074F), ("arabic", 0x0750, 0x077F),
    ("thaana", 0x0780, 0x07BF), ("nko", 0x07C0, 0x07FF), ("arabic", 0x08A0, 0x08FF), ("devanagari", 0x0900, 0x097F),
    ("bengali", 0x0980, 0x09FF), ("gurmukhi", 0x0A00, 0x0A7F), ("gujarati", 0x0A80, 0x0AFF), ("oriya", 0x0B00, 0x0B7F),
    ("tamil", 0x0B80, 0x0BFF), ("telugu", 0x0C00, 0x0C7F), ("kannada", 0x0C80, 0x0CFF), ("malayalam", 0x0D00, 0x0D7F),
    ("sinhala", 0x0D80, 0x0DFF), ("thai", 0x0E00, 0x0E7F), ("lao", 0x0E80, 0x0EFF), ("tibetan", 0x0F00, 0x0FFF),
    ("myanmar", 0x1000, 0x109F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF), ("ethiopic", 0x1200, 0x139F),
    ("cherokee", 0x13A0, 0x13FF), ("khmer", 0x1780, 0x17FF), ("mongolian", 0x1800, 0x18AF), ("georgian", 0x1C90, 0x1CBF),
    ("latin", 0x1E00, 0x1EFF), ("greek", 0x1F00, 0x1FFF), ("tifinagh", 0x2D30, 0x2D7F), ("ethiopic", 0x2D80, 0x2DDF),
    ("kana", 0x3040, 0x30FF), ("bopomofo", 0x3100, 0x312F), ("han", 0x3400, 0x9FFF), ("yi", 0xA000, 0xA4CF),
    ("arabic", 0xFB50, 0xFDFF), ("arabic", 0xFE70, 0xFEFF), ("hangul", 0xAC00, 0xD7AF), ("han", 0x20000, 0x3FFFF),
)
NAMES = ["other", *dict.fromkeys(s for s, _, _ in SCRIPTS)]
UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    orders: tuple[int, ...] = (1, 2, 3, 4)
    bits: int = 18
    max_per_language: int = 4000
    table_bytes: int = 1 << 28
    smoothing: float = 0.5
    penalty: float = 12.0
    least_script_share: float = 0.005
    beyond: float = 1e4


@dataclass(frozen=True)
class Model:
    """Log-probabilities (bucket, language), and which languages use which script."""

    settings: Settings
    languages: tuple[str, ...]
    table: np.ndarray
    scripts: np.ndarray


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """2 for a letter, 1 for a mark, else 0, by code point."""
    of = {"L": 2, "M": 1}
    return np.fromiter((of.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)), np.uint8, 0x110000)


def in_words(codes: np.ndarray) -> np.ndarray:
    """Which code points belong to words: letters, and marks behind a letter with nothing but marks and letters between."""
    kind = letters()[codes]
    so_far = np.cumsum(kind == 2)
    before = np.maximum.accumulate(np.where(kind == 0, so_far, 0))  # letters up to the last other code point
    return (kind > 0) & (so_far > before)


@lru_cache(maxsize=1)
def script_of() -> np.ndarray:
    out = np.zeros(0x110000, np.uint8)
    for name, first, last in SCRIPTS:
        out[first : last + 1] = NAMES.index(name)
    return out


@dataclass
class Words:
    """Words of several texts: owner, first and last + 1 code point in its text, and the n-grams of each."""

    owner: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    script: np.ndarray
    grams: list[tuple[np.ndarray, np.ndarray]]  # bucket and word number, a pair per order


def words_of(texts: list[str], settings: Settings) -> Words:
    # lower-casing that changes a text's length would move its spans: such characters stay as they are
    lower = [low if len(low := t.lower()) == len(t) else "".join(c if len(c.lower()) != 1 else c.lower() for c in t) for t in texts]
    codes = np.frombuffer((" " + " ".join(lower) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = 1 + np.concatenate([[0], np.cumsum([len(t) + 1 for t in lower])])[:-1]
    is_letter = in_words(codes)
    codes = np.where(is_letter, codes, np.uint32(32))
    edge = np.flatnonzero(is_letter[1:] != is_letter[:-1]) + 1
    first, last = edge[0::2], edge[1::2]
    owner = np.searchsorted(starts, first, side="right") - 1
    number = np.cumsum(np.isin(np.arange(len(codes)), first, kind="table") if len(first) else np.zeros(len(codes), int)) - 1
    # a word's n-grams start at the blank before it and end at the blank behind it
    within = is_letter.copy()
    within[first - 1] = True
    grams = []
    for n, bucket in buckets(codes, settings.orders, settings.bits):
        ok = is_letter[: len(bucket)] if n == 1 else within[: len(bucket)].copy()
        if n == 2:
            ok &= is_letter[: len(bucket)] | is_letter[1:]
        for k in range(1, n - 1):
            ok = ok & is_letter[k : k + len(bucket)]
        at = np.flatnonzero(ok)
        grams.append((bucket[at], number[at + (n > 1) * ~is_letter[at]]))
    return Words(owner, first - starts[owner] if len(first) else first, last - starts[owner] if len(first) else last, script_of()[codes[first]], grams)


def _sample(docs: DataFrame, settings: Settings) -> tuple[DataFrame, list[str]]:
    known = docs.select("doc_id", "lang", "text").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("doc_id"))
    sizes = known.groupBy("lang").count().collect()  # a row per language
    languages = sorted(r["lang"] for r in sizes)
    share = {r["lang"]: min(1.0, settings.max_per_language / r["count"]) for r in sizes}
    draw = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0))), F.lit(1_000_000)) / 1e6
    wanted = F.try_element_at(F.create_map(*[F.lit(x) for pair in share.items() for x in pair]), F.col("lang")) if share else F.lit(0.0)
    return known.where(draw < wanted).repartition(8, "doc_id").select("lang", "text"), languages


def fit(docs: DataFrame, settings: Settings | None = None) -> Model:
    """Learn from rows (doc_id, lang, text) that are not held out. Counts are summed by Spark, a row per language."""
    settings = settings or Settings()
    rows, languages = _sample(docs, settings)
    place = {lang: i for i, lang in enumerate(languages)}
    fits = settings.table_bytes // (4 * max(1, len(languages)))
    settings = replace(settings, bits=min(settings.bits, max(8, fits.bit_length() - 1)))
    size = 1 << settings.bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: dict[int, np.ndarray] = {}
        scripts: dict[int, np.ndarray] = {}
        for batch in sized_batches(batches, "text", 1 << 20):
            label = np.array([place[x] for x in batch.column("lang").to_pylist()], np.int64)
            words = words_of(decoded(batch.column("text")), settings)
            mine = label[words.owner]
            for i in np.unique(mine):
                table = grams.setdefault(int(i), np.zeros(size, np.int64))
                for bucket, number in words.grams:
                    table += np.bincount(bucket[mine[number] == i], minlength=size)
                seen = scripts.setdefault(int(i), np.zeros(len(NAMES), np.int64))
                seen += np.bincount(words.script[mine == i], minlength=len(NAMES))
        for i, table in grams.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([i]), pa.array([table.astype(np.int32).tobytes()]), pa.array([scripts[i].tobytes()])], ["lang", "grams", "scripts"]
            )

    def add(group: pd.DataFrame) -> pd.DataFrame:
        grams = sum(np.frombuffer(g, np.int32).astype(np.int64) for g in group["grams"])
        scripts = sum(np.frombuffer(s, np.int64) for s in group["scripts"])
        return pd.DataFrame({"lang": [group["lang"].iloc[0]], "grams": [grams.tobytes()], "scripts": [scripts.tobytes()]})

    made = rows.mapInArrow(count, "lang long, grams binary, scripts binary").groupBy("lang")
    parts = {r["lang"]: r for r in made.applyInPandas(add, "lang long, grams binary, scripts binary").collect()} if languages else {}
    if not parts:
        return Model(settings, (), np.zeros((size, 0), np.float32), np.zeros((len(NAMES), 0), bool))
    grams = np.stack([np.frombuffer(parts[i]["grams"], np.int64) if i in parts else np.zeros(size) for i in range(len(languages))], 1) + settings.smoothing
    scripts = np.stack([np.frombuffer(parts[i]["scripts"], np.int64) if i in parts else np.zeros(len(NAMES)) for i in range(len(languages))], 1)
    usual = scripts >= settings.least_script_share * np.maximum(1, scripts.sum(0, keepdims=True))
    usual &= scripts > 0
    usual[~usual.any(1)] = True  # a script that no language uses rules none out
    return Model(settings, tuple(languages), np.log(grams / grams.sum(0, keepdims=True)).astype(np.float32), usual)


def word_scores(words: Words, model: Model) -> np.ndarray:
    """Score of every word for every language."""
    total = np.zeros((len(words.owner), len(model.languages)))
    for bucket, number in words.grams:
        for i in range(len(model.languages)):
            total[:, i] += np.bincount(number, weights=model.table[bucket, i], minlength=len(total))
    total /= len(model.settings.orders)
    return np.where(model.scripts[words.script], total, total - model.settings.beyond)


def best_path(scores: np.ndarray, owner: np.ndarray, texts: int, penalty: float) -> np.ndarray:
    """Label of every word: the path of the largest sum of scores less the penalty per change, for all texts at once.

    Texts are walked side by side, the longest first, so that step t handles the t-th word of all texts that have one.
    """
    counts = np.bincount(owner, minlength=texts)
    order = np.argsort(-counts, kind="stable")
    begin = np.concatenate([[0], np.cumsum(counts)])[:-1][order]
    counts = counts[order]
    alive = np.searchsorted(-counts, -np.arange(1, (counts[0] if texts else 0) + 1), side="right")
    stays = np.ones(scores.shape, bool)
    before = np.zeros(len(scores), np.int16)
    value = np.zeros((0, scores.shape[1]))
    last = np.zeros((texts, scores.shape[1]))
    for t, n in enumerate(alive):
        at = begin[:n] + t
        if t == 0:
            value = scores[at]
        else:
            last[n : len(value)] = value[n:]
            value = value[:n]
            top = value.argmax(1)
            moved = value[np.arange(n), top] - penalty
            stay = value >= moved[:, None]
            value = np.where(stay, value, moved[:, None]) + scores[at]
            stays[at], before[at] = stay, top
    last[: len(value)] = value
    label = np.zeros(len(scores), np.int16)
    now = last.argmax(1)
    for t in range(len(alive) - 1, -1, -1):
        n = alive[t]
        at = begin[:n] + t
        label[at] = now[:n]
        if t:
            keep = stays[at, now[:n]]
            now[:n] = np.where(keep, now[:n], before[at])
    return label


def _labelled(texts: list[str], model: Model) -> tuple[Words, np.ndarray]:
    words = words_of(texts, model.settings)
    if not len(words.owner) or not model.languages:
        return words, np.zeros(0, np.int16)
    return words, best_path(word_scores(words, model), words.owner, len(texts), model.settings.penalty)


def predict(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """The kept columns with lang_pred, and score: the share of the text's letters that carry that label.

    Kept columns of these names are replaced.
    """
    given = docs.sparkSession.sparkContext.broadcast(model)  # buckets x languages
    keep = unmade(keep, ("lang_pred", "score"))
    given_columns = keep if text in keep else [*keep, text]
    source, body = docs.select(placed(given_columns)), f"c{given_columns.index(text)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = given.value
        names = np.array([*model.languages, UNKNOWN], object)
        for batch in sized_batches(batches, body, 2 << 20):
            n, width = batch.num_rows, max(1, len(model.languages))
            words, label = _labelled(decoded(batch.column(body)), model)
            size = (words.end - words.begin)[: len(label)]
            weight = np.bincount(words.owner[: len(label)] * width + label, weights=size, minlength=n * width).reshape(n, width)
            total = weight.sum(1)
            best = np.where(total > 0, weight.argmax(1), len(names) - 1)
            score = weight.max(1) / np.maximum(total, 1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array(names[best].tolist(), pa.string()), pa.array(score, pa.float64())], [*keep, "lang_pred", "score"]
            )

    types = dict(source.dtypes)
    return source.mapInArrow(run, ", ".join([*(f"{quoted(c)} {types[f'c{i}']}" for i, c in enumerate(keep)), "lang_pred string, score double"]))


def spans(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """A row per span of one language: the kept columns, begin and end (code points) and span_lang, which replace kept columns of these names."""
    given = docs.sparkSession.sparkContext.broadcast(model)
    keep = unmade(keep, ("begin", "end", "span_lang"))
    given_columns = keep if text in keep else [*keep, text]
    source, body = docs.select(placed(given_columns)), f"c{given_columns.index(text)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = given.value
        for batch in sized_batches(batches, body, 2 << 20):
            words, label = _labelled(decoded(batch.column(body)), model)
            owner = words.owner[: len(label)]
            first = np.flatnonzero(np.r_[True, (label[1:] != label[:-1]) | (owner[1:] != owner[:-1])]) if len(label) else np.zeros(0, int)
            final = np.r_[first[1:], len(label)][: len(first)] - 1
            rows = pa.array(owner[first], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(c.take(rows) for c in batch.columns[: len(keep)]), pa.array(words.begin[first], pa.int64()), pa.array(words.end[final], pa.int64()),
                 pa.array([model.languages[i] for i in label[first]], pa.string())],
                [*keep, "begin", "end", "span_lang"],
            )

    types = dict(source.dtypes)
    return source.mapInArrow(run, ", ".join([*(f"{quoted(c)} {types[f'c{i}']}" for i, c in enumerate(keep)), "begin long, end long, span_lang string"]))
