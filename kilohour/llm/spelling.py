"""Groups of spelling variants among the words of a corpus: asymmetric q-chunks, joined and verified.

One word of a pair, the shorter one, contributes two disjoint chunks, its halves; the other contributes positional grams of
the same sizes. A single edit falls into one half, so the other half is preserved: the first where it was, the second moved by
the difference of the lengths (-1, 0 or 1). Grams at other places can meet no preserved chunk and are not made. What is left
of the word beside the preserved half differs by the one edit, so the same holds there once more: of its two halves one
is preserved as well. A join key therefore names the length of the shorter word, a preserved half and a preserved half of the
rest; only about a quarter of the word is open, which bounds how many words share a key by the alphabet, not by the corpus.
Every pair that meets is verified by its edit distance. Counting, joining and following forms are Spark SQL throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilohour.llm.common import discard, stored

# What counts as a letter of a run, and the letters that are lower-cased.
RUN = "[a-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row (key, run) per maximal run of letters, A-Z lower-cased. Null and empty texts give none; repeated rows count."""
    found = F.regexp_extract_all(F.translate(docs[text], UPPER, LOWER), F.lit(RUN), F.lit(0))
    return docs.select(docs[key].alias("key"), F.explode(found).alias("run"))


def misspelt(found: DataFrame, one_in: int = 199) -> DataFrame:
    """(word) of each run: where ``one_in`` divides the crc32 of ``key:run`` one code point goes. A null key counts as ''."""
    hashed = F.crc32(F.concat(F.coalesce(F.col("key").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return found.withColumn("h", hashed).select(F.when(F.col("h") % one_in == 0, less).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, least_chars: int = 6, least_count: int = 5) -> DataFrame:
    """(word, n) of the distinct words long and frequent enough; null words do not count. Partial counts meet in the shuffle."""
    return words.where(F.length("word") >= least_chars).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def _keys(word: Column, length: Column) -> Column:
    """Keys of a word for pairs whose shorter word has ``length`` code points (the word's own, or one less).

    With the halves AB of the shorter word and their halves, what is preserved is A and the begin of B, A and the end of B,
    B and the begin of A, or B and the end of A: a prefix and a suffix of both words, of sizes that the length alone sets.
    """
    half = F.floor(length / 2).cast("int")
    inner, outer = F.floor((length - half) / 2).cast("int"), F.floor(half / 2).cast("int")
    none = F.lit(0)
    kept = [(half + inner, none), (half, length - half - inner), (outer, length - half), (none, length - outer)]
    size = F.length(word)
    hashes = [
        F.xxhash64(length, F.lit(i), F.substring(word, F.lit(1), p), F.substring(word, size - s + 1, s)) for i, (p, s) in enumerate(kept)
    ]
    return F.array(*hashes)


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n), both ways round, of words exactly one inserted, deleted or replaced code point apart.

    ``words`` holds distinct words (column word; column n is passed on); words under two code points pair with nothing.
    Equal keys alone decide who meets: nothing is paired that does not share about three quarters of its letters.
    """
    words = words.where(F.length("word") >= 2).select("word", "n")
    size = F.length("word")
    chunks = words.select("word", "n", F.explode(_keys(F.col("word"), size)).alias("_key"))
    grams = words.select("word", "n", F.explode(F.concat(_keys(F.col("word"), size), _keys(F.col("word"), size - 1))).alias("_key"))
    a, b = chunks.alias("a"), grams.alias("b")
    wa, wb = F.col("a.word"), F.col("b.word")
    ordered = ((F.length(wa) == F.length(wb)) & (wa < wb)) | (F.length(wa) + 1 == F.length(wb))
    near = F.levenshtein(wa, wb, 1) == 1
    met = a.join(b, (F.col("a._key") == F.col("b._key")) & ordered & near)
    once = met.select(wa.alias("word"), F.col("a.n").alias("n"), wb.alias("other"), F.col("b.n").alias("other_n")).distinct()
    both = F.array(F.struct("word", "n", "other", "other_n"), F.struct(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    return once.select(F.inline(both))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for every row of a table (word, form) without cycles: the last word that forms lead to.

    Each round a word takes the root of its root, so chains halve; rounds end when nothing moves.
    """
    links = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        jump = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = stored(links.join(jump, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        discard(links)
        links = after.select("word", "root")
        if after.where("moved").isEmpty():
            return links


def variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """Each word with its form and root.

    Columns: word, form, root, n, n_near, form_n. A word's form is its near word of largest n (ties: the smallest in
    code-point order) if that n is at least ``ratio`` times its own, else null; the root is where forms lead from the word,
    the word itself if nowhere. ``words`` is a table of distinct words with counts (``ratio`` must exceed 1, so that forms
    have no cycles); further columns are ignored. An empty table gives an empty table.
    """
    if ratio <= 1:
        raise ValueError("ratio must exceed 1")
    words = stored(words.select("word", "n"))
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("other")))
    near = near_pairs(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    found = words.join(near, "word", "left")
    count = -F.col("best.less")
    is_form = count >= ratio * F.col("n")
    found = stored(found.select(
        "word", F.when(is_form, F.col("best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, count).alias("form_n")
    ))
    discard(words)
    led = roots(found.where("form is not null"))
    return found.join(led, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
