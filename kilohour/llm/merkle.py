"""Document fingerprints: a Merkle tree over sections, paragraphs and word runs, in DataFrame functions only.

Paragraphs are the lines of a text; a paragraph's leaves are runs of its code points. Where a run ends depends on its last
four code points, so lines without blanks are cut as well and an edit moves only the ends near it; a run has 64 code points
at most and starts anew with each paragraph. A leaf is a 48-bit hash of its run; a paragraph's digest is the hash of its
leaves and of its text, which keeps digests as strong as SHA-256; a section digests its paragraphs, the root its sections. A
section ends at a paragraph whose digest begins with 0 or 1 (one in eight), so an edit moves only the section borders near
it. The fingerprint is the tree as text: ``root:sections:paragraphs per section:paragraphs:runs per paragraph:runs``, lists
joined by dots.

Equal texts have equal fingerprints; equal roots mean equal texts. ``likeness`` is the share of nodes that both trees have,
each as often as the tree that has fewer of it: order tells in the digests above, number in the counts. Since equal nodes
stand over equal subtrees, counting them level by level gives what descending into differing branches alone would. Sections
and paragraphs weigh an eighth of a run each. ``changed_paragraphs`` visits only the sections whose digests differ.

Defined results: a null text is empty; empty texts are alike (1), an empty text and one with runs are not (0), nor are
different texts of line feeds alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kilohour.llm.common import stored

LONGEST = 64


def endings() -> list[tuple[set[int], set[int]]]:
    """For each of the last four code points of a run, the ASCII codes and the last UTF-8 bytes of others that it may have.

    Half of the ASCII codes, and of the bytes three quarters twice and half twice: runs have about 20 letters, or 10 of other scripts.
    """
    spread = lambda x, k: hashlib.sha256(b"%d,%d" % (x, k)).digest()[0]
    return [({x for x in range(128) if x != 10 and spread(x, k) < 128}, {x for x in range(128, 192) if spread(x, k) < (192 if k < 2 else 128)}) for k in range(4)]


def run_pattern() -> str:
    """A regular expression of a run, over the UTF-8 bytes of a text read as Latin-1."""
    listed = lambda codes: "[" + "".join(rf"\x{x:02x}" for x in sorted(codes)) + "]"
    other = r"[\x80-\xff][\x80-\xbf]{0,3}+"
    point = rf"(?:[\x00-\x09\x0b-\x7f]|{other})"
    end = "".join(rf"(?:{listed(a)}|[\xc0-\xff][\x80-\xbf]{{0,2}}{listed(b)}(?![\x80-\xbf]))" for a, b in endings())
    return rf"{point}{{0,{LONGEST - 4}}}?{end}|{point}{{1,{LONGEST}}}"


RUN = run_pattern()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fingerprint(text: Column) -> Column:
    """The tree of a text that is not null."""

    def leaves(lines: Column) -> Column:
        pieces = lambda p: F.regexp_extract_all(F.decode(p.cast("binary"), "ISO-8859-1"), F.lit(RUN), F.lit(0))
        runs = F.transform(lines, lambda p: F.transform(pieces(p), lambda r: F.substring(F.base64(F.unhex(F.lpad(F.hex(F.xxhash64(r)), 16, "0"))), 1, 8)))
        return let(runs, lambda r: paragraphs(lines, r))

    def paragraphs(lines: Column, runs: Column) -> Column:
        digests = F.zip_with(lines, runs, lambda p, r: F.sha2(F.concat(F.array_join(r, ""), F.lit("\n"), p), 256))
        return let(digests, lambda d: tree(d, runs))

    def tree(digests: Column, runs: Column) -> Column:
        last = F.size(digests)
        ends = F.filter(
            F.sequence(F.lit(1), last), lambda i: (F.substring(F.get(digests, i - 1), 1, 1).isin("0", "1")) | (i == last)
        )
        return let(ends, lambda e: sections(digests, runs, e))

    def sections(digests: Column, runs: Column, ends: Column) -> Column:
        begin = lambda k: F.coalesce(F.get(ends, k - 1), F.lit(0))
        parts = F.transform(ends, lambda end, k: F.sha2(F.array_join(F.slice(digests, begin(k) + 1, end - begin(k)), ""), 256))
        sizes = F.transform(ends, lambda end, k: (end - begin(k)).cast("string"))
        return let(
            parts,
            lambda s: F.concat_ws(
                ":",
                F.sha2(F.array_join(s, ""), 256),
                F.array_join(F.transform(s, lambda x: F.substring(x, 1, 16)), "."),
                F.array_join(sizes, "."),
                F.array_join(F.transform(digests, lambda x: F.substring(x, 1, 12)), "."),
                F.array_join(F.transform(runs, lambda r: F.size(r).cast("string")), "."),
                F.array_join(F.flatten(runs), "."),
            ),
        )

    return let(F.split(text, "\n"), leaves)


def level(print_: Column, number: int) -> Column:
    """The list at a place of a fingerprint; an empty one has no elements."""
    part = F.split_part(print_, F.lit(":"), F.lit(number))
    return let(part, lambda p: F.when(p == "", F.array().cast("array<string>")).otherwise(F.split(p, r"\.")))


def common(one: Column, two: Column) -> Column:
    """How many elements two arrays share, repeated ones as often as both have them: where both have some, one merge of both, sorted."""

    def merge(a: Column, b: Column) -> Column:
        def step(state: Column, _: Column) -> Column:
            x, y = F.get(a, state["i"]), F.get(b, state["j"])
            move = lambda i, j, n: F.struct((state["i"] + i).alias("i"), (state["j"] + j).alias("j"), (state["n"] + n).alias("n"))
            return F.when(x < y, move(1, 0, 0)).when(x > y, move(0, 1, 0)).when(x == y, move(1, 1, 1)).otherwise(state)  # one is at its end

        zero = F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("n"))
        return F.aggregate(F.sequence(F.lit(1), F.size(a) + F.size(b)), zero, step, lambda state: state["n"])

    distinct = (F.size(F.array_distinct(one)) == F.size(one)) | (F.size(F.array_distinct(two)) == F.size(two))
    merged = let(F.sort_array(one), lambda a: let(F.sort_array(two), lambda b: merge(a, b)))
    return F.when(distinct, F.size(F.array_intersect(one, two))).otherwise(merged)


def likeness(one: Column, two: Column) -> Column:
    """From 0 to 1, from two fingerprints alone."""
    inner = lambda x: F.concat(level(x, 2), level(x, 4))
    runs = lambda x: level(x, 6)

    def of_runs(a: Column) -> Column:
        return let(runs(two), lambda b: F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(let(inner(one), lambda c: let(inner(two), lambda d: share(a, b, c, d)))))

    def share(a: Column, b: Column, c: Column, d: Column) -> Column:
        # the roots, which differ, are two further nodes
        return 2.0 * (common(a, b) + common(c, d) / 8) / (F.size(a) + F.size(b) + (F.size(c) + F.size(d) + 2) / 8)

    return F.when(F.split_part(one, F.lit(":"), F.lit(1)) == F.split_part(two, F.lit(":"), F.lit(1)), F.lit(1.0)).otherwise(let(runs(one), of_runs))


def changed_paragraphs(one: Column, two: Column) -> Column:
    """Numbers (from 0) of paragraphs of the first tree that the second does not have: only differing branches are entered."""

    def entered(sections: Column) -> Column:
        sizes = F.transform(level(one, 3), lambda s: s.cast("int"))
        other = level(two, 2)
        return let(sizes, lambda n: let(F.array_except(sections, other), lambda d: ranges(sections, n, d)))

    def ranges(sections: Column, sizes: Column, differing: Column) -> Column:
        start = lambda k: F.aggregate(F.slice(sizes, 1, k), F.lit(0), lambda a, b: a + b)
        numbers = F.transform(
            sections,
            lambda s, k: F.when(F.array_contains(differing, s), F.sequence(start(k), start(k) + F.get(sizes, k) - 1)).otherwise(F.array().cast("array<int>")),
        )
        mine, other = level(one, 4), level(two, 4)
        return F.filter(F.flatten(numbers), lambda i: ~F.array_contains(other, F.get(mine, i)))

    return let(level(one, 2), entered)


def neighbours(docs: DataFrame) -> DataFrame:
    """doc_id, wanted (a third of its longest text's length) and next_id: the next smaller id, after the smallest the largest.

    Ids are range-partitioned and stored with their part; inside a part the neighbour is one row away, and only the
    first row of a part asks the table of part bounds, which has one row per part.
    """
    ids = docs.where("doc_id is not null").groupBy("doc_id").agg(F.floor(F.max(F.length("text")) / 3).cast("int").alias("wanted"))
    placed = stored(ids.repartitionByRange("doc_id").withColumn("part", F.spark_partition_id()))
    bounds = placed.groupBy("part").agg(F.max("doc_id").alias("top"))
    below = bounds.select(
        "part", F.coalesce(F.lag("top").over(Window.orderBy("part")), F.max("top").over(Window.partitionBy(F.lit(1)))).alias("below")
    )
    inside = placed.withColumn("next_id", F.lag("doc_id").over(Window.partitionBy("part").orderBy("doc_id")))
    return inside.join(below, "part").select("doc_id", "wanted", F.coalesce("next_id", "below").alias("next_id"))


def edited_pairs(docs: DataFrame) -> DataFrame:
    """doc_id, text, edited text and the fingerprint of the next document (see ``compare``), a row per row.

    Texts are shuffled by doc_id once and read twice: as the next document they send the wanted prefix and their
    fingerprint, as the document itself they receive them. Of rows that share the next id the smallest text is taken.
    A row without doc_id has no next document and keeps its text.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    next_of = stored(neighbours(rows))
    repeated = rows.where("doc_id is not null").select("doc_id").groupBy("doc_id").count().where("count > 1")
    asked = next_of.select(F.col("next_id").alias("doc_id"), F.col("doc_id").alias("target"), "wanted")
    known = rows.where("doc_id is not null")  # the same exchange for both joins
    sources = known.join(asked.hint("shuffle_hash"), "doc_id")
    if not repeated.isEmpty():
        sources = sources.groupBy("target").agg(F.min("text").alias("text"), F.max("wanted").alias("wanted"))
    sent = sources.select(
        F.col("target").alias("doc_id"), F.substring(F.col("text"), F.lit(1), F.col("wanted")).alias("prefix"), fingerprint(F.col("text")).alias("next_fingerprint")
    )
    met = known.join(sent.hint("shuffle_hash"), "doc_id", "left")
    met = met.unionByName(rows.where("doc_id is null"), allowMissingColumns=True)
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(F.col("prefix"), F.lit(1), third))
    return met.select("doc_id", "text", F.coalesce(edited, "text").alias("edited"), "next_fingerprint")


def compare(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and likenesses to the edited text and to the next document."""
    rows = edited_pairs(docs).select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("text")).alias("fingerprint"),
        fingerprint(F.col("edited")).alias("edited_fingerprint"),
        "next_fingerprint",
    )
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        F.coalesce(likeness(F.col("fingerprint"), F.col("next_fingerprint")), F.lit(0.0)).alias("near_next"),
    )
