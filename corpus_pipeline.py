"""A corpus pipeline over the documents table: score, deduplicate, decontaminate, tokenise."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kilohour.llm import bpe, decontam, line_dedup, minhash, toxicity
from kilohour.llm.common import discard, stored, table
from kilohour.session import configure

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
NEAR = minhash.Settings(percent=80)
REST = "_further_columns"

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keeping(stage: Stage) -> Stage:
    """The stage with any further columns of the documents, whatever their names, carried as one and given back.

    Columns of ``documents`` that are missing stay an error; without further columns nothing changes.
    """

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        more = [c for c in docs.columns if c not in COLUMNS]
        if not more:
            return stage(spark, docs.select(COLUMNS), sf_dir)
        # fields are named by place, since a name may need quoting in a schema
        packed = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(more)])
        out = stage(spark, docs.select(*COLUMNS, packed.alias(REST)), sf_dir)
        return out.select(*COLUMNS, *[F.col(REST)[f"c{i}"].alias(c) for i, c in enumerate(more)]).select(*[F.col(f"`{c}`") for c in docs.columns])

    run.__name__, run.__doc__ = stage.__name__, stage.__doc__
    return run


@keeping
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, docs.columns).where("predicted = 0").select(docs.columns)


@keeping
def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go; a null text stays null."""
    kept = line_dedup.drop_lines(docs, line_dedup.indexed(docs.select("doc_id", "text")))
    text = F.when(F.col("text").isNotNull(), F.col("kept_text"))
    now = {"text": text.alias("text"), "n_chars": F.length(text).cast("long").alias("n_chars")}
    return kept.select(*[now.get(c, F.col(c)) for c in docs.columns])


@keeping
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id in each group of near copies (similarity 0.8 or more) stays."""
    gone = minhash.near_duplicates(docs.select("doc_id", "text"), NEAR).where("not kept").select("doc_id").distinct()
    return docs.join(gone.hint("shuffle_hash"), "doc_id", "left_anti").select(docs.columns)


@keeping
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    return decontam.clean_documents(docs, table(spark, sf_dir, "benchmark")).select(docs.columns)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("near_dedup", drop_near_copies),
    ("decontamination", decontaminate),
    ("byte_bpe", tokenise),
]
# A fitted classifier cannot be said in SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; what a stage returns is written and read again before the next."""
    configure(spark)
    docs = table(spark, sf_dir, "documents")
    before = None
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
