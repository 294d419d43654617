"""The corpus pipeline: five stages over the documents, each one operator on all that the stage before kept.

toxicity: documents that score 0.5 or more go. line_dedup: repeated lines go, and documents of which nothing else is
left. near_dedup: one document of each group of near duplicates stays. mixing: documents are repeated, cut or left out
so that sources meet their target weights. byte_bpe: tokens of what is left, and digests of the round trip.

Nulls, empty texts, repeated rows, empty tables and further columns, whatever their names, have the results that each
operator defines; all stages but the last return the columns of their input. A row without doc_id goes through all
stages: it has no lines and no near duplicates there, and is mixed like others.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.llm import bpe, lines, minhash, mixing, toxicity
from quillstream.llm.shared import free_name, saved


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic; learnt from the labels outside the held-out fold."""
    weights = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = free_name("score", docs.columns)
    scored = toxicity.score(docs, weights, keep=tuple(docs.columns), name=name)
    return scored.where(F.col(name) < 0.5).select(*(F.col(f"`{c}`") for c in docs.columns))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that occurred before, within two edits."""
    return lines.without_repeats(docs)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near duplicates; rows without a doc_id stay."""
    gone = minhash.near_duplicates(docs).where(~F.col("kept")).select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs, F.array("source"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every row."""
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", keep_one_of_each_group),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]
#: The classifier and the tokens are beyond SQL; the tests compare each stage with brute force on what it was given.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what a stage returns is written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
