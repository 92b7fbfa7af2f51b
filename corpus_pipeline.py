"""A training-data pipeline: five stages over documents, each written as Parquet and read again.

Toxic documents go, one of each group of near duplicates stays, personal data is masked, sources are
mixed to target weights, and the rest is encoded for training. Every stage works on all rows it is
given, whatever further columns they have; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from helixframe.llm import byte_bpe, jaccard_join, mixing, pii, toxicity
from helixframe.llm.base import table
from helixframe.session import settle

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score 0.5 or more; the model learns from the labelled rows of ``docs``."""
    return toxicity.reject_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group (five-word shingles, Jaccard 0.75 or more)."""
    return jaccard_join.keep_one(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts by its kind in brackets."""
    return pii.mask(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents until the sources have their weights, in order of the blocks."""
    return mixing.mix_documents(docs)


def encode_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the encoded and of the decoded texts."""
    ranks = byte_bpe.read_ranks(spark, public_tokenizers.path(VOCABULARY))
    return byte_bpe.digests(docs, ranks, public_tokenizers.PATTERN)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("toxicity", reject_toxic),
    ("ngram_jaccard_join", join_near_duplicates),
    ("pii", mask_personal_data),
    ("mixing", mix_sources),
    ("byte_bpe", encode_bytes),
]

#: The first stage is a trained model, which SQL cannot state.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir))
    return docs
