"""A corpus cleaning pipeline: each stage reads what the one before it kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs.  All but the last return the columns of
documents.  Rows are kept whole or dropped by a decision of the stage's operator; only the personal data
stage changes texts.  The last stage returns the token ids' digests.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harborline.llm import bpe, decontaminate, pii, simhash, toxicity
from harborline.llm.common import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.3, learned from the labelled ones among them."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), F.lit(True))
    scored = toxicity.score(docs, model, "__toxicity")
    return scored.where(F.col("__toxicity") < 0.3).drop("__toxicity")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id."""
    return simhash.representatives(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def generalise_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and the terms that disclose it generalised."""
    return pii.sanitised(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.round_trip_digests(docs, ranks, public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("personal_data", generalise_personal_data),
    ("tokens", encode),
]

#: Learned weights, fingerprints and latent vectors are beyond SQL; tests compare the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
