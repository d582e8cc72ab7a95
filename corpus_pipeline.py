"""A training corpus from ``documents``: toxic texts go, one of each group of near duplicates stays, personal data is
replaced, sources are mixed to their target weights, and what is left is encoded.

Defined results: a null text counts as an empty one; texts without words are no near duplicates of anything; repeated
rows of one id and text stay once after the near duplicates; ties follow the stages' own docstrings; columns of any
name go through all stages but the last; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import bpe, minhash, mixing, pii, toxicity
from textloom.llm.common import quoted, stored, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    network = toxicity.fitted(docs, table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, network)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.deduplicated(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return docs.withColumn("text", pii.redact(F.col("text"))).withColumn("n_chars", F.length("text").cast("long")).select(*map(quoted, docs.columns))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encoded(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_duplicates),
    ("personal_data", without_personal_data),
    ("mixing", mixed),
    ("bpe", encoded),
]

#: A trained network and a draw by hash are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
