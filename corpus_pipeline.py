"""From raw documents to packed training sequences.

Each stage gets what its predecessor kept, written as Parquet, and returns the
rows that stay with all their columns; the last returns the packed pieces.
Rows leave by doc_id and a hash of their text: the names of rejected rows are
written and anti-joined, and the texts of the rows that stay are not shuffled as
long as these are few enough to broadcast.

Defined results: a null text counts as empty and is not toxic by itself; a row
without a doc_id is a document like others and comes last among its copies; rows
that repeat a doc_id with different texts are different documents, and of rows
that repeat both one stays; an empty table gives no pieces.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklake.llm import common, exact_dedup, jaccard_join, packing, toxicity

VOCABULARY = "byte_bpe_50k.json"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a classifier trained on the labelled ones scores under its threshold."""
    model = toxicity.train(docs, common.table(spark, sf_dir, "labels"), F.lit(True))
    return toxicity.without_toxic(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal up to white space, the document with the smallest doc_id."""
    decided = exact_dedup.exact_dedup(docs).select("doc_id", F.col("text_sha256").alias("key"), "kept")
    return common.one_of_each(docs, decided, exact_dedup.digest(common.text_or_empty()))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard index of at least 0.8, the one with the smallest doc_id."""
    decided = jaccard_join.similarity_classes(docs, keyed=True)
    decided = common.materialize(decided.select("doc_id", F.col("text_key").alias("key"), F.col("is_first").alias("kept")), "near-copies")
    return common.one_of_each(docs, decided, jaccard_join.text_key())


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, each with its sequence and offset."""
    return packing.pack(docs, public_tokenizers.path(VOCABULARY))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("jaccard_join", drop_near_copies),
    ("packing", pack),
]
#: Classifiers and tokenizers have no SQL form; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
