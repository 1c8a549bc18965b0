"""The corpus pipeline: toxicity filter, exact dedup, near-dedup, packing; each stage written and read again.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame. All but the last return the columns of documents. Rows with null text count as
empty throughout; empty tables pass through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratapack.llm.common import staged, table
from stratapack.llm.exact_dedup import drop_exact_copies
from stratapack.llm.near_dedup import drop_near_copies
from stratapack.llm.retrieval_pack import retrieval_pack
from stratapack.llm.toxicity import drop_toxic

#: Neither the fitted classifier nor the packing order can be stated in SQL; tests check each stage by brute force.
ORACLE_SQL = None


def toxic_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, one row stays."""
    return drop_exact_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays."""
    return drop_near_copies(docs)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences: doc_id, start, length, ids, doc_tokens, sequence_id, offset."""
    return retrieval_pack(docs)


STAGES = [
    ("toxicity", toxic_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("packing", pack_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each from its predecessor's written rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
