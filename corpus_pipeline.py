"""From documents to packed token rows: the training-data operators in a row.

Each stage works on all that its predecessor kept, is written as Parquet in the
shared folder, and is read again by the next.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from newsweave.llm import decontam, mixing, neardup, packing, toxicity
from newsweave.llm.common import shared_dir, table


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not reject."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return neardup.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources at their target weights, documents repeated as needed."""
    return mixing.emit(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed rows of token ids."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", not_toxic),
    ("near_duplicates", one_of_each),
    ("decontamination", decontaminated),
    ("mixing", mixed),
    ("packing", packed),
]

#: Classification and tokenisation are beyond SQL; tests restate the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`, each written and read again -> packed rows.

    Null and empty texts, null ids, sources and labels, and repeated rows pass
    through each stage as its docstring says; a text without ids is in no
    packed row, and empty tables give no rows.  The written stages stand in the
    session's shared folder until the caller deletes them.
    """
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
