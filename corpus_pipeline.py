"""The corpus pipeline: quality rules, exact and near deduplication, substring deduplication, packing.

Every stage takes all rows that the one before kept and, but for the last, returns the columns of documents.
A document that quality rules reject goes; of equal texts the one with the largest doc_id stays; of a class of
near duplicates the one with the least; repeated passages of 35 words or more are cut from what is left; the
rest is packed into sequences, a row for each piece. Documents without any word left are still packed: they
hold an end token. Rows are told apart by id and text; extra columns come along to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lipiflow.llm.common import documents, stored, surviving
from lipiflow.llm.exact_dedup import exact_rows
from lipiflow.llm.near_dedup import near_rows
from lipiflow.llm.packing import packed_sequences
from lipiflow.llm.quality_rules import passing
from lipiflow.llm.queries import tokenizer
from lipiflow.llm.substring_dedup import cut_documents

#: SQL cannot express near-duplicate classes, so there is none for the whole; tests hold stages against brute force.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose own text passes: null and empty texts go, null and repeated ids are nothing special."""
    return passing(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: that of the largest doc_id, a null id being below all others."""
    return surviving(docs, exact_rows(docs))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class: that of the least doc_id. Rows without an id are in no class and stay, but for repeated ones."""
    return surviving(docs, near_rows(docs))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows; the text becomes the kept words, joined by one space, and n_chars follows it. A null text becomes empty."""
    return cut_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each row's ids; the columns of op9. A null text is empty and still has its end token."""
    return packed_sequences(docs, tokenizer("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("substring_dedup", substring_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, f"pipeline-{name}")
    return docs
