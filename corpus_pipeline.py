"""From raw documents to packed training sequences.

Quality rules, near copies, benchmark overlaps, secrets, packing: each stage
works on what the one before it kept, and its decisions take effect.  All
but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mendframe.llm import near_copies, packing, quality_rules, secret_scan, winnowing
from mendframe.plans.registry import table
from mendframe.sources.workspace import Workspace

#: No SQL: rules and models are learned, and tokens come from a tokenizer.
ORACLE_SQL = None
SHINGLE_WORDS = 5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned decision list keep."""
    return quality_rules.kept_documents(docs, table(spark, sf_dir, "labels"), Workspace(spark))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_copies.without_copies(docs, SHINGLE_WORDS, Workspace(spark))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share too little with the benchmark to be contaminated."""
    return winnowing.clean_documents(docs, table(spark, sf_dir, "benchmark"), Workspace(spark))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in their texts."""
    return secret_scan.redacted(docs, Workspace(spark))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in the sequences."""
    return packing.pack(docs, Workspace(spark))


STAGES = [
    ("quality_rules", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scans", secrets),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each one's result is written and read again."""
    work, docs = Workspace(spark), table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = work.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
