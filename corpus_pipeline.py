"""A training corpus from raw documents: quality, near-duplicates, benchmark leaks, personal data, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spherix.llm import common, decontam, packing, pii, quality, simhash


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep: null and short texts go, rows that repeat are judged each."""
    return quality.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest doc_id, any one if none has one; of rows that repeat it, one."""
    return simhash.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window; null texts and rows without doc_id stay."""
    return decontam.decontaminate(docs, common.table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and what discloses it replaced by its kind; null texts stay null."""
    return pii.sanitise(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with their places in sequences of 2048 tokens; a null text is one end token."""
    return packing.pack(docs)


STAGES = [("quality", quality_rules), ("near_dedup", near_dedup), ("decontamination", decontamination), ("pii", personal_data), ("packing", pack)]

#: Fingerprints, disclosure and packing aren't for SQL; tests/llm/test_pipeline.py holds each stage against plain Python.
#: An empty table gives no rows at each stage; further columns, whatever their names, go through all but the last.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), name)
    return docs
