"""Corpus pipeline: quality rules, near-duplicates, decontamination, PII surrogates, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before it kept. All but the last return the columns of ``documents``; the last
returns the pieces of packed sequences. Between stages the rows are written as
Parquet to the folder that the cluster shares and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldgrid.llm import bag_minhash, decontamination, packing, pii, quality_rules
from fieldgrid.llm.common import materialise, table
from fieldgrid.llm.queries import surrogate_key


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go."""
    return quality_rules.keep(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays."""
    return bag_minhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def replace_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Entities give way to surrogates; no document goes, and the other columns stay."""
    return pii.scrub(docs, surrogate_key(spark))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", reject_low_quality),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("pii", replace_pii),
    ("packing", pack_sequences),
]

#: Near-duplicate classes, surrogates and token ids are beyond SQL; the tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
