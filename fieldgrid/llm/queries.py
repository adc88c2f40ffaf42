"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from fieldgrid.llm import bag_minhash, decontamination, licenses, packing, pii, quality_rules, rule_ensemble, suffix_dedup, token_rollup, url_reputation
from fieldgrid.llm.common import shared_dir, table


def surrogate_key(spark: SparkSession) -> str:
    """The secret key of PII surrogates, from the session's settings; the stand-in is for synthetic tables only."""
    return spark.conf.get("spark.fieldgrid.pii.key", "key of synthetic tables")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"), surrogate_key(spark))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes = url_reputation.outcomes_from_labels(table(spark, sf_dir, "labels"))
    return url_reputation.judge_pages(table(spark, sf_dir, "pages"), outcomes)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/token-rollup-{uuid.uuid4().hex}"
    return token_rollup.load_corpus(spark, table(spark, sf_dir, "documents"), path, keep_empty=True)


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bag_minhash.dedupe_classes(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.cut_repeats(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_ensemble.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def conversation_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole conversations under limits on tokens, segments and the answers' tokens, all of which bind."""
    return packing.pack(packing.instruction_examples(table(spark, sf_dir, "conversations")), packing.Capacity(2048, 8, 1024))


QUERIES = {f.__name__: f for f in (op1_pii, op2_url_filters, op3_license_scan, op4_token_counts, op5_near_dedup, op6_quality_rules, op7_suffix_dedup, op8_decontamination, op9_quality_classifier, op10_packing, conversation_packing)}
ORACLES = {"op2_url_filters": url_reputation.ORACLE_SQL, "op6_quality_rules": quality_rules.ORACLE_SQL, "op8_decontamination": decontamination.ORACLE_SQL}
