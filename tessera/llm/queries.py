"""One query per operator, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import (attention_lm, decontaminate, importance, jaccard_join, license_scan, mixing, oracle, periodic_runs, repetition, site_tree,
               suffix_dedup, token_counts, toxicity, warc)
from .common import table


def op1_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition_rules(table(spark, sf_dir, "documents"))


def op2_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_tree.main_text(table(spark, sf_dir, "pages"))


def op3_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (mixing.mix(table(spark, sf_dir, "documents"))
            .select("doc_id", "size", "source_size", "target", "taken", "copies"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op5_toxicity_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_qgram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_run_length_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(table(spark, sf_dir, "documents"))


def op8_trie_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op9_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attention_lm.score(table(spark, sf_dir, "documents"))


def op10_signature_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similarity_components(table(spark, sf_dir, "documents"))


def op11_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.periodic_runs(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_repetition_rules, op2_site_style_tree, op3_pareto_mixing, op4_license_scan, op5_toxicity_lexicon,
                                   op6_qgram_decontamination, op7_run_length_dedup, op8_trie_token_counts, op9_attention_lm,
                                   op10_signature_tree_join, op11_warc_transactions, op12_importance_resampling,
                                   op13_periodic_runs)}
ORACLE = {
    "op1_repetition_rules": oracle.repetition(repetition.MAX_SHARE, repetition.MAX_LINE_SHARE),
    "op3_pareto_mixing": oracle.mixing(mixing.SEED, mixing.WEIGHTS, mixing.SHARE, mixing.MOST_COPIES),
    "op11_warc_transactions": oracle.warc(warc.MIN_REVISIT),
    "op12_importance_resampling": oracle.importance(importance.BUCKETS, importance.MIN_WORDS, importance.PERCENT, importance.SEED, importance.SCALE),
    "op10_signature_tree_join": oracle.components(jaccard_join.SHINGLE, jaccard_join.PERCENT),
}
