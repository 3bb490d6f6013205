"""Corpus pipeline: five stages over ``documents``, each one operator.

1. toxicity: documents the lexicon predicts toxic go.
2. near duplicates: one document (the smallest id) of each group of 5-word
   shingle sets with Jaccard similarity of 0.75 or more stays.
3. repeated passages: bytes of long strings that start earlier are removed.
4. decontamination: documents with a benchmark passage go.
5. mixing: whole copies by target weights of the sources.

Every stage gets all rows its predecessor kept, reads them from Parquet in
the shared folder, and returns the columns of ``documents``; the last adds
``copy`` (1, 2, ...), one row per copy the mix takes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, jaccard_join, mixing, suffix_dedup, toxicity
from tessera.llm.common import table
from tessera.session import scratch_path, ship_package

#: not expressible in SQL (learned lexicon, banded alignment); tests compare
#: the stages with brute-force versions.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the toxicity lexicon doesn't predict toxic."""
    ship_package(spark)
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of links; of rows
    that repeat one id and text, one stays."""
    ship_package(spark)
    return jaccard_join.keep_first(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of 100-byte strings that start earlier; a text
    left empty goes."""
    ship_package(spark)
    return suffix_dedup.cut_repeats(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    ship_package(spark)
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The copies the mix takes, one row each."""
    ship_package(spark)
    return mixing.copies(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("suffix-array dedup", cut_repeats),
    ("benchmark decontamination", decontaminated),
    ("mixing", mixed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        at = scratch_path(spark, f"pipeline-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return STAGES[-1][1](spark, docs, sf_dir)
