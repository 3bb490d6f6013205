"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import bounded_count

#: a table of at most this many short rows is broadcast; a larger one is joined by shuffle
SMALL_ROWS = 50_000
SMALL_IDS = 300_000

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` only, whatever other columns ``docs`` has."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def unit_hash(*cols: Column, seed: int) -> Column:
    """Uniform number in (0, 1) from an md5 of the seed and the columns."""
    s = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("~")) for c in cols])
    top = F.conv(F.substring(F.md5(s), 1, 13), 16, 10).cast("long")
    return (top.cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it is counted to have at most ``rows``
    rows, else as it is (the same join then shuffles)."""
    return F.broadcast(df) if bounded_count(df, rows) <= rows else df
