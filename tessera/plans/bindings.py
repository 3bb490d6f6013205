"""Bindings of the driver's tables to the engine's long-form inputs.

* ``documents``: a document is a sheet (``source`` is its source file,
  ``sheet`` is ``doc<doc_id>``), each text line is a row with one cell.
* ``events``: the events of one user on one day form a sheet; rows are in
  ``(ts, event_id)`` order; cells are event type, value and properties.
* ``customer`` / ``nation``: one sheet per table, rows in key order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scan import row_ordinal

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def document_sheet_name(doc_id) -> F.Column:
    return F.concat(F.lit("doc"), doc_id.cast("string"))


def document_rows(docs: DataFrame) -> DataFrame:
    """``sheet_rows`` of documents: one row per text line (empty line = null cell)."""
    d = docs.where(F.col("text").isNotNull() & (F.length("text") > 0))
    x = d.select("source", document_sheet_name(F.col("doc_id")).alias("sheet"),
                 F.col("doc_id").alias("sheet_pos"),
                 F.posexplode(F.split("text", "\n")).alias("row_idx", "line"))
    return x.select("source", "sheet", "sheet_pos", F.col("row_idx").cast("bigint"),
                    F.array(F.lit("text")).alias("columns"),
                    F.array(F.when(F.col("line") != "", F.col("line"))).alias("cells"))


EVENT_COLUMNS = ["event_type", "value", "props"]


def event_rows(events: DataFrame) -> DataFrame:
    """``sheet_rows`` of events: sheet = one user on one day."""
    x = events.select(
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("source"),
        F.date_format("ts", "yyyy-MM-dd").alias("sheet"),
        F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")).cast("bigint").alias("sheet_pos"),
        "ts", "event_id",
        F.array(F.col("event_type"), F.format_string("%.2f", "value"), F.col("props")).alias("cells"))
    # one user-day may hold most events: number the rows by a range-sorted
    # prefix count instead of a window over the whole sheet
    x = row_ordinal(x, ["source", "sheet"], ["ts", "event_id"], "row_idx")
    return x.select("source", "sheet", "sheet_pos", "row_idx",
                    F.array(*[F.lit(c) for c in EVENT_COLUMNS]).alias("columns"), "cells")


def keyed_table_rows(df: DataFrame, source: str, key: str, columns: list[str], fmt: dict | None = None) -> DataFrame:
    """A table as one sheet; ``row_idx = key - 1`` (keys are dense from 1)."""
    fmt = fmt or {}
    cells = [F.format_string(fmt[c], c) if c in fmt else F.col(c).cast("string") for c in columns]
    return df.select(F.lit(source).alias("source"), F.lit("Sheet1").alias("sheet"), F.lit(0).cast("bigint").alias("sheet_pos"),
                     (F.col(key) - 1).cast("bigint").alias("row_idx"),
                     F.array(*[F.lit(c) for c in columns]).alias("columns"), F.array(*cells).alias("cells"))
