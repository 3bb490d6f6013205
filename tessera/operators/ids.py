"""Chunk ids that run over all sheets of a source, and unions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..schema import CHUNK_COLUMNS
from ..session import cut_lineage
from .scan import group_offsets, join_small


def with_chunk_ids(light: DataFrame, sep: str, lower: bool = False) -> DataFrame:
    """Add ``chunk_id = base(source) <sep> n`` with ``n`` running over the
    sheets of a source in ``(sheet_pos, sheet)`` order, then ``part``.

    ``light`` has one row per chunk (``source, sheet, sheet_pos, part, ...``),
    best without the chunk's text: it is read twice (counts per sheet, join
    back) and so is written once.  The running number is built from one row
    per sheet (count of its chunks, exclusive prefix per source, see
    ``group_offsets``), so no window ever spans all chunks of a large source.
    """
    light = cut_lineage(light)
    per_sheet = (light.groupBy("source", "sheet")
                      .agg(F.max("sheet_pos").alias("__pos"), F.count(F.lit(1)).alias("__n")))
    offs = group_offsets(per_sheet, ["source"], ["__pos", "sheet"], "__n", "__off").drop("__pos", "__n")
    base = tx.base_name(tx.file_name("source"))
    if lower:
        base = F.lower(base)
    out = join_small(light, offs, ["source", "sheet"])
    return out.withColumn("chunk_id", tx.chunk_id(base, sep, F.col("__off") + F.col("part"))).drop("__off")


ROW_KEY = "row_key"


def with_row_key(chunks: DataFrame, number: str | None = None) -> DataFrame:
    """Add ``row_key``, unique over all chunks: ingest number (0 without one),
    length and text of the source, sheet, part.  ``chunk_id`` shows only a
    file's base name, so files of equal names share ids."""
    n = F.col(number) if number else F.lit(0)
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return chunks.withColumn(ROW_KEY, F.concat_ws(":", n.cast("string"), F.length(part("source")).cast("string"),
                                                  part("source"), part("sheet"), part("part")))


def chunk_layout(chunks: DataFrame) -> DataFrame:
    """The fixed chunk columns first, then any others."""
    return chunks.select(*CHUNK_COLUMNS, *[c for c in chunks.columns if c not in CHUNK_COLUMNS])


def assign_chunk_ids(chunks: DataFrame, sep: str, lower: bool = False) -> DataFrame:
    """Ids for chunks whose text is already there (the text is written with
    them; where it can be attached later, use ``with_chunk_ids`` before)."""
    return chunk_layout(with_chunk_ids(chunks, sep, lower))


def union_chunks(*frames: DataFrame) -> DataFrame:
    """Q1: UNION ALL of chunk tables with different metadata columns."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
