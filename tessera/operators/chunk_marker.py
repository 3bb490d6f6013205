"""K3/K4/K5/K7: split sheets at marker rows, fully native.

A row is a marker row when one of its non-null cells, stripped, starts with
the marker text.  Rows before the first marker form a preamble section;
every marker row opens a section that runs to the next marker.  A sheet
without any marker becomes one ``Full Sheet`` chunk.

Plan: one skew-safe running count of markers over light columns (section id,
W1), written once; one group-by of ``(source, sheet, section)`` for bounds,
counts and label; a per-sheet aggregate of the section table joined back; ids.
The text follows last: the rows join their section and are put together in
two levels (blocks of a section in parallel; the finished text of a section is
one row, as the rule asks for).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import cut_lineage
from .ids import chunk_layout, with_chunk_ids
from .scan import join_small, ordered_text, running_sum

# Fixed values of the marker chunker's output.
DEFAULT_MARKER = "TestNumber"
TYPE_SECTION = "Test Number"
TYPE_FULL = "Full Sheet"
LABEL_PREAMBLE = "Preamble"
HEADER_PREAMBLE = "Header/Preamble"
LABEL_NONE = "No Test Number Found"
ID_SEP = "#"


def mark_sections(rows: DataFrame, marker: str = DEFAULT_MARKER) -> DataFrame:
    """Add ``is_marker`` and ``section`` (running marker count)."""
    x = rows.withColumn("is_marker", tx.has_marker_cell("cells", marker).cast("int"))
    return running_sum(x, ["source", "sheet"], "row_idx", "is_marker", "section")


def _marks(rows: DataFrame, marker: str) -> DataFrame:
    """Section and label of every row, without its cells."""
    is_marker = tx.has_marker_cell("cells", marker)
    x = rows.select("source", "sheet", "sheet_pos", "row_idx", is_marker.cast("int").alias("is_marker"),
                    F.when(is_marker, tx.section_label("cells", marker)).alias("label"))
    return running_sum(x, ["source", "sheet"], "row_idx", "is_marker", "section")


SECTION = ["source", "sheet", "section"]


def section_text(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """K5: ordered labelled text of every section, and its columns."""
    x = rows.select("source", "sheet", "row_idx", "columns", "cells").join(
        marks.select("source", "sheet", "row_idx", "section"), ["source", "sheet", "row_idx"])
    x = x.withColumn("__line", tx.row_labelled_text("row_idx", "columns", "cells"))
    return ordered_text(x, SECTION, "row_idx", "__line", "\n", "body", extra_aggs=[(F.max("columns"), "max", "columns")])


def chunk_by_marker(rows: DataFrame, marker: str = DEFAULT_MARKER, with_text: bool = True) -> DataFrame:
    """Marker chunks in the ``chunks`` layout (content null when ``with_text`` is off)."""
    marks = cut_lineage(_marks(rows, marker)) if with_text else _marks(rows, marker)
    s = marks.groupBy(*SECTION).agg(
        F.min("row_idx").alias("first_idx"), F.max("row_idx").alias("last_idx"), F.count(F.lit(1)).alias("n_rows"),
        F.max("label").alias("label"), F.max("sheet_pos").alias("sheet_pos"))
    # per-sheet facts from a partial aggregate joined back (AQE broadcasts it
    # when small and splits a sheet with very many sections otherwise)
    per_sheet = (s.groupBy("source", "sheet")
                  .agg(F.max("section").alias("__n_markers"), F.min("section").alias("__min_section"),
                       (F.max("last_idx") + 1).alias("__sheet_rows")))
    s = join_small(s, per_sheet, ["source", "sheet"])
    full = F.col("__n_markers") == 0
    pre = (F.col("section") == 0) & ~full
    chunk_type = F.when(full, F.lit(TYPE_FULL)).otherwise(F.lit(TYPE_SECTION))
    label = (F.when(full, F.lit(LABEL_NONE)).when(pre, F.lit(LABEL_PREAMBLE))
             .otherwise(F.col("label")))
    start_row = F.when(full | pre, F.lit(1)).otherwise(F.col("first_idx") + 1)
    end_row = F.when(full, F.col("__sheet_rows")).otherwise(F.col("last_idx") + 1)
    total_rows = F.when(full, F.lit(None)).otherwise(F.col("n_rows"))
    out = s.select(
        "source", "sheet", "sheet_pos", "section", full.alias("__full"),
        chunk_type.alias("chunk_type"),
        (F.col("section") - F.col("__min_section")).cast("bigint").alias("part"),
        start_row.cast("bigint").alias("start_row"),
        end_row.cast("bigint").alias("end_row"),
        total_rows.cast("bigint").alias("total_rows"),
        label.alias("section_label"),
    )
    out = with_chunk_ids(out, ID_SEP)
    full = F.col("__full")
    if with_text:
        out = out.join(section_text(rows, marks), SECTION)
        head = F.when(
            full,
            F.concat_ws("\n",
                        F.concat(F.lit("File: "), F.col("source")),
                        F.concat(F.lit("Sheet: "), F.col("sheet")),
                        F.concat(F.lit("Total Rows: "), F.col("end_row").cast("string")),
                        F.concat(F.lit("Columns: "), F.array_join("columns", ", ")),
                        F.lit("=" * tx.RULE_WIDTH)),
        ).otherwise(
            F.concat_ws("\n",
                        F.concat(F.lit("File: "), F.col("source")),
                        F.concat(F.lit("Sheet: "), F.col("sheet")),
                        F.concat(F.lit("Test: "), F.when(F.col("section") == 0, F.lit(HEADER_PREAMBLE))
                                 .otherwise(F.col("section_label"))),
                        F.concat(F.lit("Rows: "), F.col("start_row").cast("string"), F.lit("-"),
                                 F.col("end_row").cast("string")),
                        F.concat(F.lit("Columns: "), F.array_join("columns", ", ")),
                        F.lit("=" * tx.RULE_WIDTH)))
        # the header is built from the already-projected columns
        out = out.withColumn("content", F.when(F.length("body") > 0, F.concat(head, F.lit("\n"), F.col("body")))
                             .otherwise(head)).drop("body")
    else:
        out = out.withColumn("content", F.lit(None).cast("string"))
    out = (out.withColumn("token_count", F.lit(None).cast("bigint"))
              .withColumn("num_rows", F.lit(None).cast("bigint"))
              .withColumn("total_parts", F.lit(None).cast("bigint")))
    return chunk_layout(out.drop("section", "columns", "__full"))
