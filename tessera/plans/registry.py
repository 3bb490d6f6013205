"""Registered queries (Spark plans over the driver's tables) and their
DuckDB oracle statements.  Every query reads whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bindings as B
from . import oracle as O

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def _docs(spark, sf):
    return B.document_rows(B.table(spark, sf, "documents"))


# ---------------------------------------------------------------------------
# Sheets and chunking
# ---------------------------------------------------------------------------
K1_BUDGET, K1_OVERLAP = 200, 100
MARKER = "signup"


@register("sheet_rows", f"""
WITH {O.DOC_LINES.strip()}
SELECT source, sheet, sheet_pos, row_idx, cell FROM doc_lines""")
def q_sheet_rows(spark, sf):
    return _docs(spark, sf).select("source", "sheet", "sheet_pos", "row_idx", F.col("cells")[0].alias("cell"))


@register("chunk_tokens", f"""
WITH RECURSIVE {O.DOC_LINES.strip()},
{O.k1_bounds('doc_lines', 'COALESCE(length(cell), 0) // 5', K1_BUDGET, K1_OVERLAP).strip()},
{O.chunk_ids('k1', '_', 'k1_ids').strip()}
SELECT chunk_id, source, sheet, part, start_row, end_row, total_rows, token_sum, total_parts FROM k1_ids""")
def q_chunk_tokens(spark, sf):
    from ..operators.chunk_tokens import chunk_by_tokens
    ch = chunk_by_tokens(_docs(spark, sf), K1_BUDGET, K1_OVERLAP, with_text=False)
    return ch.select("chunk_id", "source", "sheet", "part", "start_row", "end_row", "total_rows",
                     "token_sum", "total_parts")


@register("chunk_tokens_text", f"""
WITH RECURSIVE {O.DOC_LINES.strip()},
{O.k1_bounds('doc_lines', 'COALESCE(length(cell), 0) // 5', K1_BUDGET, K1_OVERLAP).strip()},
{O.chunk_ids('k1', '_', 'k1_ids').strip()},
mem AS (
  SELECT k.chunk_id, k.source, k.sheet, k.start_row, k.end_row, l.row_idx, COALESCE(l.cell, 'NaN') AS v
  FROM k1_ids k JOIN doc_lines l
    ON l.source = k.source AND l.sheet = k.sheet AND l.row_idx BETWEEN k.start_row - 1 AND k.end_row - 1
),
wid AS (
  SELECT chunk_id, greatest(length('text'), 1 + max(length(v))) AS w,
         max(length(CAST(row_idx AS VARCHAR))) AS wi
  FROM mem GROUP BY chunk_id
),
body AS (
  SELECT m.chunk_id, any_value(m.source) AS source, any_value(m.sheet) AS sheet,
         any_value(m.start_row) AS start_row, any_value(m.end_row) AS end_row,
         repeat(' ', CAST(any_value(w.wi) AS INTEGER)) || ' ' || lpad('text', CAST(any_value(w.w) AS INTEGER), ' ') || chr(10) ||
         string_agg(rpad(CAST(m.row_idx AS VARCHAR), CAST(w.wi AS INTEGER), ' ') || ' ' || lpad(m.v, CAST(w.w AS INTEGER), ' '), chr(10) ORDER BY m.row_idx) AS body
  FROM mem m JOIN wid w ON w.chunk_id = m.chunk_id
  GROUP BY m.chunk_id
),
txt AS (
  SELECT chunk_id, start_row, end_row,
         'Sheet: ' || sheet || chr(10) || 'Source: ' || source || chr(10) || 'Rows ' || CAST(start_row AS VARCHAR)
         || '-' || CAST(end_row AS VARCHAR) || ':' || chr(10) || chr(10) || body AS content
  FROM body
)
SELECT chunk_id, start_row, end_row, CAST(length(content) // 5 AS BIGINT) AS token_count, content FROM txt""")
def q_chunk_tokens_text(spark, sf):
    from ..operators.chunk_tokens import chunk_by_tokens
    ch = chunk_by_tokens(_docs(spark, sf), K1_BUDGET, K1_OVERLAP, layout="table")
    return ch.select("chunk_id", "start_row", "end_row", "token_count", "content")


def _event_sql(with_text: bool) -> str:
    cells = ["event_type", "value_s", "props"]
    labels = [("event_type", "event_type"), ("value", "value_s"), ("props", "props")]
    text_cols = f", {O.labelled_line('row_idx', labels)} AS line" if with_text else ""
    body_col = ", string_agg(line, chr(10) ORDER BY row_idx) AS body" if with_text else ""
    return f"""
ev0 AS (
  SELECT 'user_' || CAST(user_id AS VARCHAR) AS source, strftime(ts, '%Y-%m-%d') AS sheet,
         CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS BIGINT) AS sheet_pos,
         CAST(row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) - 1 AS BIGINT) AS row_idx,
         event_type, printf('%.2f', value) AS value_s, props
  FROM events
),
ev1 AS (
  SELECT *, CASE WHEN {O.marker_any(cells, MARKER)} THEN 1 ELSE 0 END AS is_marker{text_cols}
  FROM ev0
),
ev2 AS (
  SELECT *, SUM(is_marker) OVER (PARTITION BY source, sheet ORDER BY row_idx ROWS UNBOUNDED PRECEDING) AS section,
         CASE WHEN is_marker = 1 THEN {O.section_label(cells, MARKER)} END AS lbl
  FROM ev1
),
sec AS (
  SELECT source, sheet, max(sheet_pos) AS sheet_pos, section, min(row_idx) AS first_idx, max(row_idx) AS last_idx,
         count(*) AS n_rows, max(lbl) AS label{body_col}
  FROM ev2 GROUP BY source, sheet, section
),
sec2 AS (
  SELECT *, max(section) OVER (PARTITION BY source, sheet) AS n_markers,
         min(section) OVER (PARTITION BY source, sheet) AS min_section,
         max(last_idx) OVER (PARTITION BY source, sheet) + 1 AS sheet_rows
  FROM sec
),
mk AS (
  SELECT source, sheet, sheet_pos, section,
         CASE WHEN n_markers = 0 THEN 'Full Sheet' ELSE 'Test Number' END AS chunk_type,
         CAST(section - min_section AS BIGINT) AS part,
         CAST(CASE WHEN n_markers = 0 OR section = 0 THEN 1 ELSE first_idx + 1 END AS BIGINT) AS start_row,
         CAST(CASE WHEN n_markers = 0 THEN sheet_rows ELSE last_idx + 1 END AS BIGINT) AS end_row,
         CAST(CASE WHEN n_markers = 0 THEN NULL ELSE n_rows END AS BIGINT) AS total_rows,
         CASE WHEN n_markers = 0 THEN 'No Test Number Found' WHEN section = 0 THEN 'Preamble' ELSE label END AS section_label
         {', body' if with_text else ''}
  FROM sec2
),
{O.chunk_ids('mk', '#', 'mk_ids').strip()}"""


@register("chunk_marker", f"""
WITH {_event_sql(False).strip()}
SELECT chunk_id, source, sheet, chunk_type, part, start_row, end_row, total_rows, section_label FROM mk_ids""")
def q_chunk_marker(spark, sf):
    from ..operators.chunk_marker import chunk_by_marker
    ch = chunk_by_marker(B.event_rows(B.table(spark, sf, "events")), MARKER, with_text=False)
    return ch.select("chunk_id", "source", "sheet", "chunk_type", "part", "start_row", "end_row", "total_rows",
                     "section_label")


@register("chunk_marker_text", f"""
WITH {_event_sql(True).strip()},
hd AS (
  SELECT chunk_id, body,
         CASE WHEN chunk_type = 'Full Sheet' THEN
           'File: ' || source || chr(10) || 'Sheet: ' || sheet || chr(10) || 'Total Rows: ' || CAST(end_row AS VARCHAR)
           || chr(10) || 'Columns: event_type, value, props' || chr(10) || repeat('=', 60)
         ELSE
           'File: ' || source || chr(10) || 'Sheet: ' || sheet || chr(10) || 'Test: ' ||
           CASE WHEN section = 0 THEN 'Header/Preamble' ELSE section_label END || chr(10) ||
           'Rows: ' || CAST(start_row AS VARCHAR) || '-' || CAST(end_row AS VARCHAR) || chr(10) ||
           'Columns: event_type, value, props' || chr(10) || repeat('=', 60)
         END AS head
  FROM mk_ids
)
SELECT chunk_id, CASE WHEN body IS NULL OR body = '' THEN head ELSE head || chr(10) || body END AS content FROM hd""")
def q_chunk_marker_text(spark, sf):
    from ..operators.chunk_marker import chunk_by_marker
    ch = chunk_by_marker(B.event_rows(B.table(spark, sf, "events")), MARKER, with_text=True)
    return ch.select("chunk_id", "content")


# the other query groups register themselves on import
from . import registry_search  # noqa: E402,F401
from . import registry_text  # noqa: E402,F401
