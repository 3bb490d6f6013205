"""DuckDB SQL fragments shared by the oracle statements of the registry.

They restate each rule in plain SQL over the driver's tables so that the
Spark plans can be checked value by value.
"""

from __future__ import annotations

# white space and line ends of Python's str methods, and the label rule
WS = r"[\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
NON_WS = r"[^\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
LINE_BREAK = r"(?:\r\n|[\n\x{0B}\f\r\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}])"
LABEL_PATTERN = r"(?i)Test Number[:\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]*([0-9.]+)"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {q('^' + WS + '+|' + WS + '+\\z')}, '', 'g')"


def lstrip(x: str) -> str:
    return f"regexp_replace({x}, {q('^' + WS + '+')}, '')"


def nonblank(x: str) -> str:
    return f"({x} IS NOT NULL AND regexp_matches({x}, {q(NON_WS)}))"


def labelled_line(row_idx: str, cols: list[tuple[str, str]]) -> str:
    """P7 for a fixed list of (label, expr) cells; NULL when no cell is left."""
    parts = ", ".join(f"CASE WHEN {nonblank(e)} THEN {q(lbl + ': ')} || {e} END" for lbl, e in cols)
    any_kept = " OR ".join(nonblank(e) for _l, e in cols)
    return (f"CASE WHEN {any_kept} THEN 'Row ' || CAST({row_idx} + 1 AS VARCHAR) || ': ' || "
            f"concat_ws(' | ', {parts}) END")


def marker_any(cells: list[str], marker: str) -> str:
    return "(" + " OR ".join(f"({c} IS NOT NULL AND starts_with({lstrip(c)}, {q(marker)}))" for c in cells) + ")"


def section_label(cells: list[str], marker: str) -> str:
    first = "COALESCE(" + ", ".join(f"CASE WHEN contains({c}, {q(marker)}) THEN {c} END" for c in cells) + ")"
    st = strip(first)
    return (f"CASE WHEN {first} IS NULL THEN 'Unknown Test' "
            f"WHEN regexp_matches({st}, {q(LABEL_PATTERN)}) THEN 'Test Number ' || regexp_extract({st}, {q(LABEL_PATTERN)}, 1) "
            f"ELSE {st} END")


def line_count(x: str) -> str:
    return (f"(len(regexp_split_to_array({x}, {q(LINE_BREAK)})) - 1 + "
            f"CASE WHEN length({x}) > 0 AND NOT regexp_matches({x}, {q(LINE_BREAK + '\\z')}) THEN 1 ELSE 0 END)")


DOC_LINES = """
doc_arr AS (
  SELECT source, 'doc' || CAST(doc_id AS VARCHAR) AS sheet, doc_id AS sheet_pos,
         string_split(text, chr(10)) AS arr
  FROM documents WHERE text IS NOT NULL AND length(text) > 0
),
doc_lines AS (
  SELECT source, sheet, sheet_pos, CAST(unnest(range(len(arr))) AS BIGINT) AS row_idx,
         NULLIF(unnest(arr), '') AS cell
  FROM doc_arr
)"""


def k1_bounds(rows_cte: str, tok_expr: str, max_tokens: int, overlap_tokens: int) -> str:
    """Recursive-CTE statement of the K1 rule over ``rows_cte(source, sheet,
    sheet_pos, row_idx, ...)``; defines ``k1`` (one row per chunk)."""
    keep = min(overlap_tokens // 10, 5)
    return f"""
k1_tok AS (
  SELECT source, sheet, sheet_pos, row_idx, CAST({tok_expr} AS BIGINT) AS tok FROM {rows_cte}
),
k1_pre AS (
  SELECT *, COALESCE(SUM(tok) OVER (PARTITION BY source, sheet ORDER BY row_idx
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p_ex
  FROM k1_tok
),
k1_inc AS (SELECT *, p_ex + tok AS p_in FROM k1_pre),
k1_n AS (SELECT source, sheet, max(sheet_pos) AS sheet_pos, count(*) AS n FROM k1_inc GROUP BY source, sheet),
k1_end AS (
  SELECT a.source, a.sheet, a.row_idx AS s, a.p_ex,
         greatest(a.row_idx + 1, COALESCE(max(b.row_idx) + 1, 0)) AS e
  FROM k1_inc a LEFT JOIN k1_inc b
    ON a.source = b.source AND a.sheet = b.sheet AND b.row_idx >= a.row_idx AND b.p_in <= a.p_ex + {max_tokens}
  GROUP BY a.source, a.sheet, a.row_idx, a.p_ex
),
k1_chain AS (
  SELECT source, sheet, CAST(0 AS BIGINT) AS s, CAST(0 AS BIGINT) AS part FROM k1_n
  UNION ALL
  SELECT c.source, c.sheet,
         greatest(c.s + 1, x.e - least({keep}, (x.e - c.s) // 4)), c.part + 1
  FROM k1_chain c
  JOIN k1_end x ON x.source = c.source AND x.sheet = c.sheet AND x.s = c.s
  JOIN k1_n n ON n.source = c.source AND n.sheet = c.sheet
  WHERE x.e < n.n
),
k1 AS (
  SELECT c.source, c.sheet, n.sheet_pos, c.part, c.s + 1 AS start_row, x.e AS end_row,
         x.e - c.s AS total_rows, last.p_in - x.p_ex AS token_sum,
         count(*) OVER (PARTITION BY c.source, c.sheet) AS total_parts
  FROM k1_chain c
  JOIN k1_end x ON x.source = c.source AND x.sheet = c.sheet AND x.s = c.s
  JOIN k1_n n ON n.source = c.source AND n.sheet = c.sheet
  JOIN k1_inc last ON last.source = c.source AND last.sheet = c.sheet AND last.row_idx = x.e - 1
)"""


def chunk_ids(cte: str, sep: str, out: str) -> str:
    """W4 running number over sheets of a source: ``{out}`` adds ``chunk_id``."""
    return f"""
{out}_cnt AS (SELECT source, sheet, max(sheet_pos) AS sheet_pos, count(*) AS n FROM {cte} GROUP BY source, sheet),
{out}_off AS (
  SELECT source, sheet, COALESCE(SUM(n) OVER (PARTITION BY source ORDER BY sheet_pos, sheet
                                              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
  FROM {out}_cnt
),
{out} AS (
  SELECT c.*, regexp_replace(regexp_extract(c.source, '([^/]*)$', 1), '\\.[^./]*$', '') || {q(sep)} ||
              CAST(o.off + c.part AS VARCHAR) AS chunk_id
  FROM {cte} c JOIN {out}_off o ON o.source = c.source AND o.sheet = c.sheet
)"""
