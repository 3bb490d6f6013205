"""Registered queries: scalar text rules, file routing, sheets as text,
chunk ids, ingest log, CSV round trip, vector store round trip, the
recursive splitter and the streaming ingest."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.tokens import fallback_tokens
from ..operators.scan import row_ordinal
from ..sources.csv_source import MISSING_MARKERS
from . import bindings as B
from . import oracle as O
from .registry import K1_BUDGET, K1_OVERLAP, MARKER, _event_sql, register

NON_WS_SQL = O.q(tx.NON_WS)


def _docs(spark, sf):
    return B.document_rows(B.table(spark, sf, "documents"))


# -- P1 / P2 / P3 -----------------------------------------------------------------
@register("cells_clean", f"""
WITH {O.DOC_LINES.strip()},
c AS (SELECT source, sheet, row_idx, list_concat([cell], string_split(COALESCE(cell, ''), ',')) AS cells FROM doc_lines),
k AS (SELECT *, list_filter(cells, lambda x: x IS NOT NULL AND regexp_matches(x, {NON_WS_SQL})) AS kept FROM c)
SELECT source, sheet, row_idx, CAST(len(cells) AS BIGINT) AS n_cells,
       CAST(len(list_filter(cells, lambda x: x IS NOT NULL)) AS BIGINT) AS n_non_null,
       CAST(len(kept) AS BIGINT) AS n_kept, array_to_string(kept, '|') AS kept_text, len(kept) > 0 AS has_text
FROM k""")
def q_cells_clean(spark, sf):
    r = _docs(spark, sf)
    cells = F.concat(F.array(F.col("cells")[0]), F.split(F.coalesce(F.col("cells")[0], F.lit("")), ","))
    x = r.select("source", "sheet", "row_idx", cells.alias("c"))
    kept = tx.non_blank_cells("c")
    return x.select("source", "sheet", "row_idx", F.size("c").cast("bigint").alias("n_cells"),
                    F.size(tx.non_null_cells("c")).cast("bigint").alias("n_non_null"),
                    F.size(kept).cast("bigint").alias("n_kept"), F.array_join(kept, "|").alias("kept_text"),
                    (F.size(kept) > 0).alias("has_text"))


# -- customer as a sheet ------------------------------------------------------------
CUST_COLS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
CUST_FMT = {"c_acctbal": "%.2f"}
CUST_SQL = ["CAST(c_custkey AS VARCHAR)", "c_name", "CAST(c_nationkey AS VARCHAR)", "printf('%.2f', c_acctbal)",
            "c_mktsegment"]


def _customer_rows(spark, sf):
    return B.keyed_table_rows(B.table(spark, sf, "customer"), "customer", "c_custkey", CUST_COLS, CUST_FMT)


@register("row_text", f"""
SELECT c_custkey, concat_ws(' ', {', '.join(CUST_SQL)}) AS row_text,
       CAST(length(concat_ws(' ', {', '.join(CUST_SQL)})) // 5 AS BIGINT) AS tokens
FROM customer""")
def q_row_text(spark, sf):
    r = _customer_rows(spark, sf)
    t = tx.row_plain_text("cells")
    return r.select((F.col("row_idx") + 1).alias("c_custkey"), t.alias("row_text"), fallback_tokens(t).alias("tokens"))


@register("row_labelled", f"""
SELECT c_custkey, {O.labelled_line('c_custkey - 1', list(zip(CUST_COLS, CUST_SQL)))} AS line FROM customer""")
def q_row_labelled(spark, sf):
    r = _customer_rows(spark, sf)
    return r.select((F.col("row_idx") + 1).alias("c_custkey"),
                    tx.row_labelled_text("row_idx", "columns", "cells").alias("line"))


# customer split into one sheet per nation, with a column that needs CSV quoting
NATION_COLS = CUST_COLS + ["label"]
NATION_SQL = CUST_SQL + ["c_name || ', \"' || c_mktsegment || '\"'"]


def _nation_sheets(spark, sf):
    c = row_ordinal(B.table(spark, sf, "customer"), ["c_nationkey"], ["c_custkey"], "__pos")
    cells = [F.col(c_).cast("string") for c_ in CUST_COLS]
    cells[3] = F.format_string("%.2f", "c_acctbal")
    cells.append(F.concat(F.col("c_name"), F.lit(', "'), F.col("c_mktsegment"), F.lit('"')))
    return c.select(F.lit("customer.csv").alias("source"), F.concat(F.lit("nation_"), F.col("c_nationkey").cast("string")).alias("sheet"),
                    F.col("c_nationkey").cast("bigint").alias("sheet_pos"),
                    F.col("__pos").alias("row_idx"),
                    F.array(*[F.lit(x) for x in NATION_COLS]).alias("columns"), F.array(*cells).alias("cells"))


def _csv_field_sql(x: str) -> str:
    return (f"CASE WHEN ({x}) IS NULL THEN '' WHEN regexp_matches({x}, '[,\"\\n\\r]') "
            f"THEN '\"' || replace({x}, '\"', '\"\"') || '\"' ELSE {x} END")


NATION_BASE_SQL = f"""
nb AS (
  SELECT 'nation_' || CAST(c_nationkey AS VARCHAR) AS sheet, c_custkey,
         CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS BIGINT) AS row_idx,
         {', '.join(f'{e} AS v{i}' for i, e in enumerate(NATION_SQL))}
  FROM customer
)"""


@register("sheet_csv", f"""
WITH {NATION_BASE_SQL.strip()}
SELECT sheet, {O.q(','.join(NATION_COLS))} || chr(10) ||
       string_agg({" || ',' || ".join(_csv_field_sql(f'v{i}') for i in range(len(NATION_COLS)))}, chr(10) ORDER BY row_idx)
       || chr(10) AS csv_text
FROM nb GROUP BY sheet""")
def q_sheet_csv(spark, sf):
    from ..operators.chunk_recursive import sheet_csv_text
    return sheet_csv_text(_nation_sheets(spark, sf)).select("sheet", F.col("text").alias("csv_text"))


def _table_sql() -> str:
    n = len(NATION_COLS)
    wcols = ", ".join(f"greatest({len(c)}, 1 + max(length(v{i}))) AS w{i}" for i, c in enumerate(NATION_COLS))
    head = " || ' ' || ".join(f"lpad({O.q(c)}, CAST(w.w{i} AS INTEGER), ' ')" for i, c in enumerate(NATION_COLS))
    line = " || ' ' || ".join(f"lpad(b.v{i}, CAST(w.w{i} AS INTEGER), ' ')" for i in range(n))
    return f"""
WITH {NATION_BASE_SQL.strip()},
w AS (SELECT sheet, max(length(CAST(row_idx AS VARCHAR))) AS wi, {wcols} FROM nb GROUP BY sheet)
SELECT b.sheet, any_value(repeat(' ', CAST(w.wi AS INTEGER)) || ' ' || {head}) || chr(10) ||
       string_agg(rpad(CAST(b.row_idx AS VARCHAR), CAST(w.wi AS INTEGER), ' ') || ' ' || {line}, chr(10) ORDER BY b.row_idx) AS table_text
FROM nb b JOIN w ON w.sheet = b.sheet GROUP BY b.sheet"""


@register("rows_table", _table_sql())
def q_rows_table(spark, sf):
    from ..operators.chunk_tokens import rows_table
    return rows_table(_nation_sheets(spark, sf)).select("sheet", F.col("body").alias("table_text"))


# -- P10 / P11 / S6 on made-up file names ------------------------------------------
# Fixed test extensions, one per routing case.
EXTENSIONS = [".csv", ".XLSX", ".xls", ".pdf", ""]


def _doc_names(spark, sf):
    d = B.table(spark, sf, "documents")
    ext = F.element_at(F.array(*[F.lit(e) for e in EXTENSIONS]), (F.pmod(F.col("doc_id"), F.lit(5)) + 1).cast("int"))
    return d.select("doc_id", F.concat(F.col("source"), F.lit(".part"), F.col("doc_id").cast("string"), ext).alias("name"))


NAME_SQL = ("source || '.part' || CAST(doc_id AS VARCHAR) || "
            "CASE doc_id % 5 " + " ".join(f"WHEN {i} THEN {O.q(e)}" for i, e in enumerate(EXTENSIONS)) + " END")
BASE_SQL = "regexp_replace(name, '\\.[^./]*$', '')"


@register("base_name_id", f"""
WITH n AS (SELECT doc_id, {NAME_SQL} AS name FROM documents)
SELECT doc_id, name, {BASE_SQL} AS base, lower({BASE_SQL}) || '-' || CAST(doc_id AS VARCHAR) AS id_dash,
       {BASE_SQL} || '_' || CAST(doc_id AS VARCHAR) AS id_underscore
FROM n""")
def q_base_name_id(spark, sf):
    n = _doc_names(spark, sf)
    base = tx.base_name("name")
    return n.select("doc_id", "name", base.alias("base"), tx.chunk_id(F.lower(base), "-", F.col("doc_id")).alias("id_dash"),
                    tx.chunk_id(base, "_", F.col("doc_id")).alias("id_underscore"))


ROUTE_SQL = """
CASE WHEN ends_with(lower(name), '.csv') THEN 'csv' WHEN ends_with(lower(name), '.xlsx') THEN 'xlsx'
     WHEN ends_with(lower(name), '.xls') THEN 'xls' ELSE 'unsupported' END"""


@register("ext_route", f"""
WITH n AS (SELECT doc_id, {NAME_SQL} AS name FROM documents), k AS (SELECT *, {ROUTE_SQL} AS kind FROM n)
SELECT doc_id, name, kind, CASE WHEN kind IN ('csv', 'xlsx') THEN 'ok' ELSE 'rejected' END AS status,
       CASE WHEN kind = 'xls' THEN 'No reader for legacy workbook: ' || lower(name)
            WHEN kind = 'unsupported' THEN 'Unsupported file extension: ' || lower(name) END AS error
FROM k""")
def q_ext_route(spark, sf):
    from ..sources.ingest import route
    return route(_doc_names(spark, sf)).select("doc_id", "name", "kind", "status", "error")


# -- U1 / A4 -------------------------------------------------------------------------
@register("token_count", """
SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars, CAST(length(text) // 5 AS BIGINT) AS tokens FROM documents""")
def q_token_count(spark, sf):
    d = B.table(spark, sf, "documents")
    return d.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), fallback_tokens("text").alias("tokens"))


@register("line_count", f"""
SELECT doc_id, CAST({O.line_count('text')} AS BIGINT) AS n_lines,
       CAST({O.line_count("replace(text, chr(10), chr(13) || chr(10)) || chr(10)")} AS BIGINT) AS n_lines_crlf
FROM documents""")
def q_line_count(spark, sf):
    d = B.table(spark, sf, "documents")
    crlf = F.concat(F.replace(F.col("text"), F.lit("\n"), F.lit("\r\n")), F.lit("\n"))
    return d.select("doc_id", tx.line_count("text").alias("n_lines"), tx.line_count(crlf).alias("n_lines_crlf"))


# -- K7 / P5 / F3 / F4 -------------------------------------------------------------------
# Fixed label cells: plain label, labelled number, indented label, marker inside a cell, none.
LABEL_CELLS = ["TestNumber = 5;", "TestNumber Test Number: 3.1", "\tTestNumber Test Number 7", "see TestNumber = 9", None]
LABEL_MARKER = "TestNumber"


def _label_sql() -> str:
    case = "CASE row_idx % 5 " + " ".join(
        f"WHEN {i} THEN {O.q(c) if c is not None else 'NULL'}" for i, c in enumerate(LABEL_CELLS)) + " END"
    return case.replace("\t", "' || chr(9) || '")


@register("section_label", f"""
WITH {O.DOC_LINES.strip()},
c AS (SELECT source, sheet, row_idx, {_label_sql()} AS lab, cell FROM doc_lines)
SELECT source, sheet, row_idx, {O.marker_any(['lab', 'cell'], LABEL_MARKER)} AS is_marker,
       {O.section_label(['lab', 'cell'], LABEL_MARKER)} AS label
FROM c""")
def q_section_label(spark, sf):
    r = _docs(spark, sf)
    lab = F.element_at(F.array(*[F.lit(c) for c in LABEL_CELLS]), (F.pmod(F.col("row_idx"), F.lit(5)) + 1).cast("int"))
    x = r.select("source", "sheet", "row_idx", F.array(lab, F.col("cells")[0]).alias("c"))
    return x.select("source", "sheet", "row_idx", tx.has_marker_cell("c", LABEL_MARKER).alias("is_marker"),
                    tx.section_label("c", LABEL_MARKER).alias("label"))


# -- W4 / Q1 ---------------------------------------------------------------------------
@register("chunk_ids", f"""
WITH RECURSIVE {O.DOC_LINES.strip()},
{O.k1_bounds('doc_lines', 'COALESCE(length(cell), 0) // 5', K1_BUDGET, K1_OVERLAP).strip()},
{O.chunk_ids('k1', '_', 'k1_ids').strip()},
{_event_sql(False).strip()}
SELECT chunk_id, 'Token Count' AS chunk_type, source, sheet, part FROM k1_ids
UNION ALL
SELECT chunk_id, chunk_type, source, sheet, part FROM mk_ids""")
def q_chunk_ids(spark, sf):
    from ..operators.chunk_marker import chunk_by_marker
    from ..operators.chunk_tokens import chunk_by_tokens
    from ..operators.ids import union_chunks
    a = chunk_by_tokens(_docs(spark, sf), K1_BUDGET, K1_OVERLAP, with_text=False)
    b = chunk_by_marker(B.event_rows(B.table(spark, sf, "events")), MARKER, with_text=False)
    return union_chunks(a, b).select("chunk_id", "chunk_type", "source", "sheet", "part")


# -- S7 / A2 -----------------------------------------------------------------------------
@register("ingest_log", f"""
WITH RECURSIVE n AS (SELECT doc_id, {NAME_SQL} AS name FROM documents),
k AS (SELECT *, {ROUTE_SQL} AS kind FROM n),
ok AS (SELECT doc_id, name FROM k WHERE kind IN ('csv', 'xlsx')),
doc_arr AS (
  SELECT ok.name AS source, 'doc' || CAST(d.doc_id AS VARCHAR) AS sheet, d.doc_id AS sheet_pos,
         string_split(d.text, chr(10)) AS arr
  FROM documents d JOIN ok ON ok.doc_id = d.doc_id WHERE d.text IS NOT NULL AND length(d.text) > 0
),
doc_lines AS (
  SELECT source, sheet, sheet_pos, CAST(unnest(range(len(arr))) AS BIGINT) AS row_idx, NULLIF(unnest(arr), '') AS cell
  FROM doc_arr
),
{O.k1_bounds('doc_lines', 'COALESCE(length(cell), 0) // 5', K1_BUDGET, K1_OVERLAP).strip()},
sh AS (SELECT source, count(DISTINCT sheet) AS n_sheets FROM doc_lines GROUP BY source),
ch AS (SELECT source, count(*) AS n_chunks FROM k1 GROUP BY source)
SELECT k.name AS source,
       CASE WHEN kind NOT IN ('csv', 'xlsx') THEN 'rejected' WHEN COALESCE(sh.n_sheets, 0) = 0 THEN 'empty' ELSE 'ok' END AS status,
       CASE WHEN kind = 'xls' THEN 'No reader for legacy workbook: ' || lower(k.name)
            WHEN kind = 'unsupported' THEN 'Unsupported file extension: ' || lower(k.name) END AS error,
       CAST(COALESCE(sh.n_sheets, 0) AS BIGINT) AS n_sheets, CAST(COALESCE(ch.n_chunks, 0) AS BIGINT) AS n_chunks
FROM k LEFT JOIN sh ON sh.source = k.name LEFT JOIN ch ON ch.source = k.name""")
def q_ingest_log(spark, sf):
    from ..operators.chunk_tokens import chunk_by_tokens
    from ..sources.ingest import ingest_log, route
    files = route(_doc_names(spark, sf))
    ok = files.where(F.col("status") == "ok").select("doc_id", F.col("name").alias("__name"))
    docs = B.table(spark, sf, "documents").join(ok, "doc_id").withColumn("source", F.col("__name")).drop("__name")
    rows = B.document_rows(docs)
    chunks = chunk_by_tokens(rows, K1_BUDGET, K1_OVERLAP, with_text=False)
    errors = spark.createDataFrame([], "path string, error string")
    return ingest_log(files, rows, chunks, errors)


# -- S3 / S5: CSV round trip through the shared folder ------------------------------------
@register("csv_scan", f"""
SELECT c_custkey, c_name, c_nationkey, printf('%.2f', c_acctbal) AS c_acctbal, c_mktsegment,
       c_name || ', "' || c_mktsegment || '"' AS label, {O.q(','.join(NATION_COLS))} AS header, 'CSV' AS sheet
FROM customer""")
def q_csv_scan(spark, sf):
    from ..session import scratch_path
    from ..sources.csv_source import read_csv_sheets
    c = B.table(spark, sf, "customer")
    out = scratch_path(spark, "csv-scan")
    (c.select(F.col("c_custkey").cast("string"), "c_name", F.col("c_nationkey").cast("string"),
              F.format_string("%.2f", "c_acctbal").alias("c_acctbal"), "c_mktsegment",
              F.concat(F.col("c_name"), F.lit(', "'), F.col("c_mktsegment"), F.lit('"')).alias("label"))
      .write.option("header", True).option("escape", '"').option("quoteAll", False).csv(out))
    r = read_csv_sheets(spark, out)
    cell = lambda i: F.col("cells")[i]
    return r.select(cell(0).cast("bigint").alias("c_custkey"), cell(1).alias("c_name"),
                    cell(2).cast("int").alias("c_nationkey"), cell(3).alias("c_acctbal"), cell(4).alias("c_mktsegment"),
                    cell(5).alias("label"), F.array_join("columns", ",").alias("header"), "sheet")


# -- S1 / S2 / S8 / S9 / S12: vector store round trip ---------------------------------------
@register("store_roundtrip", """
SELECT vec_id, label, CAST(len(embedding) AS BIGINT) AS dim, round(list_sum(embedding::DOUBLE[]), 4) AS esum
FROM embeddings""")
def q_store_roundtrip(spark, sf):
    from ..session import scratch_path
    from ..sources.files import list_files
    from ..sources.store import append_vectors, load_vectors, write_vectors
    e = B.table(spark, sf, "embeddings")
    v = e.select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("chunk_id"), "vec_id", "label", "embedding")
    path = scratch_path(spark, "store")
    write_vectors(v, path, "overwrite")          # S9 snapshot
    append_vectors(v, path)                       # S8 idempotent append: nothing new
    n_files = list_files(spark, path, glob="*.parquet").count()   # S1 listing, no bodies read
    if n_files == 0:
        raise RuntimeError("store write produced no files")
    back = load_vectors(spark, path)
    esum = F.aggregate("embedding", F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double"))
    return back.select("vec_id", "label", F.size("embedding").cast("bigint").alias("dim"),
                       F.round(esum, 4).alias("esum"))


# -- K2: pieces (blocks between blank lines, lines, words), runs of short ones, merge chain --------
K2_BUDGET, K2_OVERLAP = 200, 20
_SHEET = "source, sheet"
_K2_SQL = f"""
WITH RECURSIVE {O.DOC_LINES.strip()},
ln AS (
  SELECT source, sheet, sheet_pos, row_idx + 1 AS k, CASE WHEN cell IS NULL THEN '' WHEN regexp_matches(cell, '[,"\\n\\r]')
         THEN '"' || replace(cell, '"', '""') || '"' ELSE cell END AS l, false AS fin FROM doc_lines
  UNION ALL SELECT source, sheet, max(sheet_pos), 0, 'text', false FROM doc_lines GROUP BY {_SHEET}
  UNION ALL SELECT source, sheet, max(sheet_pos), max(row_idx) + 2, '', true FROM doc_lines GROUP BY {_SHEET}
),
pc AS (SELECT *, CASE WHEN k = 0 THEN l ELSE chr(10) || l END AS piece, l = '' AND k > 0 AND NOT fin AS e FROM ln),
nl AS (SELECT *, k - 1 - max(CASE WHEN NOT e THEN k END) OVER (PARTITION BY {_SHEET} ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM pc),
bl AS (SELECT *, sum(CASE WHEN e AND r % 2 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY {_SHEET} ORDER BY k) AS blk, bool_or(e) OVER (PARTITION BY {_SHEET}) AS has FROM nl),
bt AS (SELECT *, has AND sum(length(piece)) OVER (PARTITION BY {_SHEET}, blk) // 5 < {K2_BUDGET} AS whole FROM bl),
wd AS (SELECT source, sheet, sheet_pos, k, unnest(string_split(piece, ' ')) AS w, unnest(range(len(string_split(piece, ' ')))) AS j
       FROM bt WHERE NOT whole AND length(piece) // 5 >= {K2_BUDGET}),
items AS (
  SELECT source, sheet, max(sheet_pos) AS sheet_pos, min(k) AS k, 0 AS j, string_agg(piece, '' ORDER BY k) AS txt, 'b' AS g FROM bt WHERE whole GROUP BY {_SHEET}, blk
  UNION ALL SELECT source, sheet, sheet_pos, k, 0, piece, 'l' || blk FROM bt WHERE NOT whole AND length(piece) // 5 < {K2_BUDGET}
  UNION ALL SELECT source, sheet, sheet_pos, k, j, CASE WHEN j = 0 THEN w ELSE ' ' || w END,
                   CASE WHEN length(w) + CASE WHEN j = 0 THEN 0 ELSE 1 END >= 5 * {K2_BUDGET} THEN 'x' || k || '.' || j ELSE 'w' || k END
  FROM wd WHERE j > 0 OR w <> ''
),
ru AS (SELECT *, sum(CASE WHEN g IS DISTINCT FROM pg THEN 1 ELSE 0 END) OVER (PARTITION BY {_SHEET} ORDER BY k, j) AS run
       FROM (SELECT *, lag(g) OVER (PARTITION BY {_SHEET} ORDER BY k, j) AS pg FROM items)),
tk AS (SELECT *, length(txt) // 5 AS tok, row_number() OVER (PARTITION BY {_SHEET}, run ORDER BY k, j) - 1 AS i FROM ru),
it AS (SELECT *, sum(tok) OVER (PARTITION BY {_SHEET}, run ORDER BY i) AS p_in, sum(tok) OVER (PARTITION BY {_SHEET}, run ORDER BY i) - tok AS p_ex FROM tk),
ends AS (SELECT a.source, a.sheet, a.run, a.i AS s, min(b.i) AS e FROM it a JOIN it b
         ON a.source = b.source AND a.sheet = b.sheet AND a.run = b.run AND b.i > a.i AND b.p_in > a.p_ex + {K2_BUDGET} GROUP BY ALL),
starts AS (SELECT e.source, e.sheet, e.run, e.i AS e, min(x.i) AS s FROM it e JOIN it x
           ON e.source = x.source AND e.sheet = x.sheet AND e.run = x.run AND x.i <= e.i AND e.p_ex - x.p_ex <= {K2_OVERLAP}
              AND (e.p_in - x.p_ex <= {K2_BUDGET} OR e.p_ex = x.p_ex) GROUP BY ALL),
chain AS (
  SELECT source, sheet, run, CAST(0 AS BIGINT) AS s FROM it WHERE i = 0
  UNION ALL
  SELECT c.source, c.sheet, c.run, st.s FROM chain c
  JOIN ends ON ends.source = c.source AND ends.sheet = c.sheet AND ends.run = c.run AND ends.s = c.s
  JOIN starts st ON st.source = c.source AND st.sheet = c.sheet AND st.run = c.run AND st.e = ends.e
),
dc AS (
  SELECT c.source, c.sheet, max(it.sheet_pos) AS sheet_pos, c.run, c.s, {O.strip("string_agg(it.txt, '' ORDER BY it.i)")} AS content
  FROM chain c LEFT JOIN ends ON ends.source = c.source AND ends.sheet = c.sheet AND ends.run = c.run AND ends.s = c.s
  JOIN it ON it.source = c.source AND it.sheet = c.sheet AND it.run = c.run AND it.i >= c.s AND it.i < coalesce(ends.e, 1000000000)
  GROUP BY c.source, c.sheet, c.run, c.s
),
k2 AS (SELECT source, sheet, sheet_pos, content, row_number() OVER (PARTITION BY {_SHEET} ORDER BY run, s) - 1 AS part FROM dc WHERE content <> ''),
{O.chunk_ids('k2', '-', 'k2_ids').strip()}
SELECT lower(chunk_id) AS chunk_id, source, sheet, part, CAST({O.line_count('content')} AS BIGINT) AS num_rows, content FROM k2_ids"""


@register("chunk_recursive", _K2_SQL)
def q_chunk_recursive(spark, sf):
    from ..operators.chunk_recursive import chunk_recursive
    ch = chunk_recursive(_docs(spark, sf), budget=K2_BUDGET, overlap=K2_OVERLAP)
    return ch.select("chunk_id", "source", "sheet", "part", "num_rows", "content")


# -- T1 / S11: documents as CSV files, one folder each, taken by the stream ----------------
N_FILES = 16
_ROW_TEXT = "sheet || ' ' || row_idx || coalesce(' ' || cell, '')"
#: rows of the CSV files in file order: source is the folder
FILE_LINES = f"""
file_lines AS (
  SELECT CAST(sheet_pos % {N_FILES} AS VARCHAR) AS source, 'CSV' AS sheet, CAST(0 AS BIGINT) AS sheet_pos,
         row_number() OVER (PARTITION BY sheet_pos % {N_FILES} ORDER BY sheet_pos, row_idx) - 1 AS row_idx, {_ROW_TEXT} AS line
  FROM (SELECT sheet, sheet_pos, row_idx, CASE WHEN cell IN ({', '.join(O.q(m) for m in MISSING_MARKERS)}) THEN NULL ELSE cell END AS cell FROM doc_lines)
)"""


def _rename(spark, path, name):
    """Give the only file of every folder under ``path`` the name ``name``."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for d in fs.listStatus(at):
        if d.isDirectory():
            for f in fs.listStatus(d.getPath()):
                if f.getPath().getName().startswith("part-"):
                    fs.rename(f.getPath(), jvm.org.apache.hadoop.fs.Path(d.getPath(), name))


def write_document_files(spark, sf, path, rows=None):
    """The given documents as CSV files (sheet, row_idx, text), ``n.csv`` in
    each of ``N_FILES`` folders."""
    rows = _docs(spark, sf) if rows is None else rows
    rows = rows.select(F.pmod("sheet_pos", F.lit(N_FILES)).cast("int").alias("part"), "sheet", "sheet_pos", "row_idx",
                       F.col("cells")[0].alias("text"))
    (rows.repartitionById(N_FILES, "part").sortWithinPartitions("part", "sheet_pos", "row_idx").drop("sheet_pos")
         .write.mode("append").partitionBy("part").option("header", True).option("escape", '"')
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    _rename(spark, path, "n.csv")


def _folder(c):
    return F.regexp_extract(c, "part=([0-9]+)/", 1)


@register("ingest_stream", f"""
WITH RECURSIVE {O.DOC_LINES.strip()},
{FILE_LINES.strip()},
{O.k1_bounds('file_lines', 'length(line) // 5', K1_BUDGET, K1_OVERLAP).strip()}
SELECT source AS folder, CAST(part AS VARCHAR) AS number, part, start_row, end_row, total_rows, total_parts FROM k1""")
def q_ingest_stream(spark, sf):
    from ..session import scratch_path
    from ..streaming.ingest import ingest_stream, read_ingested
    src, out, ckpt = (scratch_path(spark, f"stream-{x}") for x in ("in", "out", "ckpt"))
    write_document_files(spark, sf, src)
    q = ingest_stream(spark, src, out, ckpt, max_tokens=K1_BUDGET, overlap_tokens=K1_OVERLAP, max_files_per_trigger=8)
    q.awaitTermination()
    v = read_ingested(spark, out)
    return v.select(_folder("source").alias("folder"), F.regexp_extract("chunk_id", "_([0-9]+)$", 1).alias("number"),
                    "part", "start_row", "end_row", "total_rows", "total_parts")


# -- S7-S11 / J2 / P11: files of equal names, edited, emptied, deleted, unsupported ---------
EDITED, EMPTIED, DELETED = 0, 1, 2


def _changed_store(spark, sf):
    """A store built from the documents' files, then brought up to date with a
    folder in which one file is edited, one cut to its header, one gone, and
    one of an unsupported kind and one that breaks off in a quoted cell are
    new: ``(store path, log of both)``."""
    from ..session import scratch_path
    from ..sources.store import add_documents, log_path, rebuild_store
    first, second, store = (scratch_path(spark, f"files-{x}") for x in ("first", "second", "store"))
    rows = _docs(spark, sf)
    write_document_files(spark, sf, first)
    part = F.pmod("sheet_pos", F.lit(N_FILES))
    write_document_files(spark, sf, second, rows.where(~part.isin(EMPTIED, DELETED) & ((part != EDITED) | (F.col("row_idx") > 0))))
    head = rows.limit(0).select("sheet", "row_idx", F.col("cells")[0].alias("text"))
    head.coalesce(1).write.option("header", True).csv(f"{second}/part={EMPTIED}")
    _rename(spark, second, "n.csv")
    rows.select("sheet").limit(1).coalesce(1).write.text(f"{second}/part={N_FILES}")
    _rename(spark, second, "n.txt")
    rows.limit(1).select(F.concat(F.lit('text\n"'), "sheet").alias("value")).coalesce(1).write.text(f"{second}/part={N_FILES + 1}")
    _rename(spark, second, "n.csv")
    kw = {"max_tokens": K1_BUDGET, "overlap_tokens": K1_OVERLAP}
    rebuild_store(spark, first, store, **kw)
    add_documents(spark, second, store, remove_missing=True, **kw)
    return store, spark.read.parquet(log_path(store))


@register("ingest_files", f"""
WITH RECURSIVE {O.DOC_LINES.replace("FROM doc_arr", f"FROM doc_arr WHERE sheet_pos % {N_FILES} NOT IN ({EMPTIED}, {DELETED})").strip()},
edited AS (SELECT * FROM doc_lines WHERE sheet_pos % {N_FILES} <> {EDITED} OR row_idx > 0),
{FILE_LINES.replace("FROM doc_lines", "FROM edited").strip()},
{O.k1_bounds('file_lines', 'length(line) // 5', K1_BUDGET, K1_OVERLAP).strip()}
SELECT CAST(source AS INT) AS folder, 'n_' || part AS chunk_id, start_row, end_row, total_rows, 'ok' AS status FROM k1
UNION ALL SELECT {EMPTIED}, NULL, NULL, NULL, NULL, 'empty'
UNION ALL SELECT {N_FILES}, NULL, NULL, NULL, NULL, 'rejected'
UNION ALL SELECT {N_FILES + 1}, NULL, NULL, NULL, NULL, 'error'""")
def q_ingest_files(spark, sf):
    """Chunks that are left in the store, and the files without any by the log."""
    from ..sources.store import load_vectors
    store, log = _changed_store(spark, sf)
    live = load_vectors(spark, store).select(_folder("source").cast("int").alias("folder"), "source", "chunk_id", "start_row", "end_row", "total_rows")
    # the last status of every file that the second folder has
    status = log.groupBy("source").agg(F.min_by("status", F.when(F.col("status") != "ok", 0).otherwise(1)).alias("status"))
    out = live.join(status, "source", "full").withColumn("folder", _folder("source").cast("int"))
    return out.where("chunk_id IS NOT NULL OR status <> 'ok'").select("folder", "chunk_id", "start_row", "end_row", "total_rows", "status")


FILE_HITS = 3


@register("search_files", f"""
SELECT item_id AS query_id, CAST({FILE_HITS} AS BIGINT) AS n_hits, CAST({FILE_HITS} AS BIGINT) AS n_right, CAST({FILE_HITS} AS BIGINT) AS n_live
FROM benchmark WHERE text IS NOT NULL""")
def q_search_files(spark, sf):
    """Questions against the store of files that all share one name: hits a
    question, hits whose text is of their own file and rows, and hits in
    folders that are still there."""
    from ..operators.embed import embed_queries
    from ..operators.search import search_chunks
    from ..sources.store import load_vectors
    from .flagship import benchmark_questions
    store, _ = _changed_store(spark, sf)
    qv = embed_queries(benchmark_questions(spark, sf).where(F.col("query").isNotNull()))
    hits = search_chunks(qv, load_vectors(spark, store), FILE_HITS, columns=("source", "start_row", "end_row", "content"))
    own = F.concat(F.lit("Source: "), F.col("source"), F.lit("\nRows "), F.col("start_row").cast("string"), F.lit("-"), F.col("end_row").cast("string"), F.lit(":"))
    live = ~_folder("source").cast("int").isin(EMPTIED, DELETED)
    return hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_hits"), F.count_if(F.contains("content", own)).alias("n_right"),
                                        F.count_if(live).alias("n_live"))


# -- S1 / S2 / S12: listing, bytes and the raw archive of nested files of one name -----------
@register("raw_archive", f"""
WITH {O.DOC_LINES.strip()},
f AS (SELECT sheet_pos % {N_FILES} AS part, string_agg(coalesce(cell, '') || chr(10), '' ORDER BY sheet_pos, row_idx) AS body FROM doc_lines GROUP BY 1)
SELECT 'raw_docs/part=' || part || '/n.txt' AS key, CAST(strlen(body) AS BIGINT) AS length, CAST(strlen(body) AS BIGINT) AS listed, md5(body) AS digest FROM f""")
def q_raw_archive(spark, sf):
    from ..session import scratch_path
    from ..sources.files import RAW_PREFIX, archive_raw, list_files, read_files, relative_path
    src = scratch_path(spark, "raw-in")
    rows = _docs(spark, sf).select(F.pmod("sheet_pos", F.lit(N_FILES)).cast("int").alias("part"), "sheet_pos", "row_idx",
                                   F.coalesce(F.col("cells")[0], F.lit("")).alias("value"))
    (rows.repartition(N_FILES, "part").sortWithinPartitions("part", "sheet_pos", "row_idx").select("part", "value")
         .write.partitionBy("part").text(src))
    _rename(spark, src, "n.txt")
    kept = archive_raw(read_files(spark, src, "*.txt"), scratch_path(spark, "raw-out"), root=src)
    listed = list_files(spark, src).select(F.concat(F.lit(RAW_PREFIX), relative_path("path", src)).alias("key"), F.col("length").alias("listed"))
    return kept.join(listed, "key").select("key", "length", "listed", F.md5("content").alias("digest"))


# -- K6: one entry point, the chunker by name ----------------------------------------------
@register("chunk_by_method", f"""
{_K2_SQL[:_K2_SQL.rindex('SELECT lower(chunk_id)')].rstrip()},
{O.k1_bounds('doc_lines', 'COALESCE(length(cell), 0) // 5', K1_BUDGET, K1_OVERLAP).strip()}
SELECT 'Token Count' AS method, source, count(*) AS n_chunks FROM k1 GROUP BY source
UNION ALL SELECT 'Test Number', source, count(DISTINCT sheet) FROM doc_lines GROUP BY source
UNION ALL SELECT 'Recursive', source, count(*) FROM k2 GROUP BY source""")
def q_chunk_by_method(spark, sf):
    """Chunks a source by each of the three chunkers (no document has a line
    that begins with the marker, so each is one full-sheet chunk there)."""
    from ..operators.ids import union_chunks
    from ..sources.ingest import METHOD_MARKER, METHOD_RECURSIVE, METHOD_TOKENS, chunk
    args = {METHOD_TOKENS: {"max_tokens": K1_BUDGET, "overlap_tokens": K1_OVERLAP, "with_text": False},
            METHOD_MARKER: {"marker": "\u0001", "with_text": False}, METHOD_RECURSIVE: {"budget": K2_BUDGET, "overlap": K2_OVERLAP}}
    parts = [chunk(_docs(spark, sf), m, **kw).select(F.lit(m).alias("method"), "source", "sheet", "part") for m, kw in args.items()]
    return union_chunks(*parts).groupBy("method", "source").agg(F.count(F.lit(1)).alias("n_chunks"))


# -- U2: another embedder -------------------------------------------------------------------
@register("embed_plugin", f"""
SELECT doc_id, CAST(length(coalesce(text, '')) AS DOUBLE) AS chars, CAST({O.line_count("coalesce(text, '')")} AS DOUBLE) AS lines FROM documents""")
def q_embed_plugin(spark, sf):
    """A caller's embedder over whole texts: characters and lines."""
    from ..operators.embed import embed_with
    d = B.table(spark, sf, "documents").select("doc_id", "text")
    v = embed_with(d, "text", lambda s: [(float(len(t)), float(len(t.splitlines()))) for t in s])
    return v.select("doc_id", F.col("embedding")[0].cast("double").alias("chars"), F.col("embedding")[1].cast("double").alias("lines"))
