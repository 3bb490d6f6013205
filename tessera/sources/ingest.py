"""Route files by extension, scan them into sheets, chunk
them, and log every file's outcome.

A document is known by its path relative to the folder that is ingested, so
files of equal names in different sub-folders stay apart.  One recursive
listing feeds the scan and the log, whichever job asks (folder ingest, store
rebuild, adding documents, stream).

CSV files are read by the splittable scan, workbooks by the workbook scan; files that cannot be read become
``ingest_log`` rows instead of stopping the job (``strict=True`` fails it).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chunk_marker import chunk_by_marker
from ..operators.chunk_recursive import chunk_recursive
from ..operators.chunk_tokens import chunk_by_tokens
from ..operators.scan import join_small
from ..schema import SHEET_ROWS
from .csv_source import scan_csv
from .files import list_files, read_files, relative_path
from .workbook import read_workbooks

# Fixed values of routing and logging.
KIND_CSV, KIND_XLSX, KIND_XLS, KIND_OTHER = "csv", "xlsx", "xls", "unsupported"
STATUS_OK, STATUS_REJECTED, STATUS_ERROR, STATUS_EMPTY = "ok", "rejected", "error", "empty"
CSV_GLOB = "*.[cC][sS][vV]"
XLSX_GLOB = "*.[xX][lL][sS][xX]"

METHOD_TOKENS = "Token Count"
METHOD_MARKER = "Test Number"
METHOD_RECURSIVE = "Recursive"


def route(files: DataFrame, name_col: str = "name", strict: bool = False) -> DataFrame:
    """``kind``, ``status`` and ``error`` from the (case-insensitive) extension."""
    lname = F.lower(F.col(name_col))
    kind = (F.when(lname.endswith(".csv"), F.lit(KIND_CSV))
             .when(lname.endswith(".xlsx"), F.lit(KIND_XLSX))
             .when(lname.endswith(".xls"), F.lit(KIND_XLS))
             .otherwise(F.lit(KIND_OTHER)))
    err = (F.when(kind == KIND_XLS, F.concat(F.lit("No reader for legacy workbook: "), lname))
            .when(kind == KIND_OTHER, F.concat(F.lit("Unsupported file extension: "), lname)))
    if strict:
        err = F.when(err.isNotNull(), F.raise_error(err))
    status = F.when(err.isNull(), F.lit(STATUS_OK)).otherwise(F.lit(STATUS_REJECTED))
    return files.withColumn("kind", kind).withColumn("status", status).withColumn("error", err)


def chunk(rows: DataFrame, method: str = METHOD_TOKENS, **kw) -> DataFrame:
    """K6: choose the chunker by name (a real parameter)."""
    if method == METHOD_TOKENS:
        return chunk_by_tokens(rows, **kw)
    if method == METHOD_MARKER:
        return chunk_by_marker(rows, **kw)
    if method == METHOD_RECURSIVE:
        return chunk_recursive(rows, **kw)
    raise ValueError(f"unknown chunking method {method!r}")


def list_documents(spark: SparkSession, root: str, strict: bool = False) -> DataFrame:
    """Every file under ``root`` with its relative path as ``name``,
    its kind and whether it can be read."""
    files = list_files(spark, root).withColumn("name", relative_path("path", root))
    return route(files, strict=strict)


def scan_folder(spark: SparkSession, root: str, paths: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """``(sheet_rows, file_errors)`` for every supported file under
    ``root``, sub-folders included (or for the given files below it).

    ``source`` is the path relative to ``root``.
    """
    chosen = lambda ext: [p for p in paths if p.lower().endswith(ext)]
    parts, errors = [], spark.createDataFrame([], "path string, error string")
    names = None if paths is None else chosen(".csv")
    csv = _found(lambda: scan_csv(spark, root, glob=CSV_GLOB)) if names is None else scan_csv(spark, names) if names else None
    if csv is not None:
        parts.append(csv[0])
        errors = csv[1]
    if paths is None:
        books = _found(lambda: read_files(spark, root, XLSX_GLOB))
    else:
        names = chosen(".xlsx")
        books = spark.read.format("binaryFile").load(names).select("path", "length", "content") if names else None
    if books is not None:
        wb = read_workbooks(books)
        parts.append(wb.where(F.col("error").isNull()).drop("error"))
        errors = errors.unionByName(wb.where(F.col("error").isNotNull()).select(F.col("source").alias("path"), "error"))
    if not parts:
        rows = spark.createDataFrame([], SHEET_ROWS)
    else:
        rows = reduce(DataFrame.unionByName, parts).withColumn("source", relative_path("source", root))
    return rows, errors.withColumn("path", relative_path("path", root))


def _found(read):
    """``read()``, or nothing when no file matches."""
    try:
        return read()
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            return None
        raise


def ingest_folder(spark: SparkSession, root: str, method: str = METHOD_MARKER,
                  strict: bool = False, **chunk_kw) -> tuple[DataFrame, DataFrame]:
    """``(chunks, ingest_log)``; bad files are logged, the rest go on."""
    files = list_documents(spark, root, strict)
    rows, errors = scan_folder(spark, root)
    chunks = chunk(rows, method, **chunk_kw)
    return chunks, ingest_log(files, rows, chunks, errors)


def ingest_log(files: DataFrame, rows: DataFrame, chunks: DataFrame, errors: DataFrame) -> DataFrame:
    """A2: one row per file: status, error, sheets with rows, chunks."""
    sheets = rows.groupBy("source").agg(F.countDistinct("sheet").alias("n_sheets"))
    counts = chunks.groupBy("source").agg(F.count(F.lit(1)).alias("n_chunks"))
    f = files.select(F.col("name").alias("source"), "status", "error")
    f = join_small(f, errors.select(F.col("path").alias("source"), F.col("error").alias("read_error")),
                   ["source"], "left")
    f = join_small(f, sheets, ["source"], "left")
    f = join_small(f, counts, ["source"], "left")
    status = (F.when(F.col("read_error").isNotNull(), F.lit(STATUS_ERROR))
               .when((F.col("status") == STATUS_OK) & F.coalesce(F.col("n_sheets"), F.lit(0)).__eq__(0),
                     F.lit(STATUS_EMPTY))
               .otherwise(F.col("status")))
    return f.select("source", status.alias("status"), F.coalesce("read_error", "error").alias("error"),
                    F.coalesce("n_sheets", F.lit(0)).cast("bigint").alias("n_sheets"),
                    F.coalesce("n_chunks", F.lit(0)).cast("bigint").alias("n_chunks"))
