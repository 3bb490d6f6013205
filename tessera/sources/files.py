"""List files, read their bytes, keep a raw archive.

All three are ``binaryFile`` scans; listing selects only metadata columns,
so Spark prunes the ``content`` column and never reads file bodies.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx

RAW_PREFIX = "raw_docs/"   # fixed value: key prefix of the raw archive


def _reader(spark: SparkSession, glob: str | None, recursive: bool):
    r = spark.read.format("binaryFile")
    if glob:
        r = r.option("pathGlobFilter", glob)
    if recursive:
        r = r.option("recursiveFileLookup", "true")
    return r


def list_files(spark: SparkSession, root: str, glob: str | None = None, recursive: bool = True) -> DataFrame:
    """``path, name, length, modificationTime`` (no file body is read)."""
    df = _reader(spark, glob, recursive).load(root)
    return df.select("path", tx.file_name(F.col("path")).alias("name"), "length", "modificationTime")


def read_files(spark: SparkSession, root: str, glob: str | None = None, recursive: bool = True) -> DataFrame:
    """File bytes, one row per file (one task per file split)."""
    df = _reader(spark, glob, recursive).load(root)
    return df.select("path", tx.file_name(F.col("path")).alias("name"), "length", "content")


def relative_path(path, root: str):
    """Path of a file below ``root`` (decoded; the scheme doesn't matter)."""
    plain = lambda c: F.regexp_replace(F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), "^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?/*", "/")
    base = re.sub("^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?/*", "/", root).rstrip("/") + "/"
    full = plain(F.col(path) if isinstance(path, str) else path)
    return F.when(full.startswith(base), F.substr(full, F.lit(len(base) + 1))).otherwise(tx.file_name(full))


def archive_raw(files: DataFrame, out_path: str, mode: str = "append", root: str | None = None) -> DataFrame:
    """Keep raw bytes under ``raw_docs/<name>`` keys (Parquet table); with
    ``root``, the name is the path below it, so equal names of different
    folders keep a key each."""
    name = F.col("name") if root is None else relative_path("path", root)
    arch = files.select(F.concat(F.lit(RAW_PREFIX), name).alias("key"), "length", "content")
    arch.write.mode(mode).parquet(out_path)
    return arch.sparkSession.read.parquet(out_path)
