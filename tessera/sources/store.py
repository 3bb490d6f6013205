"""The vector table (Parquet) and the jobs that fill it.

* A document is its ``source`` (path relative to the ingested folder); its
  version is a hash of its chunks.  ``chunk_id`` is what users see; it need
  not be unique across documents.
* ``write_vectors(mode="overwrite")`` is the snapshot (S9) and the default
  of a rebuild (S10), so re-running never duplicates rows.
* ``append_vectors`` (S8/S11) adds the documents whose version is not the
  stored one, under the next ingest number; ``load_vectors`` returns each
  document's latest version.  So a retried ingest adds nothing, an edited
  file replaces its old chunks, and files of equal names stay apart.  Rows are
  only ever added, never rewritten.
* A document that was read and has no chunks any more (emptied, cut to its
  header), and on request one that is no longer listed, gets a tombstone: one
  row without chunk under the next ingest number, in the same write as that
  ingest's chunks.  As the latest version of its document it hides the older
  rows when the table is read.  A file that can't be read keeps its chunks.
* ``row_key`` (ingest number, document, sheet, part) names a stored row; the
  search joins by it, see ``operators.search.search_chunks``.
* ``rebuild_store`` and ``add_documents`` write one log row per listed file
  beside the table (``<path>_log``).
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.embed import DEFAULT_DIM, embed_chunks
from ..operators.ids import ROW_KEY, with_row_key
from ..operators.scan import join_few
from ..session import SCRATCH_CODEC, cut_lineage, written
from .ingest import METHOD_TOKENS, STATUS_EMPTY, STATUS_OK, chunk, ingest_log, list_documents, scan_folder


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p)


def write_vectors(vectors: DataFrame, path: str, mode: str = "overwrite",
                  partition_by: tuple[str, ...] = ()) -> None:
    w = vectors.write.mode(mode).option("compression", SCRATCH_CODEC)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


VERSION, NUMBER = "doc_version", "ingest_no"
REMOVED = "removed"          # version of a tombstone


def _versions(chunks: DataFrame) -> DataFrame:
    """``source, doc_version``: a hash of the set of a document's chunks."""
    parts = [c for c in ("chunk_id", "content", "embedding") if c in chunks.columns]
    return chunks.groupBy("source").agg(F.concat_ws(":", F.count(F.lit(1)), F.bit_xor(F.xxhash64(*parts))).alias(VERSION))


def _latest(stored: DataFrame) -> DataFrame:
    """``source, ingest_no, doc_version`` of each document's last ingest."""
    return (stored.groupBy("source").agg(F.max(F.struct(NUMBER, VERSION)).alias("l"))
            .select("source", F.col("l." + NUMBER).alias(NUMBER), F.col("l." + VERSION).alias(VERSION)))


def _stored(spark: SparkSession, path: str) -> DataFrame:
    """The table with its helper columns (a snapshot has ingest number 0)."""
    df = spark.read.option("mergeSchema", "true").parquet(path)
    if NUMBER not in df.columns:
        df = df.withColumn(NUMBER, F.lit(0).cast("bigint")).withColumn(VERSION, F.lit(None).cast("string"))
    return df.withColumn(NUMBER, F.coalesce(NUMBER, F.lit(0).cast("bigint")))


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Every document's latest rows with their ``row_key``, without the
    helper columns; nothing of documents whose latest row is a tombstone."""
    df = _stored(spark, path)
    if "source" not in df.columns:
        return df.drop(NUMBER, VERSION)
    last = _latest(df).select("source", NUMBER)
    live = join_few(df.where(F.col("chunk_id").isNotNull()), last, ["source", NUMBER], "left_semi")
    return with_row_key(live, NUMBER).drop(NUMBER, VERSION)


def _tombstones(stored: DataFrame, gone: DataFrame, columns: list[str]) -> DataFrame:
    """One row without chunk for every live document among ``gone``."""
    last = _latest(stored).where(F.coalesce(VERSION, F.lit("")) != REMOVED)
    none = [F.lit(None).cast(stored.schema[c].dataType).alias(c) for c in columns if c not in ("source", VERSION)]
    return (last.join(gone.select("source").distinct(), "source", "left_semi")
            .select("source", F.lit(REMOVED).alias(VERSION), *none).select(*columns))


def append_vectors(vectors: DataFrame, path: str, read: DataFrame | None = None, listed: DataFrame | None = None) -> DataFrame:
    """Append the documents that are new or differ from what is stored;
    returns the rows added.  A table without ``source`` (plain vectors) is
    appended by ``chunk_id``.

    ``read`` (``source``): documents that were read, with chunks or without;
    stored ones of these without chunks in ``vectors`` are removed.
    ``listed`` (``source``): all documents there are; stored ones that are not
    among them are removed too."""
    spark = vectors.sparkSession
    vectors = vectors.drop(ROW_KEY)
    if "source" not in vectors.columns:
        new = vectors
        if _exists(spark, path):
            new = vectors.join(spark.read.parquet(path).select("chunk_id"), "chunk_id", "left_anti")
        new = cut_lineage(new.select(*vectors.columns))
        write_vectors(new, path, "append")
        return new
    number, versions = 1, cut_lineage(_versions(vectors))
    fresh = versions
    gone = []
    if _exists(spark, path):
        stored = _stored(spark, path)
        last = _latest(stored)
        # a snapshot has no versions yet: they follow from its rows
        known = (last.filter(F.col(VERSION).isNotNull())
                 .unionByName(last.filter(F.col(VERSION).isNull()).drop(VERSION)
                              .join(_versions(stored.filter(F.col(NUMBER) == 0)), "source").select("source", NUMBER, VERSION)))
        number = (stored.agg(F.max(NUMBER)).first()[0] or 0) + 1
        fresh = versions.join(known.select("source", VERSION), ["source", VERSION], "left_anti")
        if read is not None:
            gone.append(read.select("source").join(versions.select("source"), "source", "left_anti"))
        if listed is not None:
            gone.append(last.select("source").join(listed.select("source"), "source", "left_anti"))
    columns = [*vectors.columns, VERSION]
    rows = join_few(vectors, fresh, ["source"]).select(*columns)
    if gone:
        rows = rows.unionByName(_tombstones(stored, reduce(DataFrame.union, gone), columns))
    # fix the new rows before writing: read lazily afterwards, the anti-join
    # would see them in the store and report nothing added
    rows = cut_lineage(rows.withColumn(NUMBER, F.lit(number).cast("bigint")))
    write_vectors(rows, path, "append")
    return rows.where(F.col("chunk_id").isNotNull()).drop(VERSION, NUMBER)


def remove_documents(sources: DataFrame, path: str) -> int:
    """Tombstones for the documents named in ``source``; how many there were."""
    stored = _stored(sources.sparkSession, path)
    number = (stored.agg(F.max(NUMBER)).first()[0] or 0) + 1
    columns = [c for c in stored.columns if c != NUMBER]
    rows = cut_lineage(_tombstones(stored, sources, columns).withColumn(NUMBER, F.lit(number).cast("bigint")))
    write_vectors(rows, path, "append")
    return rows.count()


def _embedded(spark: SparkSession, root: str, method: str, dim: int, chunk_kw: dict):
    """The vectors of every file under ``root`` (not made yet), and a function
    that gives the log when they are written."""
    rows, errors = scan_folder(spark, root)
    return embed_chunks(chunk(rows, method, **chunk_kw), dim), lambda vectors: ingest_log(list_documents(spark, root), rows, vectors, errors)


def _replace(spark: SparkSession, vectors: DataFrame, path: str) -> None:
    """Write ``vectors`` beside ``path`` and put them in its place when they are whole."""
    fresh = f"{path.rstrip('/')}_new_{uuid.uuid4().hex[:12]}"
    write_vectors(vectors, fresh)
    jvm = spark.sparkContext._jvm
    at, to = jvm.org.apache.hadoop.fs.Path(fresh), jvm.org.apache.hadoop.fs.Path(path)
    fs = to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(to, True)
    if not fs.rename(at, to):
        raise OSError(f"{fresh} could not be renamed to {path}")


def rebuild_store(spark: SparkSession, root: str, path: str, method: str = METHOD_TOKENS,
                  dim: int = DEFAULT_DIM, **chunk_kw) -> DataFrame:
    """All files under ``root`` -> sheets -> chunks -> vectors -> overwrite."""
    vectors, log = _embedded(spark, root, method, dim, chunk_kw)
    _replace(spark, vectors, path)
    log(spark.read.parquet(path)).write.mode("overwrite").parquet(log_path(path))
    return load_vectors(spark, path)


def add_documents(spark: SparkSession, root: str, path: str, method: str = METHOD_TOKENS,
                  dim: int = DEFAULT_DIM, remove_missing: bool = False, **chunk_kw) -> DataFrame:
    """S11 (batch): chunk and embed the files under ``root``; new and changed
    documents are added, emptied ones removed, and with ``remove_missing``
    (``root`` holds all documents) those that are no longer there."""
    vectors, log = _embedded(spark, root, method, dim, chunk_kw)
    # read for the log, the versions and the new rows: embedded once
    vectors = written(vectors, "vectors")
    log = cut_lineage(log(vectors))
    added = append_vectors(vectors, path, read=log.where(F.col("status").isin(STATUS_OK, STATUS_EMPTY)),
                           listed=log.select("source") if remove_missing else None)
    log.write.mode("append").parquet(log_path(path))
    return added


def log_path(path: str) -> str:
    """Where the ingest log of a store lies."""
    return path.rstrip("/") + "_log"
