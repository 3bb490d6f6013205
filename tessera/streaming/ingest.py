"""Incremental document ingest with Structured Streaming.

A file stream (``binaryFile``, only paths are read by the stream itself)
drives ``foreachBatch``: each micro-batch's new files are scanned into
sheets, chunked and embedded, and written under ``epoch=<batch_id>`` with
``overwrite``, so a replayed epoch replaces its own output instead of
appending twice (exactly-once per file together with the checkpoint).
Every file of a batch gets a row in the log beside the output
(``<output>_log``), readable or not.

``<output>_manifest`` holds a row per file taken: name, digest of its bytes,
epoch.  It is written last, so an epoch counts once its manifest is there
(``read_ingested``), and what a broken run left behind is replaced when the
epoch is replayed.  A file whose bytes an earlier epoch has taken (a renamed or
copied file, also one delivered again to a new checkpoint) adds nothing and is
logged as ``duplicate``; so are all but one of equal files of one batch.  Files
over ``HASHED_BYTES`` are known by path, length and time of change.

K1/K3 need whole sheets, and a file never spans micro-batches, so chunking
per micro-batch is exact.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.embed import DEFAULT_DIM, embed_chunks
from ..session import cut_lineage
from ..sources.ingest import METHOD_TOKENS, chunk, ingest_log, relative_path, route, scan_folder
from ..sources.store import log_path

BINARY_FILE_SCHEMA = T.StructType([
    T.StructField("path", T.StringType(), False),
    T.StructField("modificationTime", T.TimestampType(), False),
    T.StructField("length", T.LongType(), False),
    T.StructField("content", T.BinaryType(), True),
])


HASHED_BYTES = 256 << 20
MANIFEST = "name string, digest string, epoch long"
STATUS_DUPLICATE = "duplicate"


def manifest_path(output_path: str) -> str:
    return output_path.rstrip("/") + "_manifest"


def read_manifest(spark: SparkSession, output_path: str) -> DataFrame:
    """``name, digest, epoch`` of the files that were taken."""
    try:
        return spark.read.schema(MANIFEST).parquet(manifest_path(output_path))
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], MANIFEST)


def read_ingested(spark: SparkSession, output_path: str) -> DataFrame:
    """The rows of all epochs whose manifest is written."""
    # one row an epoch
    done = read_manifest(spark, output_path).select("epoch").distinct()
    return spark.read.parquet(output_path).join(F.broadcast(done), "epoch", "left_semi")


def digests(spark: SparkSession, paths: list[str], root: str) -> DataFrame:
    """``path, name, digest`` of the files; bodies are hashed in the tasks
    that read them."""
    files = spark.read.format("binaryFile").load(paths).withColumn("name", relative_path("path", root))
    small = files.where(F.col("length") <= HASHED_BYTES).select("path", "name", F.sha2("content", 256).alias("digest"))
    mark = F.concat_ws(":", "path", F.col("length").cast("string"), F.col("modificationTime").cast("string"))
    large = files.where(F.col("length") > HASHED_BYTES).select("path", "name", mark.alias("digest"))
    return small.unionByName(large)


def ingest_stream(spark: SparkSession, input_dir: str, output_path: str, checkpoint: str,
                  method: str = METHOD_TOKENS, dim: int = DEFAULT_DIM, max_files_per_trigger: int = 64,
                  available_now: bool = True, **chunk_kw):
    """Start the stream; returns the ``StreamingQuery``."""
    files = (spark.readStream.format("binaryFile").schema(BINARY_FILE_SCHEMA)
             .option("recursiveFileLookup", "true")
             .option("maxFilesPerTrigger", max_files_per_trigger)
             .load(input_dir)
             .select("path"))

    def process(batch: DataFrame, batch_id: int):
        # the micro-batch holds at most max_files_per_trigger paths
        paths = [r["path"] for r in batch.select("path").collect()]
        if not paths:
            return
        seen = digests(spark, paths, input_dir)
        before = read_manifest(spark, output_path).where(F.col("epoch") != batch_id).groupBy("digest").agg(F.min("name").alias("taken"))
        first = Window.partitionBy("digest").orderBy("name")
        seen = cut_lineage(seen.join(before, "digest", "left").withColumn("taken", F.coalesce(
            "taken", F.when(F.row_number().over(first) > 1, F.first("name").over(first)))))
        # the micro-batch holds at most max_files_per_trigger paths
        fresh = [r["path"] for r in seen.where("taken IS NULL").select("path").collect()]
        rows, errors = scan_folder(spark, input_dir, fresh)
        chunks = cut_lineage(chunk(rows, method, **chunk_kw))
        embed_chunks(chunks, dim).write.mode("overwrite").parquet(f"{output_path}/epoch={batch_id}")
        log = ingest_log(route(seen.where("taken IS NULL").select("path", "name")), rows, chunks, errors)
        none = F.lit(0).cast("bigint")
        again = seen.where("taken IS NOT NULL").select(
            F.col("name").alias("source"), F.lit(STATUS_DUPLICATE).alias("status"), F.concat(F.lit("Same bytes as "), "taken").alias("error"),
            none.alias("n_sheets"), none.alias("n_chunks"))
        log.unionByName(again).write.mode("overwrite").parquet(f"{log_path(output_path)}/epoch={batch_id}")
        # last: from now on the epoch counts
        seen.where("taken IS NULL").select("name", "digest").write.mode("overwrite").parquet(f"{manifest_path(output_path)}/epoch={batch_id}")

    w = files.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
