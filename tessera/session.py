"""Session-level helpers: shared scratch folders and size guards.

Library code never builds a SparkSession; it reads settings from the session
of the DataFrames it is given.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder shared by all executors: the session's ``spark.checkpoint.dir``.

    On a cluster this setting names shared storage and is always read, never
    overridden.  Only a local session without it (tests) gets a folder of its
    own; on a cluster a machine-local folder would be wrong, so that raises.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if d and not sc.getCheckpointDir():
        # named by the session only: apply it so that checkpoint() uses it
        sc.setCheckpointDir(d)
    if not d:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="tessera-ckpt-")
        sc.setCheckpointDir(d)
        d = sc.getCheckpointDir() or d
    return d.rstrip("/")


SCRATCH_CODEC = "zstd"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared folder."""
    return f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder (survives executor loss)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` read from Parquet in the shared folder: for rows with whole texts
    or vectors, which take less disk there than in a checkpoint."""
    at = scratch_path(df.sparkSession, name)
    df.write.option("compression", SCRATCH_CODEC).parquet(at)
    return df.sparkSession.read.parquet(at)


def bounded_count(df: DataFrame, limit: int) -> int:
    """Row count of ``df`` if it is at most ``limit``, else ``limit + 1``.

    Reads at most ``limit + 1`` rows, so the check itself stays cheap even on
    a huge input.
    """
    return df.limit(limit + 1).count()


BATCH_BYTES = "8m"
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ``BATCH_BYTES``, unless the application sets
    its own bound: rows hold whole texts, and at Spark's default (10,000 rows
    or 64 MB) a worker holds several copies of that much."""
    if spark.sparkContext.getConf().get(_BATCH_CONF) is None:
        spark.conf.set(_BATCH_CONF, BATCH_BYTES)


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``tessera`` importable in every Python worker (``addPyFile``).

    Operators run Python in ``mapInPandas``/``pandas_udf`` workers; on a
    cluster those processes do not see the driver's ``sys.path``.  The
    package is zipped once per application and distributed by Spark.
    """
    import os
    import zipfile

    bound_batches(spark)
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    out = os.path.join(tempfile.mkdtemp(prefix="tessera-pkg-"), "tessera.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _dirs, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    _SHIPPED.add(key)


def _bytes(text: str) -> int:
    t = str(text).strip().lower()
    for suffix, mult in (("kb", 1 << 10), ("mb", 1 << 20), ("gb", 1 << 30), ("k", 1 << 10), ("m", 1 << 20),
                         ("g", 1 << 30), ("b", 1)):
        if t.endswith(suffix):
            return int(float(t[: -len(suffix)]) * mult)
    return int(t)


def spread(df: DataFrame) -> DataFrame:
    """Round-robin a *small* input over the default parallelism before a
    Python-heavy step (a small file is a single scan task).

    The decision uses the optimizer's size estimate, so nothing is executed;
    an input larger than ``defaultParallelism x maxPartitionBytes`` already
    has enough partitions and passes through unchanged.
    """
    spark = df.sparkSession
    want = spark.sparkContext.defaultParallelism
    try:
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        part = _bytes(spark.conf.get("spark.sql.files.maxPartitionBytes", "128m"))
    except Exception:
        return df
    if size < want * part:
        return df.repartition(want)
    return df
