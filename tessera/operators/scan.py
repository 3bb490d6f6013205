"""Skew-safe building blocks used by several operators.

A single sheet, source or section may hold a large share of all rows.  A
window or ``collect_list`` partitioned by that key would put all of it into
one task, so the helpers below split each key into fixed-size blocks of its
ordinal: per-block partials are computed in parallel, the (small) block
table is scanned per key, and the result is joined back on ``(key, block)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 1 << 14          # rows per block of one key


def join_small(big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join a per-group summary (one row per key) back to its detail rows.

    No broadcast hint: adaptive execution measures the finished summary
    stage and switches to a broadcast join only when its real size is under
    ``spark.sql.adaptive.autoBroadcastJoinThreshold``; otherwise it stays a
    shuffled join, and a hot key on the detail side is split by the
    skew-join rule.
    """
    return big.join(small, list(on), how)


#: a summary is broadcast up to this many rows and values
FEW_ROWS = 2_000
FEW_VALUES = 200_000


def join_few(big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner", values=None, rows: int = FEW_ROWS) -> DataFrame:
    """``join_small`` for a summary by file, which usually has few rows while
    ``big`` holds whole texts: adaptive execution would only see that after
    ``big`` was shuffled, by as many keys as there are files.  The summary is
    written once and broadcast if it has at most ``rows`` rows (and, of
    rows that hold a number of ``values`` each, at most ``FEW_VALUES``)."""
    from ..session import cut_lineage

    small = cut_lineage(small)
    size = small.agg(F.count(F.lit(1)).alias("n"), F.sum(F.lit(0) if values is None else values).alias("v")).first()
    if size["n"] <= rows and (size["v"] or 0) <= FEW_VALUES:
        return big.join(F.broadcast(small), list(on), how)
    return join_small(big, small, on, how)


def running_sum(df: DataFrame, keys: Sequence[str], pos: str, value, out: str,
                block: int = BLOCK_ROWS) -> DataFrame:
    """Inclusive running sum of ``value`` per ``keys`` in ``pos`` order.

    ``pos`` must be a non-negative ordinal within the key (as ``row_idx``);
    gaps are allowed and only leave blocks less full.
    Equals ``sum(value) over (partition by keys order by pos)`` but no task
    ever holds more than ``block`` rows of one key.
    """
    keys = list(keys)
    val = F.col(value) if isinstance(value, str) else value
    b = "__blk"
    x = df.withColumn(b, F.floor(F.col(pos) / block)).withColumn("__v", val.cast("bigint"))
    totals = x.groupBy(*keys, b).agg(F.sum("__v").alias("__tot"))
    w_blocks = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, b, F.coalesce(F.sum("__tot").over(w_blocks), F.lit(0)).alias("__off"))
    w_rows = Window.partitionBy(*keys, b).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return (x.join(offsets, keys + [b], "inner")
             .withColumn(out, (F.col("__off") + F.sum("__v").over(w_rows)).cast("bigint"))
             .drop(b, "__v", "__off"))


def ordered_text(df: DataFrame, keys: Sequence[str], order: str, text: str, sep: str,
                 out: str, block: int = BLOCK_ROWS, extra_aggs: Sequence = ()) -> DataFrame:
    """Ordered string aggregate (``string_agg(text, sep order by order)``).

    Two levels: rows are joined per ``(keys, order // block)`` first, then the
    block texts per key.  Null texts are skipped; keys whose texts are all
    null get an empty string.  ``extra_aggs`` are (level-1 expr, level-2
    combiner name, alias) triples for side aggregates such as counts.
    """
    keys = list(keys)
    b = "__blk"
    x = df.withColumn(b, F.floor(F.col(order) / block))
    lvl1_aggs = [
        F.array_sort(F.collect_list(F.when(F.col(text).isNotNull(), F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))).alias("__parts"),
    ]
    for expr, _comb, alias in extra_aggs:
        lvl1_aggs.append(expr.alias(alias))
    part = (x.groupBy(*keys, b).agg(*lvl1_aggs)
             .select(*keys, b,
                     F.when(F.size("__parts") > 0,
                            F.array_join(F.transform("__parts", lambda s: s["t"]), sep)).alias("__ptext"),
                     *[F.col(a) for _e, _c, a in extra_aggs]))
    combiners = {"sum": F.sum, "min": F.min, "max": F.max}
    lvl2 = [F.array_sort(F.collect_list(F.when(F.col("__ptext").isNotNull(),
                                               F.struct(F.col(b).alias("o"), F.col("__ptext").alias("t"))))).alias("__blocks")]
    for _e, comb, alias in extra_aggs:
        lvl2.append(combiners[comb](alias).alias(alias))
    return (part.groupBy(*keys).agg(*lvl2)
                .select(*keys, F.array_join(F.transform("__blocks", lambda s: s["t"]), sep).alias(out),
                        *[F.col(a) for _e, _c, a in extra_aggs]))


def group_offsets(counts: DataFrame, keys: Sequence[str], order: Sequence[str], n: str, out: str) -> DataFrame:
    """Exclusive running total of ``n`` per ``keys`` in ``order`` (one row per
    group, e.g. one per sheet).

    A key may own a large share of the groups (a source with most of the
    sheets), so no window is partitioned by ``keys`` alone.  The rows are
    range-sorted globally (a hot key spreads over many partitions), each
    partition keeps its own running totals, and a table with one row per
    (partition, key) gives every partition the total of the partitions
    before it.  The sorted table is checkpointed so the partition numbers
    stay fixed between the two uses.
    """
    from ..session import cut_lineage

    keys, order = list(keys), list(order)
    srt = counts.orderBy(*keys, *order).withColumn("__pid", F.spark_partition_id())
    srt = cut_lineage(srt)
    w_loc = Window.partitionBy("__pid", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    loc = srt.withColumn("__loc", F.coalesce(F.sum(n).over(w_loc), F.lit(0)))
    tot = srt.groupBy("__pid", *keys).agg(F.sum(n).alias("__t"))
    w_part = Window.partitionBy(*keys).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select("__pid", *keys, F.coalesce(F.sum("__t").over(w_part), F.lit(0)).alias("__poff"))
    return (loc.join(off, ["__pid", *keys])
               .withColumn(out, (F.col("__poff") + F.col("__loc")).cast("bigint"))
               .drop("__pid", "__loc", "__poff"))


def row_ordinal(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """0-based position of each row within ``keys`` in ``order`` (which must
    be unique within a key): ``row_number() - 1`` without a window over a
    whole key.  The exclusive running count of ``group_offsets`` with one
    per row, so a key holding most rows is still spread over many tasks."""
    x = df.withColumn("__one", F.lit(1).cast("bigint"))
    return group_offsets(x, keys, order, "__one", out).drop("__one")
