"""Mixing sources to target weights by Pareto order sampling.

Every document of a source is due the same expected number of copies
``r = target / source size``.  ``floor(r)`` copies are certain; the fractional
part is the inclusion probability of one more copy.  Documents are ranked by
their random odds divided by their inclusion odds (Pareto order sampling) and
taken in that order up to the words still due, so the sample has a fixed size
in words.  The order is cut where the words taken are nearest to the target;
one further document per source may then fill what is left of the gap.

All of it is DataFrame expressions.  A source may hold a third of all rows:
the running number of words is computed per (source, bucket of the rank) with
about sqrt(n) buckets of a source with n documents, so no window ever holds
a whole source.  Only the table with one row per source is handled by one
task (it is needed in code-point order for the weights).

Defined cases: a null text has size 0; documents of size 0 are never taken
more often than the certain copies and count nothing; a null source is a
source of its own and comes last; repeated rows are documents of their own;
a source whose documents are all empty has target 0; an empty table gives an
empty result.  Random numbers come from an md5 of seed, ``doc_id`` and text,
so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.scan import row_ordinal
from ..session import cut_lineage
from .common import WORD, small, unit_hash

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_COPIES = 2
SEED = 7


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """One row per source: ``source, source_size, n_docs, target``.

    The shares are a water level: sources are capped at ``most`` times their
    size in ascending order of size per weight, and the level of the others is
    what is left divided by their weights (the fixed point of resharing the
    excess again and again).
    """
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    picked = F.element_at(F.array(*[F.lit(int(w)) for w in weights]),
                          ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    s = s.withColumn("weight", picked).withColumn("cap", F.col("source_size") * most)
    every = Window.partitionBy()
    fill = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    s = (s.withColumn("level", (F.sum("source_size").over(every) * F.lit(share)
                                - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(rest))
          .withColumn("open", F.col("level") * F.col("weight") <= F.col("cap")))
    # the first source in filling order that stays under its cap fixes the level
    s = s.withColumn("place", F.row_number().over(fill))
    s = s.withColumn("final", F.min_by(F.when(F.col("open"), F.col("level")),
                                       F.when(F.col("open"), F.col("place"))).over(every))
    target = F.least(F.coalesce(F.col("final") * F.col("weight"), F.col("cap").cast("double")), F.col("cap").cast("double"))
    return s.select("source", "source_size", "n_docs", target.alias("target"))


def mix(docs: DataFrame, seed: int = SEED, weights=WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken`` of every
    row of ``docs``; ``taken = copies * size`` and ``copies <= most``."""
    return _mixed(docs, seed, weights, share, most).drop("key")


def _row_key() -> Column:
    """Rows of one id, source and text have one key."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string"))


def _mixed(docs: DataFrame, seed: int, weights, share: float, most: int) -> DataFrame:
    # rows are numbered once, in the written table
    base = cut_lineage(docs.select(
        F.monotonically_increasing_id().alias("row"), _row_key().alias("key"),
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        word_count(F.col("text").cast("string")).alias("size"),
        unit_hash(F.col("doc_id"), F.col("text"), seed=seed).alias("u")))
    per = small(cut_lineage(source_targets(base, weights, share, most)).withColumnRenamed("source", "s"))
    x = base.join(per, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    x = (x.withColumn("rate", rate).withColumn("certain", F.floor("rate"))
          .withColumn("pi", F.col("rate") - F.col("certain"))
          .withColumn("due", F.col("target") - F.col("certain") * F.col("source_size")))
    odds = lambda p: p / (F.lit(1.0) - p)
    x = x.withColumn("rank_key", F.when(F.col("pi") > 0, odds(F.col("u")) / odds(F.col("pi"))))
    # bucket of the rank: monotone in rank_key within a source, even in size
    x = (x.withColumn("n_buckets", F.ceil(F.sqrt(F.col("n_docs"))))
          .withColumn("bucket", F.floor(F.col("u") * F.col("n_buckets"))))
    cand = x.filter(F.col("pi") > 0)
    sums = cand.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    up_to = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offs = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"),
                       F.coalesce(F.sum("words").over(up_to), F.lit(0)).alias("off"))
    ranked = cand.join(offs, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).drop("s", "b")
    within = (Window.partitionBy("source", "bucket").orderBy("rank_key", F.col("doc_id").asc_nulls_first(), "size")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = ranked.withColumn("upto", F.col("off") + F.sum("size").over(within))
    # nearest cut: a document is taken while its middle is not past what is due
    ranked = cut_lineage(ranked.withColumn("extra", (F.col("upto") - F.col("size") / 2 <= F.col("due")).cast("int"))
                         .select("row", "key", "doc_id", "source", "size", "source_size", "target", "certain", "due", "rank_key", "extra"))
    got = ranked.groupBy("source", "due").agg(F.sum(F.col("extra") * F.col("size")).alias("got"))
    gap = small(got.select(F.col("source").alias("s"), (F.col("due") - F.col("got")).alias("gap")))
    left = (ranked.filter("extra = 0 and size > 0").join(gap, F.col("source").eqNullSafe(F.col("s")))
            .filter(F.col("size") < 2 * F.col("gap")))
    best = left.groupBy("source").agg(F.min(F.struct(
        F.abs(F.col("size") - F.col("gap")).alias("miss"), F.col("rank_key").alias("k"), F.col("doc_id").alias("d"),
        F.col("size").alias("z"), "row")).alias("f"))
    # one row a source, whatever rows are equal to it
    best = small(best.select(F.col("f.row").alias("fr")))
    done = ranked.join(best, F.col("row") == F.col("fr"), "left").withColumn("copies", F.col("certain") + F.col("extra") + F.col("fr").isNotNull().cast("int"))
    cols = ["key", "doc_id", "source", "size", "source_size", "target"]
    none = x.filter(F.col("pi") <= 0).select(*cols, F.col("certain").alias("copies"))
    out = done.select(*cols, "copies").unionByName(none)
    return out.select(*cols, F.col("copies").cast("long").alias("copies"), (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def copies(docs: DataFrame, seed: int = SEED, weights=WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as the mix takes it,
    with ``copy`` 1, 2, ...  Rows that repeat id, source and text share what
    their group was given as evenly as whole copies allow."""
    got = (_mixed(docs, seed, weights, share, most).groupBy("key")
           .agg(F.sum("copies").alias("__copies"), F.count(F.lit(1)).alias("__rows")).filter("__copies > 0"))
    got = cut_lineage(got.withColumnRenamed("key", "__key"))
    x = docs.withColumn("__k", _row_key()).join(got, F.col("__k") == F.col("__key"))
    once = x.filter("__rows = 1").withColumn("__n", F.col("__copies"))
    if got.filter("__rows > 1").limit(1).count():
        again = row_ordinal(x.filter("__rows > 1").withColumn("__id", F.monotonically_increasing_id()), ["__k"], ["__id"], "__at")
        each = F.floor(F.col("__copies") / F.col("__rows"))
        again = again.withColumn("__n", each + (F.col("__at") < F.col("__copies") - each * F.col("__rows")).cast("int")).filter("__n > 0")
        once = once.select(*docs.columns, "__n").unionByName(again.select(*docs.columns, "__n"))
    return (once.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("__n").cast("int")))).select(*docs.columns, "copy"))
