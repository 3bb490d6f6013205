"""Target-distribution importance resampling over hashed word n-grams.

A document's features are its runs of one and two consecutive words; a
feature's bucket is the CRC-32 of its UTF-8 bytes modulo ``BUCKETS``.  Bucket
counts over all documents and over all target texts give every bucket a gain
(log ratio of add-one shares), a document weighs the mean gain of its
features, and a Gumbel number by document turns "the highest scores" into
sampling without replacement.

Method: in each slice of texts the distinct words, each bounded by
delimiters, go into an Aho-Corasick automaton with a payload of CRC and byte
length.  One scan of a text emits its words' payloads in order; neighbouring
payloads are composed (the CRC of "a b" follows from the CRCs of "a" and "b"
and the length of "b"), so no occurrence of a word and no pair of words is
ever hashed again.  The same scan serves counting and scoring.

Spark: each task adds its features to one array of ``BUCKETS`` counts, the
arrays meet in an aggregate by bucket, and only that table (of fixed size)
reaches the driver.  Scored rows (five numbers each) are written once.  Ranks
come from counts per score and a range-sorted running number
(``row_ordinal``) among the drawn, never from one window over all rows.

Defined cases: a null or empty text has no features, weight 0 and fewer than
``MIN_WORDS`` words, so it is never drawn; texts of any length are read whole,
in pieces cut between words; equal scores go by smaller ``doc_id`` (null
last), equal rows are separate rows; an empty table gives an empty result; an
empty target has T = 0; a null ``doc_id`` is the empty string in the random
number; further columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.scan import row_ordinal
from ..session import scratch_path
from . import textbatch as tb
from .common import texts

BUCKETS = 10_000
#: texts of a slice share one automaton
SLICE = 4 << 20
MIN_WORDS = 20
PERCENT = 25
SEED = 7
#: gains and scores are whole thousandths
SCALE = 1000

#: every byte outside words becomes a space, A-Z become a-z
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


# ------------------------------------------------------------ payload algebra

def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> np.uint32(1)) ^ np.uint32(0xEDB88320), t >> np.uint32(1))
    return t


_BYTE = _crc_table()


def _tables(columns: np.ndarray) -> np.ndarray:
    """Lookup by byte, ``(4, 256)``, of a linear map given by its 32 columns."""
    out = np.zeros((4, 256), dtype=np.uint32)
    for bit in range(32):
        has = (np.arange(256) >> (bit % 8)) & 1 == 1
        out[bit // 8, has] ^= columns[bit]
    return out


def _apply(t: np.ndarray, x: np.ndarray) -> np.ndarray:
    m = np.uint32(255)
    return (t[0][x & m] ^ t[1][(x >> np.uint32(8)) & m] ^ t[2][(x >> np.uint32(16)) & m] ^ t[3][x >> np.uint32(24)])


def _shifts(bits: int = 31) -> list[np.ndarray]:
    """Maps "append 2**k zero bytes" of a CRC without its final inversion."""
    unit = np.uint32(1) << np.arange(32, dtype=np.uint32)
    cols = _BYTE[unit & np.uint32(255)] ^ (unit >> np.uint32(8))
    out = []
    for _ in range(bits):
        out.append(_tables(cols))
        cols = _apply(out[-1], cols)
    return out


_SHIFT = _shifts()


def compose(left: np.ndarray, right: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRCs of A + B from those of A and of B and the byte lengths of B."""
    x = left.copy()
    for k in range(int(size.max(initial=0)).bit_length()):
        on = (size >> k) & 1 == 1
        x[on] = _apply(_SHIFT[k], x[on])
    return x ^ right


def _with_space(crc: np.ndarray) -> np.ndarray:
    """CRCs of A + b" "."""
    x = ~crc
    return ~(_BYTE[(x ^ np.uint32(32)) & np.uint32(255)] ^ (x >> np.uint32(8)))


# ---------------------------------------------------------- dictionary, scans

def dictionary(folded: list[bytes]):
    """Automaton of the distinct words of the folded texts, each between two
    delimiters; payload: CRC in the low 32 bits, byte length above."""
    import ahocorasick

    found = ahocorasick.Automaton()
    words = set()
    for t in folded:
        words.update(t.split(b" "))
    words.discard(b"")
    for w in words:
        found.add_word(" " + w.decode("latin-1") + " ", zlib.crc32(w) | len(w) << 32)
    if words:
        found.make_automaton()
    return found, len(words)


def emitted(found, folded: bytes) -> np.ndarray:
    """Payloads of a text's words, in order."""
    return np.fromiter(map(itemgetter(1), found.iter(" " + folded.decode("latin-1") + " ")), dtype=np.int64)


def _pieces(raw: bytes, limit: int) -> Iterator[bytes]:
    """A folded text in pieces of about ``limit`` bytes, cut at delimiters."""
    lo = 0
    while len(raw) - lo > limit:
        cut = raw.find(b" ", lo + limit)
        if cut < 0:
            break
        yield raw[lo:cut]
        lo = cut
    yield raw[lo:]


def features(raws: list[bytes], limit: int = SLICE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(text number, buckets, number of words)`` in turn: the buckets of all
    features of one text, in one or (very long texts) several parts."""
    group, size = [], 0
    for i, raw in enumerate(raws):
        for piece in _pieces(raw.translate(_FOLD), limit):
            group.append((i, piece))
            size += len(piece)
            if size >= limit:
                yield from _scan(group)
                # the last word of a text that goes on stays in front of the next piece
                word = next((g[1].rsplit(None, 1)[-1] if g[1] is not None else g[2] for g in reversed(group)
                             if g[0] == i and (g[1] is None or g[1].strip(b" "))), None)
                group, size = [(i, None, word)] if word else [], 0
    if group:
        yield from _scan(group)


def _scan(group: list[tuple]) -> Iterator[tuple[int, np.ndarray, int]]:
    before = group[0] if len(group[0]) == 3 else None
    group = group[1:] if before else group
    if not group:
        return
    found, n = dictionary([g[1] for g in group])
    runs = [emitted(found, g[1]) if n else np.zeros(0, dtype=np.int64) for g in group]
    if before and before[0] == group[0][0]:
        runs[0] = np.concatenate([[zlib.crc32(before[2]) | len(before[2]) << 32], runs[0]]).astype(np.int64)
    else:
        before = None
    flat = np.concatenate(runs)
    crc, length = (flat & 0xFFFFFFFF).astype(np.uint32), flat >> 32
    one = crc % BUCKETS
    two = compose(_with_space(crc[:-1]), crc[1:], length[1:]) % BUCKETS if len(flat) > 1 else one[:0]
    lo = 0
    for k, (g, r) in enumerate(zip(group, runs)):
        hi = lo + len(r)
        skip = 1 if k == 0 and before else 0          # that word is counted with its own piece
        yield g[0], np.concatenate([one[lo + skip: hi], two[lo: max(hi - 1, lo)]]), hi - lo - skip
        lo = hi


def _raws(col: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of rows of about ``SLICE`` bytes: first row and texts (null: empty)."""
    for lo, _hi, data, off in tb.slices(col, SLICE):
        whole = data.tobytes()
        yield lo, [whole[a:b] for a, b in zip(off[:-1], off[1:])]


# --------------------------------------------------------------------- counts

def _count(it):
    total = np.zeros(BUCKETS, dtype=np.int64)
    for batch in it:
        for _lo, raws in _raws(batch.column(0)):
            for _i, buckets, _n in features(raws):
                total += np.bincount(buckets, minlength=BUCKETS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])


def bucket_counts(rows: DataFrame) -> DataFrame:
    """``bucket, n`` over the features of all texts of ``rows``; at most
    ``BUCKETS`` rows a task are shuffled."""
    return (rows.select(F.col("text").cast("string").alias("text")).mapInArrow(_count, "bucket long, n long")
            .groupBy("bucket").agg(F.sum("n").alias("n")))


def gains(docs: DataFrame, target: DataFrame) -> np.ndarray:
    """Gain of every bucket, by the counts of all documents and all target
    texts (two tables of at most ``BUCKETS`` rows reach the driver)."""
    s, t = np.zeros(BUCKETS, dtype=object), np.zeros(BUCKETS, dtype=object)
    for into, rows in ((s, docs), (t, target)):
        for bucket, n in bucket_counts(rows).collect():
            into[bucket] = n
    all_s, all_t = float(sum(s) + BUCKETS), float(sum(t) + BUCKETS)
    return np.array([math.floor(SCALE * math.log((float(b + 1) * all_s) / (float(a + 1) * all_t))) for a, b in zip(s, t)],
                    dtype=np.int64)


# --------------------------------------------------------------------- scores

def _weigh(it, gain):
    for batch in it:
        ids = batch.column(0)
        for lo, raws in _raws(batch.column(1)):
            total, n_features, n_words = np.zeros((3, len(raws)), dtype=np.int64)
            for i, buckets, words in features(raws):
                total[i] += gain.value[buckets].sum()
                n_features[i] += len(buckets)
                n_words[i] += words
            weight = np.where(n_features > 0, total // np.maximum(n_features, 1), 0)
            yield pa.RecordBatch.from_arrays(
                [ids.slice(lo, len(raws)), pa.array(n_words), pa.array(n_features), pa.array(weight)],
                names=["doc_id", "n_words", "n_features", "weight"])


def gumbel(doc_id: Column, seed: int) -> Column:
    """Whole thousandths of a Gumbel number fixed by seed and id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-float(SCALE)) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def scores(docs: DataFrame, target: DataFrame, seed: int = SEED) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score`` of every row of ``docs``."""
    gain = docs.sparkSession.sparkContext.broadcast(gains(docs, target))
    got = texts(docs).mapInArrow(lambda it: _weigh(it, gain), "doc_id long, n_words long, n_features long, weight long")
    return got.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` of every row of
    ``docs``; ``rank`` 1, 2, ... of the drawn, null of the others."""
    spark = docs.sparkSession
    at = scratch_path(spark, "importance")
    scores(docs, target, seed).write.parquet(at)
    rows = spark.read.parquet(at)
    may = rows.filter(F.col("n_words") >= min_words)
    # scores are whole numbers in a fixed range: a table of fixed size
    per = may.groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    above = Window.orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("score", "n", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("before"))
    draw = may.count() * percent // 100
    last = per.filter(F.col("before") < draw).agg(F.min("score")).first()[0]
    drawn = F.lit(False) if last is None else (F.col("n_words") >= min_words) & (F.col("score") >= last)
    keyed = rows.filter(drawn).withColumn("down", -F.col("score")).withColumn("unknown", F.col("doc_id").isNull())
    first = row_ordinal(keyed, [], ["down", "unknown", "doc_id", "n_features", "weight"], "rank").drop("down", "unknown")
    place = F.col("rank") + 1
    first = first.withColumn("rank", F.when(place <= draw, place))
    return first.unionByName(rows.filter(~drawn).withColumn("rank", F.lit(None).cast("long")))
