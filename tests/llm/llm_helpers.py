"""Small tables and brute-force versions for the operator tests."""

import re

from pyspark.sql import types as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: a column of every name that an operator uses inside
CLASH = ["sid", "size", "h", "key", "bucket", "lo", "rate", "u", "copies", "raw", "g", "doc", "path", "node", "root"]

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType()), *[T.StructField(c, T.StringType()) for c in CLASH]])


def docs_df(spark, rows, parts=3):
    """``rows``: (doc_id, text) or (doc_id, text, source)."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1]), *["x"] * len(CLASH)) for r in rows]
    df = spark.createDataFrame(full, DOCS)
    return df.repartition(parts) if rows else df


def words(text):
    return WORD.findall(text or "")


def sentence(rng, n=60, pool=400):
    return " ".join(f"w{rng.randrange(pool)}x" for _ in range(n))


def odd_rows(rng):
    """Nulls, empty, blank and long texts, ties and repeated rows."""
    base = sentence(rng, 120)
    long = " ".join(sentence(rng, 200, 5000) for _ in range(60)) + " é" * 50
    return [(1, base), (2, base), (2, base), (3, base + " tail"), (4, None), (5, ""), (6, " \n\t "), (7, "One two"),
            (8, long), (None, base), (None, sentence(rng, 80)), (9, "x" * 5000), (10, "\x00 ​ á \U0001F600 " * 30), (11, sentence(rng, 80))]
