"""Toxicity by a weighted lexicon and an Aho-Corasick automaton.

Texts are folded (compatibility forms, accents, look-alike letters of other
alphabets, digits standing for letters) and scanned once by an automaton of
word beginnings.  The raw score is the sum of the weights of the words hit,
normalised by the length of the text; hits inside an exception phrase do not
count.

The weights are learned: a bounded sample of labelled rows (``SAMPLE`` rows of
each class, those with the smallest hash of ``doc_id``; the class bound is a
parameter) gives for every word beginning of 4 to 12 letters the number of
toxic and of clean texts that hold it; those that are significantly more
common in toxic texts enter the lexicon with their log odds.  A small list of
common insults has a weight of its own, so that the scan also works without
labels.  A second pass over the same sample sets the point where the score is
one half.  Every document is then scored, whole, in one Arrow pass.

Defined cases: a null or empty text scores the smallest value (no hit); a
null label is no label; labels without a document and documents without a
label are fine; repeated rows are scored one by one; no labelled rows of one
class leaves the list alone; further columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import textbatch as tb
from .common import texts

SAMPLE = 5000            # labelled rows of each class to learn from
STEM_LENGTHS = range(4, 13)
MIN_LLR = 24.0           # significance of an entry: 2 * log likelihood ratio
MIN_WEIGHT = 2.5         # log odds
MAX_ENTRIES = 5000
BASE_WEIGHT = 3.0
DEFAULT_CUT = 0.05       # where the score is one half when nothing can be learned
STEEPNESS = 4.0

# fixed values: common insults, phrases in which one of them is harmless
BASE = ("idiot", "moron", "stupid", "loser", "scum", "worthless", "pathetic", "disgusting", "trash", "clown", "dumbass",
        "imbecile", "bastard", "bitch", "asshole", "retard", "shithead", "douchebag", "jerk", "scumbag")
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "clownfish", "pond scum", "idiot proof", "idiotproof",
              "sore loser clause", "scum line", "jerky")
# fixed values: letters of other alphabets that look like Latin ones
_LOOKALIKE = str.maketrans(
    "аеорсухіјѕԁһвмнткı"
    "αβεικνορτυχ",
    "aeopcyxijsdhbmhtki" "abeikvoptux")
_DIGIT = str.maketrans("0134578@$!", "oieastbasi")
_HIDDEN = re.compile("[​-‏⁠﻿­]")
_TOKEN = re.compile(r"[a-z0-9@$!]*[a-z][a-z0-9@$!]*")
_MARKS = re.compile("[̀-ͯ]")
_SUBST = re.compile(r"[0-9@$!]+(?=[a-z])|(?<=[a-z])[0-9]+")
_GAP = re.compile(r"[^a-zß-ɏ]+")


def fold(text: str) -> str:
    """Lower-case letters with one space before and after each word."""
    if not text.isascii():
        text = _HIDDEN.sub("", unicodedata.normalize("NFKD", text))
        text = _MARKS.sub("", text).lower().translate(_LOOKALIKE)
    else:
        text = text.lower()
    text = _SUBST.sub(lambda m: m.group().translate(_DIGIT), text)
    return " " + _GAP.sub(" ", text) + " "


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0


def _count_stems(it):
    """Per task: texts of each class that hold a word beginning."""
    seen = (Counter(), Counter())
    for batch in it:
        for text, toxic in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            words = set(fold(text or "").split())
            seen[toxic].update({w[:k] for w in words for k in STEM_LENGTHS if k <= len(w)})
    both = list(seen[1].keys())
    step = 50_000
    for i in range(0, len(both), step):
        part = both[i:i + step]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([seen[1][s] for s in part], pa.int64()),
                                          pa.array([0] * len(part), pa.int64())], names=["stem", "t", "c"])
    rest = list(seen[0].keys())
    for i in range(0, len(rest), step):
        part = rest[i:i + step]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([0] * len(part), pa.int64()),
                                          pa.array([seen[0][s] for s in part], pa.int64())], names=["stem", "t", "c"])


class Scanner:
    """The automaton: word beginnings with weights, and exception phrases."""

    def __init__(self, lexicon: dict[str, float]):
        import ahocorasick

        self.auto = ahocorasick.Automaton()
        for stem, weight in lexicon.items():
            self.auto.add_word(" " + stem, (len(stem) + 1, weight))
        for phrase in EXCEPTIONS:
            self.auto.add_word(" " + phrase, (len(phrase) + 1, None))
        self.auto.make_automaton()

    def raw(self, text: str) -> float:
        """Sum over the words hit of the largest weight, by length."""
        folded = fold(text)
        hits, free = {}, []
        for end, (n, weight) in self.auto.iter(folded):
            at = end - n + 1
            if weight is None:
                free.append((at, end))
            elif weight > hits.get(at, 0.0):
                hits[at] = weight
        if not hits:
            return 0.0
        total = sum(w for at, w in hits.items() if not any(a <= at <= b for a, b in free))
        return total / math.sqrt(max(folded.count(" ") - 1, 50))


def _raws(it, lexicon):
    scan = Scanner(lexicon)
    for batch in it:
        out = [scan.raw(t or "") for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())] + batch.columns[2:],
                                         names=["doc_id", "raw"] + batch.schema.names[2:])


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """``doc_id, text, toxic`` of at most ``most`` training rows a class."""
    lab = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
           .filter("doc_id is not null and toxic in (0, 1)").filter(~held_out(F.col("doc_id"))))
    lab = lab.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    pick = [lab.filter(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for c in (0, 1)]
    # at most 2 * most rows of 12 bytes
    few = F.broadcast(cut_lineage(pick[0].unionByName(pick[1])))
    return cut_lineage(docs.join(few, "doc_id").select("doc_id", "text", "toxic"))


def learn_lexicon(sample: DataFrame) -> dict[str, float]:
    """Word beginnings with their weights; at most ``MAX_ENTRIES`` learned."""
    lexicon = {s: BASE_WEIGHT for s in BASE}
    n = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_t, n_c = n.get(1, 0), n.get(0, 0)
    if not n_t or not n_c:
        return lexicon
    counts = (sample.mapInArrow(tb.lean(_count_stems), "stem string, t long, c long")
              .groupBy("stem").agg(F.sum("t").alias("t"), F.sum("c").alias("c")).filter("t >= 3"))
    t, c = F.col("t"), F.col("c")
    part = lambda k, e: F.when(k > 0, k * F.log(k / e)).otherwise(0.0)
    rate = (t + c) / F.lit(n_t + n_c)
    llr = 2 * (part(t, rate * n_t) + part(c, rate * n_c)
               + part(n_t - t, (1 - rate) * n_t) + part(n_c - c, (1 - rate) * n_c))
    weight = F.log((t + 0.5) / F.lit(n_t + 1.0)) - F.log((c + 0.5) / F.lit(n_c + 1.0))
    found = (counts.withColumn("llr", llr).withColumn("w", weight).filter((F.col("llr") >= MIN_LLR) & (F.col("w") >= MIN_WEIGHT))
             .orderBy(F.desc("llr"), "stem").limit(MAX_ENTRIES).select("stem", "w").collect())
    for r in found:
        lexicon[r["stem"]] = max(float(r["w"]), lexicon.get(r["stem"], 0.0))
    return lexicon


def cut_point(sample: DataFrame, lexicon: dict[str, float]) -> float:
    """Raw score with the fewest errors on the sample (each class counts
    half); the sample's size bounds what the driver gets."""
    rows = sample.mapInArrow(tb.lean(lambda it: _raws(it, lexicon)), "doc_id long, raw double, toxic int").select("raw", "toxic").toPandas()
    x, y = rows["raw"].to_numpy(), rows["toxic"].to_numpy()
    if not (y == 1).any() or not (y == 0).any():
        return DEFAULT_CUT
    cuts = np.unique(x)
    if len(cuts) < 2:
        return DEFAULT_CUT
    mids = (cuts[1:] + cuts[:-1]) / 2
    tox, clean = np.sort(x[y == 1]), np.sort(x[y == 0])
    err = np.searchsorted(tox, mids) / len(tox) + 1 - np.searchsorted(clean, mids) / len(clean)
    return float(mids[np.flatnonzero(err == err.min())[0]])


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``."""
    docs = texts(docs)
    learn = labelled_sample(docs, labels, sample)
    lexicon = learn_lexicon(learn)
    cut = max(cut_point(learn, lexicon), 1e-3)
    raws = docs.mapInArrow(tb.lean(lambda it: _raws(it, lexicon)), "doc_id long, raw double")
    score = 1 / (1 + F.pow(F.lit(cut) / F.greatest(F.col("raw"), F.lit(cut / 1e6)), F.lit(STEEPNESS)))
    return raws.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
                       score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Rows of ``docs`` that aren't predicted toxic (all columns).  A row is
    judged by its own text, so nothing is joined."""
    judged = texts(docs)
    learn = labelled_sample(judged, labels, sample)
    lexicon = learn_lexicon(learn)
    cut = max(cut_point(learn, lexicon), 1e-3)

    def clean(it):
        scan = Scanner(lexicon)
        for batch in it:
            at = batch.schema.names.index("text")
            yield batch.filter(pa.array([scan.raw(t or "") < cut for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(tb.lean(clean), docs.schema)
