"""Quality rules by repetition coverage.

Every whole text is cut into words and lines; rolling hashes of several
n-gram lengths find the n-grams that occur twice or more in the same text,
and the rule measures how many of the text's word characters lie inside such
n-grams, and inside repeated lines.  One Arrow pass, no shuffle: every text
is judged by itself, in numpy slices of a few megabytes.

Defined cases: a null or empty text has no words and fails the base rule; a
text of any length is read whole; repeated rows are judged one by one; a null
``doc_id`` is passed on; an empty table gives an empty result; further
columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textbatch as tb
from .common import texts

#: n-gram length -> largest share of word characters inside n-grams of that
#: length that occur twice or more in the text.
MAX_SHARE = {3: 0.50, 5: 0.45, 7: 0.42, 10: 0.38}
#: largest share of characters inside repeated lines.
MAX_LINE_SHARE = 0.30

SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, kept boolean, dup_line_share double, "
          + ", ".join(f"dup_{n}gram_share double" for n in MAX_SHARE))

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _covered(hashes: np.ndarray, doc: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """Mask of words inside an n-gram that occurs twice or more in its text."""
    out = np.zeros(len(doc), dtype=bool)
    if len(doc) < n:
        return out
    i = np.arange(len(doc) - n + 1)
    i = i[i + n <= first[1:][doc[i]]]
    rep = i[tb.repeated(tb.mix(hashes[i] + doc[i].astype(np.uint64) * np.uint64(0xD1342543DE82EF95)))]
    d = np.bincount(rep, minlength=len(doc) + 1) - np.bincount(rep + n, minlength=len(doc) + 1)
    return np.cumsum(d)[:-1] > 0


def measure(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """All columns but ``doc_id`` for one slice of texts."""
    n_docs = len(off) - 1
    start, end, first = tb.word_spans(data, off)
    doc = tb.owner(first)
    cp = tb.code_points(data)
    chars = cp[end] - cp[start]
    sh = tb.SpanHash(tb.byte_codes(data))
    words = sh(start, end)
    grams = tb.SpanHash(words)
    out = {"n_words": np.diff(first), "word_chars": tb.per_text(chars, first)}
    sym = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(_SYMBOL[data], out=sym[1:])
    out["n_symbols"] = sym[off[1:]] - sym[off[:-1]]

    # lines: between \n and the ends of the text; only those with a word count
    nl = np.flatnonzero(data == 10)
    ls = np.concatenate([off[:-1], nl + 1])
    le = np.concatenate([off[1:], nl])
    ld = np.concatenate([np.arange(n_docs), np.searchsorted(off, nl, side="right") - 1])
    order = np.lexsort((ls, ld))
    ls, ld = ls[order], ld[order]
    le = np.append(ls[1:] - 1, off[-1])
    last = np.append(ld[1:] != ld[:-1], True)
    le = np.where(last, off[1:][ld], le)
    has_word = np.searchsorted(start, le) > np.searchsorted(start, ls)
    ls, le, ld = ls[has_word], le[has_word], ld[has_word]
    key = tb.mix(sh(ls, le) + ld.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    dup = tb.not_first(key)
    out["n_dup_lines"] = np.bincount(ld[dup], minlength=n_docs).astype(np.int64)
    line_chars = np.bincount(ld[dup], weights=(cp[le] - cp[ls])[dup], minlength=n_docs)
    total = np.maximum(cp[off[1:]] - cp[off[:-1]], 1)
    out["dup_line_share"] = line_chars / total

    kept = out["dup_line_share"] <= MAX_LINE_SHARE
    word_total = np.maximum(out["word_chars"], 1)
    for n, most in MAX_SHARE.items():
        cov = _covered(grams.windows(n), doc, first, n)
        if n == 3:
            out["n_repeat_words"] = tb.per_text(cov, first)
        share = tb.per_text(chars * cov, first) / word_total
        out[f"dup_{n}gram_share"] = share
        kept &= share <= most
    out["base_failed"] = (out["n_words"] < 50) | (100 * out["n_repeat_words"] > 50 * out["n_words"])
    out["kept"] = kept & ~out["base_failed"]
    return out


_ORDER = [x.split()[0] for x in SCHEMA.split(", ")]


def _batches(it):
    for batch in it:
        ids = batch.column(0)
        for lo, hi, data, off in tb.slices(batch.column(1)):
            got = measure(data, off)
            yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo)] + [pa.array(got[c]) for c in _ORDER[1:]], names=_ORDER)


def repetition_rules(docs: DataFrame) -> DataFrame:
    """Base counts, coverage shares and the verdict of every document."""
    return texts(docs).mapInArrow(_batches, SCHEMA)
