"""Benchmark decontamination by q-gram lemma filtering.

Texts and benchmark items are brought to one form (lower case, runs of ASCII
characters that are neither letters nor digits become one space).  An item of
``m`` bytes may be met with up to ``k = floor(EDIT_RATE * m)`` edits.  By the
q-gram lemma such a region shares at least ``m - q + 1 - k * q`` q-grams with
the item, and they all lie within ``k + 1`` neighbouring diagonals; so shared
q-grams are counted per item in bins of ``k + 1`` diagonals, two neighbouring
bins make one of the overlapping bands, and bands that reach the bound are
verified by a banded alignment (free ends in the text).

The benchmark is the stated query set: it goes to the tasks in blocks of at
most ``BLOCK_BYTES`` bytes, each against all documents in one Arrow pass
without shuffle; no pairs of rows are formed.

Defined cases: null and empty texts match nothing; items of fewer than
``MIN_ITEM`` bytes in normal form are no passages and match nothing; null ids
are passed on; repeated documents are searched one by one, repeated items are
reported under each id; very long texts are cut into overlapping pieces, so
no match is lost; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import textbatch as tb
from .common import SMALL_IDS, small, texts

Q = 10
EDIT_RATE = 0.08
MIN_ITEM = 2 * Q
BLOCK_BYTES = 16 << 20
_TABLE_BITS = 22

SCHEMA = "doc_id long, item_id long, edits int, n_regions long"

_KEEP = np.zeros(256, dtype=bool)
_KEEP[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def normalise(col: pa.Array) -> pa.Array:
    """Lower-case normal form of a string column; nulls become empty."""
    low = pc.utf8_lower(col.cast(pa.large_string()).fill_null(""))
    out = []
    for _, _, data, off in tb.slices(low):
        word = _KEEP[data]
        first = np.zeros(len(data) + 1, dtype=bool)
        first[off[:-1]] = True
        after = np.empty(len(data), dtype=bool)
        after[1:] = word[:-1]
        after[:1] = False
        after[first[:-1]] = False
        keep = word | after            # the first of a run of others stands for it
        chars = np.where(word, data, np.uint8(32))[keep]
        n = np.zeros(len(data) + 1, dtype=np.int64)
        np.cumsum(keep, out=n[1:])
        raw = chars.tobytes()
        bounds = n[off].tolist()
        out.extend(raw[a:b].rstrip(b" ") for a, b in zip(bounds, bounds[1:]))
    return pa.array(out, pa.large_binary())


def budget(m: int) -> int:
    """Edits allowed for an item of ``m`` bytes: the rate, as far as the
    lemma still leaves one shared q-gram."""
    return max(0, min(int(EDIT_RATE * m), (m - Q) // Q))


def _loads(data: np.ndarray) -> np.ndarray:
    """Little-endian 8-byte words that start at every byte (len - 7)."""
    n = len(data) - 7
    out = np.empty(max(n, 0), dtype=np.uint64)
    raw = data.tobytes()
    for k in range(min(8, max(n, 0))):
        out[k::8] = np.frombuffer(raw, dtype="<u8", offset=k, count=len(out[k::8]))
    return out


def _grams(data: np.ndarray) -> np.ndarray:
    """64-bit code of the Q bytes at every start."""
    if len(data) < Q:
        return np.zeros(0, dtype=np.uint64)
    w = _loads(data)
    n = len(data) - Q + 1
    return tb.mix(w[:n] * np.uint64(0x9E3779B97F4A7C15) ^ w[Q - 8: Q - 8 + n] * np.uint64(0xC2B2AE3D27D4EB4F))


class Items:
    """Q-gram index of one block of the benchmark."""

    def __init__(self, ids: list, raws: list[bytes]):
        self.ids, self.raws = ids, raws
        self.m = np.array([len(r) for r in raws], dtype=np.int64)
        self.k = np.array([budget(len(r)) for r in raws], dtype=np.int64)
        self.need = self.m - Q + 1 - self.k * Q
        codes, item, at = [], [], []
        for i, r in enumerate(raws):
            g = _grams(np.frombuffer(r, dtype=np.uint8))
            codes.append(g)
            item.append(np.full(len(g), i))
            at.append(np.arange(len(g)))
        c = np.concatenate(codes) if codes else np.zeros(0, dtype=np.uint64)
        order = np.argsort(c, kind="stable")
        self.code = c[order]
        self.item = np.concatenate(item)[order] if item else np.zeros(0, dtype=np.int64)
        self.at = np.concatenate(at)[order] if at else np.zeros(0, dtype=np.int64)
        self.table = np.zeros(1 << _TABLE_BITS, dtype=bool)
        self.table[(self.code >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True
        self.reach = int((self.m + 2 * self.k).max()) if len(self.m) else 0

    def hits(self, data: np.ndarray):
        """``(position, item, position in the item)`` of shared q-grams."""
        g = _grams(data)
        pos = np.flatnonzero(self.table[(g >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)])
        lo = np.searchsorted(self.code, g[pos], side="left")
        n = np.searchsorted(self.code, g[pos], side="right") - lo
        pos, lo, n = pos[n > 0], lo[n > 0], n[n > 0]
        which = np.repeat(lo, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        return np.repeat(pos, n), self.item[which], self.at[which]

    def bands(self, data: np.ndarray, off: np.ndarray):
        """``(text, item, first diagonal)`` of the bands that reach the bound."""
        pos, item, at = self.hits(data)
        doc = np.searchsorted(off, pos, side="right") - 1
        ok = pos + Q <= off[doc + 1]
        pos, item, at, doc = pos[ok], item[ok], at[ok], doc[ok]
        width = self.k[item] + 1
        bin_ = (pos - off[doc] - at + self.m[item]) // width       # never negative
        if not len(doc):
            return doc, item, bin_
        order = np.lexsort((bin_, item, doc))
        d, i, b = doc[order], item[order], bin_[order]
        new = np.ones(len(d), dtype=bool)
        new[1:] = (d[1:] != d[:-1]) | (i[1:] != i[:-1]) | (b[1:] != b[:-1])
        at0 = np.flatnonzero(new)
        n = np.diff(np.append(at0, len(d)))
        d, i, b = d[at0], i[at0], b[at0]
        both = n.copy()
        nxt = (d[1:] == d[:-1]) & (i[1:] == i[:-1]) & (b[1:] == b[:-1] + 1)
        both[:-1][nxt] += n[1:][nxt]
        good = both >= self.need[i]
        d, i, b = d[good], i[good], b[good]
        return d, i, b * (self.k[i] + 1) - self.m[i]


def align(text: list[bytes], pattern: list[bytes], k: np.ndarray) -> np.ndarray:
    """Smallest number of edits between each pattern and any part of its
    text, as far as it is at most ``k`` (else ``k + 1``).

    All pairs advance together, one pattern byte a step; a row of the table
    is cut to the text given, which is the band's part of the document.
    """
    n = len(text)
    t_len = np.array([len(t) for t in text])
    p_len = np.array([len(p) for p in pattern])
    width, steps = int(t_len.max()), int(p_len.max())
    t = np.full((n, width), 256, dtype=np.int16)
    p = np.full((n, steps), 257, dtype=np.int16)
    for r in range(n):
        t[r, :t_len[r]] = np.frombuffer(text[r], dtype=np.uint8)
        p[r, :p_len[r]] = np.frombuffer(pattern[r], dtype=np.uint8)
    # column j of the row of pattern byte i is text position i + j - slack
    slack = (t_len - p_len).max() if n else 0
    slack = int(max(slack, 0))
    idx = np.arange(slack + 2 + 2 * int(k.max()))
    band = len(idx)
    shift = int(k.max())
    big = np.int32(1 << 20)
    # text column of band cell j at step i is i + j - shift
    start = idx[None, :] - shift
    row = np.where((start >= 0) & (start <= t_len[:, None]), 0, big).astype(np.int32)
    best = np.full(n, big, dtype=np.int32)
    best[p_len == 0] = 0
    cells = np.arange(band, dtype=np.int32)
    for i in range(steps):
        col = i + 1 + idx - shift                    # text columns after this step
        inside = (col[None, :] >= 0) & (col[None, :] <= t_len[:, None])
        c = np.clip(col - 1, 0, max(width - 1, 0))
        sub = row + ((t[:, c] != p[:, i][:, None]) | (col[None, :] < 1))
        dele = np.full_like(row, big)
        dele[:, :-1] = row[:, 1:] + 1                # pattern byte without a text byte
        cur = np.where(inside, np.minimum(sub, dele), big)
        cur = np.minimum.accumulate(cur - cells, axis=1) + cells   # text bytes without a pattern byte
        row = np.where(inside, np.minimum(cur, big), big)
        done = p_len == i + 1
        if done.any():
            best[done] = row[done].min(axis=1)
    return np.minimum(best, k + 1)


def find(ids, norm: list[bytes], items: Items) -> list[tuple[int, int, int, int]]:
    """``(row, item, edits, regions)`` of the matches in a run of texts."""
    if not norm or not items.raws:
        return []
    data = np.frombuffer(b"".join(norm), dtype=np.uint8)
    off = np.zeros(len(norm) + 1, dtype=np.int64)
    np.cumsum([len(x) for x in norm], out=off[1:])
    d, i, diag = items.bands(data, off)
    found: dict[tuple[int, int], list[tuple[int, int]]] = {}
    todo = []
    for r, it, dg in zip(d.tolist(), i.tolist(), diag.tolist()):
        k, m = int(items.k[it]), int(items.m[it])
        lo, hi = max(0, dg - k), dg + 2 * (k + 1) + m + k
        part = norm[r][lo:max(hi, 0)]
        at = part.find(items.raws[it])
        if at >= 0:                                   # alignment without edits
            found.setdefault((r, it), []).append((0, dg // (2 * k + 2)))
        else:
            todo.append((r, it, dg // (2 * k + 2), part))
    for a in range(0, len(todo), 512):
        part = todo[a:a + 512]
        k = items.k[[x[1] for x in part]]
        got = align([x[3] for x in part], [items.raws[x[1]] for x in part], k)
        for x, e, most in zip(part, got.tolist(), k.tolist()):
            if e <= most:
                found.setdefault((x[0], x[1]), []).append((e, x[2]))
    return [(r, it, min(e for e, _ in v), len({g for _, g in v})) for (r, it), v in found.items()]


PIECE = 1 << 22


def _search(it, packed):
    items = Items(*packed.value)
    for batch in it:
        ids = batch.column(0)
        norm = normalise(batch.column(1)).to_pylist()
        rows: dict[tuple[int, int], list[int]] = {}
        run, own, size = [], [], 0

        def flush():
            for r, i, e, g in find(None, run, items):
                old = rows.get((own[r], i))
                rows[own[r], i] = [min(e, old[0]), old[1] + g] if old else [e, g]
            run.clear()
            own.clear()

        for r, x in enumerate(norm):
            # a text longer than a piece is read in pieces that overlap by the longest region
            for a in range(0, max(len(x) - items.reach, 1), PIECE):
                piece = x[a:a + PIECE + items.reach]
                run.append(piece)
                own.append(r)
                size += len(piece)
                if size > PIECE:
                    flush()
                    size = 0
        flush()
        if rows:
            keys = sorted(rows)
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array([r for r, _ in keys])), pa.array([items.ids[i] for _, i in keys], pa.int64()),
                 pa.array([rows[x][0] for x in keys], pa.int32()), pa.array([rows[x][1] for x in keys], pa.int64())],
                names=["doc_id", "item_id", "edits", "n_regions"])


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, edits, n_regions``: documents with a passage within
    the edit budget of a benchmark item."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-int(total) // BLOCK_BYTES))
    out = None
    for b in range(n):
        block = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).toArrow()
        norm = normalise(block.column("text").combine_chunks()).to_pylist() if block.num_rows else []
        keep = [(i, x) for i, x in zip(block.column("item_id").to_pylist(), norm) if len(x) >= MIN_ITEM]
        packed = spark.sparkContext.broadcast(([i for i, _ in keep], [x for _, x in keep]))
        found = texts(docs).mapInArrow(tb.lean(lambda it, packed=packed: _search(it, packed)), SCHEMA)
        out = found if out is None else out.unionByName(found)
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs`` without a benchmark passage (all columns).  Every row is
    judged by its own text: rows are told apart by a hash of id and text."""
    key = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = cut_lineage(contaminated(docs.select(key.alias("doc_id"), "text"), benchmark)).select(F.col("doc_id").alias("__key")).distinct()
    return docs.join(small(found, SMALL_IDS), key == F.col("__key"), "left_anti")
