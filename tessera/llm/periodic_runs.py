"""Periodic runs of words by suffix-tree extension queries.

A run is a maximal stretch of consecutive words with smallest period q, of at
least ``max(MIN_LENGTH, MIN_EXPONENT * q)`` words.

Method: Ukkonen trees of the text and of its reversal; an Euler tour of each
tree gives every leaf its place and, between neighbouring leaves, the string
depth at which the tour turns back, so a range minimum (sparse table) answers
the depth of any lowest common ancestor, the longest common extension of two
positions, in constant time.  Every run has a Lyndon root that is the longest
Lyndon word at its position under the words' order or under the reverse order;
that word ends at the next smaller suffix, which the tour's leaf places tell.
Each such candidate is extended in both directions by one query per tree.

Before the trees, positions are ruled out that no run can hold: in a run of
length L >= max(6, 4q) every window of ``GRAM`` words stands at least twice in
the text, most of them again at most L / 4 words on.  Trees are built over the
remaining maximal stretches, all stretches of a slice of texts in one tree,
each closed by a separator that occurs once.  The filter is exact: a run and
both its neighbours' mismatch lie in one stretch or at its edge, and window
hashes that collide only add stretches (words in the trees are compared as
bytes).

Spark: one Arrow pass without a shuffle; memory follows the slice (about a
megabyte of texts, or one longer text).  A tree takes some hundred bytes a
word of the repeating stretches.

Defined cases: a null or empty text has no words and no run; a null ``doc_id``
has no decimal form, so its text is taken as it is; texts of any length are
read whole; ties go by smallest start, then smallest period; repeated rows are
judged one by one; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textbatch as tb
from .common import texts

MIN_LENGTH = 6
MIN_EXPONENT = 4
#: words in the windows of the filter; with exponent 4 and 6 words at least,
#: every window of 4 words in a run occurs twice in it
GRAM = 4

SCHEMA = ("doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, "
          "runs_sha256 string, collapsed_sha256 string, n_dropped long")


# --------------------------------------------------------------- suffix trees

def suffix_tree(s: list[int], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ukkonen's construction over ``s`` (symbols below ``size``, the last one
    occurs once).  Per node but the root (number 0): parent, first symbol and
    string depth; ``leaf[j]`` is the node of suffix j."""
    n = len(s)
    start, end, link = [0], [0], [0]
    child: dict[int, int] = {}
    leaf = []
    node = edge = length = todo = 0
    for i, c in enumerate(s):
        todo += 1
        last = 0
        while todo:
            if not length:
                edge = i
            key = node * size + s[edge]
            nxt = child.get(key)
            if nxt is None:
                child[key] = len(start)
                leaf.append(len(start))
                start.append(i)
                end.append(n)
                link.append(0)
                if last:
                    link[last] = node
                    last = 0
            else:
                lo = start[nxt]
                span = (end[nxt] if end[nxt] <= i else i + 1) - lo
                if length >= span:
                    edge += span
                    length -= span
                    node = nxt
                    continue
                if s[lo + length] == c:
                    length += 1
                    if last:
                        link[last] = node
                    break
                mid = len(start)
                child[key] = mid
                start.append(lo)
                end.append(lo + length)
                link.append(0)
                child[mid * size + c] = mid + 1
                leaf.append(mid + 1)
                start.append(i)
                end.append(n)
                link.append(0)
                start[nxt] = lo + length
                child[mid * size + s[lo + length]] = nxt
                if last:
                    link[last] = mid
                last = mid
            todo -= 1
            if not node and length:
                length -= 1
                edge = i - todo + 1
            elif node:
                node = link[node]
    keys = np.fromiter(child.keys(), dtype=np.int64, count=len(child))
    at = np.fromiter(child.values(), dtype=np.int64, count=len(child))
    parent, symbol, depth = np.zeros((3, len(start)), dtype=np.int64)
    parent[at], symbol[at] = keys // size, keys % size
    depth[:] = np.array(end) - np.array(start)
    return parent, symbol, _path_sum(parent, depth), np.array(leaf)


def _path_sum(parent: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Sums of ``value`` over every node's path to the root (pointer jumping)."""
    total, up = value.copy(), parent.copy()
    total[0] = 0
    while up.any():
        total += total[up]
        up = up[up]
    return total


class Tour:
    """Euler tour of a suffix tree: the leaves' places, and the string depth of
    the lowest common ancestor of any two leaves in constant time."""

    def __init__(self, tree, symbol: np.ndarray):
        parent, _, depth, leaf = tree
        n_nodes = len(parent)
        # leaves below each node: children are deeper than their parents
        below = np.zeros(n_nodes, dtype=np.int64)
        below[leaf] = 1
        counts, up = below.tolist(), parent.tolist()
        for v in np.argsort(-depth, kind="stable").tolist():
            if v:
                counts[up[v]] += counts[v]
        below = np.array(counts)
        # a child's leaves follow those of its smaller brothers
        order = np.lexsort((symbol[1:], parent[1:])) + 1
        p = parent[order]
        before = np.cumsum(below[order]) - below[order]
        first = np.r_[True, p[1:] != p[:-1]]
        before -= before[first][np.cumsum(first) - 1]
        shift = np.zeros(n_nodes, dtype=np.int64)
        shift[order] = before
        place = _path_sum(parent, shift)
        self.rank = place[leaf]
        # the tour turns back at the parent between two brothers
        turn = np.zeros(len(leaf), dtype=np.int32)
        turn[place[order[~first]]] = depth[p[~first]]
        self.table = [turn]
        step = 1
        while 2 * step < len(turn):
            t = self.table[-1]
            self.table.append(np.minimum(t[:-step], t[step:]))
            step *= 2

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Longest common prefix of the suffixes i and j (i and j differ)."""
        a, b = self.rank[i], self.rank[j]
        lo, hi = np.minimum(a, b) + 1, np.maximum(a, b) + 1
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        out = np.empty(len(i), dtype=np.int64)
        for k in np.unique(level).tolist():
            on = level == k
            t = self.table[k]
            out[on] = np.minimum(t[lo[on]], t[hi[on] - (1 << k)])
        return out


def _next_smaller(rank: np.ndarray) -> np.ndarray:
    """For every position the next one with a smaller rank (n if none)."""
    n = len(rank)
    out = [n] * n
    stack: list[int] = []
    r = rank.tolist()
    for i in range(n):
        x = r[i]
        while stack and r[stack[-1]] > x:
            out[stack.pop()] = i
        stack.append(i)
    return np.array(out)


def runs_of(parts: list[list[int]]) -> np.ndarray:
    """All runs, ``(part, start, length, period)`` rows, of the given parts
    (lists of word numbers)."""
    m = 1 + max(max(p) for p in parts)                    # words below, separators from m on
    size = m + len(parts) + 1
    s, owner, base = [size - 1], [-1], []
    for k, p in enumerate(parts):
        base.append(len(s))
        s += p
        s.append(m + k)
        owner += [k] * len(p) + [-1]
    n = len(s)
    owner, base = np.array(owner), np.array(base)
    size_of = np.array([len(p) for p in parts])
    forward = suffix_tree(s, size)
    symbol = forward[1]
    # separators end a text: smaller than all words, in both orders of words
    up = Tour(forward, np.where(symbol >= m, symbol - size, symbol))
    down = Tour(forward, np.where(symbol >= m, symbol - size, m - 1 - symbol))
    back = Tour(tree := suffix_tree(s[::-1], size), tree[1])
    found = []
    for tour in (up, down):
        i = np.flatnonzero(owner >= 0)
        period = _next_smaller(tour.rank)[i] - i
        ok = (MIN_EXPONENT * period <= size_of[owner[i]]) & (i + period < n) & (owner[np.minimum(i + period, n - 1)] == owner[i])
        i, period = i[ok], period[ok]
        if not len(i):
            continue
        right = up.common(i, i + period)
        left = back.common(n - i, n - i - period)          # from the words before
        length = left + period + right
        ok = length >= np.maximum(MIN_LENGTH, MIN_EXPONENT * period)
        k = owner[i[ok]]
        found.append(np.column_stack([k, (i - left)[ok] - base[k], length[ok], period[ok]]))
    if not found:
        return np.zeros((0, 4), dtype=np.int64)
    return np.unique(np.concatenate(found), axis=0)


# -------------------------------------------------------------- texts, stretches

def _pattern(doc_id: int, n: int) -> tuple[int, int] | None:
    """From which word on, and with which period, the words repeat."""
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def _source_words(ids: list, first: np.ndarray) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """For every word of a slice the original word that stands there, and the
    texts where that is another one (their words' numbers in the text)."""
    at = np.arange(first[-1])
    changed = {}
    for k, i in enumerate(ids):
        n = int(first[k + 1] - first[k])
        got = _pattern(i, n) if i is not None else None
        if got:
            a, p = got
            j = np.arange(n)
            j[a:] = a + (j[a:] - a) % p
            at[first[k]: first[k + 1]] = first[k] + j
            changed[k] = j
    return at, changed


def stretches(hashes: np.ndarray, doc: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and end of the maximal stretches whose windows of ``GRAM``
    words all stand twice or more in their text, where a run can be."""
    none = np.zeros(0, dtype=np.int64)
    if len(doc) < MIN_LENGTH:
        return none, none
    grams = tb.SpanHash(hashes).windows(GRAM)
    at = np.arange(len(grams))
    at = at[at + GRAM <= first[1:][doc[at]]]
    key = tb.mix(grams[at] + doc[at].astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    ahead = np.zeros(len(doc) + 1, dtype=np.int64)        # distance to the next equal window
    ahead[at[order[:-1][same]]] = at[order[1:][same]] - at[order[:-1][same]]
    twice = np.zeros(len(doc) + 1, dtype=bool)
    twice[at[order[:-1][same]]] = True
    twice[at[order[1:][same]]] = True
    edge = np.flatnonzero(np.diff(np.r_[False, twice].astype(np.int8)))
    lo, hi = edge[::2], edge[1::2]
    # windows of two texts never join: the last words of a text start none
    width = hi - lo + GRAM - 1
    if not len(lo):
        return none, none
    near = np.where(ahead > 0, ahead, np.iinfo(np.int64).max)
    nearest = np.minimum.reduceat(near, np.column_stack([lo, hi]).ravel())[::2]
    ok = (width >= MIN_LENGTH) & (MIN_EXPONENT * nearest.astype(np.float64) <= width)
    return lo[ok], (hi + GRAM - 1)[ok]


def _rows(ids: list, data: np.ndarray, off: np.ndarray):
    start, end, first = tb.word_spans(data, off)
    doc = tb.owner(first)
    at, changed = _source_words(ids, first)
    hashes = tb.SpanHash(tb.byte_codes(data))(start, end)[at]
    lo, hi = stretches(hashes, doc, first)
    whole = data.tobytes()
    runs: dict[int, list] = {}
    if len(lo):
        number: dict[bytes, int] = {}
        parts = [[number.setdefault(whole[start[w]: end[w]], len(number)) for w in at[a:b].tolist()] for a, b in zip(lo, hi)]
        for k, s, length, period in runs_of(parts).tolist():
            d = int(doc[lo[k]])
            runs.setdefault(d, []).append((s + int(lo[k] - first[d]), length, period))
    for k, i in enumerate(ids):
        n = int(first[k + 1] - first[k])
        words = whole[off[k]: off[k + 1]].split()
        if k in changed:
            words = [words[j] for j in changed[k].tolist()]
        got = sorted(runs.get(k, []), key=lambda r: (r[0], r[2]))
        listed = "".join(f"{s},{length},{p}\n" for s, length, p in got)
        keep = np.ones(n, dtype=bool)
        for s, length, p in got:
            keep[s + p: s + length] = False
        if got:
            words = [words[j] for j in np.flatnonzero(keep).tolist()]
        best = min(got, key=lambda r: (-r[1], r[0], r[2])) if got else (None, None, None)
        yield (i, n, len(got), *best, 1000 * best[1] // best[2] if got else None, hashlib.sha256(listed.encode()).hexdigest(),
               hashlib.sha256(b" ".join(words)).hexdigest(), int(n - keep.sum()))


_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
_TYPES = [pa.int64()] * 7 + [pa.string()] * 2 + [pa.int64()]


def _batches(it):
    for batch in it:
        ids = batch.column(0).to_pylist()
        for lo, hi, data, off in tb.slices(batch.column(1)):
            cols = list(zip(*_rows(ids[lo:hi], data, off)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES)], names=_NAMES)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """Runs of every document (counted, the longest one, digest of all) and
    the digest of the words left when only each run's first period stays."""
    return texts(docs).mapInArrow(_batches, SCHEMA)
