"""N-gram Jaccard join with signature trees.

A document is the set of its distinct 5-word shingles (64-bit hashes of
ASCII-lower-cased words; fewer than five words: the whole sequence as one).
Two documents link when ``100 * |A & B| >= 75 * |A | B|``; the result is the
component of links each document belongs to.

1. One light pass gives every document its set's size and id (a hash of the
   set); equal sets are one class from here on.
2. Prefix filter: in any fixed order of all shingles, two linked sets share a
   shingle among their first ``n - ceil(0.75 n) + 1``.  The order is by hash,
   with the shingles most frequent in a sample last, so that passages common
   to many documents don't bring them together.  The prefixes are dealt by
   hash range, packed into arrays; shingles that only one class has end there.
3. Groups of two classes with a common prefix shingle are verified as pairs,
   by exact intersection of the whole sets.  In larger groups stars come
   first, in rounds: each class asks one other, the highest-ranked class of
   another component in most of its groups, so a round has at most as many
   pairs as classes; the links make components.  The rank puts a text before
   its edited copies.  Rounds go on while they add a tenth of the links.
4. Groups that still hold several components are joined by signature trees,
   dealt out by shingle, the attributes of a class once a part: leaves hold the bitmap of a class's shared prefix shingles and its size,
   inner nodes the OR of the bitmaps and the range of the sizes; a dual
   traversal drops pairs of nodes that lie in one component or whose largest
   possible overlap is too small.  What is left is verified like the star.
   Before either verification, bitmaps of the whole sets (2 to 4 bits a
   shingle) rule out most pairs that don't link.  A pair is met only in
   groups that the smaller set is in by the first shingles of its order.
5. Components of all links by label propagation with pointer jumping.

Only classes in a verified pair's neighbourhood ever move their whole sets,
and no group of copies is expanded into pairs.  No link is lost: steps 2 and
4 only drop pairs that can't reach the threshold.

Defined cases: null, empty and blank texts have no shingles, ``n_shingles``
0 and are their own component; repeated rows and equal sets share a
component; a null ``doc_id`` counts as no id (it never names a component that
has another), and every row without one is a document of its own; empty tables give an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import textbatch as tb
from .common import SMALL_IDS, small, texts

SHINGLE = 5
PERCENT = 75
BUCKET_HASHES = 300_000      # prefix shingles a bucket is meant to hold
PART_MEMBERS = 150_000       # members of open groups that a tree join is meant to hold
SAMPLE_SHARE = 64            # one document in so many is sampled for the order
SAMPLE_LEAST = 3             # sampled documents that make a shingle frequent
MAX_FREQUENT = 1 << 16       # frequent shingles that the order knows
BLOOM_BITS = 1 << 23
LEAF = 32
PAIRS = 1 << 18              # pairs of nodes that a tree join looks at together
ROUNDS = 24                  # stars before the trees, at most
LEAST_GAIN = 10              # stars go on while one adds a link to ten: what is left is the trees'


def shingle_sets(data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text of a slice."""
    low = tb.lower_ascii(data)
    start, end, first = tb.word_spans(low, off)
    grams = tb.SpanHash(tb.SpanHash(tb.byte_codes(low))(start, end))
    n = np.diff(first)
    h = grams.windows(SHINGLE)
    out = []
    for k, a in zip(n.tolist(), first.tolist()):
        if k >= SHINGLE:
            out.append(np.unique(h[a:a + k - SHINGLE + 1]))
        elif k:
            out.append(grams(np.array([a]), np.array([a + k])))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def set_id(s: np.ndarray) -> int:
    """Hash of a set as a signed 64-bit number, even (the last bit is free)."""
    x = tb.mix(np.array([tb.mix(s ^ np.uint64(0x1D8E4E27C47D124F)).sum(dtype=np.uint64) ^ np.uint64(len(s))], dtype=np.uint64))
    return int(x.view(np.int64)[0]) & ~1


def least_overlap(n):
    """Shingles a set of ``n`` shares with any linked set at least."""
    return (PERCENT * n + 99) // 100


def pair_overlap(a, b):
    """Shingles two linked sets of these sizes share at least:
    100 o >= 75 (a + b - o)."""
    return -((-PERCENT * (a + b)) // (100 + PERCENT))


def bitmap(s: np.ndarray) -> bytes:
    """A set's shingles by their low bits, in 2 to 4 bits a shingle."""
    bits = 1 << max(6, (2 * len(s) - 1).bit_length())
    out = np.zeros(bits, dtype=bool)
    out[(s & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little").tobytes()


def _light(it):
    for batch in it:
        for lo, hi, data, off in tb.slices(batch.column(1)):
            sets = shingle_sets(data, off)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([set_id(s) if len(s) else None for s in sets], pa.int64()),
                 pa.array([bitmap(s) for s in sets], pa.binary())],
                names=["doc_id", "key", "n_shingles", "sid", "bitmap"])


def _sampled(it):
    for batch in it:
        for _, _, data, off in tb.slices(batch.column(1)):
            s = np.concatenate([*shingle_sets(data, off), np.zeros(0, dtype=np.uint64)])
            yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64))], names=["h"])


def _frequent(docs: DataFrame) -> np.ndarray:
    """Shingles of at least ``SAMPLE_LEAST`` sampled documents, the most
    frequent first to go in when there are too many; only the order of the
    prefixes depends on them, never the result."""
    few = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE_SHARE)) == 0).mapInArrow(tb.lean(_sampled), "h long")
    top = (few.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= SAMPLE_LEAST)
           .orderBy(F.desc("n"), "h").limit(MAX_FREQUENT).select("h").toPandas()["h"].to_numpy(dtype=np.int64))
    return np.sort(top.view(np.uint64))


def prefix(s: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The first ``n - least_overlap(n) + 1`` shingles in the global order."""
    p = len(s) - least_overlap(len(s)) + 1
    if not len(frequent):
        return s[:p]
    late = np.isin(s, frequent, assume_unique=True) if len(s) > 64 else frequent[np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)] == s
    if not late.any():
        return s[:p]
    return np.concatenate([s[~late], s[late]])[:p]


def early(n: int, p: int) -> np.ndarray:
    """1 for the shingles of a prefix of ``p`` that may bring a set of ``n``
    together with one at least as large: two linked sets share a shingle
    among the first ``n - pair_overlap(n, n) + 1`` of the smaller one."""
    return (np.arange(p) < n - pair_overlap(n, n) + 1).astype(np.int64)


def _prefixes(it, packed, n_buckets):
    frequent = packed.value
    step = np.uint64((1 << 64) // n_buckets + 1)
    for batch in it:
        for _, _, data, off in tb.slices(batch.column(1)):
            sets = [s for s in shingle_sets(data, off) if len(s)]
            if not sets:
                continue
            ids = np.array([set_id(s) for s in sets], dtype=np.int64)
            once = np.unique(ids, return_index=True)[1]
            pre = [prefix(sets[i], frequent) for i in once]
            h = np.concatenate(pre)
            sid = np.repeat(ids[once], [len(x) for x in pre]) | np.concatenate([early(len(sets[i]), len(x)) for i, x in zip(once, pre)])
            order = np.argsort(h)
            h, sid = h[order], sid[order]
            b = (h // step).astype(np.int64)
            cut = np.flatnonzero(np.append(True, b[1:] != b[:-1]))
            ends = np.append(cut[1:], len(b))
            yield pa.RecordBatch.from_arrays(
                [pa.array(b[cut]), pa.array([h[x:y].tobytes() for x, y in zip(cut, ends)], pa.binary()),
                 pa.array([sid[x:y].tobytes() for x, y in zip(cut, ends)], pa.binary())], names=["bucket", "h", "sid"])


GROUPED = "kind int, x long, y long, n long, b0 long, b1 long, b2 long, b3 long"
PAIR, MEMBER, SHARED = 0, 1, 2


def _bits(sid: np.ndarray, h: np.ndarray):
    """For sorted ``sid``: its ids, how many ``h`` each has, and their
    256-bit bitmaps."""
    cut = np.flatnonzero(np.append(True, sid[1:] != sid[:-1]))
    n = np.diff(np.append(cut, len(sid)))
    at = (tb.mix(h) & np.uint64(255)).astype(np.int64)
    words = []
    for w in range(4):
        v = np.where(at >> 6 == w, np.uint64(1) << (at & 63).astype(np.uint64), np.uint64(0))
        words.append(np.bitwise_or.reduceat(v, cut).view(np.int64))
    return sid[cut], n, words


def _group(table: pa.Table) -> pa.Table:
    """One hash range: the groups of classes that share a prefix shingle, as
    a pair if there are two and as members if more, and each class's bitmap
    of shared shingles."""
    h = np.concatenate([np.frombuffer(x, dtype=np.uint64) for x in table.column("h").to_pylist()])
    sid = np.concatenate([np.frombuffer(x, dtype=np.int64) for x in table.column("sid").to_pylist()])
    order = np.lexsort((sid, h))
    h, sid = h[order], sid[order]
    once = np.append(True, (h[1:] != h[:-1]) | (sid[1:] != sid[:-1]))
    h, sid = h[once], sid[once]
    first_half, sid = sid & 1, sid & ~1
    cut = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    size = np.diff(np.append(cut, len(h)))
    per = np.repeat(size, size)
    centre = np.repeat(sid[cut], size)
    shared = per > 1
    h, sid, centre, per, first_half = h[shared], sid[shared], centre[shared], per[shared], first_half[shared]
    if not len(h):
        return pa.table({c.split()[0]: pa.array([], pa.int32() if c.startswith("kind") else pa.int64()) for c in GROUPED.split(", ")})
    many = per > 2
    pair = np.unique(np.stack([centre, sid], axis=1)[~many & (sid != centre)], axis=0)
    order = np.argsort(sid, kind="stable")
    ids, n, words = _bits(sid[order], h[order])
    k = [len(pair), int(many.sum()), len(ids)]
    pad = np.zeros(k[0] + k[1], dtype=np.int64)
    marks = np.append(np.zeros(k[0], dtype=np.int64), first_half[many])
    return pa.table({
        "kind": pa.array(np.repeat([PAIR, MEMBER, SHARED], k).astype(np.int32)),
        "x": np.concatenate([pair[:, 0], h[many].view(np.int64), ids]),
        "y": np.concatenate([pair[:, 1], sid[many], np.zeros(k[2], dtype=np.int64)]),
        "n": np.concatenate([marks, n]), **{f"b{w}": np.concatenate([pad, words[w]]) for w in range(4)}})


def room(na, nb, x, y) -> np.ndarray:
    """Which pairs of sets the bitmaps of the whole sets leave room for a
    link: a bit of one that the other lacks is a shingle it lacks (the wider
    bitmap is folded)."""
    out = np.zeros(len(x), dtype=bool)
    for i, (a, b) in enumerate(zip(x, y)):
        while len(a) > len(b):
            a = a[:len(a) // 2] | a[len(a) // 2:]
        while len(b) > len(a):
            b = b[:len(b) // 2] | b[len(b) // 2:]
        both = int(np.bitwise_count(a & b).sum())
        o = pair_overlap(int(na[i]), int(nb[i]))
        out[i] = int(np.bitwise_count(a).sum()) - both <= na[i] - o and int(np.bitwise_count(b).sum()) - both <= nb[i] - o
    return out


class SignatureTree:
    """Classes of one group, in order of size; inner nodes hold the OR of the
    bitmaps, the range of the sizes, the most shared shingles of a class and
    the component, if it is only one.  ``whole`` are the bitmaps of the whole
    sets, which pairs of leaves are held against last."""

    def __init__(self, size, shared, bits, comp, early, whole):
        self.size, self.early, self.whole = size, early, whole
        lo = hi = size
        most, word, one = shared, bits, comp
        self.levels = [(lo, hi, most, word, one)]
        fan = LEAF
        while len(lo) > 1:
            cut = np.arange(0, len(lo), fan)
            first, last = np.minimum.reduceat(one, cut), np.maximum.reduceat(one, cut)
            lo, hi = np.minimum.reduceat(lo, cut), np.maximum.reduceat(hi, cut)
            most, word = np.maximum.reduceat(most, cut), np.bitwise_or.reduceat(word, cut, axis=0)
            one = np.where(first == last, first, -1)
            self.levels.append((lo, hi, most, word, one))
            fan = 8
        self.fans = [LEAF] + [8] * (len(self.levels) - 2)

    def pairs(self):
        """Pairs of members that may link, of different components.  Pairs of
        nodes are opened ``PAIRS`` at a time, depth first, so that what is held
        doesn't grow with the square of the group."""
        top = len(self.levels) - 1
        a = b = np.zeros(1, dtype=np.int64)
        ok = self._may(top, a, b)
        todo, found = [(top, a[ok], b[ok])], []
        while todo:
            level, a, b = todo.pop()
            if not level:
                found.append((a, b))
                continue
            level -= 1
            fan, n = self.fans[level], len(self.levels[level][0])
            step = max(1, PAIRS // fan ** 2)
            if len(a) > step:
                todo.append((level + 1, a[step:], b[step:]))
                a, b = a[:step], b[:step]
            ka = (a[:, None] * fan + np.arange(fan))
            kb = (b[:, None] * fan + np.arange(fan))
            a2 = np.repeat(ka, fan, axis=1).ravel()
            b2 = np.tile(kb, (1, fan)).ravel()
            ok = (a2 < n) & (b2 < n) & (a2 <= b2)
            a, b = a2[ok], b2[ok]
            ok = self._may(level, a, b)
            if ok.any():
                todo.append((level, a[ok], b[ok]))
        return tuple(np.concatenate([x[i] for x in found] or [np.zeros(0, dtype=np.int64)]) for i in (0, 1))

    def _may(self, level, a, b):
        lo, hi, most, word, one = self.levels[level]
        ok = (one[a] < 0) | (one[a] != one[b])
        if level == 0:
            ok &= a != b
        # sizes: members are in order of size, so a's are the smaller
        ok &= (100 * hi[a] >= PERCENT * lo[b]) & (100 * hi[b] >= PERCENT * lo[a])
        common = word[a] & word[b]
        ok &= common.any(axis=1)
        # shingles that must be shared within the shorter of the two prefixes
        need = np.minimum(_need(hi[a], lo[b]), _need(hi[b], lo[a])) - 1
        possible = np.minimum(most[a], most[b])
        if level == 0:
            miss_a = np.bitwise_count(word[a] & ~word[b]).sum(axis=1)
            miss_b = np.bitwise_count(word[b] & ~word[a]).sum(axis=1)
            possible = np.minimum(possible, np.minimum(most[a] - miss_a, most[b] - miss_b))
            ok &= self.early[a]               # in this group through the smaller one's first shingles
        ok &= possible >= np.maximum(need, 1)
        if level == 0:
            at = np.flatnonzero(ok)
            ok[at] = room(self.size[a[at]], self.size[b[at]], [self.whole[i] for i in a[at]], [self.whole[i] for i in b[at]])
        return ok


def _need(a, b):
    """Least shared shingles among the whole prefix of a set of size ``a``
    that links with one of size ``b``."""
    return (a - least_overlap(a) + 1) - (a - pair_overlap(a, b))


def _tree_join(members: pa.Table, classes: pa.Table) -> pa.Table:
    """Candidate pairs of the groups (by shingle) of one part; the part's
    classes come once each, however many of its groups they are in."""
    col = {c: members.column(c).to_numpy() for c in ("h", "m", "early")}
    of = {c: classes.column(c).to_numpy() for c in ("sid", "size", "shared", "root")}
    by = np.argsort(of["sid"])
    at = by[np.searchsorted(of["sid"], col["m"], sorter=by)]
    order = np.lexsort((col["m"], of["size"][at], col["h"]))
    h, first, at = col["h"][order], col["early"][order], at[order]
    maps = classes.column("bitmap").combine_chunks()
    bits = np.stack([classes.column(f"b{w}").to_numpy().view(np.uint64) for w in range(4)], axis=1)
    cut = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    out = []
    for x, y in zip(cut.tolist(), np.append(cut[1:], len(h)).tolist()):
        k = at[x:y]
        comp = np.unique(of["root"][k], return_inverse=True)[1]
        whole = [np.frombuffer(maps[i].as_buffer(), dtype=np.uint64) for i in k.tolist()]
        a, b = SignatureTree(of["size"][k], of["shared"][k], bits[k], comp, first[x:y] == 1, whole).pairs()
        if len(a):
            p = np.stack([of["sid"][k][a], of["sid"][k][b]], axis=1)
            p.sort(axis=1)
            out.append(np.unique(p, axis=0))
    p = np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), dtype=np.int64)
    return pa.table({"a": p[:, 0], "b": p[:, 1]})


def _whole_sets(it, wanted):
    bloom = wanted.value.tobytes()
    for batch in it:
        for _, _, data, off in tb.slices(batch.column(1)):
            got = {}
            for s in shingle_sets(data, off):
                if len(s):
                    i = set_id(s)
                    if bloom[(i & (BLOOM_BITS - 1)) >> 3] >> (i & 7) & 1:
                        got[i] = s.tobytes()
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.int64()), pa.array(list(got.values()), pa.binary())],
                                                 names=["sid", "shingles"])


def _bloom(ids: DataFrame) -> np.ndarray:
    """Packed bitmap of fixed size of the ids wanted (misses none; the join that
    follows is exact).  The driver gets at most ``BLOOM_BITS / 64`` words."""
    bit = F.col("id").bitwiseAND(F.lit(BLOOM_BITS - 1))
    words = (ids.select(F.shiftright(bit, 6).alias("w"), F.expr(f"shiftleft(1L, cast(id & 63 as int))").alias("v"))
             .groupBy("w").agg(F.bit_or("v").alias("v")).toPandas())
    out = np.zeros(BLOOM_BITS // 64, dtype=np.uint64)
    out[words["w"].to_numpy(dtype=np.int64)] = words["v"].to_numpy(dtype=np.int64).view(np.uint64)
    return out.view(np.uint8)


def _plausible(it):
    """Pairs whose bitmaps leave room for a link."""
    for batch in it:
        na, nb = (batch.column(k).to_numpy() for k in (2, 3))
        x, y = ([np.frombuffer(v, dtype=np.uint64) for v in batch.column(k).to_pylist()] for k in (4, 5))
        yield batch.select([0, 1]).filter(pa.array(room(na, nb, x, y), pa.bool_()))


def plausible(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs ``a, b`` that neither the sizes, nor the number of shared
    prefix shingles, nor the bitmaps of the whole sets rule out."""
    na, nb = F.col("na"), F.col("nb")
    least = lambda a, b: F.ceil((PERCENT * (a + b)) / F.lit(100 + PERCENT))
    need = lambda a, b: (a - F.floor((PERCENT * a + 99) / 100) + 1) - (a - least(a, b)) - 1
    by = classes.select("sid", "size", "shared", "bitmap")
    both = (pairs.join(by.toDF("a", "na", "ra", "ba"), "a").join(by.toDF("b", "nb", "rb", "bb"), "b")
            .filter((100 * na >= PERCENT * nb) & (100 * nb >= PERCENT * na))
            .filter(F.least("ra", "rb") >= F.least(need(na, nb), need(nb, na))))
    return cut_lineage(both.select("a", "b", "na", "nb", "ba", "bb").mapInArrow(tb.lean(_plausible), "a long, b long"))


def _exact(it):
    for batch in it:
        keep = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            s, t = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
            o = len(np.intersect1d(s, t, assume_unique=True))
            keep.append(100 * o >= PERCENT * (len(s) + len(t) - o))
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs ``a, b`` of class ids whose whole sets link."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b"))
    packed = docs.sparkSession.sparkContext.broadcast(_bloom(ids))
    sets = (docs.mapInArrow(tb.lean(lambda it: _whole_sets(it, packed)), "sid long, shingles binary")
            .join(ids.distinct(), F.col("sid") == F.col("id"), "left_semi")
            .groupBy("sid").agg(F.first("shingles").alias("shingles")))
    sets = cut_lineage(sets)
    left = sets.select(F.col("sid").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("sid").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb")
    return cut_lineage(both.mapInArrow(tb.lean(_exact), "a long, b long"))


def components(links: DataFrame) -> DataFrame:
    """``id, root`` of every node of ``links`` (``a, b``): the smallest id
    that it reaches.  Labels pass along the links and jump to the labels of
    their labels, so the rounds grow with the logarithm of a path's length."""
    edges = cut_lineage(links.select("a", "b").union(links.select("b", "a")).distinct())
    lab = cut_lineage(edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m"))
                      .select("id", F.least("id", "m").alias("root")))
    while True:
        near = (edges.join(lab.select(F.col("id").alias("b"), F.col("root").alias("r")), "b")
                .groupBy(F.col("a").alias("id")).agg(F.min("r").alias("r")))
        step = lab.join(near, "id").select("id", F.col("root").alias("old"), F.least("root", "r").alias("root"))
        jump = step.select(F.col("id").alias("j"), F.col("root").alias("jr"))
        new = cut_lineage(step.join(jump, F.col("root") == F.col("j")).select("id", "old", F.least("root", "jr").alias("root")))
        changed = new.filter("old <> root").limit(1).count()
        lab = new.select("id", "root")
        if not changed:
            return lab


def _ranked(members: DataFrame, classes: DataFrame) -> DataFrame:
    """Members with ``rank``, the mean size of the groups over a class's
    prefix, and ``root``, the class itself.  A text of which others are edited
    copies ranks above them: their edited shingles have no group."""
    sizes = members.groupBy("h").agg(F.count(F.lit(1)).alias("k"))
    p = F.col("size") - F.floor((PERCENT * F.col("size") + 99) / 100) + 1
    rank = (members.join(sizes, "h").groupBy("sid").agg(F.sum("k").alias("k"))
            .join(classes.select("sid", "size"), "sid").select("sid", (F.col("k") / p).alias("rank")))
    return cut_lineage(members.join(rank, "sid").select("h", "sid", "early", "rank", F.col("sid").alias("root")))


def _asked(members: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """At most one pair ``a < b`` a class, not among those ``asked``: with the
    highest-ranked class of most of its groups that is of another component."""
    centre = members.groupBy("h").agg(F.max(F.struct("rank", "sid", "root")).alias("m"))
    star = (members.join(centre, "h").filter(F.col("root") != F.col("m.root"))
            .groupBy(F.col("m.sid").alias("c"), "sid").agg(F.count(F.lit(1)).alias("votes"), F.max("m.rank").alias("rank")))
    if asked is not None:
        done = asked.unionByName(asked.select(F.col("a").alias("b"), F.col("b").alias("a"))).toDF("c", "sid")
        star = star.join(done, ["c", "sid"], "left_anti")
    best = star.groupBy("sid").agg(F.max(F.struct("votes", "rank", "c")).alias("m"))
    return best.select(F.least("sid", "m.c").alias("a"), F.greatest("sid", "m.c").alias("b")).distinct()


def _open_groups(members: DataFrame, comps: DataFrame) -> DataFrame:
    """Members (``h, sid, early, rank``) with ``root`` of the groups that hold
    several components and may bring two of them together."""
    member = (members.join(comps.withColumnRenamed("id", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid")))
    open_ = (member.groupBy("h").agg(((F.min("root") != F.max("root")) & (F.max("early") == 1)).alias("open"))
             .filter("open").select("h"))
    return cut_lineage(member.join(open_, "h").select("h", "sid", "early", "rank", "root"))


def similarity_components(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs``."""
    named = _named(docs)
    name = named.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return (named.join(name, "root", "left")
            .select("doc_id", "n_shingles", F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")))


def _row_key() -> Column:
    """Rows of one id and text have one key."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def _named(docs: DataFrame) -> DataFrame:
    """``doc_id, key, n_shingles, sid, root`` of every row: its class and the
    smallest class of its component (both null without shingles)."""
    keyed = texts(docs).withColumn("key", _row_key())
    docs = keyed.drop("key")
    light = cut_lineage(keyed.mapInArrow(tb.lean(_light), "doc_id long, key long, n_shingles long, sid long, bitmap binary"))
    total = light.agg(F.sum("n_shingles")).first()[0] or 0
    n_buckets = max(16, -(-int(total) // (4 * BUCKET_HASHES)))
    spark = docs.sparkSession
    frequent = spark.sparkContext.broadcast(_frequent(docs))
    grouped = cut_lineage(docs.mapInArrow(tb.lean(lambda it: _prefixes(it, frequent, n_buckets)), "bucket long, h binary, sid binary")
                          .groupBy("bucket").applyInArrow(tb.lean_group(_group), GROUPED))
    sizes = light.filter("sid is not null").groupBy("sid").agg(F.first("n_shingles").alias("size"), F.first("bitmap").alias("bitmap"))
    classes = cut_lineage(grouped.filter(F.col("kind") == SHARED).groupBy(F.col("x").alias("sid"))
                          .agg(F.sum("n").alias("shared"), *[F.bit_or(f"b{w}").alias(f"b{w}") for w in range(4)])
                          .join(sizes, "sid"))

    pairs = grouped.filter(F.col("kind") == PAIR).select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
    rest = _ranked(grouped.filter(F.col("kind") == MEMBER).select(F.col("x").alias("h"), F.col("y").alias("sid"), F.col("n").alias("early")), classes)
    # stars in rounds: a class asks one centre a round, that of most of its open groups
    new = pairs.union(_asked(rest))
    asked = links = comps = None
    for _ in range(ROUNDS):
        new = cut_lineage(new.distinct() if asked is None else new)
        found = verified(plausible(new, classes), docs)
        n_found = found.count()
        n_links = n_found if links is None else links.count()
        asked = new if asked is None else cut_lineage(asked.unionByName(new))
        links = found if links is None else cut_lineage(links.unionByName(found))
        if n_found or comps is None:
            comps = components(links)
            rest = _open_groups(rest.drop("root"), comps)
        if n_found * LEAST_GAIN < n_links or not n_found:
            break
        new = _asked(rest, asked)
    n_parts = -(-rest.count() // PART_MEMBERS) or 1
    rest = rest.withColumn("part", F.pmod(F.xxhash64("h"), F.lit(n_parts)))
    per_part = rest.groupBy(F.col("part").alias("p"), F.col("sid").alias("s")).agg(F.first("root").alias("root"))
    per_part = per_part.join(classes, F.col("s") == F.col("sid")).drop("s")
    more = (rest.select("part", "h", F.col("sid").alias("m"), "early").groupBy("part").cogroup(per_part.groupBy("p"))
            .applyInArrow(_tree_join, "a long, b long").distinct().join(asked, ["a", "b"], "left_anti"))
    more = cut_lineage(more)
    if more.limit(1).count():
        found = verified(more, docs)
        if found.limit(1).count():
            comps = components(links.union(found))

    return (light.drop("bitmap").join(comps.withColumnRenamed("id", "sid"), "sid", "left")
            .withColumn("root", F.coalesce("root", "sid")))


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each component, that of the smallest id (null last; all
    columns of ``docs``).  Rows without shingles are linked with nothing and
    stay, but of rows that repeat an id and a text one stays."""
    named = cut_lineage(_named(docs))
    first = (named.filter("root is not null").groupBy("root")
             .agg(F.min(F.struct(F.col("doc_id").isNull().alias("u"), "doc_id", "key")).alias("m")).select("m.key"))
    keys = cut_lineage(first.union(named.filter("root is null").select("key")).distinct())
    one = small(keys.withColumnRenamed("key", "__key"), SMALL_IDS)
    kept = docs.withColumn("__row", _row_key()).join(one, F.col("__row") == F.col("__key"), "left_semi")
    # only rows that repeat need another exchange of their texts
    again = named.filter("doc_id is not null or root is not null").groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    again = cut_lineage(again.join(keys, "key", "left_semi"))
    if not again.limit(1).count():
        return kept.drop("__row")
    more = small(again.withColumnRenamed("key", "__key"), SMALL_IDS)
    twice = F.col("__row") == F.col("__key")
    return (kept.join(more, twice, "left_anti").unionByName(kept.join(more, twice, "left_semi").dropDuplicates(["doc_id", "text"]))
            .drop("__row"))
