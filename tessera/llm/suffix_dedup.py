"""Repeated passages across documents by a run-length index.

Texts are byte strings.  A byte goes when it is covered by a string of
``LENGTH`` bytes that also starts earlier (in a smaller ``doc_id``, or earlier
in the same document); matches never cross documents and are judged on the
input.

One index over the whole corpus would be one task's work, so the corpus is
dealt out by content.  Every string of ``LENGTH`` bytes has an anchor, its
``GRAM``-byte substring with the smallest hash; equal strings have equal
anchors, neighbouring strings mostly share theirs.  An anchor's context, the
bytes of all strings that have it, is at most ``2 * LENGTH - GRAM`` bytes.

1. Anchors (about one per 35 bytes) are dealt by the anchor's hash, packed
   into arrays, with a hash of their context.  Anchors that stand alone end
   here.  Of equal contexts all but the first are repeats as a whole.
2. Where one anchor has several contexts (the ends of a shared passage, edits
   in near copies) the distinct contexts are fetched and indexed in groups:
   a Burrows-Wheeler transform, compressed to its runs, with the longest
   common prefix sampled at run ends.  Streaming over the text, the match
   length falls by one a byte from the last sample (run-internal values need
   no comparison), which gives the matching statistics; stretches of at least
   ``LENGTH`` form classes, and all but a class's first are repeats.
3. An anchor with more than ``HOT`` distinct contexts would make one group
   too large; its strings are then counted one by one by an aggregate.
4. The repeats of a document are joined to its text and cut out.

Defined cases: null texts are empty; empty texts and texts shorter than
``LENGTH`` lose nothing but may be any length; a null ``doc_id`` sorts first;
every row is a document of its own, rows of one id (or without one) go in order
of their texts; an empty table gives an empty result; further columns are kept by ``cut_repeats`` and ignored by
``repeats``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scan import row_ordinal
from ..session import cut_lineage
from . import textbatch as tb
from .common import texts

LENGTH = 100
GRAM = 32
HOT = 8000                   # distinct contexts of one anchor (about a megabyte) beyond which strings are counted one by one
BUCKET_BYTES = 6 << 20       # bytes of text whose anchors a bucket is meant to hold
INDEX_BYTES = 1 << 18        # bytes of context an index is meant to hold
COMPARED = 1 << 15           # pairs of suffixes compared at once
MAX_BITS = 1 << 27           # largest bitmap of places (16 MB)
NO_ID = -(1 << 63)

_LOW = np.uint64((1 << 32) - 1)


def anchors(data: np.ndarray, off: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """``(text, gram hash, first start, last start, context hash)`` of every
    run of neighbouring strings with one anchor; starts count from the start
    of the slice."""
    n = len(data) - gram + 1
    size = np.diff(off)
    if n <= 0 or not (size >= length).any():
        z = np.zeros(0, dtype=np.int64)
        return z, z.astype(np.uint64), z, z, z.astype(np.uint64)
    sh = tb.SpanHash(tb.byte_codes(data))
    h = sh.windows(gram)
    key = (h & ~_LOW) | np.arange(n, dtype=np.uint64)
    want, have = length - gram + 1, 1
    while have * 2 <= want:                 # smallest key of `have` neighbours, doubling
        key = np.minimum(key[:-have], key[have:]) if len(key) > have else key[:0]
        have *= 2
    if want > have:
        key = np.minimum(key[:len(key) - (want - have)], key[want - have:])
    inside = np.zeros(len(data) + 1, dtype=np.int64)
    big = size >= length
    np.add.at(inside, off[:-1][big], 1)
    np.add.at(inside, off[1:][big] - length + 1, -1)
    p = np.flatnonzero(np.cumsum(inside)[:len(key)] > 0)
    a = (key[p] & _LOW).astype(np.int64)
    cut = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
    lo, hi, x = p[cut], p[np.append(cut[1:], len(p)) - 1], a[cut]
    ctx = tb.mix(sh(lo, hi + length) ^ (x - lo + 1).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return np.searchsorted(off, lo, side="right") - 1, h[x], lo, hi, ctx


def _ids(col: pa.Array) -> np.ndarray:
    return col.fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)


_PACK = ("g", "ctx", "doc", "lo", "n")
_TYPES = {"g": np.uint64, "ctx": np.uint64, "doc": np.int64, "lo": np.int32, "n": np.uint8}


def _packed(it, n_buckets):
    step = np.uint64((1 << 64) // n_buckets + 1)
    for batch in it:
        ids = _ids(batch.column(0))
        for r0, r1, data, off in tb.slices(batch.column(1)):
            doc, g, lo, hi, ctx = anchors(data, off)
            if not len(g):
                continue
            order = np.argsort(g)
            v = {"g": g, "ctx": ctx, "doc": ids[r0:r1][doc], "lo": lo - off[doc], "n": hi - lo}
            v = {c: v[c].astype(_TYPES[c])[order] for c in _PACK}
            b = (v["g"] // step).astype(np.int64)
            cut = np.flatnonzero(np.append(True, b[1:] != b[:-1]))
            ends = np.append(cut[1:], len(b))
            yield pa.RecordBatch.from_arrays(
                [pa.array(b[cut])] + [pa.array([v[c][x:y].tobytes() for x, y in zip(cut, ends)], pa.binary()) for c in _PACK],
                names=["bucket", *_PACK])


REPEAT, OPEN = 0, 1


def _classes(table: pa.Table) -> pa.Table:
    """One range of anchors: the repeats of equal contexts, and the anchors
    with several contexts."""
    v = {c: np.concatenate([np.frombuffer(x, dtype=_TYPES[c]) for x in table.column(c).to_pylist()]) for c in _PACK}
    order = np.argsort(v["g"])
    g = v["g"][order]
    same = g[1:] == g[:-1]
    shared = np.append(False, same) | np.append(same, False)
    pick = order[shared]
    v = {c: v[c][pick] for c in _PACK}
    order = np.lexsort((v["lo"], v["doc"], v["ctx"], v["g"]))
    v = {c: v[c][order] for c in _PACK}
    g, ctx, doc, lo = v["g"], v["ctx"], v["doc"], v["lo"]
    if not len(g):
        return pa.table({"kind": pa.array([], pa.int32()), "doc": pa.array([], pa.int64()), "lo": pa.array([], pa.int64()),
                         "hi": pa.array([], pa.int64())})
    new = np.append(True, (g[1:] != g[:-1]) | (ctx[1:] != ctx[:-1]))
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    rep = (doc != doc[first]) | (lo != lo[first])
    at = np.flatnonzero(new)
    gs = g[at]
    more = np.append(gs[1:] == gs[:-1], False)
    several = at[more | np.append(False, more[:-1])]      # first places of the contexts of such anchors
    start = lo[rep].astype(np.int64)
    return pa.table({
        "kind": pa.array(np.repeat([REPEAT, OPEN], [int(rep.sum()), len(several)]).astype(np.int32)),
        "doc": np.concatenate([doc[rep], doc[several]]), "lo": np.concatenate([start, lo[several].astype(np.int64)]),
        "hi": np.concatenate([start + v["n"][rep] + LENGTH, _place(doc[several], lo[several]).view(np.int64)])})


def _place(doc: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Hash of a place in the corpus."""
    return tb.mix(doc.view(np.uint64) * np.uint64(0x9FB21C651E98DF25) ^ lo.astype(np.uint64))


def _rows(g, doc, lo, ctx):
    return pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(doc), pa.array(lo), pa.array(ctx, pa.binary())],
                                      names=["g", "doc", "lo", "ctx"])


def _contexts(it, wanted):
    """Contexts whose place may be wanted (a bitmap of places by hash)."""
    bloom = wanted.value
    bits = np.uint64(8 * len(bloom) - 1)
    for batch in it:
        ids = _ids(batch.column(0))
        for r0, r1, data, off in tb.slices(batch.column(1)):
            doc, g, lo, hi, _ = anchors(data, off)
            if not len(g):
                continue
            d, at = ids[r0:r1][doc], lo - off[doc]
            ok = np.flatnonzero(tb.has_bit(bloom, (_place(d, at) & bits).astype(np.int64)))
            raw = data.tobytes()
            yield _rows(g[ok], d[ok], at[ok], [raw[x:y + LENGTH] for x, y in zip(lo[ok].tolist(), hi[ok].tolist())])


def _all_contexts(it):
    """Contexts at the places that come with each text."""
    for batch in it:
        ids = _ids(batch.column(0))
        places = [np.array(x, dtype=np.int64) for x in batch.column(2).to_pylist()]
        for r0, r1, data, off in tb.slices(batch.column(1)):
            doc, g, lo, hi, _ = anchors(data, off)
            at = lo - off[doc]
            cuts = np.searchsorted(doc, np.arange(r1 - r0 + 1))
            ok = np.concatenate([x + np.flatnonzero(np.isin(at[x:y], places[r0 + k])) for k, (x, y) in enumerate(zip(cuts, cuts[1:]))])
            raw = data.tobytes()
            yield _rows(g[ok], ids[r0:r1][doc[ok]], at[ok], [raw[x:y + LENGTH] for x, y in zip(lo[ok].tolist(), hi[ok].tolist())])


def _bitmap(open_: DataFrame, bits: int) -> np.ndarray:
    """Packed bitmap of the wanted places (misses none; the join that follows
    is exact).  The driver gets ``bits / 64`` words at most."""
    words = (open_.select(F.shiftright(F.col("key").bitwiseAND(F.lit(bits - 1)), 6).alias("w"),
                          F.expr("shiftleft(1L, cast(key & 63 as int))").alias("v"))
             .groupBy("w").agg(F.bit_or("v").alias("v")).toPandas())
    out = np.zeros(bits // 64, dtype=np.uint64)
    out[words["w"].to_numpy(dtype=np.int64)] = words["v"].to_numpy(dtype=np.int64).view(np.uint64)
    return out.view(np.uint8)


def _fetch(docs: DataFrame, open_: DataFrame, max_bits: int) -> DataFrame:
    """``g, doc, lo, ctx`` of the open contexts (``doc, lo, key``).

    While a bitmap of at most ``max_bits`` tells the places well enough, the
    tasks that read the texts pick them; beyond, the places are joined to the
    texts by document."""
    n = open_.count()
    bits = 1 << max(16, (16 * n).bit_length())
    schema = "g long, doc long, lo long, ctx binary"
    if bits <= max_bits:
        packed = docs.sparkSession.sparkContext.broadcast(_bitmap(open_, bits))
        picked = docs.mapInArrow(tb.lean(lambda it: _contexts(it, packed)), schema)
        return picked.join(open_.select("doc", "lo").distinct(), ["doc", "lo"], "left_semi").select("g", "doc", "lo", "ctx")
    places = open_.groupBy("doc").agg(F.collect_list("lo").alias("places"))
    key = F.coalesce(F.col("doc_id"), F.lit(NO_ID))
    return docs.join(places, key == F.col("doc")).select("doc_id", "text", "places").mapInArrow(tb.lean(_all_contexts), schema)


def suffix_array(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and its inverse, by prefix doubling."""
    n = len(s)
    # first rank by eight bytes at once; behind the end stands less than any byte
    wide = np.zeros(n + 7, dtype=np.uint16)
    wide[:n] = s
    key = np.zeros(n, dtype=np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | wide[k:k + n]
    order = np.argsort(key, kind="stable")
    r = np.cumsum(np.append(0, key[order][1:] != key[order][:-1])) + 1
    rank = np.empty(n, dtype=np.int64)
    rank[order] = r
    h = 8
    while True:
        second = np.zeros(n, dtype=np.int64)
        second[:max(n - h, 0)] = rank[h:]
        key = rank * (max(n, 256) + 2) + second
        sa = np.argsort(key, kind="stable")
        k = key[sa]
        r = np.cumsum(np.append(0, k[1:] != k[:-1])) + 1
        rank = np.empty(n, dtype=np.int64)
        rank[sa] = r
        if r[-1] == n or h >= n:
            return sa, rank - 1
        h *= 2


class RunLengthIndex:
    """Run-compressed transform of one text with match lengths sampled at the
    run ends."""

    def __init__(self, s: np.ndarray):
        self.s, self.n = s, len(s)
        self.sa, isa = suffix_array(s)
        bwt = s[self.sa - 1].astype(np.int16)
        bwt[isa[0]] = -1            # the end of the text, no byte
        #: rows of the transform where a run begins
        self.heads = np.flatnonzero(np.append(True, bwt[1:] != bwt[:-1]))
        self.symbols = bwt[self.heads]
        #: text positions of the suffixes at run ends, sorted, and the length
        #: each has in common with the suffix of the row before
        at = self.sa[self.heads]
        before = np.where(self.heads > 0, self.sa[self.heads - 1], -1)
        order = np.argsort(at)
        self.at = at[order]
        self.common = self._compare(self.at, before[order])

    def _compare(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefix of the suffixes at ``a`` and ``b``, in whole
        (``b`` < 0: none), eight bytes a step."""
        out = np.zeros(len(a), dtype=np.int64)
        pad = np.concatenate([self.s, np.zeros(8, dtype=np.uint8)])
        some = np.flatnonzero(b >= 0)
        for k in range(0, len(some), COMPARED):
            self._extend(a, b, pad, out, some[k:k + COMPARED])
        return out

    def _extend(self, a, b, pad, out, live) -> None:
        steps = np.arange(8)
        while len(live):
            x, y = a[live] + out[live], b[live] + out[live]
            room = np.minimum(self.n - np.maximum(x, y), 8)
            same = pad[np.minimum(x, self.n)[:, None] + steps] == pad[np.minimum(y, self.n)[:, None] + steps]
            same &= steps < room[:, None]
            n = np.where(same.all(axis=1), 8, same.argmin(axis=1))
            out[live] += n
            live = live[n == 8]

    def match_lengths(self) -> np.ndarray:
        """For every text position the prefix its suffix has in common with
        the suffix of the row before: streamed from the samples, one less a
        byte."""
        i = np.arange(self.n)
        k = np.searchsorted(self.at, i, side="right") - 1
        return np.where(k >= 0, self.common[k] - (i - self.at[k]), 0)


def mark_contexts(contexts: list[bytes], length: int = LENGTH) -> list[list[int]]:
    """For each context, the starts of its strings of ``length`` bytes that
    also start in an earlier context."""
    s = np.frombuffer(b"\xff".join(contexts) + b"\xff", dtype=np.uint8)
    sizes = np.array([len(c) for c in contexts])
    starts = np.cumsum(np.append(0, sizes[:-1] + 1))
    index = RunLengthIndex(s)
    match = index.match_lengths()[index.sa]
    # rows joined by at least `length` bytes hold one string; only full strings of a context count
    left = np.repeat(sizes, sizes + 1) - (np.arange(len(s)) - np.repeat(starts, sizes + 1))
    full = left[index.sa] >= length
    group = np.cumsum(match < length)
    pos, grp = index.sa[full], group[full]
    first = np.full(grp.max() + 1 if len(grp) else 0, len(s), dtype=np.int64)
    np.minimum.at(first, grp, pos)
    rep = np.sort(pos[pos != first[grp]])
    which = np.searchsorted(starts, rep, side="right") - 1
    out: list[list[int]] = [[] for _ in contexts]
    for w, r in zip(which.tolist(), (rep - starts[which]).tolist()):
        out[w].append(r)
    return out


def _indexed(table: pa.Table) -> pa.Table:
    rows = sorted(zip(table.column("doc").to_pylist(), table.column("lo").to_pylist(), table.column("ctx").to_pylist()))
    doc, lo, hi = [], [], []
    for (d, at, _), starts in zip(rows, mark_contexts([r[2] for r in rows])):
        for r in starts:
            if doc and doc[-1] == d and hi[-1] == at + r - 1 + LENGTH:
                hi[-1] += 1
            else:
                doc.append(d)
                lo.append(at + r)
                hi.append(at + r + LENGTH)
    return pa.table({"doc": pa.array(doc, pa.int64()), "lo": pa.array(lo, pa.int64()), "hi": pa.array(hi, pa.int64())})


def repeats(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``doc, lo, hi``: spans of bytes to remove (they may overlap), by
    ``doc_id``, of rows that have an id each."""
    docs = texts(docs)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_buckets = max(16, -(-int(total) // BUCKET_BYTES))
    found = cut_lineage(
        docs.mapInArrow(tb.lean(lambda it: _packed(it, n_buckets)), "bucket long, g binary, ctx binary, doc binary, lo binary, n binary")
        .groupBy("bucket").applyInArrow(tb.lean_group(_classes), "kind int, doc long, lo long, hi long"))
    whole = found.filter(F.col("kind") == REPEAT).select("doc", "lo", "hi")
    open_ = found.filter(F.col("kind") == OPEN).select("doc", "lo", F.col("hi").alias("key"))
    ctx = cut_lineage(_fetch(docs, open_, max_bits))
    many = ctx.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("ctx")).alias("bytes"))
    n_parts = max(8, -(-int(many.agg(F.sum("bytes")).first()[0] or 0) // INDEX_BYTES))
    hot = many.filter(F.col("n") > HOT).select("g")
    indexed = (ctx.join(hot, "g", "left_anti").withColumn("part", F.pmod(F.xxhash64("g"), F.lit(n_parts)))
               .groupBy("part").applyInArrow(tb.lean_group(_indexed), "doc long, lo long, hi long"))
    strings = (ctx.join(hot, "g", "left_semi")
               .select("doc", "lo", "ctx", F.explode(F.sequence(F.lit(0), F.octet_length("ctx") - LENGTH)).alias("i"))
               .select("doc", (F.col("lo") + F.col("i")).alias("lo"), F.md5(F.expr(f"substring(ctx, i + 1, {LENGTH})")).alias("s")))
    least = strings.groupBy("s").agg(F.min(F.struct("doc", "lo")).alias("f"))
    single = (strings.join(least, "s").filter(F.struct("doc", "lo") != F.col("f"))
              .select("doc", "lo", (F.col("lo") + LENGTH).alias("hi")))
    return whole.union(indexed).union(single)


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__doc``, a number of its own for every row, in order of
    ids: the id itself where all rows have one of their own, else a running
    number (rows without an id first, rows of one id in order of their texts),
    written once."""
    ident = F.col("doc_id").cast("long")
    shared = docs.groupBy(ident.alias("i")).agg(F.count(F.lit(1)).alias("n")).filter("i IS NULL OR n > 1").limit(1).count()
    if not shared:
        return docs.withColumn("__doc", ident)
    x = docs.withColumns({"__i": ident, "__t": F.col("text").cast("string"), "__row": F.monotonically_increasing_id()})
    return row_ordinal(x, [], ["__i", "__t", "__row"], "__doc").drop("__i", "__t", "__row")


def _spans(numbered: DataFrame) -> DataFrame:
    """One row per document with repeats: ``__d, __spans``."""
    return (repeats(numbered.select(F.col("__doc").alias("doc_id"), "text")).groupBy(F.col("doc").alias("__d"))
            .agg(F.collect_list(F.struct("lo", "hi")).alias("__spans")))


def merge(spans) -> list[tuple[int, int]]:
    """Maximal runs of a list of spans."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            if hi > out[-1][1]:
                out[-1] = (out[-1][0], hi)
        else:
            out.append((lo, hi))
    return out


def cut(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    """``raw`` without the bytes of the runs."""
    parts, at = [], 0
    for lo, hi in runs:
        parts.append(raw[at:lo])
        at = hi
    return b"".join([*parts, raw[at:]])


def _runs(col: pa.Array) -> list[list[tuple[int, int]]]:
    flat = col.flatten()
    lo, hi = flat.field(0).to_pylist(), flat.field(1).to_pylist()
    n = pc.list_value_length(col).fill_null(0).to_pylist()
    out, at = [], 0
    for k in n:
        out.append(merge(zip(lo[at:at + k], hi[at:at + k])) if k else [])
        at += k
    return out


def _digest(it):
    for batch in it:
        rows = []
        for text, runs in zip(batch.column(1).to_pylist(), _runs(batch.column(2))):
            raw = (text or "").encode()
            runs = [(lo, min(hi, len(raw))) for lo, hi in runs if lo < len(raw)]
            kept = cut(raw, runs)
            rows.append((len(raw), len(raw) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()))
        n, gone, spans, sha = zip(*rows) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _kept(it):
    for batch in it:
        out = []
        for text, runs in zip(batch.column("text").to_pylist(), _runs(batch.column("__spans"))):
            out.append(cut(text.encode(), runs).decode("utf-8", "ignore") if text and runs else text)
        at = batch.schema.names.index("text")
        emptied = [bool(old) and new == "" for old, new in zip(batch.column("text").to_pylist(), out)]
        kept = batch.set_column(at, "text", pa.array(out, pa.string()))
        yield kept.select([c for c in kept.schema.names if c != "__spans"]).filter(pa.array([not e for e in emptied], pa.bool_()))


def _with_spans(docs: DataFrame) -> DataFrame:
    numbered = _numbered(docs)
    return numbered.join(_spans(numbered), F.col("__doc") == F.col("__d"), "left").drop("__doc", "__d")


def digest(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row."""
    return (_with_spans(texts(docs)).select("doc_id", "text", "__spans")
            .mapInArrow(tb.lean(_digest), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"))


def cut_repeats(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` with their texts cut (``n_chars`` follows, where
    there is one); rows whose text is left empty by the cut go.  A character
    that loses some of its bytes goes as a whole."""
    from pyspark.sql.types import StructType

    joined = _with_spans(docs)
    out = joined.mapInArrow(tb.lean(_kept), StructType(docs.schema.fields))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.length("text").cast(kind))
    return out.select(*docs.columns)
