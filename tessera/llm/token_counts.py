"""Token counts by trie-shared dynamic programming.

A text is cut into pre-tokens that cover all its bytes: every word takes one
space before it, white space left over forms runs.  A pre-token is segmented
into pieces of a fixed public vocabulary (byte pieces included, so every byte
string has a segmentation) with the smallest total cost under a unigram model
whose cost of a piece grows with the logarithm of its rank; among equal costs
the fewest pieces count.

The distinct pre-tokens of a slice of texts are inserted in a trie, level by
level, as numpy arrays; the forward scores are computed once per node, so
pre-tokens share the work of their common prefixes, and the count at a
pre-token's last node is its token count.  One Arrow pass, no shuffle.

Defined cases: null and empty texts have no tokens; texts of any length are
counted whole; pre-tokens longer than ``LONG`` bytes are scored by themselves
(same scores, no trie); repeated rows are counted one by one; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textbatch as tb
from .common import texts

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
LONG = 256
_COUNT_BITS = 20     # low bits of a score: number of pieces
_TABLE_BITS = 20
_B = np.uint64(0x100000001B3)

SCHEMA = "doc_id long, n_tokens long, n_pretokens long, n_bytes long"


def read_vocabulary(path: str = VOCABULARY) -> dict[bytes, int]:
    """Piece -> cost of all pieces, from lines of base64 piece and rank.  Costs are
    integers, ``1e6 * ln(rank + 2)``, so sums and ties are exact."""
    out = {}
    with open(path, "rb") as f:
        for line in f:
            piece, rank = line.split()
            piece = base64.b64decode(piece)
            out[piece] = int(round(1e6 * np.log(int(rank) + 2.0)))
    return out


def pre_tokens(data: np.ndarray, off: np.ndarray):
    """Start and end of every pre-token and, per text, the index of its
    first (one more entry than texts)."""
    ws, we, first = tb.word_spans(data, off)
    doc = tb.owner(first)
    space = (ws > off[:-1][doc]) & (data[np.maximum(ws - 1, 0)] == 0x20)
    start = ws - space
    # what lies between: from the end of the word before (or of the text's start) to the word, and after the last word
    before = np.append(0, we[:-1]) if len(we) else we
    is_first = np.zeros(len(ws), dtype=bool)
    is_first[first[:-1][np.diff(first) > 0]] = True
    before = np.where(is_first, off[:-1][doc], before)
    last = first[1:] - 1
    tail = np.where(np.diff(first) > 0, we[np.maximum(last, 0)] if len(we) else off[:-1], off[:-1])
    s = np.concatenate([start, before, tail])
    e = np.concatenate([we, start, off[1:]])
    ok = e > s
    s, e = s[ok], e[ok]
    order = np.argsort(s, kind="stable")
    s, e = s[order], e[order]
    return s, e, np.searchsorted(s, off)


class Unigram:
    """Costs of pieces by hash of their bytes."""

    def __init__(self, pieces: dict[bytes, int]):
        self.pieces = pieces
        self.longest = max((len(p) for p in pieces), default=1)
        self.lengths = sorted({len(p) for p in pieces})
        codes = np.array([self._hash(p) for p in pieces], dtype=np.uint64)
        order = np.argsort(codes)
        self.codes = codes[order]
        self.costs = (np.fromiter(pieces.values(), dtype=np.int64, count=len(pieces))[order] << _COUNT_BITS) + 1
        self.table = np.zeros(1 << _TABLE_BITS, dtype=bool)
        self.table[(self.codes >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True

    @staticmethod
    def _hash(piece: bytes) -> int:
        h = 0
        for b in piece:
            h = (h * int(_B) + b + 1) & ((1 << 64) - 1)
        return int(tb.mix(np.array([h ^ len(piece) << 56], dtype=np.uint64))[0])

    def cost(self, raw: np.ndarray, length: int) -> np.ndarray:
        """Cost of the pieces with these running hashes; very large if none."""
        h = tb.mix(raw ^ np.uint64(length << 56))
        out = np.full(len(h), np.int64(1) << 61)
        at = np.flatnonzero(self.table[(h >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.codes, h[at]), len(self.codes) - 1)
        hit = self.codes[k] == h[at]
        out[at[hit]] = self.costs[k[hit]]
        return out

    def counts(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Token counts of distinct pre-tokens, through one trie."""
        n = len(start)
        out = np.zeros(n, dtype=np.int64)
        active = np.flatnonzero(size <= LONG)
        for i in np.flatnonzero(size > LONG):
            out[i] = self.count_one(data[start[i]: start[i] + size[i]].tobytes())
        # per node of the level: forward scores of itself and its ancestors (by distance), hashes of its last bytes
        node = np.zeros(n, dtype=np.int64)
        # as wide as the level is deep, up to the longest piece
        best = np.zeros((1, 1), dtype=np.int64)
        tails = np.zeros((1, 1), dtype=np.uint64)
        depth = 0
        while len(active):
            byte = data[start[active] + depth]
            key, at = np.unique(node[active] * 256 + byte, return_inverse=True)
            parent, b = key >> 8, (key & 255).astype(np.uint64)
            depth += 1
            reach = min(depth, self.longest)
            new_tails = np.zeros((len(key), reach + 1), dtype=np.uint64)
            new_tails[:, 1:] = tails[parent, :reach] * _B + (b + np.uint64(1))[:, None]
            score = np.full(len(key), np.int64(1) << 61)
            for length in self.lengths:
                if length > reach:
                    break
                np.minimum(score, best[parent, length - 1] + self.cost(new_tails[:, length], length), out=score)
            width = min(depth + 1, self.longest)
            new_best = np.empty((len(key), width), dtype=np.int64)
            new_best[:, 0] = score
            new_best[:, 1:] = best[parent, :width - 1]
            best, tails = new_best, new_tails
            node[active] = at
            done = size[active] == depth
            out[active[done]] = score[at[done]] & ((1 << _COUNT_BITS) - 1)
            active = active[~done]
        return out

    def count_one(self, raw: bytes) -> int:
        """Token count of one pre-token."""
        best = [(0, 0)]
        for j in range(1, len(raw) + 1):
            best.append(min((best[i][0] + self.pieces[raw[i:j]], best[i][1] + 1)
                            for i in range(max(0, j - self.longest), j) if raw[i:j] in self.pieces))
        return best[-1][1]


def _batches(it, packed):
    model = Unigram(packed.value)
    for batch in it:
        for lo, hi, data, off in tb.slices(batch.column(1)):
            s, e, first = pre_tokens(data, off)
            h = tb.SpanHash(tb.byte_codes(data))(s, e)
            _, one, inv = np.unique(h, return_index=True, return_inverse=True)
            n = model.counts(data, s[one], (e - s)[one])[inv]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), pa.array(tb.per_text(n, first)), pa.array(np.diff(first)), pa.array(np.diff(off))],
                names=["doc_id", "n_tokens", "n_pretokens", "n_bytes"])


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, n_tokens, n_pretokens, n_bytes`` of every row of ``docs``."""
    # one vocabulary, some tens of thousands of short pieces
    packed = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    return texts(docs).mapInArrow(lambda it: _batches(it, packed), SCHEMA)
