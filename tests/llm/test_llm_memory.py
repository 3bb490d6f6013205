"""What a task holds doesn't grow with the square of a group."""

import tracemalloc

import numpy as np
import pyarrow as pa

from tessera.llm import jaccard_join as jj
from tessera.llm import suffix_dedup as sd
from tessera.llm import textbatch as tb


def _peak(run):
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def _tree(n, rng):
    size = np.sort(rng.integers(90, 110, n))
    sets = [np.sort(rng.choice(1 << 20, k, replace=False)).astype(np.uint64) for k in size]
    bits = np.full((n, 4), (1 << 64) - 1, dtype=np.uint64)      # nothing that tells them apart
    return jj.SignatureTree(size, np.full(n, 60), bits, np.arange(n), np.ones(n, dtype=bool), [np.frombuffer(jj.bitmap(s), dtype=np.uint64) for s in sets])


def test_a_large_group_is_compared_in_pieces(monkeypatch):
    seen = []
    may = jj.SignatureTree._may
    monkeypatch.setattr(jj.SignatureTree, "_may", lambda self, level, a, b: (seen.append(len(a)), may(self, level, a, b))[1])
    monkeypatch.setattr(jj, "room", lambda na, nb, x, y: np.ones(len(x), dtype=bool))
    tree = _tree(1200, np.random.default_rng(5))
    a, b = tree.pairs()
    assert max(seen) <= 1 << 18
    i, j = np.triu_indices(1200, 1)
    ok = may(tree, 0, i, j)
    assert sorted(zip(a.tolist(), b.tolist())) == sorted(zip(i[ok].tolist(), j[ok].tolist()))


def test_index_of_suffixes_compares_them_in_pieces():
    s = np.random.default_rng(3).integers(0, 255, 300_000).astype(np.uint8)
    index = sd.RunLengthIndex(s)
    before = np.where(index.sa > 0, index.sa - 1, -1)
    want = [int(b >= 0 and np.argmin(np.append(s[a:a + 9][:min(len(s[a:]), 9)] == s[b:b + 9][:min(len(s[a:]), 9)], False)))
            for a, b in zip(index.sa[:2000].tolist(), before[:2000].tolist())]
    got = index._compare(index.sa, before)
    assert got[:2000].tolist() == want
    assert _peak(lambda: index._compare(index.sa, before)) < 20 << 20


def test_bits_are_read_from_the_packed_bitmap():
    rng = np.random.default_rng(1)
    bits = rng.random(1 << 16) < 0.3
    at = rng.integers(0, 1 << 16, 5000)
    assert (tb.has_bit(np.packbits(bits, bitorder="little"), at) == bits[at]).all()


def test_places_are_picked_without_unpacking_their_bitmap():
    class Wanted:
        value = np.zeros(1 << 24, dtype=np.uint8)

    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["word " * 60])], names=["doc_id", "text"])
    assert _peak(lambda: list(sd._contexts([batch], Wanted))) < 64 << 20
