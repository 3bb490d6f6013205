"""Numpy parts against plain loops, without Spark."""

import random

import numpy as np
import pyarrow as pa
import pytest

from llm_helpers import WORD
from tessera.llm import attention_lm, decontaminate, jaccard_join, repetition, suffix_dedup, textbatch as tb, token_counts, toxicity


def test_word_spans_and_hashes():
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab é\n\t ") for _ in range(rng.randrange(40))) for _ in range(60)] + ["", None]
    (lo, hi, data, off), = tb.slices(pa.array(texts))
    start, end, first = tb.word_spans(data, off)
    raw = data.tobytes()
    h = tb.SpanHash(tb.byte_codes(data))
    seen = {}
    for i, t in enumerate(texts):
        got = [raw[a:b].decode() for a, b in zip(start[first[i]:first[i + 1]], end[first[i]:first[i + 1]])]
        assert got == WORD.findall(t or "")
        for w, x in zip(got, h(start, end)[first[i]:first[i + 1]].tolist()):
            assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)
    win = h.windows(3)
    assert win.tolist() == h(np.arange(len(data) - 2), np.arange(len(data) - 2) + 3).tolist()


def test_slices_split_and_cover():
    texts = ["abc" * k for k in range(50)]
    got = list(tb.slices(pa.array(texts), 100))
    assert [g[0] for g in got][1:] == [g[1] for g in got][:-1] and got[-1][1] == 50
    assert b"".join(g[2].tobytes() for g in got) == "".join(texts).encode()


def brute_repetition(text):
    ws = WORD.findall(text)
    grams = [tuple(ws[i:i + 3]) for i in range(len(ws) - 2)]
    cov = set()
    for i, g in enumerate(grams):
        if grams.count(g) > 1:
            cov |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(cov))


def test_repetition_against_loops():
    rng = random.Random(2)
    texts = ["".join(rng.choice(["a ", "b ", "é ", "\n", "a b\n", "# "]) for _ in range(rng.randrange(90))) for _ in range(80)] + [""]
    (_, _, data, off), = tb.slices(pa.array(texts))
    got = repetition.measure(data, off)
    for i, t in enumerate(texts):
        assert tuple(int(got[c][i]) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == brute_repetition(t)


def edits(p, t):
    row = [0] * (len(t) + 1)
    for i in range(1, len(p) + 1):
        new = [i]
        for j in range(1, len(t) + 1):
            new.append(min(row[j - 1] + (p[i - 1] != t[j - 1]), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_decontamination_against_alignment(seed):
    rng = random.Random(seed)
    letters = "abcdefgh "
    for _ in range(60):
        item = decontaminate.normalise(pa.array(["".join(rng.choice(letters) for _ in range(rng.randint(60, 150)))]))[0].as_py()
        near = bytearray(item)
        for _ in range(rng.randint(0, 14)):
            at, kind = rng.randrange(len(near)), rng.random()
            if kind < .4:
                near[at] = rng.choice(b"abcdefgh")
            elif kind < .7:
                del near[at]
            else:
                near.insert(at, rng.choice(b"abcdefgh"))
        pad = lambda: "".join(rng.choice(letters) for _ in range(rng.randrange(150)))
        text = decontaminate.normalise(pa.array([pad() + near.decode() + pad()]))[0].as_py()
        got = decontaminate.find(None, [b"other", text], decontaminate.Items([7], [item]))
        least = edits(item, text)
        assert bool(got) == (least <= decontaminate.budget(len(item)))
        assert not got or (got[0][0], got[0][2]) == (1, least)


def test_run_length_index():
    rng = random.Random(4)
    for _ in range(80):
        s = bytes(rng.choice([0, 97, 98, 255]) for _ in range(rng.randrange(60))) + b"\xff"
        a = np.frombuffer(s, dtype=np.uint8)
        sa, _ = suffix_dedup.suffix_array(a)
        assert sa.tolist() == sorted(range(len(s)), key=lambda i: s[i:])
        lengths = suffix_dedup.RunLengthIndex(a).match_lengths()
        for r in range(1, len(s)):
            x, y = s[sa[r]:], s[sa[r - 1]:]
            n = next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
            assert lengths[sa[r]] == n


def test_contexts_marked_once():
    rng = random.Random(5)
    for _ in range(80):
        base = bytes(rng.choice(b"ab") for _ in range(30))
        ctx = list(dict.fromkeys(base[rng.randint(0, 5):rng.randint(16, 30)] for _ in range(8)))
        seen, want = set(), []
        for c in ctx:
            want.append([i for i in range(len(c) - 9) if c[i:i + 10] in seen or seen.add(c[i:i + 10])])
        assert suffix_dedup.mark_contexts(ctx, 10) == want


def test_jaccard_bounds_lose_nothing():
    rng = np.random.default_rng(6)
    for _ in range(400):
        n = int(rng.integers(1, 300))
        base = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        a = np.unique(base)
        b = np.unique(np.concatenate([base[: n - int(rng.integers(0, n // 4 + 1))], rng.integers(0, 1 << 63, int(rng.integers(0, n // 6 + 1)), dtype=np.uint64)]))
        if not len(b):
            continue
        o = len(np.intersect1d(a, b))
        if 100 * o < 75 * (len(a) + len(b) - o):
            continue
        frequent = np.sort(rng.choice(base, min(3, n), replace=False))
        shared = np.intersect1d(jaccard_join.prefix(a, frequent), jaccard_join.prefix(b, frequent))
        assert len(shared)
        assert len(shared) >= min(jaccard_join._need(len(a), len(b)), jaccard_join._need(len(b), len(a)))
        assert o >= jaccard_join.pair_overlap(len(a), len(b))
        small = a if len(a) <= len(b) else b
        pre = jaccard_join.prefix(small, frequent)
        assert len(np.intersect1d(pre[jaccard_join.early(len(small), len(pre)) == 1], shared))
        batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), pa.array([len(a)]), pa.array([len(b)]),
                                            pa.array([jaccard_join.bitmap(a)], pa.binary()), pa.array([jaccard_join.bitmap(b)], pa.binary())],
                                           names=list("abcdef"))
        assert next(jaccard_join._plausible([batch])).num_rows == 1


def test_signature_tree_finds_all_that_share():
    rng = np.random.default_rng(7)
    m = 150
    size = np.sort(rng.integers(40, 60, m))
    shared = rng.integers(8, 15, m)
    bits = np.zeros((m, 4), dtype=np.uint64)
    for i in range(m):
        for x in rng.integers(0, 256, shared[i]):
            bits[i, x >> 6] |= np.uint64(1) << np.uint64(x & 63)
    comp = rng.integers(0, 60, m)
    whole = [np.packbits(rng.random(128) < .6, bitorder="little").view(np.uint64) for _ in range(m)]
    tree = jaccard_join.SignatureTree(size, shared, bits, comp, rng.random(m) < .7, whole)
    a, b = tree.pairs()
    every = [(i, j) for i in range(m) for j in range(i + 1, m)]
    i, j = (np.array(x) for x in zip(*every))
    want = tree._may(0, i, j)
    assert set(zip(a.tolist(), b.tolist())) == {p for p, ok in zip(every, want) if ok}


def test_trie_counts():
    pieces = {bytes([b]): 9_000_000 + b for b in range(256)} | {b"ab": 5_000_000, b"abc": 9_000_000, b"ca": 4_000_000, b" a": 6_000_000}
    model = token_counts.Unigram(pieces)
    rng = random.Random(8)
    words = list({bytes(rng.choice(b"abc ") for _ in range(rng.randint(1, 12))) for _ in range(200)}) + [b"abca" * 100]
    data = np.frombuffer(b"".join(words), dtype=np.uint8)
    size = np.array([len(w) for w in words])
    got = model.counts(data, np.cumsum(size) - size, size)
    assert got.tolist() == [model.count_one(w) for w in words]


def test_pre_tokens_cover_texts():
    rng = random.Random(9)
    texts = ["".join(rng.choice("ab \n") for _ in range(rng.randrange(30))) for _ in range(60)]
    (_, _, data, off), = tb.slices(pa.array(texts))
    s, e, first = token_counts.pre_tokens(data, off)
    raw = data.tobytes()
    for i, t in enumerate(texts):
        got = [raw[a:b].decode() for a, b in zip(s[first[i]:first[i + 1]], e[first[i]:first[i + 1]])]
        assert "".join(got) == t
        assert all(x.strip() == "" or WORD.fullmatch(x.removeprefix(" ")) for x in got)


def test_model_is_a_distribution_and_learns():
    rng = np.random.default_rng(10)
    # a language of two halves: the text's first id tells which
    ids, bounds = [], [0]
    for _ in range(200):
        base = 10 * int(rng.integers(0, 2))
        ids += [base, *(base + 1 + rng.integers(0, 5, 60)).tolist(), 30]
        bounds.append(len(ids))
    ids, bounds = np.array(ids), np.array(bounds)
    model = attention_lm.fit(ids, bounds, 31, steps=120)
    lp = model.log_probs(ids, bounds)
    assert np.isfinite(lp).all() and lp.mean() < 0
    uniform = -np.log(12)
    assert lp.mean() > uniform + 0.4
    # all continuations of one context sum to one
    total = sum(np.exp(model.log_probs(np.array([0, 1, 2, x]), np.array([0, 4]))[-1]) for x in range(31))
    assert abs(total - 1) < 1e-4
    # a later id doesn't change an earlier score
    a = model.log_probs(ids[:40], np.array([0, 40]))
    b = model.log_probs(np.append(ids[:30], np.full(10, 30)), np.array([0, 40]))
    assert np.allclose(a[:30], b[:30], atol=1e-4)


def test_language_model_tells_256_classes():
    rng = np.random.default_rng(11)
    # ids in falling frequency, each in the sample
    ids = np.concatenate([np.full(420 - i, i) for i in range(400)])
    rng.shuffle(ids)
    model = attention_lm.fit(ids, np.array([0, len(ids)]), 401, steps=1)
    cls = attention_lm._classes(None, np.bincount(ids, minlength=401), rng.random((401, 65)), 401)
    assert len(set(cls[:208].tolist())) == 208 and not set(cls[:208].tolist()) & set(cls[208:].tolist())
    assert attention_lm.N_CLASSES == 256 and any(256 in np.shape(v) for v in model.w.values())


def test_folding_and_exceptions():
    assert [toxicity.fold(x).split() for x in ("1d10t", "іdіоt", "l0s3r!!", "ÍDIOT")] == [["idiot"], ["idiot"], ["loser"], ["idiot"]]
    scan = toxicity.Scanner({"trash": 3.0, "idiot": 3.0})
    assert scan.raw("what a trash can") == 0 and scan.raw("what trash") > 0 and scan.raw("an IDI0T") > 0 and scan.raw("") == 0


def _small_batch():
    rng = np.random.default_rng(12)
    w = attention_lm.start_weights(rng.random((attention_lm.N_ROWS, attention_lm.N_CLASSES)) * 50)
    w = {k: (a + rng.normal(0, 0.05, a.shape)).astype(np.float32) for k, a in w.items()}
    ids = rng.integers(0, 300, 48 * 40 + 7)
    x, at = attention_lm.windows(ids, np.array([0, 100, 100, 101, len(ids)]), attention_lm.N_ROWS - 1)
    return w, x, rng.integers(0, attention_lm.N_CLASSES, at.shape), (at >= 0).astype(np.float32)


def _plain_log_probs(w, x, y):
    """The two layers and the output, window by window, in doubles."""
    w, n = {k: a.astype(np.float64) for k, a in w.items()}, attention_lm.CONTEXT
    for one, cls in zip(x, y):
        e = w["E"][one] + w["P"]
        s = (e[n:] @ w["Q"]) @ (e @ w["K"]).T / np.sqrt(attention_lm.WIDTH)
        s = np.where(np.arange(len(e))[None, :] <= np.arange(n, len(e))[:, None], s, -np.inf)
        a = np.exp(s - s.max(1, keepdims=True))
        h = e[n:] + a / a.sum(1, keepdims=True) @ (e @ w["V"]) @ w["O"]
        z = (h + np.maximum(h @ w["F1"] + w["f1"], 0) @ w["F2"]) @ w["U"] + w["u"]
        z -= z.max(1, keepdims=True)
        yield z[np.arange(len(z)), cls] - np.log(np.exp(z).sum(1))


@pytest.mark.parametrize("scale", [1, 40])
def test_language_model_layers_and_gradients(scale):
    w, x, y, live = _small_batch()
    w |= {k: w[k] * np.float32(scale) for k in ("Q", "U")}         # large scores too
    plain = lambda w: np.array(list(_plain_log_probs(w, x, y)))
    assert np.allclose(attention_lm.forward(w, x, y), plain(w), rtol=1e-3, atol=2e-4 * scale)
    if scale > 1:
        return
    d, rows, d_rows = attention_lm._gradients(w, x, y, live)
    assert sorted(set(x.ravel().tolist())) == rows.tolist() and set(d) | {"E"} == set(w)
    d["E"] = np.zeros_like(w["E"])
    d["E"][rows] = d_rows
    rng = np.random.default_rng(13)
    for k in w:                                                    # along a random direction
        way = rng.normal(0, 1, w[k].shape)
        loss = [-(plain(w | {k: w[k] + h * way}) * live).sum() / live.sum() for h in (-1e-4, 1e-4)]
        assert abs((loss[1] - loss[0]) / 2e-4 - (d[k] * way).sum()) < 1e-3 * max(1, np.abs(d[k]).sum()), k


def test_class_scores_are_made_in_pieces_that_a_cache_holds():
    import tracemalloc

    w, x, y, live = _small_batch()
    x, y = np.tile(x, (8, 1))[:256], np.tile(y, (8, 1))[:256]
    scores = x.shape[0] * y.shape[1] * attention_lm.N_CLASSES * 4
    tracemalloc.start()
    attention_lm.forward(w, x, y)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1.5 * scores, (peak, scores)


def test_subwords_of_a_slice_are_those_of_its_words():
    sub = attention_lm.Subwords(attention_lm.VOCABULARY)
    texts = ["a b  a", "", " naïve x 東京 zzqqxyv\x00k l ", "\t\n", "1,234 don't <|end|> a" * 3, "a"]
    data = np.frombuffer("".join(texts).encode() + b"\xff\xfe b \xff", dtype=np.uint8)
    size = [len(t.encode()) for t in texts]
    for raw, off in ((data[:sum(size)], np.append(0, np.cumsum(size))), (data, np.append(0, np.cumsum([*size, 6])))):
        start, end, first = tb.word_spans(raw, off)
        ids, bounds, n = sub.slice(raw, start, end, first)
        want = [[sub.word(raw.tobytes()[a:b]) for a, b in zip(start[lo:hi], end[lo:hi])] for lo, hi in zip(first[:-1], first[1:])]
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == [[*sum(t, []), sub.end] for t in want]
        assert n.tolist() == [len(x) for t in want for x in t]
