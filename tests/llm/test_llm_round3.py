"""WARC transactions, importance resampling, periodic runs: odd rows, empty
tables, brute-force versions."""

import collections
import gzip
import hashlib
import math
import random
import re
import zlib

import pyarrow as pa
import pytest

from llm_helpers import LOWER, docs_df, odd_rows
from tessera.llm import importance, periodic_runs, warc
from tessera.session import ship_package


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship_package(spark)


@pytest.fixture(scope="module")
def odd():
    return odd_rows(random.Random(1))


# ----------------------------------------------------------------- 11, archives

ODD_BYTES = ["\r\n\r\n", "\r\n", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nabc", "é\U0001F600", "\r", "\n", "\x00", "x" * 50,
             "Content-Length: 3\r\n\r\n"]


def page_rows(rng, n):
    urls = [None, "http://a/b c%20", "http://é/\r\nX: y", "u"]
    html = lambda: rng.choice([None, "", "a" * 99, "a" * 100, "b" * 300,
                               "".join(rng.choice(ODD_BYTES) for _ in range(rng.randrange(0, 12)))])
    rows = [(i, rng.choice(urls), html(), "x") for i in range(n)]
    return rows + [rows[3], rows[3], (None, "u", "b" * 300, "x"), (None, "u", "only" * 40, "x"), (None, "u", "only" * 40, "x")]


def digest_brute(rows):
    first, used, out = {}, set(), []
    order = lambda r: (r[0] is None, r[0] or 0)
    for r in sorted(rows, key=order):
        p = (r[2] or "").encode()
        if len(p) >= 100:
            first.setdefault(p, r[0])
    for i, url, h, _ in sorted(rows, key=order):
        p = (h or "").encode()
        again = p in used
        used |= {p} if len(p) >= 100 else set()
        out.append((i, url, len(p), hashlib.sha256(p).hexdigest(), "revisit" if again else "response", first[p] if again else None))
    return sorted(out, key=str)


def digest_got(df):
    return sorted(((r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


@pytest.mark.parametrize("small, parts", [(300_000, 20_000), (0, 3)])
def test_pages_come_back_from_the_archives(spark, monkeypatch, small, parts):
    monkeypatch.setattr(warc, "SMALL_IDS", small)
    monkeypatch.setattr(warc, "HOT_PARTS", parts)
    rows = page_rows(random.Random(small), 120)
    df = spark.createDataFrame(rows, "page_id long, url string, html string, row string")
    assert digest_got(warc.round_trip(df.repartition(4))) == digest_brute(rows)


def test_archive_of_no_pages(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def foreign(kind, rid, block, *extra, end=True):
    head = "".join(f"{k}: {v}\r\n" for k, v in [("warc-record-id", rid), ("WARC-TYPE", kind), *extra, ("content-length", len(block))])
    return b"WARC/1.0\r\n" + head.encode() + b"\r\n" + block + (b"\r\n\r\n" if end else b"")


def test_foreign_archives_and_assembly(spark, tmp_path):
    http = ("Content-Type", "application/http; msgtype=response")
    body = bytes(range(256)) + b"\r\n\r\n"
    parts = [
        foreign("warcinfo", "<w>", b"software: x\r\n", ("Content-Type", "application/warc-fields")),
        foreign("request", "<q1>", b"GET / HTTP/1.1\r\n\r\n", ("WARC-Concurrent-To", "<r1>"), ("Content-Type", "application/http; msgtype=request")),
        foreign("response", "<r1>", b"HTTP/1.1 200 OK\r\n\r\n" + body, http),
        # metadata names the request only; the second response names its request
        foreign("metadata", "<m1>", b"a: 1\r\nb: x\r\n y\r\n", ("WARC-Concurrent-To", "<q1>"), ("Content-Type", "application/warc-fields")),
        foreign("request", "<q2>", b"GET /2 HTTP/1.1\r\n\r\n"),
        foreign("response", "<r2>", b"HTTP/1.1 200 OK\r\n\r\n", ("WARC-Concurrent-To", "<q2>"), http),
        foreign("metadata", "<m2>", b"", ("WARC-Concurrent-To", "<r2>"), ("WARC-Concurrent-To", "<q2>")),
        foreign("resource", "<lost>", b"abc\r\n\r\n", end=False),
    ]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(p) for p in parts))       # one member a record
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(foreign("response", "<cut>", b"x" * 500, http)[:-300]))
    records = warc.read_records(spark, str(tmp_path))
    by = {r.record_id: r for r in records.collect()}
    assert set(by) == {"<w>", "<q1>", "<r1>", "<m1>", "<q2>", "<r2>", "<m2>", "<lost>", "<cut>"}
    assert bytes(by["<r1>"].payload) == body and by["<r1>"].payload_digest == hashlib.sha256(body).hexdigest()
    assert by["<m1>"].fields == {"a": "1", "b": "x y"} and bytes(by["<lost>"].payload) == b"abc\r\n\r\n"
    assert [by[i].truncated for i in ("<r1>", "<lost>", "<cut>")] == [False, False, True] and by["<m2>"].concurrent_to == ["<r2>", "<q2>"]
    rows = {r.capture_id: r for r in warc.assemble(records).collect()}
    assert set(rows) == {"<r1>", "<r2>", "<cut>", "<w>", "<lost>"}
    ids = lambda xs: [x.record_id for x in xs]
    assert (ids(rows["<r1>"].requests), ids(rows["<r1>"].metadata)) == (["<q1>"], ["<m1>"])
    assert (ids(rows["<r2>"].requests), ids(rows["<r2>"].metadata)) == (["<q2>"], ["<m2>"])
    assert rows["<w>"].response is None and ids(rows["<w>"].others) == ["<w>"] and bytes(rows["<r1>"].response.payload) == body


# ------------------------------------------------------------- 12, resampling

NOT_WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def feats(text):
    w = NOT_WORD.findall((text or "").translate(LOWER))
    return w, [zlib.crc32(x.encode()) % 10_000 for x in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))]]


def resample_brute(docs, target):
    rows = [(i, *feats(t)) for i, t in docs]
    s, t = collections.Counter(), collections.Counter()
    for _, _, f in rows:
        s.update(f)
    for x in target:
        t.update(feats(x)[1])
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (n_s + 10_000) / ((s[b] + 1) * (n_t + 10_000)))) for b in range(10_000)]
    out = []
    for i, w, f in rows:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    may = sorted((o for o in out if o[5] >= 20), key=lambda o: (-o[3], o[0] is None, o[0] or 0, o[1], o[2]))
    for k, o in enumerate(may[:25 * len(may) // 100]):
        o[4] = k + 1
    return sorted((tuple(o[:5]) for o in out), key=str)


def resample_got(spark, docs, target):
    got = importance.resample(docs_df(spark, docs), spark.createDataFrame([(i, t, "x") for i, t in enumerate(target)], "item_id long, text string, h string"))
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in got.collect()), key=str)


def test_resampling_rows(spark, odd):
    rng = random.Random(3)
    docs = odd + [(100 + k, " ".join(rng.choice(["Ab", "cd", "é1", "x-y", "\x00", "__"]) for _ in range(rng.randrange(60)))) for k in range(150)]
    docs += docs[-20:]
    target = ["ab cd ab", None, "", "É1 é1"]
    assert resample_got(spark, docs, target) == resample_brute(docs, target)
    assert resample_got(spark, docs, []) == resample_brute(docs, [])
    assert resample_got(spark, [], target) == []


def test_features_of_texts_in_pieces():
    rng = random.Random(4)
    texts = ["", " " * 40, *("".join(rng.choice(["ab", "Cd9", "é", " ", "  ", "-", " " * 30, "x" * 25]) for _ in range(rng.randrange(80))) for _ in range(60))]
    want = {i: sorted(feats(t)[1]) for i, t in enumerate(texts)}
    for limit in (1, 7, 64, 10_000):
        got, words = collections.defaultdict(list), collections.Counter()
        for i, buckets, n in importance.features([t.encode() for t in texts], limit):
            got[i] += buckets.tolist()
            words[i] += n
        assert {i: sorted(got[i]) for i in want} == want
        assert all(words[i] == len(feats(t)[0]) for i, t in enumerate(texts))


def test_composed_checksums():
    import numpy as np

    rng = random.Random(5)
    a = [bytes(rng.randrange(256) for _ in range(rng.randrange(40))) for _ in range(300)]
    b = [bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 5, 200, 70_000]))) for _ in range(300)]
    crc = lambda xs: np.array([zlib.crc32(x) for x in xs], dtype=np.uint32)
    assert importance.compose(crc(a), crc(b), np.array([len(x) for x in b])).tolist() == crc([x + y for x, y in zip(a, b)]).tolist()


# ------------------------------------------------------------------- 13, runs

def runs_brute(w):
    n, out = len(w), set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            run = w[i: i + length]
            if length >= max(6, 4 * q) and not any(run[x:] == run[:-x] for x in range(1, q)):
                out.add((i, length, q))
            i = j + 1
    return out


def row_brute(i, t):
    w = (t or "").encode().split()
    n = len(w)
    h = zlib.crc32(str(i).encode())
    if i is not None and h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        w = [w[x] if x < a else w[a + (x - a) % p] for x in range(n)]
    runs = sorted(runs_brute(w), key=lambda r: (r[0], r[2]))
    gone = {x for s, length, q in runs for x in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (i, n, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join("%d,%d,%d\n" % r for r in runs).encode()),
            sha(b" ".join(x for k, x in enumerate(w) if k not in gone)), len(gone))


def test_runs_of_random_words():
    rng = random.Random(6)
    for _ in range(150):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            p = [rng.randrange(rng.randrange(1, 4)) for _ in range(rng.randrange(1, 60))]
            if rng.random() < 0.5:
                r = [rng.randrange(3) for _ in range(rng.randrange(1, 9))]
                p = p[:10] + r * rng.randrange(1, 8) + r[:rng.randrange(len(r))] + p[10:20]
            parts.append(p)
        want = sorted((k, *r) for k, p in enumerate(parts) for r in runs_brute(p))
        assert sorted(map(tuple, periodic_runs.runs_of(parts).tolist())) == want


def test_periodic_rows(spark, odd):
    rng = random.Random(7)
    docs = odd + [(100 + k, rng.choice(["", "\n", "  "]) + rng.choice([" ", "\t", " \n "]).join(
        f"wé{rng.randrange(a)}" for _ in range(rng.randrange(0, 90)))) for k in range(400) for a in [rng.choice([1, 2, 3, 8, 30])]]
    got = periodic_runs.periodic_runs(docs_df(spark, docs))
    assert sorted(map(tuple, got.collect()), key=str) == sorted((row_brute(*d) for d in docs), key=str)
    assert sum(r[2] for r in map(tuple, got.collect())) > 100
    assert periodic_runs.periodic_runs(docs_df(spark, [])).count() == 0


def test_periodic_query_on_small_table():
    import pyarrow.parquet as pq

    t = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text"])
    docs = [(i, s) for i, s in zip(t["doc_id"].to_pylist(), t["text"].to_pylist()) if len((s or "").split()) < 1500]
    batch = pa.RecordBatch.from_arrays([pa.array([d[0] for d in docs]), pa.array([d[1] for d in docs])], names=["doc_id", "text"])
    got = [tuple(r.values()) for out in periodic_runs._batches([batch]) for r in out.to_pylist()]
    assert got == [row_brute(*d) for d in docs]


# ------------------------------------------------- 10, near duplicates by row

def shingles(text):
    w = (text or "").translate(LOWER).split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def groups_brute(texts):
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                x, y = root[i], root[j]
                root = [min(x, y) if r in (x, y) else r for r in root]
    return root


@pytest.mark.parametrize("rounds, members", [(24, 150_000), (1, 40)])
def test_one_row_of_each_group_stays(spark, monkeypatch, rounds, members):
    from tessera.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "ROUNDS", rounds)
    monkeypatch.setattr(jaccard_join, "PART_MEMBERS", members)
    rng = random.Random(rounds)
    rows = []
    for g in range(12):                   # copies edited from one text: most link with it, not with one another
        base = [f"g{g}w{k}" for k in range(60)]
        for _ in range(rng.randrange(1, 14)):
            w = list(base)
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(60)] = f"e{rng.randrange(10**6)}"
            rows.append((rng.choice([None, len(rows)]), " ".join(w)))
    rows += rows[:6] + [(None, ""), (None, ""), (900, None), (900, None), (None, "Two words"), (901, "two words")]
    rows = [(i, t) for i, t in rows]
    root = groups_brute([t for _, t in rows])
    want = []
    for r in set(root):
        of = [row for row, x in zip(rows, root) if x == r]
        if shingles(of[0][1]):
            of = [min(of, key=lambda row: (row[0] is None, row[0] or 0))] if any(i is not None for i, _ in of) else of
            want.append((of[0][0], None if of[0][0] is None else of[0][1], r if of[0][0] is None else None))
    got = jaccard_join.keep_first(docs_df(spark, rows)).collect()
    assert got and all(len(r) == len(docs_df(spark, rows).columns) for r in got)
    full = [(r.doc_id, r.text) for r in got if shingles(r.text)]
    assert sorted((w[:2] for w in want if w[0] is not None), key=str) == sorted((f for f in full if f[0] is not None), key=str)
    # groups whose rows have no id keep one of their rows
    at = {t: x for (i, t), x in zip(rows, root)}
    assert sorted(at[t] for i, t in full if i is None) == sorted(w[2] for w in want if w[0] is None)
    assert sorted((str(r.doc_id), r.text) for r in got if not shingles(r.text)) == [("900", None), ("None", ""), ("None", "")]
    comp = jaccard_join.similarity_components(docs_df(spark, rows)).collect()
    least = {x: min((i for (i, _), y in zip(rows, root) if y == x and i is not None), default=None) for x in root}
    expect = sorted(((i, least[x] if shingles(t) else i) for (i, t), x in zip(rows, root)), key=str)
    assert sorted(((r.doc_id, r.component_id) for r in comp), key=str) == expect


# --------------------------------------------------- 9, learning from all rows

def test_model_learns_from_every_training_row(spark, monkeypatch):
    import numpy as np

    from tessera.llm import attention_lm as lm

    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + rng.choice("xyz") for _ in range(rng.randrange(0, 120)))) for i in range(300)]
    rows += [(None, "no id here " * 20), (7, None), (8, ""), rows[4], rows[4]]
    df = docs_df(spark, rows)
    sub = lm.Subwords(lm.VOCABULARY)
    # brute force: ids of all training rows, each text closed by the end token
    texts = [(t or "") for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    ids = [[j for w in t.translate(LOWER).split() for j in sub.word(w.encode())] + [sub.end] for t in texts]
    flat, bounds = np.array([j for x in ids for j in x]), np.cumsum([0, *map(len, ids)])
    want = lm.fit(flat, bounds, sub.size, steps=0)
    got = lm.train(df, steps=0)
    assert (got.row == want.row).all() and (got.cls == want.cls).all() and np.array_equal(got.inside, want.inside)
    assert all(np.allclose(np.abs(got.w[k]), np.abs(want.w[k]), atol=1e-4) for k in got.w)
    # many tasks, averaged in a tree
    monkeypatch.setattr(lm, "PART_WINDOWS", 20)
    monkeypatch.setattr(lm, "DRAWN", 1.0)
    monkeypatch.setattr(lm, "FAN", 3)
    trained = lm.train(df, steps=30)
    better = trained.log_probs(flat, bounds).mean()
    assert better > lm.train(df, steps=0).log_probs(flat, bounds).mean() and np.isfinite(better)


def test_mixture_keeps_very_small_probabilities_apart():
    import numpy as np

    from tessera.llm import attention_lm as lm

    lp = np.array([-1.0, -700.0, -2000.0, -20000.0])
    got = lm._mixed(lp, np.zeros(4), 10)
    assert np.allclose(got, (np.log(lm.MIX) + lp) / math.log(10))
    assert np.allclose(lm._mixed(lp, np.array([3.0] * 4), 10)[1:], math.log10((1 - lm.MIX) * 0.3))


# ------------------------------------------------------- 2, names of wrappers

@pytest.mark.parametrize("name", ["has-sidebar", "with-sidebar", "no-comments", "content notice-board", "widget"])
def test_article_in_a_wrapper_is_kept(name):
    from tessera.llm.site_tree import blocks

    page = (f'<body><nav>menu</nav><div class="{name}"><article><h1>Title</h1><p>Body text.</p><div class="comments"><p>first!</p></div></article></div>'
            '<div class="related"><article><p>Teaser</p></article></div><footer>foot</footer></body>')
    got = blocks(page)
    assert [text for _, noise, main, text in got if main and not noise] == ["Title", "Body text."]
    assert {text for _, noise, _, text in got if noise} == {"menu", "first!", "Teaser", "foot"}


def test_noise_by_more_than_a_name_stays_noise():
    from tessera.llm.site_tree import blocks

    page = '<aside class="widget"><article><p>In the side bar</p></article></aside><article><p>Text</p></article>'
    assert [(noise, text) for _, noise, _, text in blocks(page)] == [(True, "In the side bar"), (False, "Text")]
