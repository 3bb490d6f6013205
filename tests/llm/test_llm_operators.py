"""Operators on small tables: odd rows, empty tables, brute-force versions."""

import collections
import hashlib
import math
import random
import zlib

import pytest

from llm_helpers import DOCS, LOWER, WORD, docs_df, odd_rows, sentence, words
from tessera.llm import (attention_lm, decontaminate, jaccard_join, license_scan, mixing, repetition, site_tree, suffix_dedup,
                         token_counts, toxicity)
from tessera.session import ship_package


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship_package(spark)


@pytest.fixture(scope="module")
def odd():
    return odd_rows(random.Random(1))


def labels_df(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, h string")


def bench_df(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string, doc_id long")


# -------------------------------------------------------------- 1, 8: one pass

def test_repetition_rows(spark, odd):
    got = repetition.repetition_rules(docs_df(spark, odd)).collect()
    assert sorted((str(r.doc_id), r.n_words) for r in got) == sorted((str(i), len(words(t))) for i, t in odd)
    by = {r.doc_id: r for r in got if r.doc_id not in (None, 2)}
    assert by[4].base_failed and not by[4].kept and by[1].kept and not by[10].kept
    assert repetition.repetition_rules(docs_df(spark, [])).count() == 0


def test_token_counts_rows(spark, odd):
    got = token_counts.token_counts(docs_df(spark, odd)).collect()
    assert sorted((str(r.doc_id), r.n_bytes) for r in got) == sorted((str(i), len((t or "").encode())) for i, t in odd)
    model = token_counts.Unigram(token_counts.read_vocabulary())
    for r in got:
        if r.doc_id in (3, 7, 9):
            t = dict(odd)[r.doc_id]
            pieces = [(" " if k else "") + w for k, w in enumerate(t.split(" "))]
            assert r.n_tokens == sum(model.count_one(p.encode()) for p in pieces)
    assert token_counts.token_counts(docs_df(spark, [])).count() == 0


def test_token_counts_with_the_whole_vocabulary(spark):
    import base64

    cost = {}
    for line in open(token_counts.VOCABULARY, "rb"):
        piece, rank = line.split()
        cost[base64.b64decode(piece)] = int(round(1e6 * math.log(int(rank) + 2.0)))

    def brute(raw):
        best = [(0, 0)]
        for j in range(1, len(raw) + 1):
            best.append(min((best[i][0] + cost[raw[i:j]], best[i][1] + 1) for i in range(j) if raw[i:j] in cost))
        return best[-1][1]

    long = sorted(p.decode() for p in cost if len(p) > 16 and p.isascii() and len(p.split()) == 1 and p[:1] == b" " and not p[1:2].isspace())
    assert " responsibilities" in long and " telecommunications" in long
    tokens = ["x", *[w for p in long for w in (p, p + "s", " un" + p[1:])], " " + "-" * 200, " " + "=" * 130, " " + "a-" * 100]
    rows = [(i, t) for i, t in enumerate(tokens)] + [(1000, "".join(tokens))]
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs_df(spark, rows)).collect()}
    want = {i: brute(t.encode()) for i, t in enumerate(tokens)}
    assert got == want | {1000: sum(want.values())}
    assert all(got[tokens.index(p)] == 1 for p in (" responsibilities", " telecommunications"))


# ------------------------------------------------------------------ 2: pages

NAV = '<nav><ul><li><a href="/x">Home</a></li></ul></nav>'


def page(body, extra=""):
    return (f'<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var a="</p><p>no";</script></head><body>{NAV}'
            f'<header><h2>Site</h2></header>{extra}{body}<footer>&copy; site</footer></body></html>')


def test_main_text_by_markup(spark):
    art = ('<article><header><h1>Head &amp; line</h1></header><!-- no --><p><b>One\n  two<br><p>Caf&eacute; &#x41;</p><ul><li>a<li>b</ul>'
           '<div class="cookie-notice">no</div><form>no</form><section id="comments"><p>no</p></section><p>end</p></article>')
    rows = [(1, "http://a.example/1", page(art)), (1, "http://a.example/1", page(art)), (2, None, page(art)), (3, "http://a.example/3", None),
            (4, "x", ""), (5, "http://a.example/5", "plain <p>text"), (None, "http://b.example/", page(art)[:-30])]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, host string")
    got = site_tree.main_text(df).collect()
    want = "Head & line\n\nOne two\n\nCafé A\n\na\n\nb\n\nend"
    assert len(got) == len(rows)
    for r in got:
        text = {3: "", 4: "", 5: "plain\n\ntext"}.get(r.page_id, want)
        assert (r.text, r.n_chars) == (text, len(text)), r.page_id
    assert site_tree.main_text(df.limit(0)).count() == 0


def test_tree_drops_what_a_host_repeats(spark):
    rows = []
    for i in range(12):
        body = (f"<div><p>Sign our list today</p></div><div><p>Story {i} of its own {i * 7}</p><p>More on {i * 3} here</p></div>")
        rows.append((i, f"http://h.example/{i}", f"<html><body><table><tr><td>All sections here</td></tr></table>{body}</body></html>"))
    got = {r.page_id: r.text for r in site_tree.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(12):
        assert got[i] == f"Story {i} of its own {i * 7}\n\nMore on {i * 3} here"


def test_copies_of_a_page_are_no_repetition(spark):
    text = "<html><body><div><p>The only story of this host</p></div></body></html>"
    rows = [(i, f"http://one.example/{i}", text) for i in range(5)]
    rows += [(10 + i, f"http://two.example/{i}", text.replace("only story", f"story {i if i > 20 else 0}")) for i in range(40)]
    got = {r.page_id: r.text for r in site_tree.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(5):
        assert got[i] == "The only story of this host"
    for i in range(40):
        assert got[10 + i] == f"The story {i if i > 20 else 0} of this host"


def test_tree_judges_inside_and_beside_an_article(spark):
    rows = []
    for i in range(40):
        tail = "" if i == 3 else "<p>Read all our stories on the front page</p>"
        rows.append((i, f"http://in.example/{i}", f"<article><h1>Head {i}</h1><p>Story {i} of its own, told at length {i * 7}</p>{tail}</article>"))
        rows.append((100 + i, f"http://beside.example/{i}", f"<article><h1>Card {i}</h1></article><div><p>Body {i} of its own {i * 7}</p></div>"
                                                            "<section><p>All sections here</p></section>"))
    got = {r.page_id: r.text for r in site_tree.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(40):
        assert got[i] == f"Head {i}\n\nStory {i} of its own, told at length {i * 7}"
        assert got[100 + i] == f"Card {i}\n\nBody {i} of its own {i * 7}"


# ----------------------------------------------------------------- 3: mixing

def fixed_point(sizes):
    """Targets by resharing until none is above twice its size."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        left = total - sum(2 * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        target = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if target[s] > 2 * sizes[s]]
        if not over:
            return target | {s: 2.0 * sizes[s] for s in capped}
        capped |= set(over)


def test_mixing_targets_and_words(spark):
    rng = random.Random(3)
    rows = [(i, sentence(rng, rng.randint(1, 60)), rng.choice(["a", "b", "c", "d", None, "é"] + ["a"] * 6)) for i in range(900)]
    rows += [(2000, None, "a"), (2001, "", "zero"), (None, "w w", "b"), (5, rows[5][1], rows[5][2])]
    df = docs_df(spark, rows)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    sizes = collections.Counter()
    for i, t, s in rows:
        sizes[s] += len(words(t))
    want = fixed_point(sizes)
    taken = collections.Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-9, abs_tol=1e-9)
        assert r.taken == r.copies * r.size and r.copies in (0, 1, 2)
        taken[r.source] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 2, (s, taken[s], t)
    key = lambda rs: sorted((str(r.doc_id), r.size, r.copies) for r in rs)
    assert key(got) == key(mixing.mix(docs_df(spark, rows, 5)).collect())
    assert mixing.mix(docs_df(spark, [])).count() == 0
    whole = mixing.copies(df)
    assert whole.columns == df.columns + ["copy"]
    count = lambda rs: collections.Counter((r.doc_id, r.source, len(words(r.text))) for r in rs)
    given = collections.Counter()
    for r in got:
        given[r.doc_id, r.source, r.size] += r.copies
    assert count(whole.collect()) == +given


def test_mixing_takes_what_it_is_due_of_repeated_rows(spark):
    rows = [(1, "w " * 3, "a")] * 40 + [(None, "x " * k, "b") for k in range(1, 60)] + [(None, "y " * 5, "b")] * 30 + [(i, "z " * 4, "c") for i in range(9, 70)]
    df = docs_df(spark, rows)
    got = mixing.mix(df).collect()
    for s in "abc":
        of = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in of) - of[0].target) <= 5 / 2 + 1, s
    copies = mixing.copies(df).collect()
    assert len(copies) == sum(r.copies for r in got)
    each = collections.Counter((r.doc_id, r.text, r.copy) for r in copies)
    assert each[1, "w " * 3, 1] <= 40 and each[None, "y " * 5, 1] <= 30


def test_decontamination_judges_every_row(spark):
    rng = random.Random(12)
    item = sentence(rng, 30)
    clean = [sentence(rng, 50) for _ in range(3)]
    rows = [(None, clean[0]), (None, clean[1] + " " + item), (None, clean[2]), (4, clean[0]), (4, item + " " + clean[1]), (4, clean[2]), (4, clean[2]), (5, None)]
    got = decontaminate.keep_clean(docs_df(spark, rows), bench_df(spark, [(0, item, 0)]))
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted((r for r in rows if item not in (r[1] or "")), key=str)


# ---------------------------------------------------------------- 4: licenses

def test_license_scan_against_containment(spark, odd):
    rng = random.Random(4)
    mit = license_scan.TEMPLATES["MIT"]
    rows = odd + [(100, sentence(rng) + "\n" + mit), (101, mit.replace("copy", "clone")), (102, sentence(rng) + "\nReleased under the MIT License."),
                  (103, "licensed UNDER the apache license -- version 2 0"), (104, mit[:120]), (104, mit)]
    got = license_scan.scan(docs_df(spark, rows)).collect()
    import re

    def shingles(text):
        out = set()
        for s in re.split(r"\n|(?<=[.;:!?])\s+", (text or "").lower()):
            w = re.findall(r"[^\W_]+", s)
            out |= {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        return out

    want = []
    for i, t in rows:
        d = shingles(t)
        for name, body in license_scan.TEMPLATES.items():
            s = shingles(body)
            if len(s & d) >= 0.75 * len(s):
                want.append((str(i), name, len(s & d), len(s)))
    assert sorted((str(r.doc_id), r.license, r.n_shared, r.n_template) for r in got) == sorted(want) and want
    assert license_scan.scan(docs_df(spark, [])).count() == 0


def test_license_scan_wrapped_and_inside_sentences(spark):
    import re
    import textwrap

    rng = random.Random(14)
    rows = []
    for k, (name, body) in enumerate(license_scan.TEMPLATES.items()):
        for width in (30, 60, 72, 78, 100):
            rows.append((1000 * k + width, sentence(rng) + "\n" + textwrap.indent(textwrap.fill(body, width), " * ") + "\n" + sentence(rng)))
        for i in range(20):
            rows.append((1000 * k + 500 + i, sentence(rng, 20 + i) + " " + body.rstrip(".:") + " " + sentence(rng, 40)))
    got = license_scan.scan(docs_df(spark, rows)).collect()

    def runs(w, k):
        return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)}

    split = lambda t: re.findall(r"[^\W_]+", t.lower())
    want = []
    for i, t in rows:
        for name, body in license_scan.TEMPLATES.items():
            parts = [split(s) for s in re.split(r"(?<=[.;:!?])\s+", body)]
            s = set().union(*[runs(w, min(5, len(w))) for w in parts if w])
            n = sum(g in runs(split(t), len(g)) for g in s)
            if n >= 0.75 * len(s):
                want.append((i, name, n, len(s)))
    assert {(i, name) for i, name, _, _ in want} >= {(i, list(license_scan.TEMPLATES)[i // 1000]) for i, _ in rows}
    assert sorted((r.doc_id, r.license, r.n_shared, r.n_template) for r in got) == sorted(want)


# ---------------------------------------------------------------- 5: toxicity

def test_toxicity_learns_and_survives(spark, odd):
    rng = random.Random(5)
    rows, lab = [], []
    for i in range(100, 500):
        bad = i % 4 == 0
        text = sentence(rng, 80) + (" grobula" * 2 if bad else "") + (" x gr0bula" if bad else "")
        rows.append((i, text))
        lab.append((i, 1, int(bad), "z"))
    df = docs_df(spark, rows + odd)
    got = toxicity.toxicity(df, labels_df(spark, lab + [(None, 1, 1, "z"), (9999, 1, 1, "z"), (100, 1, None, "z")])).collect()
    assert len(got) == len(rows) + len(odd)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        if r.doc_id is not None and r.doc_id >= 100:
            assert r.predicted == int(r.doc_id % 4 == 0)
    clean = toxicity.keep_clean(df, labels_df(spark, lab))
    assert clean.columns == df.columns and clean.count() == len(rows) * 3 // 4 + len(odd)
    empty = labels_df(spark, [])
    assert toxicity.toxicity(df, empty).count() == len(rows) + len(odd)
    assert toxicity.toxicity(docs_df(spark, []), empty).count() == 0


# ---------------------------------------------------------- 6: decontamination

def test_decontamination_rows(spark, odd):
    rng = random.Random(6)
    item = sentence(rng, 30)
    near = item.replace(item.split()[4], "zzz", 1).upper()
    rows = odd + [(200, sentence(rng) + "\n\n" + item + " and more"), (201, near), (202, item[:60]), (200, item), (None, item)]
    bench = bench_df(spark, [(1, item, 0), (2, item, 0), (3, None, 0), (4, "", 0), (5, "short one", 0), (6, sentence(rng, 25), 0)])
    df = docs_df(spark, rows)
    got = sorted((str(r.doc_id), r.item_id) for r in decontaminate.contaminated(df, bench).collect())
    assert got == sorted((i, k) for i in ("200", "200", "201", "None") for k in (1, 2))
    kept = decontaminate.keep_clean(df, bench)
    assert kept.columns == df.columns
    gone = [rows[len(odd)], rows[len(odd) + 1], rows[len(odd) + 3], rows[len(odd) + 4]]     # each row by its own text
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted((r for r in rows if r not in gone), key=str)
    assert decontaminate.contaminated(docs_df(spark, []), bench).count() == 0
    assert decontaminate.contaminated(df, bench.limit(0)).count() == 0


def test_decontamination_in_pieces_and_blocks(spark, monkeypatch):
    rng = random.Random(16)
    item = sentence(rng, 30)
    text = " ".join(sentence(rng, 50, 5000) for _ in range(40))
    text = text[:6000] + " " + item + " " + text[6000:]
    monkeypatch.setattr(decontaminate, "PIECE", 1000)
    items = decontaminate.Items([1], [item.encode()])
    packed = type("B", (), {"value": ([1], [item.encode()])})
    import pyarrow as pa
    batch = pa.RecordBatch.from_arrays([pa.array([5]), pa.array([text])], names=["doc_id", "text"])
    (out,) = decontaminate._search(iter([batch]), packed)
    assert out.to_pylist()[0]["edits"] == 0 and items.reach < 1000
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 100)
    bench = bench_df(spark, [(k, sentence(rng, 30) if k else item, 0) for k in range(5)])
    assert [(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs_df(spark, [(5, text)]), bench).collect()] == [(5, 0)]


# ------------------------------------------------------------------ 7: repeats

def brute_repeats(rows, length=suffix_dedup.LENGTH):
    seen, out = {}, []
    # every row is a document of its own; rows of one id go by their texts
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, rows[k][1] is not None, (rows[k][1] or "").encode()))
    for place, k in enumerate(order):
        raw = (rows[k][1] or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            w = raw[p:p + length]
            at = (place, p)
            if seen.setdefault(w, at) < at:
                gone[p:p + length] = b"\x01" * length
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(1 for p in range(len(raw)) if gone[p] and (p == 0 or not gone[p - 1]))
        out.append((str(rows[k][0]), len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def repeat_rows(rng):
    shared = [sentence(rng, 50) for _ in range(4)]
    rows = []
    for i in range(40, 90):
        parts = [sentence(rng, rng.randint(3, 40)) for _ in range(4)]
        parts.insert(rng.randint(0, 3), rng.choice(shared)[rng.randint(0, 30):])
        rows.append((i, (" " if i % 2 else "\n").join(parts)))
    rows += [(90, "ab" * 400), (91, "é" * 300), (92, rows[3][1]), (93, rows[3][1][5:-7])]
    return rows


def test_repeats_against_all_strings(spark, odd):
    rng = random.Random(7)
    rows = odd + repeat_rows(rng)
    twin = sentence(rng, 60)
    # no repeats, a repeat inside, and one of another row without an id
    rows += [(None, sentence(rng, 90)), (None, twin + " . " + twin), (None, sentence(rng, 9) + twin), (60, sentence(rng, 70)), (60, twin)]
    df = docs_df(spark, rows)
    got = suffix_dedup.digest(df).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_repeats(rows)
    cut = suffix_dedup.cut_repeats(df)
    assert cut.columns == df.columns
    want = {i: n - g for i, n, g, _, _ in brute_repeats(rows)}
    for r in cut.filter("doc_id >= 40 and doc_id <> 60").collect():
        assert r.text is None or r.n_chars == len(r.text) and len(r.text.encode()) <= want[str(r.doc_id)]
    assert {r.doc_id for r in cut.collect()} >= {4, 5, 6, 7}
    assert suffix_dedup.digest(docs_df(spark, [])).count() == 0


@pytest.mark.parametrize("setting", [("MAX", 1), ("HOT", 1)])
def test_repeats_by_the_other_ways(spark, monkeypatch, setting):
    """Places joined by document; strings of hot anchors counted singly."""
    rows = repeat_rows(random.Random(8))
    want = brute_repeats(rows)
    if setting[0] == "HOT":
        monkeypatch.setattr(suffix_dedup, "HOT", 1)
    spans = collections.defaultdict(list)
    for r in suffix_dedup.repeats(docs_df(spark, rows), max_bits=1 if setting[0] == "MAX" else suffix_dedup.MAX_BITS).collect():
        spans[r.doc].append((r.lo, r.hi))
    for i, n, gone, n_spans, _ in want:
        runs = suffix_dedup.merge(spans[int(i)])
        assert (sum(b - a for a, b in runs), len(runs)) == (gone, n_spans)


# ---------------------------------------------------------- 9: language model

def test_language_model_rows(spark, odd):
    rng = random.Random(9)
    rows = odd + [(i, sentence(rng, 40, 60)) for i in range(300, 420)]
    got = attention_lm.score(docs_df(spark, rows), steps=20).collect()
    assert len(got) == len(rows)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    count = collections.Counter()
    for i, t in rows:
        if not held(i):
            count.update(words((t or "").translate(LOWER)))
            count[None] += 1
    total, distinct = sum(count.values()), len(count)
    want = []
    for i, t in rows:
        w = [*words((t or "").translate(LOWER)), None]
        base = sum(math.log10((count[x] + 1) / (total + distinct + 1)) for x in w)
        want.append((str(i), held(i), len(w), sum(count[x] > 0 for x in w), total, round(base, 6)))
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == sorted(want)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert attention_lm.score(docs_df(spark, []), steps=2).count() == 0


# ------------------------------------------------------------ 10: Jaccard join

def brute_components(rows):
    sets = []
    for _, t in rows:
        w = words((t or "").translate(LOWER))
        sets.append({tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = collections.defaultdict(list)
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)].append(i)
    return sorted((str(i), len(sets[k]), str(min(least[find(k)], default=None) if sets[k] else i)) for k, (i, _) in enumerate(rows))


def test_components_against_all_pairs(spark, odd):
    rng = random.Random(10)
    rows = list(odd)
    for i in range(20, 120):
        if i < 40 or rng.random() < .3:
            rows.append((i, sentence(rng, rng.randint(20, 90), 3000)))
        else:
            w = rng.choice([t for k, t in rows if k and k >= 20]).split()
            for _ in range(rng.randint(0, 5)):
                w[rng.randrange(len(w))] = f"new{rng.randrange(9)}"
            rows.append((i, " ".join(w[rng.randint(0, 3):]).title() if i % 3 else " ".join(w)))
    df = docs_df(spark, rows)
    got = jaccard_join.similarity_components(df).collect()
    want = brute_components(rows)
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == want
    kept = jaccard_join.keep_first(df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect() if r.doc_id is not None) == sorted({i for i, _, c in want if i == c and i != "None"})
    assert jaccard_join.similarity_components(docs_df(spark, [])).count() == 0


# ------------------------------------------------------------------- pipeline

def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline
    from tessera.llm.common import table

    src = "/root/testdata/sf0.001"
    docs = table(spark, src, "documents")
    before = docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, src)
        assert out.columns == docs.columns + (["copy"] if k == 4 else [])
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        n = docs.count()
        assert 0 < n <= before * (1 if k < 4 else 2)
        before = n
    # clean documents go through the filters: few of them are lost
    assert spark.read.parquet(f"{tmp_path}/3").count() > 100


def test_pipeline_on_an_empty_table(spark):
    import corpus_pipeline

    src = "/root/testdata/sf0.001"
    docs = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, src).count() == 0
    assert WORD.findall("a b") == ["a", "b"]
