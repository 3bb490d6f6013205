"""Exact search by float32 products and pairs of blocks."""

import numpy as np
import pytest

import tessera.operators.search as S
import tessera.operators.search_grid as G


def _want(qids, q, keys, v, k, metric):
    order = np.argsort(keys, kind="stable")
    q, v, keys = q.astype(np.float64), v.astype(np.float64)[order], keys[order]
    sc = S._rounded(S._score_block(q, np.linalg.norm(q, axis=1), v, metric))
    out = set()
    for i, row in zip(qids, sc):
        at = np.lexsort((np.arange(len(keys)), -row if metric != "l2" else row))[:k]
        out |= {(int(i), keys[j], round(float(row[j]), 4)) for j in at}
    return out


@pytest.mark.parametrize("metric,size", [(m, s) for m in ("cosine", "dot", "l2") for s in (1.0, 1e-3, 50.0)] + [("cosine", 1e25)])
def test_first_k_lose_nothing_to_float32(metric, size):
    """Near ties, copies, zero vectors and numbers beyond float32 squares."""
    rng = np.random.default_rng(11)
    v = rng.normal(size=(900, 24))
    v[300:600] = v[:300] + rng.normal(size=(300, 24)) * 1e-5      # apart by less than the rounding
    v[600:640] = v[7]
    v[640:650] = 0
    v = (v * size).astype(np.float32)
    q = np.concatenate([v[::30], np.zeros((2, 24), dtype=np.float32)])
    keys = np.array([f"d{i}" for i in rng.permutation(900)], dtype=object)
    qids = np.arange(len(q)) * 7
    best = S.Best(qids, q, 5, metric)
    for a in range(0, 900, 130):
        best.add(keys[a:a + 130], v[a:a + 130])
    got = {(int(i), k, round(float(s), 4)) for i, k, s in zip(*best.result())}
    assert got == _want(qids, q, keys, v, 5, metric)


def test_few_pairs_are_scored_in_float64(monkeypatch):
    """The work that is not one float32 product stays small."""
    rng = np.random.default_rng(3)
    v, q = (rng.normal(size=(n, 32)).astype(np.float32) for n in (20_000, 100))
    scored, round_all = [], S._rounded
    monkeypatch.setattr(S, "PAIR_BLOCK", 100_000)
    monkeypatch.setattr(S, "_rounded", lambda x: scored.append(x.size) or round_all(x))
    best = S.Best(np.arange(100), q, 5, "cosine")
    best.add(np.arange(20_000), v)
    assert len(best.result()[0]) == 500 and sum(scored) < 0.02 * 100 * 20_000


def test_many_queries_are_pairs_of_blocks(spark, monkeypatch):
    """No vector is grouped or repeated over a shuffle; a task holds blocks."""
    rng = np.random.default_rng(4)
    rows = [(f"k{i:04d}", rng.normal(size=6).tolist() if i % 50 else None) for i in range(700)]
    store = spark.createDataFrame(rows, "chunk_id string, embedding array<float>")
    q = spark.createDataFrame([(i, r[1]) for i, r in enumerate(rows[:300])], "query_id long, embedding array<float>")
    want = {tuple(r) for r in S.knn(q, store, 4).collect()}
    monkeypatch.setattr(S, "MAX_BROADCAST_QUERIES", 50)
    monkeypatch.setattr(G, "BLOCK_ROWS", 40)
    monkeypatch.setattr(G, "PART_BLOCKS", 3)
    hits = S.knn(q, store, 4)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroups" not in plan and "CartesianProduct" in plan
    assert {tuple(r) for r in hits.collect()} == want and len(want) == 4 * 294


def test_block_texts_are_packed_where_they_cross_the_shuffle():
    """The texts dealt out with the verdicts take less than half their size."""
    import pyarrow as pa

    from tessera.llm import site_tree as st
    rng = np.random.default_rng(6)
    words = ["alpha", "beta", "gamma", "delta", "over", "and", "the", "of", "river", "stone", "market"]
    page = lambda: "<html><body>" + "".join(f"<p>{' '.join(rng.choice(words, 60))}</p>" for _ in range(6)) + "</body></html>"
    html = [page() for _ in range(40)] + [None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(42), pa.int64()), pa.array(["http://a/"] * 42), pa.array(html, pa.string())], names=["page_id", "url", "html"])
    sent = pa.Table.from_batches(st._texts([batch])).column("texts")
    size = sum(len(t.encode()) for h in html for *_, t in st.blocks(h or ""))
    assert sum(len(x) for x in sent.to_pylist() if isinstance(x, bytes)) < 0.5 * size
    assert pa.types.is_binary(sent.type)


def test_packed_page_texts_are_whole(spark):
    from tessera.llm import site_tree as st
    rows = [(1, "http://a/1", "<p>one \x1f two\u2028three</p><p>caf\u00e9 &amp; \U0001f600</p>"), (2, "http://a/2", None), (3, None, "<p>x</p>"), (3, None, "<p>x</p>")]
    got = sorted(tuple(r) for r in st.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).select("page_id", "text", "n_chars").collect())
    assert got == [(1, "one two three\n\ncaf\u00e9 & \U0001f600", 23), (2, "", 0), (3, "x", 1), (3, "x", 1)]


def test_language_model_trains_on_every_window(spark):
    """parts hold the windows of all texts, and a part's training uses each."""
    import numpy as np

    from tessera.llm import attention_lm as lm

    rng = np.random.default_rng(3)
    size, n = lm.Subwords(lm.VOCABULARY).size, [0, 1, 47, 48, 49, 800, 2500]
    texts = [np.append(rng.integers(0, 900, k), size - 1) for k in n]
    row, cls = rng.integers(0, lm.N_ROWS - 2, size), rng.integers(0, lm.N_CLASSES, size)
    df = spark.createDataFrame([(i, bytearray(t.astype(np.uint16).tobytes())) for i, t in enumerate(texts)], "key long, ids binary")
    ids, bounds = np.concatenate(texts), np.append(0, np.cumsum([len(t) for t in texts]))
    x, at = lm.windows(row[ids], bounds, lm.N_ROWS - 1)
    want = np.concatenate([x, np.where(at >= 0, cls[ids[np.maximum(at, 0)]], -1)], axis=1)
    got = np.concatenate(lm.dealt_windows(df.mapInArrow(lambda it: lm._stretches(it, size), "h long, lead long, ids binary").toArrow(), size, row, cls), axis=1)
    assert sorted(map(tuple, got.tolist())) == sorted(map(tuple, want.tolist()))

    # windows of one row each: a row without a step keeps its weights
    n_windows = 3 * lm.BATCH + 5
    x = np.repeat(np.arange(n_windows)[:, None], lm.WINDOW, axis=1)
    y = np.repeat(np.arange(n_windows)[:, None] % lm.N_CLASSES, lm.WINDOW - lm.CONTEXT, axis=1)
    w = lm.start_weights(rng.random((lm.N_ROWS, lm.N_CLASSES)))
    after = lm.descend(w, x, y, np.ones(y.shape, dtype=np.float32), 4, 1)
    assert (after["E"][:n_windows] != w["E"][:n_windows]).any(axis=1).all()


def _plan(df, capfd) -> str:
    capfd.readouterr()
    df.explain()
    return capfd.readouterr().out


def test_rows_of_files_are_not_shuffled_for_a_summary_by_file(spark, tmp_path, capfd):
    """Header, latest version and version by file are broadcast."""
    import re

    from tessera.sources.csv_source import scan_csv
    from tessera.sources.store import append_vectors, load_vectors

    for i in range(3):
        (tmp_path / f"f{i}.csv").write_text("a,b\n" + "".join(f"{i},{j}\n" for j in range(5)))
    rows, _ = scan_csv(spark, str(tmp_path), glob="*.csv")
    assert rows.count() == 15 and not re.search(r"hashpartitioning\(file#\d+, \d+\)", _plan(rows, capfd))

    store = str(tmp_path / "store")
    one = lambda i, t: (f"s{i}", "x", 0, f"s{i}_0", t, [1.0, 0.0])
    df = lambda v: spark.createDataFrame(v, "source string, sheet string, part int, chunk_id string, content string, embedding array<float>")
    append_vectors(df([one(0, "a"), one(1, "b"), (None, "x", 0, "n_0", "c", [1.0, 0.0])]), store)
    added = append_vectors(df([one(0, "a"), one(1, "changed"), one(2, "new")]), store)
    assert sorted(r["content"] for r in added.collect()) == ["changed", "new"]
    live = load_vectors(spark, store)
    assert sorted(r["content"] for r in live.collect()) == ["a", "changed", "new"]
    assert "hashpartitioning(source" not in _plan(live, capfd)


def test_recursive_split_without_its_text_joins_no_lines(spark, capfd):
    """counting chunks needs their bounds alone."""
    from helpers import sheet_df
    from tessera.operators.chunk_recursive import chunk_recursive

    rows = sheet_df(spark, {"a": [["word " * 30] for _ in range(20)], "b": [["x"]]})
    chunks = chunk_recursive(rows, budget=60, overlap=10)
    n = chunks.select("source", "sheet", "part").collect()
    assert len(n) == len(chunks.where("content IS NOT NULL").collect()) > 2
    assert "collect_list" not in _plan(chunks.select("source", "part"), capfd)
