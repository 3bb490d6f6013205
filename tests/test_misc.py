import numpy as np
from pyspark.sql import functions as F

from helpers import sheet_df
from tessera.operators.chunk_tokens import chunk_by_tokens
from tessera.operators.embed import embed_with
from tessera.sources.store import add_documents, load_vectors, rebuild_store
from tessera.streaming.deltas import running_tokens


def test_embedder_plugin(spark):
    def fn(texts):
        return [np.array([len(t), t.count("a")], dtype=np.float32) for t in texts]

    df = spark.createDataFrame([(1, "banana"), (2, "")], "id long, t string")
    got = {r.id: (list(r.embedding), r.norm) for r in embed_with(df, "t", fn).collect()}
    assert got[1][0] == [6.0, 3.0] and abs(got[1][1] - np.hypot(6, 3)) < 1e-9
    assert got[2][0] == [0.0, 0.0]


def test_running_tokens(spark):
    d = spark.createDataFrame([(1, 0, "abcde"), (1, 1, "abcdefghij"), (2, 0, "x")], "request_id long, seq long, delta string")
    got = {(r.request_id, r.seq): r.tokens_so_far for r in running_tokens(d).collect()}
    assert got == {(1, 0): 1, (1, 1): 3, (2, 0): 0}


def test_labelled_layout(spark):
    df = sheet_df(spark, {"S": [["a", None], [None, "  "], ["c", "d"]]}, columns=["x", "y"], source="f.csv")
    r = chunk_by_tokens(df, 2000, 100, layout="labelled").collect()[0]
    assert r.content == "Sheet: S\nSource: f.csv\nRows 1-3:\n\nRow 1: x: a\nRow 3: x: c | y: d"


def test_rebuild_and_add(spark, tmp_path):
    root = tmp_path / "docs"
    root.mkdir()
    (root / "one.csv").write_text("h\n" + "\n".join(f"line {i} " + "w" * i for i in range(40)) + "\n")
    store = str(tmp_path / "store")
    v = rebuild_store(spark, str(root), store, max_tokens=60, overlap_tokens=10)
    n = v.count()
    assert n > 1 and v.where(F.col("chunk_id").startswith("one_")).count() == n
    assert rebuild_store(spark, str(root), store, max_tokens=60, overlap_tokens=10).count() == n   # overwrite
    more = tmp_path / "more"
    more.mkdir()
    (more / "two.csv").write_text("h\nalpha\nbeta\n")
    added = add_documents(spark, str(more), store, max_tokens=60, overlap_tokens=10).count()
    assert added == 1 and load_vectors(spark, store).count() == n + 1
    assert add_documents(spark, str(more), store, max_tokens=60, overlap_tokens=10).count() == 0
