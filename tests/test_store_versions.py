"""Store with row keys and tombstones; search over files of equal names."""

import os

import pytest

from tessera.operators.embed import embed_queries
from tessera.operators.search import search_chunks
from tessera.sources.store import add_documents, load_vectors, log_path, rebuild_store, remove_documents

KW = {"max_tokens": 60, "overlap_tokens": 10}


def write(path, data):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data if isinstance(data, bytes) else data.encode())


@pytest.fixture()
def store(spark, tmp_path):
    root, path = f"{tmp_path}/docs", f"{tmp_path}/store"
    write(f"{root}/x/n.csv", "h\napple pear\nplum\n")
    write(f"{root}/y/n.csv", "h\nengine wheel\n")
    write(f"{root}/z/n.csv", "h\nriver lake\n")
    rebuild_store(spark, root, path, **KW)
    return root, path


def live(spark, path):
    return {r.source: r.content for r in load_vectors(spark, path).collect()}


def test_equal_names_give_k_right_hits(spark, store):
    root, path = store
    v = load_vectors(spark, path)
    assert {r.chunk_id for r in v.collect()} == {"n_0"} and v.select("row_key").distinct().count() == 3
    q = spark.createDataFrame([(1, "engine wheel"), (2, "apple pear plum")], "query_id long, query string")
    got = search_chunks(embed_queries(q), v, 2, columns=("chunk_id", "source", "content")).collect()
    assert len(got) == 4 and sorted((r.query_id, r["rank"]) for r in got) == [(1, 1), (1, 2), (2, 1), (2, 2)]
    assert {r.query_id: r.source for r in got if r["rank"] == 1} == {1: "y/n.csv", 2: "x/n.csv"}
    assert all(f"Source: {r.source}\n" in r.content for r in got)
    # chunks that come from no store have a key of their own too
    plain = v.drop("row_key")
    assert search_chunks(embed_queries(q), plain, 2, columns=("source",)).count() == 4


def test_emptied_and_deleted_files_leave_the_store(spark, store):
    root, path = store
    write(f"{root}/x/n.csv", "h\n")
    os.remove(f"{root}/z/n.csv")
    assert add_documents(spark, root, path, **KW).count() == 0
    assert set(live(spark, path)) == {"y/n.csv", "z/n.csv"}          # the folder need not hold all documents
    assert add_documents(spark, root, path, remove_missing=True, **KW).count() == 0
    assert set(live(spark, path)) == {"y/n.csv"}
    n = spark.read.parquet(path).count()
    add_documents(spark, root, path, remove_missing=True, **KW).count()
    assert spark.read.parquet(path).count() == n                      # no second tombstone
    write(f"{root}/x/n.csv", "h\napple pear\nplum\n")
    assert [r.source for r in add_documents(spark, root, path, **KW).collect()] == ["x/n.csv"]
    assert "plum" in live(spark, path)["x/n.csv"]
    status = [r.status for r in spark.read.parquet(log_path(path)).where("source = 'x/n.csv'").collect()]
    assert sorted(status) == ["empty", "empty", "empty", "ok", "ok"]


def test_unreadable_file_keeps_its_chunks(spark, store):
    root, path = store
    write(f"{root}/y/n.csv", b"h\n\xff\xfe\n")
    add_documents(spark, root, path, remove_missing=True, **KW).count()
    assert "engine" in live(spark, path)["y/n.csv"]
    bad = spark.read.parquet(log_path(path)).where("status = 'error'").collect()
    assert [(r.source, "UnicodeDecodeError" in r.error) for r in bad] == [("y/n.csv", True)]


def test_removing_by_name(spark, store):
    _, path = store
    gone = spark.createDataFrame([("x/n.csv",), ("none.csv",)], "source string")
    assert remove_documents(gone, path) == 1 and set(live(spark, path)) == {"y/n.csv", "z/n.csv"}
    assert remove_documents(gone, path) == 0
