"""Chunk texts cross the shuffle once and are kept compressed."""

import glob

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import tessera.operators.chunk_tokens as K
from helpers import sheet_df
from tessera.operators.search import attach_chunks
from tessera.sources.store import rebuild_store


def _plan(df, capfd) -> str:
    capfd.readouterr()
    df.explain()
    return capfd.readouterr().out


def _rows(spark):
    sheets = {f"s{n}": [[f"{n} {i} " + "w" * (i * 7 % 23), None if i % 3 else f"x\t{i}"] for i in range(n)] for n in (1, 2, 40, 97)}
    rows = sheet_df(spark, sheets, columns=["name", None])
    twice = rows.where("sheet = 's40' AND row_idx % 5 = 0")
    return rows.unionByName(twice).unionByName(rows.where("sheet = 's2'").withColumn("source", F.lit(None).cast("string")))


@pytest.mark.parametrize("layout", ["table", "labelled"])
def test_chunks_over_the_edge_of_a_block(spark, monkeypatch, layout):
    got = []
    for n in (1, 10_000):
        monkeypatch.setattr(K, "BLOCK_CHUNKS", n)
        got.append(sorted(map(str, K.chunk_by_tokens(_rows(spark), 30, 40, layout=layout).collect())))
    assert got[0] == got[1] and len(got[0]) > 20
    for r in K.chunk_by_tokens(_rows(spark), 30, 40, layout=layout).where("source IS NOT NULL AND sheet <> 's40'").collect():
        lines = r.content.split(":\n\n", 1)[1].split("\n")[int(layout == "table"):]
        assert len(lines) == r.end_row - r.start_row + 1
        assert all(f"{r.sheet[1:]} {i} " in line for i, line in zip(range(r.start_row - 1, r.end_row), lines))


def test_chunk_texts_cross_the_shuffle_once(spark, capfd):
    """Rows are dealt out by blocks, not by row and then by chunk."""
    plan = _plan(K.chunk_by_tokens(_rows(spark), 30, 40), capfd)
    assert "row_idx" not in "".join(x for x in plan.split("\n") if "hashpartitioning" in x)


def test_few_hits_go_to_the_chunks(spark, capfd):
    """no text of the store is shuffled for a few hits."""
    hits = spark.createDataFrame([(1, 1, "c2", 0.5), (1, 2, "c9", 0.25), (2, 1, "c2", 1.0)], "query_id long, rank int, chunk_id string, score double")
    chunks = spark.createDataFrame([(f"c{i}", f"text {i}") for i in range(20)], "chunk_id string, content string")
    got = attach_chunks(hits, chunks)
    assert sorted(map(tuple, got.collect())) == [(1, 1, "c2", 0.5, "text 2"), (1, 2, "c9", 0.25, "text 9"), (2, 1, "c2", 1.0, "text 2")]
    assert "hashpartitioning(chunk_id" not in _plan(got, capfd)


def test_a_rebuild_replaces_the_store_compressed(spark, tmp_path):
    src, store = tmp_path / "in", str(tmp_path / "store")
    src.mkdir()
    for i in range(3):
        (src / f"f{i}.csv").write_text("a,b\n" + "".join(f"{i},{j}\n" for j in range(5)))
    assert rebuild_store(spark, str(src), store).count() == 3
    (src / "f0.csv").unlink()
    assert sorted(r["source"] for r in rebuild_store(spark, str(src), store).collect()) == ["f1.csv", "f2.csv"]
    files = [f for f in glob.glob(f"{store}/*.parquet") if pq.ParquetFile(f).metadata.num_rows]
    assert files and all(pq.ParquetFile(f).metadata.row_group(0).column(0).compression == "ZSTD" for f in files)
    assert not glob.glob(f"{store}_new_*")
    with pytest.raises(ValueError):
        rebuild_store(spark, str(src), store, method="no such")
    assert len(spark.read.parquet(f"{store}_log").collect()) == 2
