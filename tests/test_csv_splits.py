"""CSV scan: quote states over splits, against the csv module over whole files."""

import csv
import io
import os
import random

import pytest

from tessera.sources.csv_source import INSIDE, OUTSIDE, next_state, read_csv_sheets, read_records, scan_csv


@pytest.fixture()
def small_splits(spark):
    """Splits of some tens of bytes."""
    conf = {"spark.sql.files.maxPartitionBytes": "97", "spark.sql.files.openCostInBytes": "1"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def put(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(text if isinstance(text, bytes) else text.encode())
    return str(path)


def expected(text):
    return [r for r in csv.reader(io.StringIO(text, newline="")) if r and not (len(r) == 1 and r[0] and not r[0].strip(" \t"))]


def random_csv(rng):
    cells = ["a", "", "x y", '"q"', '"a, b"', '"l1\nl2"', '"say ""hi"""', '"\n\n"', '5" pipe', '"junk" after', "é", '"é\r\nü"', '""', '"""\n"",\n"""']
    lines = [",".join(rng.choice(cells) for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(0, 30))]
    return rng.choice(["\n", "\r\n"]).join(x for k in lines for x in ([k] if rng.random() > 0.1 else [k, "", " \t"])) + rng.choice(["", "\n", "\n\n"])


def test_states_of_lines():
    assert [next_state(OUTSIDE, x) for x in (b'a,"b', b'a"b', b'"a""', b'"a"', b'"a",x"', b'"a"b",c,"', b'""","')] == [1, 0, 1, 0, 0, 1, 0]
    assert [next_state(INSIDE, x) for x in (b"", b'a"', b'a""', b'",', b'","', b'" x","y', b'x"y"z')] == [1, 0, 1, 0, 1, 1, 0]


def test_records_over_many_splits(spark, tmp_path, small_splits):
    rng = random.Random(11)
    texts = {f"f{k}.csv": random_csv(rng) for k in range(6)}
    texts["long.csv"] = 'h,i\n1,"' + "x, y\n" * 60 + '"\n2,z\n'
    for name, t in texts.items():
        put(f"{tmp_path}/{name}", t)
    got = {}
    recs = read_records(spark, str(tmp_path))
    for r in recs.collect():
        assert r.error is None, r
        got.setdefault(os.path.basename(r.file), {})[r.record] = r.cells
    for name, t in texts.items():
        rows = got.get(name, {})
        assert [rows[i] for i in range(len(rows))] == expected(t), (name, t)


def test_one_file_is_read_by_many_tasks(spark, tmp_path):
    n = 40_000
    put(f"{tmp_path}/big.csv", "id,text\n" + "".join(f'{i},"line {i}\nsecond, ""line"""\n' for i in range(n)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(64 << 10))
    try:
        rows = read_csv_sheets(spark, f"{tmp_path}/big.csv")
        assert read_records(spark, f"{tmp_path}/big.csv").count() == n + 1
        got = rows.selectExpr("count(*)", "count(distinct row_idx)", "max(row_idx)", "sum(cast(cells[0] as bigint))",
                              "count_if(cells[1] = 'line ' || row_idx || '\nsecond, \"line\"')").first()
        assert tuple(got) == (n, n, n - 1, n * (n - 1) // 2, n)
        splits = spark.read.text(f"{tmp_path}/big.csv").rdd.getNumPartitions()
        assert splits > 8
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_any_width(spark, tmp_path):
    put(f"{tmp_path}/a.csv", 'a,b\n1,"' + "," * 25_000 + '"\n')
    put(f"{tmp_path}/w.csv", ",".join(f"c{i}" for i in range(30_000)) + "\n" + "1," * 30_000 + "2\n")
    rows = {os.path.basename(r.source): r for r in read_csv_sheets(spark, str(tmp_path)).collect()}
    assert rows["a.csv"].cells == ["1", "," * 25_000]
    assert len(rows["w.csv"].columns) == 30_001 == len(rows["w.csv"].cells) and rows["w.csv"].columns[-1] == "Unnamed: 30000"


def test_files_that_cannot_be_read_are_reported(spark, tmp_path):
    put(f"{tmp_path}/good.csv", "﻿a,b\n1,2\n")
    put(f"{tmp_path}/latin.csv", "a,b\n1,2\n".encode() + "é,x\n".encode("latin-1"))
    put(f"{tmp_path}/open.csv", 'a\n"never closed\nx\n')
    put(f"{tmp_path}/empty.csv", "")
    rows, errors = scan_csv(spark, str(tmp_path))
    got = {(os.path.basename(r.source), tuple(r.columns), tuple(r.cells)) for r in rows.collect()}
    assert got == {("good.csv", ("a", "b"), ("1", "2"))}
    bad = {os.path.basename(r.path): r.error for r in errors.collect()}
    assert set(bad) == {"latin.csv", "open.csv"} and bad["open.csv"].startswith("record 1: a quoted cell") and bad["latin.csv"].startswith("record 2: UnicodeDecodeError")
