import pytest

from helpers import py_sections, sheet_df
from tessera.operators.chunk_marker import chunk_by_marker
from tessera.operators.scan import row_ordinal, running_sum

M = "TestNumber"
SHEETS = {
    "marker_row0": [["TestNumber = 1;", None], ["a", "b"], ["TestNumber = 2;", None], ["c", None]],
    "preamble": [["head", None], [None, None], ["TestNumber = 10001;", "x"], ["body", None]],
    "no_marker": [["a", None], ["b", "c"]],
    "inside_cell": [["x TestNumber = 3", None], ["y", None], ["\t TestNumber = 4;", None], ["z", None]],
    "two_in_row": [["TestNumber = 5;", "TestNumber = 6;"], ["q", None]],
    "blank_rows": [[None, None], ["  ", None], ["\t", None]],
}


@pytest.fixture(scope="module")
def chunks(spark):
    df = sheet_df(spark, SHEETS, columns=["A", "B"], source="plan.csv")
    return {(r.sheet, r.part): r for r in chunk_by_marker(df, M).collect()}


def test_sections_match_rule(chunks):
    for name, rows in SHEETS.items():
        want = py_sections(rows, M)
        got = sorted((p, r) for (s, p), r in chunks.items() if s == name)
        assert len(got) == len(want), name
        for (_p, r), (kind, start, end, total) in zip(got, want):
            assert (r.start_row, r.end_row, r.total_rows) == (start, end, total), name
            assert r.chunk_type == ("Full Sheet" if kind == "full" else "Test Number")
            if kind == "pre":
                assert r.section_label == "Preamble"
            if kind == "full":
                assert r.section_label == "No Test Number Found"


def test_labels(chunks):
    assert chunks[("preamble", 1)].section_label == "TestNumber = 10001;"
    assert chunks[("inside_cell", 1)].section_label == "TestNumber = 4;"
    assert chunks[("two_in_row", 0)].section_label == "TestNumber = 5;"


def test_text_layout(chunks):
    r = chunks[("preamble", 0)]
    assert r.content == ("File: plan.csv\nSheet: preamble\nTest: Header/Preamble\nRows: 1-2\nColumns: A, B\n"
                         + "=" * 60 + "\nRow 1: A: head")
    full = chunks[("blank_rows", 0)]
    assert full.content == ("File: plan.csv\nSheet: blank_rows\nTotal Rows: 3\nColumns: A, B\n" + "=" * 60)
    sec = chunks[("marker_row0", 0)]
    assert sec.content.endswith("Row 1: A: TestNumber = 1;\nRow 2: A: a | B: b")


def test_ids(chunks):
    ids = sorted(r.chunk_id for r in chunks.values())
    assert len(ids) == len(set(ids)) and all(i.startswith("plan#") for i in ids)


def test_running_sum_blocks(spark):
    """The blocked running sum equals a plain running count for any block size."""
    rows = [("s", "a", i, int(i % 7 == 0)) for i in range(1000)] + [("s", "b", i, 1) for i in range(10)]
    df = spark.createDataFrame(rows, "source string, sheet string, row_idx long, v int")
    for block in (1, 3, 64, 5000):
        got = {(r.sheet, r.row_idx): r.acc for r in running_sum(df, ["source", "sheet"], "row_idx", "v", "acc", block).collect()}
        acc = {}
        for s, sh, i, v in rows:
            acc[sh] = acc.get(sh, 0) + v
            assert got[(sh, i)] == acc[sh]


def test_group_offsets_spread_hot_key(spark):
    from tessera.operators.scan import group_offsets
    rows = [("hot", f"s{i:04d}", i % 37, (i * 7) % 5) for i in range(600)] + [("cold", "a", 1, 3), ("cold", "b", 0, 2)]
    df = spark.createDataFrame(rows, "source string, sheet string, pos long, n long").repartition(7)
    got = {(r.source, r.sheet): r.off for r in group_offsets(df, ["source"], ["pos", "sheet"], "n", "off").collect()}
    acc = {}
    for src, sh, pos, n in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        assert got[(src, sh)] == acc.get(src, 0)
        acc[src] = acc.get(src, 0) + n


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_sheets_partition_rows(spark, seed):
    import random
    rnd = random.Random(seed)
    sheets = {}
    for k in range(8):
        rows = []
        for _i in range(rnd.randint(1, 40)):
            r = rnd.random()
            cell = ("TestNumber = %d;" % rnd.randint(1, 99) if r < 0.15 else
                    " x TestNumber" if r < 0.25 else None if r < 0.35 else "v%d" % rnd.randint(0, 9))
            rows.append([cell, None if rnd.random() < 0.5 else "w"])
        sheets[f"r{k}"] = rows
    got = {}
    for r in chunk_by_marker(sheet_df(spark, sheets, columns=["A", "B"]), M, with_text=False).collect():
        got.setdefault(r.sheet, []).append((r.part, r.start_row, r.end_row, r.total_rows))
    for name, rows in sheets.items():
        want = [(s, e, t) for _k, s, e, t in py_sections(rows, M)]
        g = [x[1:] for x in sorted(got[name])]
        assert g == want
        # sections cover the rows with no gap and no overlap
        assert g[0][0] == 1 and g[-1][1] == len(rows)
        assert all(b[0] == a[1] + 1 for a, b in zip(g, g[1:]))


def test_row_ordinal_hot_key(spark):
    """A key holding most rows, spread over many partitions, is numbered like
    ``row_number() - 1`` in (ts, id) order; gaps and ties in ts are broken by id."""
    import random
    rnd = random.Random(7)
    rows = [("hot", rnd.randrange(50), i) for i in range(3000)] + [(f"k{j}", rnd.randrange(5), j) for j in range(40)]
    df = spark.createDataFrame(rows, "k string, ts int, id int").repartition(13)
    got = {(r.k, r.id): r.pos for r in row_ordinal(df, ["k"], ["ts", "id"], "pos").collect()}
    want = {}
    for k in {r[0] for r in rows}:
        for n, (_k, _ts, i) in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2]))):
            want[(k, i)] = n
    assert got == want


def test_running_sum_with_gaps(spark):
    """``pos`` may have gaps (filtered event sequences): blocks are less full,
    sums are unchanged."""
    rows = [("r", "x", p, p % 5) for p in range(0, 300, 7)] + [("r", "y", p, 1) for p in (3, 40, 41, 900)]
    df = spark.createDataFrame(rows, "source string, sheet string, seq long, v int")
    for block in (1, 4, 50):
        got = {(r.sheet, r.seq): r.acc for r in running_sum(df, ["source", "sheet"], "seq", "v", "acc", block).collect()}
        acc = {}
        for _s, sh, p, v in sorted(rows, key=lambda r: (r[1], r[2])):
            acc[sh] = acc.get(sh, 0) + v
            assert got[(sh, p)] == acc[sh]
