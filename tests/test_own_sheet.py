"""A sheet made here in the shape of a test plan: a header of one named
column, quoted cells, CRLF line ends, markers at known rows and inside cells,
blank rows."""

import random

import pytest

from helpers import py_pack, py_tokens
from tessera.operators.chunk_marker import chunk_by_marker
from tessera.operators.chunk_tokens import token_bounds, with_row_tokens
from tessera.sources.csv_source import read_csv_sheets

N, WIDTH = 282, 13
MARKERS = [30, 61, 88, 115, 144, 173, 201, 226, 255]


def cells_of(i, rng):
    row = [None] * WIDTH
    if i in MARKERS:
        row[0] = f"{rng.choice(['', chr(9), '  '])}Section = {MARKERS.index(i) + 1};"
        return row
    kind = rng.randrange(8)
    if kind == 0:
        return row                                              # no value
    if kind == 1:
        row[2] = "  "                                           # white space only
        return row
    row[12] = f"step {i}, set \"{rng.randrange(99)}\" and wait" if kind < 5 else f"note {i}"
    if kind > 4:
        row[0] = "see Section = 3;" if kind == 5 else "x" * rng.randrange(1, 120)
    return row


@pytest.fixture(scope="module")
def sheet(spark, tmp_path_factory):
    rng = random.Random(282)
    rows = [cells_of(i, rng) for i in range(N)]
    quote = lambda c: "" if c is None else '"' + c.replace('"', '""') + '"' if any(x in c for x in ',"') else c
    path = tmp_path_factory.mktemp("own") / "plan.csv"
    lines = ['"#plan ""own"""' + "," * (WIDTH - 1), *(",".join(map(quote, r)) for r in rows)]
    path.write_bytes("".join(x + "\r\n" for x in lines).encode())
    return rows, read_csv_sheets(spark, str(path)).cache()


def test_shape(sheet):
    rows, df = sheet
    got = df.orderBy("row_idx").collect()
    assert [r.cells for r in got] == rows and got[0].columns == ['#plan "own"', *(f"Unnamed: {i}" for i in range(1, WIDTH))]


def test_sections(sheet):
    _, df = sheet
    got = sorted((r.part, r.start_row, r.end_row, r.total_rows, r.section_label) for r in chunk_by_marker(df, "Section").collect())
    ends = [*MARKERS, N]
    assert got == [(0, 1, MARKERS[0], MARKERS[0], "Preamble")] + [
        (k + 1, m + 1, ends[k + 1], ends[k + 1] - m, f"Section = {k + 1};") for k, m in enumerate(MARKERS)]


@pytest.mark.parametrize("budget, overlap", [(2000, 100), (500, 100), (500, 20), (60, 0)])
def test_packing(sheet, budget, overlap):
    rows, df = sheet
    got = sorted((r.start_row, r.end_row, r.total_rows, r.token_sum) for r in token_bounds(with_row_tokens(df), budget, overlap).collect())
    assert got == sorted(py_pack([py_tokens(c) for c in rows], budget, overlap))
