"""Recursive split over lines against the splitter on the whole sheet text."""

import random

from tessera.operators.chunk_recursive import chunk_recursive, sheet_csv_text, split_text

from helpers import sheet_df  # noqa: F401  (shared fixtures)

ROWS = "source string, sheet string, sheet_pos long, row_idx long, columns array<string>, cells array<string>"


def sheets(rng, n):
    rows = []
    for s in range(n):
        cols = rng.choice([["h"], [""], ["a", "b"], ["x\ny"], ["long " * rng.randrange(1, 60)]])
        for i in range(rng.randrange(1, 25)):
            cell = lambda: rng.choice([None, "", " ", "w" * rng.randrange(1, 9), "one two " * rng.randrange(1, 40), "x" * rng.randrange(1, 300),
                                       "l1\nl2", "\n\n\n", 'q"t', "é ü\n" * rng.randrange(1, 9)])
            rows.append((f"f{s % 3}.csv", f"s{s}", s, i, cols, [cell() for _ in cols]))
    return rows


def test_split_over_lines(spark):
    rng = random.Random(3)
    df = spark.createDataFrame(sheets(rng, 60), ROWS).repartition(5)
    texts = {(r.source, r.sheet): r.text for r in sheet_csv_text(df).collect()}
    assert any("\n\n" in t for t in texts.values()) and any("\n\n" not in t for t in texts.values())
    for budget, overlap in ((10, 3), (25, 10), (8000, 100)):
        got = {}
        for r in chunk_recursive(df, budget, overlap).collect():
            got.setdefault((r.source, r.sheet), {})[r.part] = r.content
        for key, t in texts.items():
            mine = got.get(key, {})
            assert [mine[i] for i in range(len(mine))] == split_text(t, budget, overlap), (key, budget, overlap)


def test_other_length_function(spark):
    df = spark.createDataFrame(sheets(random.Random(4), 5), ROWS)
    texts = {(r.source, r.sheet): r.text for r in sheet_csv_text(df).collect()}
    words = lambda s: len(s.split())
    got = {}
    for r in chunk_recursive(df, 12, 4, words).collect():
        got.setdefault((r.source, r.sheet), {})[r.part] = r.content
    assert all([got[k][i] for i in range(len(got[k]))] == split_text(t, 12, 4, words) for k, t in texts.items())
