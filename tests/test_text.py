import pytest
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators.chunk_recursive import split_text

CASES = ["", "a", " a ", "\t x \n", " y ", "line1\nline2", "a\r\nb\r\n", "a\n\n", "x y\x1cz",
         "trail\n", "\x0bv\x0c", "no break"]


@pytest.fixture(scope="module")
def cases(spark):
    return spark.createDataFrame([(i, s) for i, s in enumerate(CASES)], "i int, s string")


def test_strip_blank_lines(cases):
    got = cases.select("i", tx.py_strip("s").alias("st"), tx.is_blank("s").alias("bl"),
                       tx.line_count("s").alias("n")).collect()
    for r in got:
        s = CASES[r.i]
        assert r.st == s.strip()
        assert r.bl == (not s.strip())
        assert r.n == len(s.splitlines()), repr(s)


def test_labelled_and_plain(spark):
    df = spark.createDataFrame([(4, ["a", "b", "c"], ["x", None, "  "]), (0, ["a"], [None])],
                               "row_idx long, columns array<string>, cells array<string>")
    got = {r.row_idx: r for r in df.select("row_idx", tx.row_labelled_text("row_idx", "columns", "cells").alias("l"),
                                           tx.row_plain_text("cells").alias("p")).collect()}
    assert got[4].l == "Row 5: a: x" and got[4].p == "x   "
    assert got[0].l is None and got[0].p == ""


def test_csv_field_matches_pandas(spark):
    import pandas as pd
    vals = ["plain", "a,b", 'say "hi"', "two\nlines", " pad ", "tab\there", None, ""]
    df = spark.createDataFrame([(vals,)], "c array<string>")
    line = df.select(tx.csv_line("c").alias("l")).first().l
    want = pd.DataFrame([vals]).to_csv(index=False, header=False, lineterminator="\n").rstrip("\n")
    assert line == want


def test_section_label_rule(spark):
    rows = [["TestNumber = 5;"], ["TestNumber Test Number: 3.1"], ["\tTestNumber Test Number 7 "], ["x", "no"],
            [None, "a TestNumber b"]]
    df = spark.createDataFrame([(r,) for r in rows], "c array<string>")
    got = [r.l for r in df.select(tx.section_label("c", "TestNumber").alias("l")).collect()]
    assert got == ["TestNumber = 5;", "Test Number 3.1", "Test Number 7", "Unknown Test", "a TestNumber b"]


def test_strip_reasoning_greedy(spark):
    texts = ["no tags", "<reasoning>x</reasoning>keep", "<reasoning>a</reasoning>mid<reasoning>\nb\n</reasoning>end",
             "<reasoning>open only"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.a for r in df.select(tx.strip_reasoning("t").alias("a")).collect()]
    assert got == ["no tags", "keep", "end", "<reasoning>open only"]


def test_fill_template_single_pass(spark):
    df = spark.createDataFrame([("{question}", "q?")], "context string, query string")
    got = df.select(tx.fill_template("C={context} Q={question} {{lit}}", context=F.col("context"),
                                     question=F.col("query")).alias("p")).first().p
    assert got == "C={question} Q=q? {lit}"


def test_base_name_and_ids(spark):
    names = ["a.CSV", "a.b.csv", "a.pdf", "a.xls", "noext", "dir/x.y.xlsx"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r.b for r in df.select(tx.base_name(tx.file_name("n")).alias("b")).collect()]
    assert got == ["a", "a.b", "a", "a", "noext", "x.y"]


def test_split_text_rules():
    text = "head\n" + "\n".join(f"row {i}, " + "w" * (i % 13) for i in range(200))
    parts = split_text(text, budget=40, overlap=5)
    # every non-whitespace character is covered, in order
    covered = "".join(p.replace(" ", "").replace("\n", "") for p in parts)
    flat = text.replace(" ", "").replace("\n", "")
    pos = 0
    for ch in flat:
        pos = covered.find(ch, pos)
        assert pos >= 0
    assert all(p == p.strip() and p for p in parts)


def test_split_text_small_cases():
    assert split_text("", 10, 2) == []
    assert split_text("abc", 10, 2) == ["abc"]
    # a long word with the len//5 counter: character pieces count 0, kept whole
    assert split_text("x" * 100, 10, 0) == ["x" * 100]


def test_tokenizer_udf_falls_back(spark):
    from tessera.functions.tokens import count_tokens
    df = spark.createDataFrame([("hello world, this is text",), ("",), (None,)], "t string")
    got = [r.n for r in df.select(count_tokens("t", "no-such-encoding").alias("n")).collect()]
    assert got == [len("hello world, this is text") // 5, 0, 0]
