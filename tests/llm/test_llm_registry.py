"""The registered operator queries on the small tables: DuckDB statements
where there are some, and learned operators on held-out rows."""

import duckdb
import pytest

import __spark_entry__ as E
from tessera.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


def test_every_operator_is_registered():
    names = E.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13 and "pipeline" in names


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    got = E.queries()[name](spark, SF)
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.sql(ORACLE[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    norm = lambda rows: sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows)
    assert norm(tuple(r) for r in got.select(*cols).collect()) == norm(want.select(*cols).fetchall())


def test_held_out_toxicity(spark):
    sf = SF.replace("0.001", "0.01")
    got = QUERIES["op5_toxicity_lexicon"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out")
    right = got.filter("predicted = toxic").count()
    assert right >= 0.95 * got.count()


def test_language_model_beats_the_base_on_held_out_rows(spark):
    # with few documents the base gives every new word more than there is to give
    got = QUERIES["op9_attention_lm"](spark, SF.replace("0.001", "0.1"))
    base, score = got.filter("held_out").selectExpr("sum(base_score)", "sum(score)").first()
    assert score > base
