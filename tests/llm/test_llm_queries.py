"""Registered training-data queries equal their SQL; others run and keep every document."""

import duckdb
import pytest

from strataweb.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "pages", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, duck, name):
    ours, theirs = queries.QUERIES[name](spark, SF).toPandas(), duck.execute(queries.ORACLE[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    duck.register("ours", ours[theirs.columns])
    duck.register("theirs", theirs)
    for a, b in (("ours", "theirs"), ("theirs", "ours")):
        assert duck.execute(f"select * from {a} except all select * from {b} limit 3").fetchall() == []


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE) - {"op13_whitening"}))
def test_query_keeps_every_document(spark, duck, name):
    assert queries.QUERIES[name](spark, SF).select("doc_id").distinct().count() == duck.execute("select count(*) from documents").fetchone()[0]


def test_mixing_equals_its_sql_on_unequal_sources(spark, tmp_path):
    rows = [(k, None if k % 97 == 0 else f"t{k % 500}", "en", None if k % 50 == 0 else "abc"[min(k % 17, 2)] if k % 3 else f"s{k % 7}", 1) for k in range(1200)]
    spark.createDataFrame([*rows, rows[5], (None, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    ours, theirs = queries.op3_mixing(spark, str(tmp_path)).toPandas(), con.execute(queries.ORACLE["op3_mixing"]).df()
    con.register("ours", ours[theirs.columns])
    con.register("theirs", theirs)
    assert len(ours) == 1202 and con.execute("select count(distinct coalesce(source, '')), max(n) - min(n) from (select source, count(*) n from ours group by 1)").fetchone()[0] > 6
    for a, b in (("ours", "theirs"), ("theirs", "ours")):
        assert con.execute(f"select * from {a} except all select * from {b} limit 3").fetchall() == []
