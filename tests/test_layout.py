"""Laid-out tables: the join of resources and revisions shuffles nothing, lookups of a URL read what may hold it."""

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from strataweb.operators import resources as resources_
from strataweb.sources import layout


@pytest.fixture
def tables(spark):
    rows = spark.range(4000).select("id", F.concat(F.lit("https://x.test/"), F.md5(F.col("id").cast("string"))).alias("url"))
    revisions = spark.range(9000).select("id", (F.col("id") * 7 % 4100).alias("resource_id"), F.lit(None).cast("string").alias("request_cookie"), F.lit("null").alias("error"))
    return {"resource": rows, "resource_revision": revisions}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_the_join_has_no_exchange(spark, tables, tmp_path):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        held = layout.lay_out(tables, str(tmp_path), 8, "laid_")
        joined = layout.resources_with_revisions(held["resource"], held["resource_revision"])
        assert "Exchange" not in plan(joined)
        wanted = layout.resources_with_revisions(*tables.values())
        assert "Exchange" in plan(wanted)
        assert sorted(map(tuple, joined.select("id", "url").collect())) == sorted(map(tuple, wanted.select("id", "url").collect()))
        schemas = {name: ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in t.schema) for name, t in tables.items()}
        again = layout.open_layout(spark, str(tmp_path), schemas, 8, "again_")
        joined = layout.resources_with_revisions(again["resource"], again["resource_revision"])
        assert "Exchange" not in plan(joined) and joined.count() == wanted.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        for name in ("laid_resource", "laid_resource_revision", "again_resource", "again_resource_revision"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def rows_read(spark, df):
    """Rows that the scan of a plan has put out."""
    df.collect()
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if "Scan parquet" in node.nodeName():
            found.append(node.metrics().apply("numOutputRows").value())
        todo += [node.children().apply(k) for k in range(node.children().size())]
    return sum(found)


def test_lookups_skip_what_cannot_hold_the_url(spark, tables, tmp_path):
    try:
        held = layout.lay_out({"resource": tables["resource"]}, str(tmp_path), 8, "look_")["resource"]
        files = list((tmp_path / "resource").glob("*.parquet"))
        assert len(files) == 8
        url = held.first()["url"]
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        assert rows_read(spark, resources_.by_url(held, url)) <= 4000 // 4  # one file of eight, by its Bloom filter
        assert rows_read(spark, resources_.by_url(held, "https://x.test/zzzz")) <= 4000 // 4
        assert rows_read(spark, held) == 4000
        # Buckets are known too: one id is one file.
        assert rows_read(spark, resources_.by_id(held, 77)) <= 4000 // 4 and resources_.by_id(held, 77).count() == 1
        ids = pq.read_table(files[0]).column("id").to_pylist()
        assert ids == sorted(ids)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.sql("DROP TABLE IF EXISTS look_resource")
