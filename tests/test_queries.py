"""Every registered query with SQL gives the rows of its SQL, over whole tables."""

import base64
import json

import duckdb
import pytest

from strataweb.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def assert_same(con, spark, run, sql):
    ours, theirs = run(spark, SF).toPandas(), con.execute(sql).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    con.register("ours", ours[theirs.columns])
    con.register("theirs", theirs)
    for a, b in (("ours", "theirs"), ("theirs", "ours")):
        assert con.execute(f"select * from {a} except all select * from {b} limit 3").fetchall() == []


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query_equals_sql(spark, duck, name):
    assert_same(duck, spark, catalogue.QUERIES[name], catalogue.ORACLE[name])


def test_sizes_of_ids_whose_cubes_leave_a_long(spark, tmp_path):
    """The cube of 2097152 is 2 ** 63.  The SQL overflows there too, so the rows are those of the same SQL on a wider key."""
    events = spark.read.parquet(f"{SF}/events.parquet").selectExpr("event_id + 2097000 as event_id", "* except (event_id)")
    events.write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select event_id::hugeint as event_id, * exclude (event_id) from '{tmp_path}/events.parquet/*.parquet'")
    theirs = con.execute(f"select id::bigint, shown from ({catalogue.ORACLE['format_size']})").fetchall()
    ours = [tuple(r) for r in catalogue.QUERIES["format_size"](spark, str(tmp_path)).select("id", "shown").collect()]
    assert sorted(ours) == sorted(theirs) and min(ours)[0] < 2097152 <= max(ours)[0]


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE)))
def test_query_without_sql_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_substack_pins_the_event(spark):
    from pyspark.sql import functions as F

    from strataweb.functions import urls

    def packed(event):
        return base64.urlsafe_b64encode(json.dumps(event).encode()).decode()

    event = {"properties": {"browserSessionId": "z", "n": [1]}, "context": {"page": {"referrer": "q", "url": "http://o.com/x?y#z"}}}
    other = {"context": {"page": "text"}, "properties": {"browserSessionId": 5}}
    cases = [f"https://n.com/api/v1/firehose?_=5&d={packed(event)}", f"https://n.com/api/v1/firehose?_=5&d={packed(other)}", "https://n.com/api/v1/firehose?_=5&d=%%%", f"https://n.com/api/v1/firehose?_=x&d={packed(event)}", f"https://n.com/other?_=5&d={packed(event)}"]
    out = [r["out"] for r in spark.createDataFrame([(c,) for c in cases], "u string").select(urls.substack(F.col("u")).alias("out")).collect()]
    found = [json.loads(base64.urlsafe_b64decode(u.split("d=")[1].replace("%3D", "="))) for u in out[:2]]
    assert found[0] == {"properties": {"browserSessionId": "1xh68gok0s4", "n": [1]}, "context": {"page": {"referrer": "", "url": "https://n.com/x?y#z"}}}
    assert found[1] == other and out[2:] == cases[2:]


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    """The tables as folders of files, and a page whose URL another page has too."""
    root = tmp_path_factory.mktemp("folders")
    for t in TABLES:
        rows = spark.read.parquet(f"{SF}/{t}.parquet")
        if t == "pages":
            last = rows.agg({"page_id": "max"}).first()[0]
            twice = rows.where("page_id in (5, 7)").selectExpr(f"page_id + {last} as page_id", "url", "CASE WHEN page_id = 7 THEN html ELSE '<a href=\"/one\">one</a>' END AS html")
            rows = rows.union(twice)
        rows.repartition(2).write.parquet(f"{root}/{t}.parquet")
    return str(root)


def assert_same_in_folders(spark, folders, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folders}/{t}.parquet/*.parquet'")
    ours, theirs = catalogue.QUERIES[name](spark, folders).toPandas(), con.execute(catalogue.ORACLE[name]).df()
    con.register("ours", ours[theirs.columns])
    con.register("theirs", theirs)
    assert len(theirs)
    for a, b in (("ours", "theirs"), ("theirs", "ours")):
        assert con.execute(f"select * from {a} except all select * from {b} limit 3").fetchall() == []


@pytest.mark.parametrize("name", ["stream_group_membership", "stream_first_seen"])
def test_streams_of_tables_in_folders(spark, folders, name):
    assert_same_in_folders(spark, folders, name)


@pytest.mark.parametrize("name", ["pending_work", "rewrite_links", "detect_regular_pages"])
def test_pages_of_one_url_stay_apart(spark, folders, name):
    assert_same_in_folders(spark, folders, name)
