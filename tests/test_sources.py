"""Bodies, packs, project databases and streams."""

import json
import sqlite3
import time
import zipfile
from datetime import datetime
from decimal import Decimal

from pyspark.sql import functions as F

from strataweb.operators import groups, revisions
from strataweb.operators import resources as resources_
from strataweb.plans import model
from strataweb.sources import bodies, project, recorded
from strataweb.streaming import membership


def test_paths(spark):
    cases = [(0x001, "001", "revisions/000/000/000/000/00_.zip"), (0x01A, "01a", "revisions/000/000/000/000/01_.zip"), (0xFFF, "fff", "revisions/000/000/000/000/ff_.zip"), (0x123456789AB, "9ab", "revisions/000/012/345/678/9a_.zip")]
    df = spark.createDataFrame([(c[0],) for c in cases], "id long")
    rows = df.orderBy("id").select("id", bodies.entry_name(F.col("id")), bodies.pack_path(F.col("id"))).collect()
    assert [tuple(r) for r in rows] == cases
    assert spark.range(1).select(bodies.hierarchical_path(F.lit(1 << 60))).first()[0] is None


def test_packs_round_trip_with_loose_files(spark, tmp_path):
    rows = [(k, f"body {k}".encode()) for k in (3, 4, 15, 16, 40, 4097)]
    written = bodies.write_packs(spark.createDataFrame(rows, "id long, body binary"), str(tmp_path)).collect()
    assert sorted(r["n"] for r in written) == [1, 1, 1, 3]
    loose = tmp_path / "revisions/000/000/000/000/063"
    loose.write_bytes(b"loose")
    (tmp_path / "revisions/000/000/000/000/07_.zip").write_bytes(b"no archive")
    found = {r["id"]: bytes(r["body"]) for r in bodies.read_bodies(spark, str(tmp_path)).collect()}
    assert found == dict(rows) | {0x63: b"loose"}


def test_broken_entries_spare_their_pack(spark, tmp_path):
    place = tmp_path / "revisions/000/000/000/000"
    place.mkdir(parents=True)
    with zipfile.ZipFile(place / "00_.zip", "w", zipfile.ZIP_DEFLATED) as archive:
        for k in range(4):
            archive.writestr(f"{k:03x}", f"body {k} ".encode() * 50)
        archive.writestr("odd name", b"x")
    data = bytearray((place / "00_.zip").read_bytes())
    at = data.index(b"001", 30) + 3
    data[at : at + 6] = b"\xff" * 6
    (place / "00_.zip").write_bytes(bytes(data))
    assert {r["id"] for r in bodies.read_packs(spark, str(tmp_path)).collect()} == {0, 2, 3}
    assert {r["id"] for r in bodies.pack_entries(spark, str(tmp_path)).collect()} == {0, 1, 2, 3}


def test_packs_without_deleted_bodies_and_migration(spark, tmp_path):
    rows = [(k, f"body {k}".encode()) for k in (3, 4, 16, 17, 40)]
    bodies.write_packs(spark.createDataFrame(rows, "id long, body binary"), str(tmp_path / "p")).collect()
    gone = spark.createDataFrame([(4,), (16,), (17,)], "id long")
    done = {r["path"]: r["n"] for r in bodies.rewrite_packs(spark, str(tmp_path / "p"), gone, f"file://{tmp_path}/q").collect()}
    assert done == {"000/000/000/000/00_.zip": 1, "000/000/000/000/01_.zip": 0}
    assert [(r["id"], bytes(r["body"])) for r in bodies.read_packs(spark, str(tmp_path / "q")).collect()] == [(3, b"body 3")]
    flat = tmp_path / "flat/revisions"
    flat.mkdir(parents=True)
    for k in (1, 2, 33):
        (flat / str(k)).write_bytes(b"%d" % k)
    assert sorted(r["n"] for r in bodies.migrate(spark, str(tmp_path / "flat"), str(tmp_path / "m"), hierarchical=False).collect()) == [1, 2]
    assert {r["id"]: bytes(r["body"]) for r in bodies.read_bodies(spark, str(tmp_path / "m")).collect()} == {1: b"1", 2: b"2", 33: b"33"}


def test_revisions_are_recorded_with_bodies_and_errors(spark, tmp_path):
    schema = "resource_id long, request_cookie string, http_version int, status_code int, reason_phrase string, headers array<array<string>>, body binary, error struct<type:string,message:string>, fetched_at timestamp"
    when = datetime(2023, 8, 16)
    rows = [(1, None, 11, 200, "OK", [["Server", "x"]], b"one", None, when), (2, "c", 11, 200, "OK", [["Date", "kept"]], b"", None, when), (3, None, None, None, None, None, b"lost", ("IOError", "away"), when)]
    for part in (rows[:2], rows[2:]):
        project.record_revisions(spark, spark.createDataFrame(part, schema), str(tmp_path))
    table = project.open_project(spark, str(tmp_path))["resource_revision"]
    found = {r["resource_id"]: r for r in table.collect()}
    assert sorted(r["id"] for r in found.values()) == [1, 2, 3] and found[3]["id"] == 3
    assert json.loads(found[1]["metadata"])["headers"] == [["Server", "x"], ["Date", "Wed, 16 Aug 2023 00:00:00 GMT"]] and json.loads(found[2]["metadata"])["headers"] == [["Date", "kept"]]
    assert json.loads(found[3]["error"]) == {"type": "IOError", "message": "away"} and found[3]["metadata"] is None and found[1]["error"] == "null"
    held = recorded.read_recorded_bodies(spark, f"{tmp_path}/{project.RECORDED}")
    assert {r["id"]: bytes(r["body"]) for r in held.collect()} == {found[1]["id"]: b"one", found[2]["id"]: b""}
    assert revisions.orphans(table, held).count() == 0


def test_repairs_deletions_and_names(spark):
    rows = spark.createDataFrame([(k, k % 3, "null" if k != 4 else '{"type":"E"}') for k in range(1, 8)], "id long, resource_id long, error string")
    ids = lambda *k: spark.createDataFrame([(x,) for x in k], "id long")
    assert [r["id"] for r in revisions.repairs(rows, ids(1, 2, 3, 5, 6)).collect()] == [7]
    assert revisions.repairs(rows, ids(1, 2, 3, 5, 6, 7)).count() == 0 and revisions.repairs(rows, ids(1, 2, 5)).count() == 0
    resources = spark.createDataFrame([(0, "u0"), (1, "u1"), (2, "u2")], "id long, url string")
    left = revisions.deleted(rows, ids(*range(1, 8)), resources, ids(1))
    assert [sorted(r["id"] for r in t.collect()) for t in left] == [[0, 2], [2, 3, 5, 6], [2, 3, 5, 6]]
    named = revisions.renamed(spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id long, name string"), spark.createDataFrame([(2, None), (3, "c")], "id long, name string"))
    assert {r["id"]: r["name"] for r in named.collect()} == {1: "a", 2: None, 3: "c"}


def test_lookups_by_any_column(spark):
    roots = spark.createDataFrame([(1, "Home", 2), (2, "Ten", 10), (3, "Home", None)], "root_id long, name string, resource_id long")
    found = lambda **equal: sorted(r["root_id"] for r in resources_.lookup(roots, **equal).collect())
    assert found(name="Home") == [1, 3] and found(name="Home", resource_id=2) == [1] and found(root_id=2) == [2]
    assert found(resource_id=None) == [] and found() == [1, 2, 3]


def test_rates_and_sizes(spark):
    rows = [("t", 0.0, 0, 100), ("t", 10.0, 10, 100), ("t", 20.0, 30, 110), ("u", 5.0, 1, 9)]
    df = spark.createDataFrame(rows, "task_id string, seconds double, done long, total long")
    found = {(r["task_id"], r["seconds"]): (r["rate"], r["eta_seconds"]) for r in resources_.rates(df, half_life=10.0).collect()}
    assert found["t", 0.0] == (None, None) and found["u", 5.0] == (None, None) and found["t", 10.0] == (1.0, 90.0)
    rate = (10 * 2 + 10 * 4) / (10 * 2 + 10 * 4)
    assert found["t", 20.0] == (rate, 80 / rate)
    sizes = spark.createDataFrame([(x,) for x in (0, 1, 1023, 1024, 1536, 5 << 20, 3 << 40)], "n long")
    assert [r[0] for r in sizes.select(resources_.format_size(F.col("n"))).collect()] == ["0 bytes", "1 byte", "1023 bytes", "1 KB", "1.5 KB", "5 MB", "3 TB"]


def test_sqlite_tables_with_missing_columns(spark, tmp_path):
    path = str(tmp_path / "database.sqlite")
    with sqlite3.connect(path) as db:
        db.execute("create table resource (id integer primary key, url text unique not null)")
        db.executemany("insert into resource values (?, ?)", [(k, f"http://x/{k}") for k in range(1, 101)])
        db.execute("create table resource_group (id integer primary key, name text, url_pattern text)")
        db.execute("insert into resource_group values (1, 'g', 'http://x/#')")
    db.close()
    found = project.read_sqlite(spark, path, "resource", partitions=3)
    assert found.rdd.getNumPartitions() == 3 and found.agg(F.sum("id")).first()[0] == 5050
    group = project.read_sqlite(spark, path, "resource_group").first()
    assert (group["do_not_download"], group["source_id"]) == (False, None)
    assert project.read_sqlite(spark, path, "alias").count() == 0
    project.export(spark, path, str(tmp_path / "out"))
    assert project.open_project(spark, str(tmp_path / "out"))["resource"].count() == 100


def test_stream_resumes_and_maintains(spark, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    own = [groups.Group(1, "all", "http://x/**")]
    schema = "id long, url string"
    for part in ([(1, "http://x/a"), (2, "http://y/")], [(3, "http://x/b")]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        stream = membership.resource_stream(spark, source, schema)
        membership.run_available(membership.standing_membership(stream, own), out, state)
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == [1, 3]

    changes, table = str(tmp_path / "changes"), str(tmp_path / "table")
    schema = "seq long, id long, url string, deleted boolean"
    for rows in ([(1, 1, "http://x/a", False), (2, 2, "http://x/b", False)], [(3, 1, "http://y/", False), (4, 2, "", True), (5, 3, "http://x/c", False)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(changes)
        membership.maintain(membership.resource_stream(spark, changes, schema), own, table, str(tmp_path / "state2"))
    assert [r["id"] for r in membership.current_members(spark, table).collect()] == [3]
    membership.compact(spark, table, str(tmp_path / "short"))
    assert [tuple(r) for r in membership.current_members(spark, str(tmp_path / "short")).collect()] == [(3, "http://x/c", 1)]
    assert membership.StreamingQueryListener and spark.read.parquet(str(tmp_path / "short")).count() < spark.read.parquet(table).count()


def test_progress_is_reported(spark, tmp_path):
    spark.createDataFrame([(1, "http://x/a"), (2, "http://x/b")], "id long, url string").coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = []
    feed = membership.ProgressFeed(lambda name, batch, rows, rate: seen.append((batch, rows)))
    spark.streams.addListener(feed)
    try:
        stream = membership.first_seen(membership.resource_stream(spark, str(tmp_path / "in"), "id long, url string"))
        membership.run_available(stream, str(tmp_path / "out"), str(tmp_path / "state"))
        for _ in range(50):
            if seen:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(feed)
    assert (0, 2) in seen


def test_prefix_reaches_the_scan(spark, tmp_path):
    spark.createDataFrame([(1, "http://x/a")], "id long, url string").write.parquet(str(tmp_path / "r"))
    plan = groups.members(spark.read.parquet(str(tmp_path / "r")), "http://x/*")._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(url,http://x/)" in plan
    assert model.GROUPS


def test_sizes_beyond_a_thousand_terabytes_stay_in_terabytes(spark):
    from strataweb.operators import resources as resources_

    sizes = spark.createDataFrame([(1024**5,), (294767**3,)], "n long")
    assert [r[0] for r in sizes.select(resources_.format_size(F.col("n"))).collect()] == ["1024 TB", "23293.61 TB"]


def test_sizes_beyond_a_long(spark):
    rows = [(Decimal(n),) for n in (2**63, 5999999**3, 5000000000**3, -(2**63) - 1)]
    found = spark.createDataFrame(rows, "n decimal(38,0)").select(resources_.format_size(F.col("n"))).collect()
    assert [r[0] for r in found] == ["8388608 TB", "196450757.36 TB", "113686837721616032 TB", "-9223372036854775809 bytes"]


def test_responses_without_a_target_are_spread(spark):
    rows = spark.range(1000).selectExpr("id", "id % 50 as resource_id", "CASE WHEN id % 5 = 4 THEN 304 WHEN id = 7 THEN NULL ELSE 200 END as status_code", "CASE WHEN id % 11 > 0 THEN concat('e', id % 2) END as etag", "array(array('Date', cast(id as string))) as headers")
    held = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        found = revisions.resolve_not_modified(rows.repartition(4)).withColumn("_part", F.spark_partition_id()).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    plain = rows.collect()
    last = {}
    for r in plain:
        if r["status_code"] == 200 and r["etag"]:
            last[r["resource_id"], r["etag"]] = r["id"]
    wanted = {r["id"]: last.get((r["resource_id"], r["etag"]), r["id"]) if r["status_code"] == 304 else r["id"] for r in plain}
    assert len(found) == 1000 and {r["id"]: r["target_id"] for r in found} == wanted
    parts = [r["_part"] for r in found]
    assert max(parts.count(p) for p in set(parts)) < 600
