"""Recording is all or nothing, and ids of several writers never meet; projects of older versions open."""

import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from strataweb.sources import project, recorded


def rows(spark, ids, parts=2):
    made = spark.createDataFrame([(i, f"b{i}".encode() if i % 3 else None) for i in ids], "resource_id long, body binary").repartition(parts)
    return made.select("resource_id", F.lit(None).cast("string").alias("request_cookie"), F.lit("null").alias("error"), F.lit("{}").alias("metadata"), "body")


def seen(spark, path):
    return {r["resource_id"]: r["id"] for r in recorded.read_revisions(spark, path).collect()}


def test_rows_and_bodies_carry_the_same_ids(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "p")
    assert recorded.read_revisions(spark, path).count() == 0 and recorded.read_recorded_bodies(spark, path).count() == 0
    recorded.append(rows(spark, range(10), 3), path, after=5)
    recorded.append(rows(spark, range(10, 12)), path, after=500)  # the log goes on
    recorded.append(rows(spark, []), path)
    ids = seen(spark, path)
    assert sorted(ids.values()) == list(range(6, 18)) and set(ids) == set(range(12)) and {ids[10], ids[11]} == {16, 17}
    held = {r["id"]: (bytes(r["body"]), r["size"]) for r in recorded.read_recorded_bodies(spark, path).collect()}
    assert held == {i: (f"b{k}".encode(), len(f"b{k}")) for k, i in ids.items() if k % 3}


def test_long_parts_are_cut_into_files(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        writer = recorded.RevisionWriter(path, 0)
        batches = rows(spark, range(30), 1).toArrow().to_batches(max_chunksize=4)
        old, recorded.FILE_ROWS = recorded.FILE_ROWS, 10
        done = writer.write(iter(batches))
        recorded.FILE_ROWS = old
        assert sum(n for _, n in done.files) == 30 and max(n for _, n in done.files) <= 10
        assert seen(spark, path) == {}  # written, but not committed
        writer.commit([done, None])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(seen(spark, path).values()) == list(range(1, 31))


def test_failed_jobs_leave_nothing(spark, tmp_path):
    path = str(tmp_path / "p")
    recorded.append(rows(spark, range(4)), path)
    broken = rows(spark, range(100, 140), 4).withColumn("metadata", F.when(F.col("resource_id") == 139, F.raise_error(F.lit("lost"))).otherwise("{}"))
    with pytest.raises(Exception, match="lost"):
        recorded.append(broken, path)
    assert set(seen(spark, path)) == set(range(4)) and recorded.read_recorded_bodies(spark, path).count() == 2
    files = {f.name.lstrip("_").split("-")[0] for f in (tmp_path / "p/data").iterdir() if not f.name.endswith(".crc")}
    assert len(files) == 1  # what was written of the failed job is gone


def test_a_writer_killed_before_its_commit_is_not_seen(spark, tmp_path):
    path = str(tmp_path / "p")
    recorded.append(rows(spark, range(4)), path)
    recorded.RevisionWriter(path, 0).write(iter(rows(spark, range(50, 60), 1).toArrow().to_batches()))
    (tmp_path / "p/data/_0-half.rows").write_bytes(b"PAR1 half")
    assert set(seen(spark, path)) == set(range(4))
    assert recorded.vacuum(path, 0) == []
    assert len(recorded.vacuum(path, time.time() + 60)) == 3
    assert set(seen(spark, path)) == set(range(4)) and recorded.read_recorded_bodies(spark, path).count() == 2


def test_writers_at_once_take_different_ids(spark, tmp_path):
    path = str(tmp_path / "p")
    batches = {k: rows(spark, range(10 * k, 10 * k + 10), 1).toArrow().to_batches() for k in range(6)}
    writers = [recorded.RevisionWriter(path, 0) for _ in batches]
    done = [w.write(iter(batches[k])) for k, w in enumerate(writers)]
    threads = [threading.Thread(target=w.commit, args=([d],)) for w, d in zip(writers, done, strict=True)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    ids = seen(spark, path)
    assert set(ids) == set(range(60)) and sorted(ids.values()) == list(range(1, 61))
    assert len(list((tmp_path / "p/_log").glob("*.json"))) == 6 and not list((tmp_path / "p/_log").glob("*.json.*"))


def test_only_appends_of_the_schema(spark, tmp_path):
    recorded.append(rows(spark, range(2)), str(tmp_path / "p"))
    with pytest.raises(Exception, match="only ever appended"):
        rows(spark, range(2)).write.format("project_revisions").mode("overwrite").save(str(tmp_path / "p"))
    with pytest.raises(Exception, match="have the columns"):
        rows(spark, range(2)).drop("error").write.format("project_revisions").mode("append").save(str(tmp_path / "p"))


def test_projects_of_older_versions_open(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([(1, "http://x/")], "id long, url string").write.parquet(f"{folder}/resource")
    spark.createDataFrame([(1, "g", "http://x/#")], "id int, name string, url_pattern string").write.parquet(f"{folder}/resource_group")
    later = spark.createDataFrame([(2, "h", "http://y/#", 1, "more")], "id int, name string, url_pattern string, do_not_download int, other string")
    later.write.mode("append").parquet(f"{folder}/resource_group")
    spark.createDataFrame([(7, 1, "null", json.dumps({}))], "id long, resource_id long, error string, metadata string").write.parquet(f"{folder}/resource_revision")
    found = project.open_project(spark, folder)
    assert set(found) == set(project.TABLES) and found["alias"].count() == 0
    assert {r["id"]: (r["do_not_download"], r["source_type"]) for r in found["resource_group"].collect()} == {1: (False, None), 2: (True, None)}
    assert found["resource_revision"].first()["request_cookie"] is None and "other" not in found["resource_group"].columns
    schema = "resource_id long, request_cookie string, http_version int, status_code int, reason_phrase string, headers array<array<string>>, body binary, error struct<type:string,message:string>, fetched_at timestamp"
    project.record_revisions(spark, spark.createDataFrame([(1, "c", 11, 200, "OK", [], b"x", None, None)], schema), folder)
    assert sorted(r["id"] for r in project.open_project(spark, folder)["resource_revision"].collect()) == [7, 8]
