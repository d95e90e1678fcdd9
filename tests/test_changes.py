"""Streams with keyed state give what the batch answer gives, restarts included."""

import random

import pytest
from pyspark.sql import functions as F

from strataweb.operators import groups
from strataweb.operators import resources as resources_
from strataweb.streaming import changes, membership

OWN = [groups.Group(1, "all", "http://x/**"), groups.Group(2, "numbers", "http://*/#")]


def append(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_changes_fold_to_the_members_after_restarts(spark, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    schema, r = "seq long, id long, url string, deleted boolean", random.Random(5)
    urls, known, seq = ["http://x/a", "http://x/7", "http://y/8", "http://y/b", None], {}, 0
    for _ in range(3):
        rows = []
        for _ in range(40):
            seq += 1
            rows.append((seq, r.randrange(15), r.choice(urls), r.random() < 0.2))
        late = (rows[3][0] - 1000, rows[3][1], "http://x/late", False)
        for s, i, u, d in rows:
            known[i] = (s, None if d else u)
        append(spark, [*rows, late, (seq, None, "http://x/a", False), (None, 3, "http://x/a", False)], schema, source)
        stream = changes.member_changes(membership.resource_stream(spark, source, schema), OWN)
        membership.run_available(stream, out, state)  # a new query each time, from the checkpoint
        emitted = spark.read.schema(changes.CHANGES).parquet(out)
        found = sorted(map(tuple, changes.members_of(emitted).collect()))
        table = spark.createDataFrame([(i, u) for i, (_, u) in known.items()], "id long, url string")
        assert found == sorted(map(tuple, groups.membership(table, OWN).collect())) and found
    assert emitted.where("change = 'removed'").count() > 5
    assert emitted.groupBy("id", "group_id", "url").agg(F.sum(F.when(F.col("change") == "added", 1).otherwise(-1)).alias("n")).where("n < 0 or n > 1").isEmpty()


def test_rates_of_a_stream_equal_those_of_the_table(spark, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    schema, rows = "task_id string, seconds double, done long, total long", []
    r = random.Random(9)
    for part in range(2):
        fresh = [(t, 100.0 * part + 10 * k + r.random(), 5 * (10 * part + k) + r.randrange(3), 200 + 3 * k) for t in ("a", "b") for k in range(6)]
        rows += fresh
        append(spark, fresh, schema, source)
        membership.run_available(changes.rates(membership.resource_stream(spark, source, schema), 30.0), out, state)
    found = {(x["task_id"], x["seconds"]): x for x in spark.read.schema(changes.RATES).parquet(out).collect()}
    wanted = resources_.rates(spark.createDataFrame(rows, schema), 30.0).collect()
    assert len(found) == len(wanted) == 24
    for x in wanted:
        got = found[x["task_id"], x["seconds"]]
        assert not got["stalled"] and got["rate"] == (None if x["rate"] is None else pytest.approx(x["rate"])) and got["eta_seconds"] == (None if x["eta_seconds"] is None else pytest.approx(x["eta_seconds"]))


def test_quiet_tasks_are_told_of(spark, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    schema = "task_id string, seconds double, done long, total long"
    for rows in ([("a", 1000.0, 0, 9), ("b", 1000.0, 0, 9), ("c", 1000.0, 9, 9)], [("b", 1020.0, 5, 9)], [("b", 1100.0, 6, 9)]):
        append(spark, rows, schema, source)
        membership.run_available(changes.rates(membership.resource_stream(spark, source, schema), 30.0, quiet=50.0), out, state)
    found = spark.read.schema(changes.RATES).parquet(out)
    # c is done, and b's sample came before its timer had run out.
    assert [(x["task_id"], x["seconds"], x["rate"]) for x in found.where("stalled").collect()] == [("a", 1050.0, 0.0)]
    assert found.where("not stalled").count() == 5
