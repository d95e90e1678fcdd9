"""Crawls from a table of seeds and from a stream of them, with seeds that come late."""

import pytest

from strataweb.operators import crawl, groups
from strataweb.sources import scratch

EDGES = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "bad/1"), ("x", "c"), ("x", "y"), ("y", "x"), ("z", None), ("a", "a")]
BANNED = [groups.Group(1, "bad", "bad/**", do_not_download=True)]


def test_frontiers(spark):
    links, seeds = spark.createDataFrame(EDGES, "url string, target_url string"), spark.createDataFrame([("a",), ("a",), ("q",)], "url string")
    found = {r["url"]: r["depth"] for r in crawl.frontier(seeds, links, groups=BANNED).collect()}
    assert found == {"a": 0, "q": 0, "b": 1, "c": 2, "d": 3}
    assert {r["url"] for r in crawl.frontier(seeds, links, 1).collect()} == {"a", "q", "b"}


def test_a_standing_crawl_takes_late_seeds_and_resumes(spark, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    links = spark.createDataFrame(EDGES, "url string, target_url string")

    def run(urls):
        spark.createDataFrame([(u,) for u in urls], "url string").coalesce(1).write.mode("append").parquet(source)
        crawl.standing(spark.readStream.schema("url string").parquet(source), links, out, state, BANNED)
        rows = crawl.visited(spark, out).collect()
        assert len(rows) == len({r["url"] for r in rows})  # nothing is visited twice
        return {r["url"]: (r["epoch"], r["depth"]) for r in rows}

    first = run(["b", "b", None])
    assert first == {"b": (0, 0), "c": (0, 1), "a": (0, 2), "d": (0, 2)}
    assert run(["x", "a"]) == first | {"x": (1, 0), "y": (1, 1)}
    assert run(["d"]) == first | {"x": (1, 0), "y": (1, 1)}


def test_an_epoch_that_runs_again_replaces_its_folder(spark, tmp_path, monkeypatch):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    links = spark.createDataFrame(EDGES, "url string, target_url string")
    spark.createDataFrame([("a",)], "url string").write.parquet(source)
    stream = lambda: spark.readStream.schema("url string").parquet(source)
    walk = crawl._walk

    def stopped(*args, **kwargs):
        walk(*args, **kwargs, max_depth=1)
        raise RuntimeError("stopped")

    monkeypatch.setattr(crawl, "_walk", stopped)
    with pytest.raises(Exception, match="stopped"):
        crawl.standing(stream(), links, out, state)
    assert len(scratch.folders(spark, f"{out}/epoch=0")) == 2
    monkeypatch.setattr(crawl, "_walk", walk)
    crawl.standing(stream(), links, out, state)
    assert {r["url"]: r["depth"] for r in crawl.visited(spark, out).collect()} == {"a": 0, "b": 1, "c": 2, "d": 3, "bad/1": 4}


def test_a_standing_crawl_without_seeds_has_visited_nothing(spark, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    spark.createDataFrame([], "url string").write.parquet(source)
    crawl.standing(spark.readStream.schema("url string").parquet(source), spark.createDataFrame(EDGES, "url string, target_url string"), out, state)
    assert crawl.visited(spark, out).collect() == []


def test_rounds_send_no_tables_to_the_driver(spark):
    steps, urls = spark.createDataFrame(EDGES, "url string, target_url string"), spark.createDataFrame([("a",)], "url string")
    fresh = crawl._unseen(urls, steps, urls)
    assert [r["url"] for r in fresh.collect()] == ["b"]
    assert "Broadcast" not in fresh._jdf.queryExecution().executedPlan().toString()
