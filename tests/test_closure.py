"""Closures of group sources: chains, cycles and forests against a walk, and how many rounds a long chain takes."""

import random

from strataweb.operators import groups
from strataweb.sources import scratch

SCHEMA = "group_id long, source_type string, source_id long"


def walked(rows):
    up = {g: s for g, kind, s in rows if kind == "resource_group" and s != g and s is not None}
    found = set()
    for g in up:
        at, depth, seen = up[g], 1, {g}
        while at not in seen:
            found.add((g, at, depth))
            seen.add(at)
            if at not in up:
                break
            at, depth = up[at], depth + 1
    return found


def closure(spark, rows):
    return sorted(tuple(r) for r in groups.source_closure(spark.createDataFrame(rows, SCHEMA)).select("group_id", "ancestor_id", "depth").collect())


def test_closures_equal_a_walk(spark):
    r = random.Random(3)
    forest = [(k, "resource_group", r.randrange(k)) for k in range(1, 120)] + [(0, None, None)]
    cycle = [(200 + k, "resource_group", 200 + (k + 1) % 7) for k in range(7)] + [(300, "resource_group", 203), (301, "resource_group", 300)]
    odd = [(400, "resource_group", 400), (401, "root_resource", 1), (402, "resource_group", 999), (403, "resource_group", None)]
    for rows in (forest + cycle + odd + odd, odd, []):
        assert closure(spark, rows) == sorted(walked(rows))


def test_a_chain_of_a_thousand_takes_few_rounds(spark, monkeypatch):
    n, tables = 1000, []

    def counted(df, name):
        tables.append(name)
        return scratch.written(df, name)

    monkeypatch.setattr(groups, "written", counted)
    rows = [(k, "resource_group", k - 1) for k in range(1, n)]
    found = groups.source_closure(spark.createDataFrame(rows, SCHEMA))
    assert found.count() == n * (n - 1) // 2 and found.where("depth <> group_id - ancestor_id").isEmpty()
    assert len(tables) <= 2 + 3 * 12
