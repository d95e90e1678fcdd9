"""Filters reach packs and databases: what is read, and that answers stay those of a full read."""

import os
import sqlite3

from pyspark.sql import functions as F

from strataweb.sources import bodies, packs, project
from strataweb.sources.recorded import place

IDS = [0, 3, 15, 16, 40, 255, 256, 4095, 4096, 70_000, (7 << 36) + 5]


def written(spark, path):
    rows = [(k, f"body {k} ".encode() * 200) for k in IDS]
    bodies.write_packs(spark.createDataFrame(rows, "id long, body binary"), path).collect()
    return dict(rows)


def test_filters_give_what_a_full_read_gives(spark, tmp_path):
    path = str(tmp_path)
    held = written(spark, path)
    whole = bodies.read_packs(spark, path)
    assert {r["id"]: bytes(r["body"]) for r in whole.collect()} == held
    for condition in ("id = 40", "id in (3, 4096, 5)", "id > 255", "id >= 255 and id < 4096", "id <= 15", "id = 1", "id in (16, 40) and id > 16", "id is null", "id > 15 and size < 0", "id <> 3", "id > 5 and id < 5", "40 = id"):
        kept = {r["id"] for r in spark.createDataFrame([(k, len(b)) for k, b in held.items()], "id long, size long").where(condition).collect()}
        assert {r["id"]: (bytes(r["body"]), r["size"]) for r in whole.where(condition).collect()} == {k: (held[k], len(held[k])) for k in kept}, condition
    assert sorted(r["id"] for r in bodies.pack_entries(spark, path).collect()) == IDS
    plan = whole.where("id = 40")._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan.replace("isnotnull(id", "") or "id#" in plan


def test_only_what_is_asked_for_is_planned_and_read(spark, tmp_path):
    path = str(tmp_path)
    held = written(spark, path)

    def planned(*filters):
        reader = packs.PackReader({"path": path})
        assert list(reader.pushFilters(list(filters))) == []
        return [f for p in reader.partitions() for f in p.firsts]

    id_ = ("id",)
    assert planned(packs.EqualTo(id_, 40)) == [32]
    assert planned(packs.In(id_, (40, 41, 70_000, None))) == [32, 70_000 // 16 * 16]
    assert planned(packs.EqualTo(id_, 40), packs.EqualTo(id_, 41)) == []
    low, high = 4096, 8192
    assert set(planned(packs.GreaterThanOrEqual(id_, low), packs.LessThan(id_, high))) == set(range(low, high, 16))
    assert len(planned()) == 4 * 256  # the packs of four folders, there or not

    store, root = place(path)
    file = packs.open_pack(store, f"{root}/revisions/{packs.pack_name(0)}")
    wanted = packs.IdRange()
    wanted.push(packs.EqualTo(id_, 3))
    assert [(i, b) for i, _, b in packs.entries(0, file, wanted)] == [(3, held[3])] and file.reads == 2
    file = packs.open_pack(store, f"{root}/revisions/{packs.pack_name(0)}")
    assert len(list(packs.entries(0, file, packs.IdRange()))) == 3 and file.reads == 4


def test_packs_moved_aside_are_read(spark, tmp_path):
    path = str(tmp_path)
    held = written(spark, path)
    name = tmp_path / "revisions" / packs.pack_name(256)
    os.rename(name, f"{name}{packs.ASIDE}")
    other = tmp_path / "revisions" / packs.pack_name(0)
    (other.parent / (other.name + packs.ASIDE)).write_bytes(b"an older one")
    assert {r["id"]: bytes(r["body"]) for r in bodies.read_packs(spark, path).collect()} == held


def test_large_directories_are_read_too(spark, tmp_path):
    import zipfile

    folder = tmp_path / "revisions/000/000/000/000"
    folder.mkdir(parents=True)
    with zipfile.ZipFile(folder / "00_.zip", "w", zipfile.ZIP_DEFLATED) as archive:
        archive.comment = b"c" * 5000
        for k in range(16):
            archive.writestr(zipfile.ZipInfo(f"{k:03x}"), b"x" * k)
    assert {r["id"]: r["size"] for r in bodies.read_packs(spark, str(tmp_path)).collect()} == {k: k for k in range(16)}


def test_empty_projects(spark, tmp_path):
    assert bodies.read_packs(spark, str(tmp_path)).count() == 0
    assert bodies.read_packs(spark, str(tmp_path)).where("id = 3").count() == 0


def test_filters_reach_the_database(spark, tmp_path):
    path = str(tmp_path / "database.sqlite")
    with sqlite3.connect(path) as db:
        db.execute("create table resource (id integer primary key, url text unique not null)")
        db.executemany("insert into resource values (?, ?)", [(k, f"http://x/{k}'") for k in range(-3, 101)])
        db.execute("create table resource_group (id integer primary key, name text, url_pattern text)")
        db.execute("insert into resource_group values (1, 'g', 'http://x/#')")
    db.close()
    whole = project.read_sqlite(spark, path, "resource", 4)
    known = spark.createDataFrame([(k, f"http://x/{k}'") for k in range(-3, 101)], "id long, url string")
    for condition in ("id = 7", "id in (1, 99, 500)", "id > 90", "id < 0", "url = \"http://x/5'\"", "url in (\"http://x/5'\", \"http://x/6'\", 'no')", "id = 5 and url = 'no'", "id > 3 and id <= 3", "url like '%/1%' and id < 20", "id = 1000", "url is null"):
        assert sorted(map(tuple, whole.where(condition).collect())) == sorted(map(tuple, known.where(condition).collect())), condition
    groups = project.read_sqlite(spark, path, "resource_group")
    assert groups.where("name = 'g'").count() == 1 and groups.where("source_type = 'x'").count() == 0
    many = [str(k) for k in range(200)]
    assert whole.where(F.col("id").isin([int(k) for k in many])).count() == 101 and whole.where(F.col("url").isin([f"http://x/{k}'" for k in many])).count() == 101

    reader = project.SqliteReader({"path": path, "table": "resource"}, ["id", "url"])
    assert list(reader.pushFilters([packs.EqualTo(("id",), 7), packs.EqualTo(("url",), "u")])) == []
    assert [(p.low, p.high) for p in reader.partitions()] == [(7, 8)] and list(reader.read(reader.partitions()[0])) == []


def test_a_stopped_migration_goes_on(spark, tmp_path):
    folder = tmp_path / "flat/revisions"
    folder.mkdir(parents=True)
    for k in [*range(5, 40), 200, 201]:
        (folder / str(k)).write_bytes(b"body %d" % k)
    out = str(tmp_path / "packed")
    first = {r["path"]: r["n"] for r in bodies.migrate(spark, str(tmp_path / "flat"), out, hierarchical=False).collect()}
    assert sorted(first.values()) == [2, 8, 11, 16]
    assert bodies.migrate(spark, str(tmp_path / "flat"), out, hierarchical=False).count() == 0
    # As if it had been stopped: one pack is not there, another lacks an entry that came later.
    (tmp_path / "packed/revisions" / packs.pack_name(16)).unlink()
    (folder / "202").write_bytes(b"body 202")
    (folder / "200").unlink()  # packed before, and deleted here
    kept = (tmp_path / "packed/revisions" / packs.pack_name(0)).stat().st_mtime_ns
    again = {r["path"]: r["n"] for r in bodies.migrate(spark, str(tmp_path / "flat"), out, hierarchical=False).collect()}
    assert again == {packs.pack_name(16): 16, packs.pack_name(192): 3}
    assert (tmp_path / "packed/revisions" / packs.pack_name(0)).stat().st_mtime_ns == kept
    assert {r["id"]: bytes(r["body"]) for r in bodies.read_packs(spark, out).collect()} == {k: b"body %d" % k for k in [*range(5, 40), 200, 201, 202]}


def test_missing_packs_are_rebuilt_from_loose_files(spark, tmp_path):
    path = str(tmp_path)
    bodies.write_packs(spark.createDataFrame([(k, b"x%d" % k) for k in range(16)], "id long, body binary"), path).collect()
    for k in (17, 18, 31, 40, 64):
        place = tmp_path / f"revisions/000/000/000/000/{k:03x}"
        place.write_bytes(b"x%d" % k)
    revisions = spark.range(70).where("id <> 79")
    ids = bodies.missing_packs(revisions, bodies.read_loose(spark, path).select("id"), bodies.pack_entries(spark, path))
    assert sorted(map(tuple, ids.collect())) == [(1, 3), (2, 1)]  # that of 64 is not due yet
    assert sorted(r["n"] for r in bodies.rebuild_packs(spark, path, revisions).collect()) == [1, 3]
    assert {r["id"] for r in bodies.read_packs(spark, path).collect()} == {*range(16), 17, 18, 31, 40}
    assert bodies.rebuild_packs(spark, path, revisions).count() == 0
