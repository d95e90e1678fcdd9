"""Linking within buckets, near-duplicate classes and line components against brute force, on groups with many variants of one text."""

import os
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strataweb.llm import common, line_dedup, linking, near_dedup

rng = random.Random(21)
VOCABULARY = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(300)]


def variants(n, words=60, most=0.1, seed=0, bases=1):
    """Copies of a base text, each with more or fewer of its words changed."""
    r = random.Random(seed)
    texts = []
    for _ in range(bases):
        base = [r.choice(VOCABULARY) for _ in range(words)]
        texts += [" ".join(r.choice(VOCABULARY) if r.random() < most * k / n else w for w in base) for k in range(n)]
    return texts


def classes(n, pairs):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    return [root(x) for x in range(n)]


def similar_pairs(bags, threshold):
    sizes = [sum(b.values()) for b in bags]
    for i, one in enumerate(bags):
        for j in range(i):
            both = sum(min(w, bags[j].get(g, 0)) for g, w in one.items())
            if both >= threshold * (sizes[i] + sizes[j] - both) and both:
                yield j, i


def char_shingles(line):
    return Counter({line[k : k + line_dedup.SHINGLE]: 1 for k in range(len(line) - line_dedup.SHINGLE + 1)})


@pytest.mark.parametrize("chunk", [9000, 1 << 20])
def test_one_bucket_of_variants_equals_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(linking, "CHUNK_BYTES", chunk)
    texts = list(dict.fromkeys(variants(90, words=24, most=0.3, bases=3) + variants(30, words=12, most=0.3, seed=4)))
    nodes = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    # Every text in one bucket, and some in others: no sampling is left.
    members = spark.createDataFrame([(0, k) for k in range(len(texts))] + [(1 + k % 7, k) for k in range(0, len(texts), 3)], "band long, node long")
    found = {r["node"]: r["label"] for r in linking.link(members, lambda wanted: nodes.join(wanted, "node"), line_dedup.shingles, 0.8, "test").collect()}
    wanted = classes(len(texts), similar_pairs([char_shingles(t) for t in texts], 0.8))
    assert [found.get(k, k) for k in range(len(texts))] == wanted
    assert 10 < len(set(wanted)) < len(texts) - 20


def test_joining_edges_are_links_and_join_what_links_join(spark):
    texts = variants(120, words=120, most=0.3)
    one = pa.array([texts[0]] * len(texts))
    names = ["similarity", "weight", "lacks", "extra", "deltas"]
    found = dict(zip(names, (c.to_pylist() for c in linking.overlaps(one, pa.array(texts), line_dedup.shingles, deltas=True)), strict=True))
    rows = [(0, k, k, w, o, d, w + o - e) for k, (w, o, e, d) in enumerate(zip(*(found[c] for c in names[1:]), strict=True))]
    rows = spark.createDataFrame(rows, "centre long, node long, label long, weight double, lacks double, deltas binary, whole double")
    edges = [(r["a"], r["b"]) for r in linking.joining_edges(rows, 0.8).collect()]
    links = list(similar_pairs([char_shingles(t) for t in texts], 0.8))
    assert set(edges) <= set(links) and classes(120, edges) == classes(120, links)
    assert len(edges) < 120 * 2 and len(links) > 120


def test_repeated_shingles_count_the_lesser_number_of_times():
    texts = ["a b c d e a b c d e a b c d e", "a b c d e a b c d e x", "a b c d e", "z"]
    idf = near_dedup.idf_of_texts(texts)
    one, two = (pa.array(x) for x in zip(*[(a, b) for a in texts for b in texts], strict=True))
    found = linking.overlaps(one, two, lambda t: near_dedup.occurrences(t, idf))[0].to_pylist()
    bags = []
    for t in texts:
        _, grams, weight = near_dedup.shingles(pa.array([t]), idf)
        bags.append(dict(zip(grams.tolist(), weight.tolist(), strict=True)))
    shared = [[sum(min(w, b.get(g, 0)) for g, w in a.items()) for b in bags] for a in bags]
    wanted = [shared[i][j] / (sum(a.values()) + sum(b.values()) - shared[i][j]) for i, a in enumerate(bags) for j, b in enumerate(bags)]
    assert found == pytest.approx(wanted, abs=1e-5)


def test_overlaps_are_exact():
    texts = ["the quick brown fox jumps over", "the quick brown cat jumps over it", "", "short", None]
    one, two = (pa.array(x) for x in zip(*[(a, b) for a in texts for b in texts], strict=True))
    found = linking.overlaps(one, two, line_dedup.shingles)[0].to_pylist()
    bags = [char_shingles(t or "") for t in texts]
    wanted = [len(a & b) / max(len(a | b), 1) for a in bags for b in bags]
    assert found == pytest.approx(wanted)


def test_line_components_equal_brute_force(spark):
    """Recall of links, measured: a large group of variants of one line, small groups and single lines."""
    texts = list(dict.fromkeys(variants(150, words=25, most=0.25, seed=1) + variants(3, words=25, most=0.1, seed=2, bases=25) + variants(1, words=25, seed=3, bases=40)))
    rows = [(k, f"{t}\n") for k, t in enumerate(texts)]
    pairs = list(similar_pairs([char_shingles(t) for t in texts], line_dedup.SIMILARITY))
    wanted = classes(len(texts), pairs)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    removed = {r["doc_id"]: [(s["start"], s["end"], s["first_doc_id"]) for s in r["removed"]] for r in line_dedup.report(docs).collect()}
    first = {k: removed[k][0][2] if removed[k] else k for k in removed}
    assert np.mean([first[k] == wanted[k] for k in range(len(texts))]) >= 0.97
    assert np.mean([first[a] == first[b] for a, b in pairs]) >= 0.98
    assert all((s, e) == (0, len(texts[k]) + 1) for k, v in removed.items() for s, e, _ in v)
    assert all(wanted[k] == wanted[first[k]] for k in removed)  # nothing is joined that should not be


def test_near_duplicate_classes_equal_brute_force_in_a_large_group(spark):
    texts = list(dict.fromkeys(variants(200, words=150, most=0.12, seed=5) + variants(4, words=150, most=0.05, seed=6, bases=15)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(docs).collect()}
    idf = near_dedup.idf_of_texts(texts)
    bags = []
    for t in texts:
        _, grams, weight = near_dedup.shingles(pa.array([t]), idf)
        bags.append(dict(zip(grams.tolist(), weight.tolist(), strict=True)))
    pairs = list(similar_pairs(bags, near_dedup.SIMILARITY))
    wanted = classes(len(texts), pairs)
    assert len(set(wanted)) > 40
    assert np.mean([found[a] == found[b] for a, b in pairs]) >= 0.98
    assert np.mean([found[k] == wanted[k] for k in range(len(texts))]) >= 0.97
    assert all(wanted[k] == wanted[found[k]] for k in found)


def test_one_large_group_is_dealt_out_by_cells(spark, monkeypatch):
    """20,000 nodes of one group, no two of them linked: every pair of chunks meets once, spread over all tasks."""
    monkeypatch.setattr(linking, "CHUNK_BYTES", 12 * 500)
    n, tasks = 20_000, 32
    # One difference each, so that chunks are many and small.
    rows = spark.range(n).selectExpr("0L as centre", "id as node", "id as label", "10.0D as weight", "1.0D as lacks", "cast(repeat('x', 12) as binary) as deltas", "10.0D as whole")
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.coalescePartitions.enabled")}
    for k, v in zip(before, (tasks, -1, "false"), strict=True):
        spark.conf.set(k, v)
    try:
        met = linking.chunk_pairs(rows, 0.8).select(F.size("p").alias("p"), F.size("q").alias("q"), F.spark_partition_id().alias("task"))
        found = met.groupBy("task").agg(F.count(F.lit(1)).alias("pairs"), F.sum(F.col("p") * F.col("q")).alias("products")).collect()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    chunks = -(-(12 * n + 1) // (12 * 500))
    assert sum(r["products"] for r in found) == n * (n - 1)  # all but the one of the main label ask all
    assert (chunks - 1) * chunks <= sum(r["pairs"] for r in found) <= chunks * chunks
    assert max(r["pairs"] for r in found) <= 4 * chunks * chunks / tasks


def test_cells_give_the_same_whatever_their_size(spark, monkeypatch):
    texts = variants(60, words=80, most=0.3, seed=8)
    found = linking.overlaps(pa.array([texts[0]] * len(texts)), pa.array(texts), line_dedup.shingles, deltas=True)
    rows = [(0, k, k, w, o, d, w + o - e) for k, (w, o, e, d) in enumerate(zip(*(c.to_pylist() for c in found[1:]), strict=True))]
    rows = spark.createDataFrame(rows, "centre long, node long, label long, weight double, lacks double, deltas binary, whole double")
    links = classes(60, similar_pairs([char_shingles(t) for t in texts], 0.8))
    for chunk, side in ((2000, 1), (2000, 3), (1 << 20, 4)):
        monkeypatch.setattr(linking, "CHUNK_BYTES", chunk)
        monkeypatch.setattr(linking, "SIDE", side)
        assert classes(60, [(r["a"], r["b"]) for r in linking.joining_edges(rows, 0.8).collect()]) == links


def test_large_groups_are_matched_in_passes(spark, monkeypatch):
    """Cells grow with the square of a group, what one pass sends does not; all passes together find what one finds."""
    texts = variants(60, words=80, most=0.3, seed=8)
    found = linking.overlaps(pa.array([texts[0]] * len(texts)), pa.array(texts), line_dedup.shingles, deltas=True)
    rows = [(0, k, k, w, o, d, w + o - e) for k, (w, o, e, d) in enumerate(zip(*(c.to_pylist() for c in found[1:]), strict=True))]
    rows = spark.createDataFrame(rows, "centre long, node long, label long, weight double, lacks double, deltas binary, whole double")
    assert linking.passes(linking.place(rows, 0.8)) == 1
    monkeypatch.setattr(linking, "CHUNK_BYTES", 12000)
    monkeypatch.setattr(linking, "SIDE", 1)
    placed = linking.place(rows, 0.8)
    n = linking.passes(placed)
    met = [linking.met_chunks(placed, k, n).count() for k in range(n)]
    assert n > 2 and sum(met) == linking.chunk_pairs(rows, 0.8).count() and max(met) < sum(met) / 2
    links = classes(60, similar_pairs([char_shingles(t) for t in texts], 0.8))
    assert classes(60, [(r["a"], r["b"]) for r in linking.joining_edges(rows, 0.8).collect()]) == links


def test_members_in_parts_gather_the_same(spark):
    rows = spark.range(300).selectExpr("id % 97 as node", "array(id % 7, 100 + id % 50, 200 + id % 97) as bands")
    whole = linking.gather(rows.select("node", F.explode("bands").alias("band")), "test")
    parts = linking.gather([rows.select("node", F.explode(F.slice("bands", k, 1)).alias("band")) for k in (1, 2, 3)], "test")
    for one, two in zip(whole, parts, strict=True):
        assert sorted(map(tuple, one.collect())) == sorted(tuple(r) for r in two.select(one.columns).collect())


def test_repeated_rows_do_not_crowd_a_band(spark):
    rows = [(1, 5), (1, 5), (1, 5), (1, 9), (2, 1), (2, 3), (2, 2), (2, 3), (3, 7), (3, 7), (-4, -1), (-4, 1)]
    buckets, crowded = linking.gather(spark.createDataFrame(rows, "band long, node long").repartition(3), "test")
    assert sorted(map(tuple, buckets.select("band", "a", "b", "n").collect())) == [(-4, -1, 1, 2), (1, 5, 9, 2), (2, 1, 3, 3)]
    assert sorted(map(tuple, crowded.select("band", "node").collect())) == [(2, 1), (2, 2), (2, 3)]


def test_members_are_shuffled_as_arrays(spark):
    members = spark.range(0, 30000, 1, 3).selectExpr("id div 2 as node", "xxhash64(id) as band0", "xxhash64(id div 6) as band1", "7L as band2")
    rows = linking.packed(members, 5)
    assert rows.count() <= 3 * 5 and rows.selectExpr("sum(size(band))").first()[0] < 50000
    flat = members.select("node", F.explode(F.array("band0", "band1", "band2")).alias("band")).groupBy("band")
    expected = flat.agg(F.min("node").alias("a"), F.max("node").alias("b"), F.least(F.countDistinct("node"), F.lit(3)).alias("n")).where("n > 1")
    assert sorted(map(tuple, linking.meetings(members).collect())) == sorted(map(tuple, expected.collect()))


def test_a_written_table_leaves_no_shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {f for f in files.getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}
    before, key = shuffles(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    kept = spark.conf.get(key)
    table = common.materialise(spark.range(2000).groupBy((F.col("id") % 50).alias("k")).count(), "test")
    assert not shuffles() - before and table.count() == 50 and spark.conf.get(key) == kept


def test_bands_of_lines_go_when_they_are_gathered(spark, monkeypatch):
    home, seen, real = common._home(spark).removeprefix("file://"), [], line_dedup.link_gathered
    before = set(os.listdir(home)) if os.path.isdir(home) else set()

    def watch(*args):
        seen.extend(f.rsplit("-", 1)[0] for f in set(os.listdir(home)) - before)
        return real(*args)

    monkeypatch.setattr(line_dedup, "link_gathered", watch)
    docs = spark.createDataFrame(list(enumerate(variants(20, seed=3))), "doc_id long, text string")
    assert line_dedup.report(docs).count() == docs.count()
    assert "line-signed" not in seen and seen.count("line-places") == 1


def test_a_line_is_the_same_whatever_text_follows():
    line = "a line that ends its text with a full stop."
    alone = line_dedup.Lines(pa.array([line]), 20).node.tolist()
    for after in ("word", ". word", "", None):
        assert line_dedup.Lines(pa.array(["", line, after, "word"]), 20).node.tolist() == alone
