"""The pipeline's stages: what each does to its own input, and run() against brute force on a small corpus."""

import random
import re

import corpus_pipeline as pipeline
import pyarrow as pa
from pyspark.sql import functions as F

from strataweb.llm import common, mixing, near_dedup, quality, sharding
from strataweb.llm.common import materialise, table

SF = "/root/testdata/sf0.001"
rng = random.Random(77)
VOCABULARY = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(500)]


def test_stages_keep_columns_and_take_effect(spark):
    d = table(spark, SF, "documents")
    counts = [d.count()]
    for k, (name, stage) in enumerate(pipeline.STAGES):
        out = materialise(stage(spark, d, SF), f"test-{name}")
        if k < len(pipeline.STAGES) - 1:
            assert out.columns == d.columns
            assert out.exceptAll(d).count() == 0
        counts.append(out.count())
        d = out
    assert counts[0] > counts[1] > counts[2] > counts[3] == counts[4] == counts[5] > 0
    per_shard = [r["count"] for r in d.groupBy("shard").count().collect()]
    assert len(per_shard) == pipeline.SHARDS and max(per_shard) - min(per_shard) <= 1


def corpus():
    """Rows (doc_id, text, lang, source, n_chars, extra), labels and benchmark items."""
    r, rows = random.Random(3), []

    def prose(n):
        return " ".join(r.choice(VOCABULARY) for _ in range(n)) + "."

    leaked = " ".join(r.choice(VOCABULARY) for _ in range(14))
    for base in range(14):
        words = prose(130).split()
        for copy in range(1 + base % 4):
            edited = [r.choice(VOCABULARY) if copy and r.random() < 0.02 else w for w in words]
            rows.append(" ".join(edited))
    rows += [prose(90) for _ in range(30)]
    rows += [f"{prose(40)} {leaked.upper()}! {prose(40)}" for _ in range(4)]
    rows += ["#$ BUY!!! || <> $$$ NOW!! %% ## " * r.randint(3, 9) for _ in range(25)]
    rows += [rows[3], rows[3], None, ""]
    r.shuffle(rows)
    table_ = [(None if k == 5 else k // 2 * 2 if k in (10, 11) else k, t, "en", r.choice(["a", "b", "c", None]), None, "x") for k, t in enumerate(rows)]
    labels = [(k, int("$" not in (t or "$")), 0) for k, t, *_ in table_ if k is not None and k % 2 == 0]
    return table_, labels, [(1, leaked), (2, None), (3, "")]


def words(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").translate({k: k + 32 for k in range(65, 91)}))


def similar(bags, i, j):
    both = sum(min(w, bags[j].get(g, 0)) for g, w in bags[i].items())
    return both > 0 and both >= near_dedup.SIMILARITY * (sum(bags[i].values()) + sum(bags[j].values()) - both)


def test_run_equals_brute_force(spark, tmp_path):
    rows, labels, items = corpus()
    schema = "doc_id long, text string, lang string, source string, n_chars long, shard string"  # a clashing column too
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    found = pipeline.run(spark, str(tmp_path)).collect()

    # The classifier as given; all else from its output, by plain loops.
    d = table(spark, str(tmp_path), "documents")
    model = quality.fit(d, table(spark, str(tmp_path), "labels"), trainable=~quality.held_out(F.col("doc_id")))
    good = [(r["doc_id"], r["text"], r["source"]) for r in quality.score(d, model).where("predicted = 1").collect()]
    assert len(rows) - 45 < len(good) < len(rows) - 15
    idf = near_dedup.idf_of_texts([t for _, t, _ in good])
    texts = sorted({t or "" for _, t, _ in good})
    bags = []
    for t in texts:
        _, grams, weight = near_dedup.shingles(pa.array([t]), idf)
        bags.append(dict(zip(grams.tolist(), weight.tolist(), strict=True)))
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if similar(bags, i, j):
                label = [label[j] if x == label[i] else x for x in label]
    classes = {}
    for k, t, s in good:
        classes.setdefault(label[texts.index(t or "")], []).append((k is not None, k or 0, t, s))
    kept = [min(c, key=lambda x: x[:2]) for c in classes.values()]
    clean = []
    windows = {tuple(w[k : k + 10]) for _, t in items for w in [words(t)] if w for k in range(max(len(w) - 9, 1))}
    for has, k, t, s in kept:
        w = words(t)
        if not any(tuple(w[a : a + n]) in windows for n in {len(x) for x in windows} for a in range(len(w) - n + 1)):
            clean.append((k if has else None, t, s))
    assert len(clean) < len(kept) < len(good)
    assert sorted(((r["doc_id"], r["text"], r["source"]) for r in found), key=str) == sorted(clean, key=str)
    # Shards: counts at most one apart, slots gapless, in the order of the curve.
    n = len(clean)
    order = sorted(found, key=lambda r: (r["shard"], r["slot"]))
    assert [r["shard"] for r in order] == [i * pipeline.SHARDS // n for i in range(n)]
    assert [r["slot"] for r in order] == [i - -(-(i * pipeline.SHARDS // n) * n // pipeline.SHARDS) for i in range(n)]
    assert [r["curve"] for r in order] == sorted(r["curve"] for r in found)
    # Mixing loses nothing and follows its weights: the stage before sharding, in file order.
    mixed = mixing.in_mixed_order(spark.createDataFrame([(k, t, "en", s, None) for k, t, s in clean], "doc_id long, text string, lang string, source string, n_chars long"))
    assert sorted((r["text"] or "" for r in mixed.collect())) == sorted(t or "" for _, t, _ in clean)
    assert sharding.BITS


def test_run_on_empty_tables(spark, tmp_path):
    rows, labels, items = corpus()
    schema = "doc_id long, text string, lang string, source string, n_chars long, extra string"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_temporary_tables_go(spark, tmp_path):
    import os

    home = common._home(spark).removeprefix("file://")
    before = set(os.listdir(home)) if os.path.exists(home) else set()
    with common.temporary(spark):
        gone = materialise(spark.range(3), "gone")
        with common.temporary(spark):
            materialise(spark.range(3), "inner")
            kept = materialise(gone, "kept", keep=True)
        assert kept.count() == 3
        names = {n.split("-")[0] for n in set(os.listdir(home)) - before}
        assert names == {"gone", "kept"}
    assert set(os.listdir(home)) == before


def test_the_mixed_order_reaches_the_shards(spark):
    d = table(spark, SF, "documents")
    wanted = {(r["doc_id"], r["text"]): r["position"] for r in mixing.mix(d).collect()}
    found = pipeline.cut_shards(spark, materialise(pipeline.mix_sources(spark, d, SF), "test-mixed"), SF).collect()
    assert {(r["doc_id"], r["text"]): r["mix_position"] for r in found} == wanted and len(found) == len(wanted)
    rank = [(r["curve"], r["mix_position"]) for r in sorted(found, key=lambda r: (r["shard"], r["slot"]))]
    assert rank == sorted(rank)
