"""Tokens against the tokenizers library, clusters and whitening against brute force, and all three on odd rows."""

import hashlib
import random

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from strataweb.llm import bpe, clustering, queries, whitening

ODD_TEXTS = [
    None, "", " ", "\n\n  \n", "a", "<|endoftext|>", "x<|endoftext|><|endoftext|> y", "<|endoftext", "don't DON'T we'll 'tis", "12345 ²³½ Ⅷ", "é ü ß İ ﬁ", "中文字符 かな 한국어", "😀👩‍👩‍👧",
    "tab\tand\x0bfeeds\r\n\x1c\x85\xa0 　end", "՘꟎\U00010ec5 newly assigned", "\x00\x01￿", "a" * 5000, "ab" * 300, "中" * 2000, "q" * 257 + " " + "z" * 256, " " * 1000 + "x",
]
nan, inf = float("nan"), float("inf")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.TOKENIZER)


@pytest.fixture(scope="module")
def texts(spark):
    r = random.Random(4)
    pieces = ["a", "e", "'", "s", "'re", " ", "  ", "\n", "1", "²", "é", "中", "!", "#", "<|endoftext|>", "😀", "՘", "​", "\xa0", "\x85", "\x1c", "　", "'ll", "—", "word", " the"]
    return ODD_TEXTS + ["".join(r.choice(pieces) for _ in range(r.randint(1, 40))) for _ in range(1500)]


def test_tokens_equal_the_library(spark, library, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    ids = {i: library.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}
    found = bpe.encode(docs, keep=["doc_id"], decoded=True).collect()
    assert {r["doc_id"]: r["ids"] for r in found} == ids
    assert all(r["n_tokens"] == len(r["ids"]) for r in found)
    assert {r["doc_id"]: r["decoded"] for r in found} == {i: library.decode(x, skip_special_tokens=False) for i, x in ids.items()}


def test_packed_ids_are_the_same_and_decode(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts[:200])), "doc_id long, text string")
    packed = bpe.encode(docs, packed=True)
    plain = {r["doc_id"]: r["ids"] for r in bpe.encode(docs).collect()}
    assert {r["doc_id"]: np.frombuffer(r["ids"], dtype="<u4").tolist() for r in packed.collect()} == plain
    for rows in (packed, bpe.encode(docs)):
        assert all(r["decoded"] == (r["text"] or "") for r in bpe.decode(rows).collect())


def test_any_ids_decode_as_in_the_library(spark, library):
    r = random.Random(8)
    ids = [[r.randrange(50_300) for _ in range(r.randint(0, 30))] for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(ids)) + [(-1, None)], "doc_id long, ids array<int>")
    found = {r["doc_id"]: r["decoded"] for r in bpe.decode(rows).collect()}
    assert found.pop(-1) == ""
    assert found == {i: library.decode(x, skip_special_tokens=False) for i, x in enumerate(ids)}


def test_scans_and_heap_cut_alike():
    model, r = bpe.tokenizer(), random.Random(3)
    for _ in range(300):
        word = bytes(r.choice(b"abcdeiorst \xc3\xa9\x00\xff") for _ in range(r.randint(1, 120)))
        assert bpe.merged(word, model.singles, model.pairs) == bpe.merged_long(word, model.singles, model.pairs)


def test_settled_blocks_split_as_in_the_library(library):
    split = library.pre_tokenizer.pre_tokenize_str
    settled = regex.compile(f"[{bpe._SETTLED}]")
    for c in settled.findall("".join(map(chr, range(0x20000)))[:0xD800] + "".join(map(chr, range(0xE000, 0x10000)))):
        text = f"a{c}a1{c}1!{c}!"
        assert next(bpe.tokenizer().split(text)) == [text[a:b] for _, (a, b) in split(text)], hex(ord(c))


def test_full_caches_are_emptied(monkeypatch, library):
    monkeypatch.setattr(bpe, "_CACHED", 3)
    monkeypatch.setattr(bpe, "_WORDS", 5)
    model, text = bpe.ByteBpe(bpe.TOKENIZER), "one two three four five six seven\n\n eight nine ten"
    assert model.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids and len(model) <= 3


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        bpe.ByteBpe("/opt/tokenizers/word_bpe_49k.json")


def test_query_of_tokens(spark, library):
    sf = "/root/testdata/sf0.001"
    text = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op11_bpe(spark, sf).collect()
    assert len(rows) == len(text)
    for r in rows:
        ids = library.encode(text[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def vectors(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int")


def odd_vectors(dims, n=60, seed=2):
    r = np.random.default_rng(seed)
    rows = [(k, [float(np.float32(x)) for x in r.normal(0, 0.3, dims)], 0) for k in range(n)]
    bad = [None, [], [0.1] * (dims - 1), [0.1] * (dims + 1), [None] * dims, [nan] * dims, [0.0] * (dims - 1) + [inf], [-inf] + [0.0] * (dims - 1), [1e30] * dims]
    return [*rows, *rows[:7], rows[3], *((100 + k, v, 0) for k, v in enumerate(bad)), (None, rows[5][1], 1), (None, [0.25] * dims, None)]


def brute_clusters(rows, k, rounds, dims):
    usable = [(i, np.floor(np.array(v, dtype=float) * 256).astype(np.int64)) for i, v, _ in rows if v is not None and len(v) == dims and all(x is not None and abs(x) < 1e6 for x in v)]
    keyed = sorted((hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest(), tuple(x)) for i, x in usable)
    centroids = [np.array(x) for _, x in keyed[:k]]

    def nearest(x):
        d = [int(((x - c) ** 2).sum()) for c in centroids]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        of = [nearest(x)[0] for _, x in usable]
        for c in range(len(centroids)):
            members = [x for (_, x), o in zip(usable, of, strict=True) if o == c]
            if members:
                centroids[c] = np.sum(members, axis=0) // len(members)
    return sorted(((i is None, i or 0, *nearest(x), centroids[nearest(x)[0]].tolist()) for i, x in usable), key=str)


@pytest.mark.parametrize(("k", "rounds", "replay"), [(5, 4, 8), (5, 4, 1), (9, 1, 8), (3, 0, 8), (500, 2, 8)])
def test_clusters_equal_brute_force(spark, monkeypatch, k, rounds, replay):
    monkeypatch.setattr(clustering, "REPLAY", replay)
    monkeypatch.setattr(clustering, "STRIP", 2)
    rows = odd_vectors(6)
    found = clustering.cluster(vectors(spark, rows).repartition(3), k, rounds, 6).collect()
    assert sorted(((r["vec_id"] is None, r["vec_id"] or 0, r["cluster"], r["distance"], r["centroid"]) for r in found), key=str) == brute_clusters(rows, k, rounds, 6)
    assert {r["inertia"] for r in found} == {sum(r["distance"] for r in found)}
    for r in found:
        assert r["cluster_inertia"] == sum(x["distance"] for x in found if x["cluster"] == r["cluster"])
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, r["centroid"])).encode()).hexdigest()


def test_ties_go_to_the_smaller_centroid_and_bounds_are_strict():
    scan = clustering.Scan(np.array([[0, 0], [4, 0], [0, 4], [4, 4], [2, 2]]))
    points = np.array([[2, 0], [0, 2], [3, 3], [1, 1], [4, 2], [2, 4]])
    for previous in range(5):
        cluster, distance = scan.assign(points, np.full(len(points), previous, dtype=np.int32))
        assert cluster.tolist() == [0, 0, 3, 0, 1, 2] and distance.tolist() == [4, 4, 2, 2, 4, 4]


def test_scans_are_exact_at_large_values():
    r = np.random.default_rng(1)
    rows, centroids = r.integers(-(1 << 25), 1 << 25, (50, 64)), r.integers(-(1 << 25), 1 << 25, (7, 64))
    exact = np.array([[sum((int(a) - int(b)) ** 2 for a, b in zip(x, c, strict=True)) for c in centroids] for x in rows])
    assert (clustering.squared(rows, centroids) == exact).all()
    cluster, distance = clustering.Scan(centroids).assign(rows, np.zeros(50, dtype=np.int32))
    assert (cluster == exact.argmin(1)).all() and (distance == exact.min(1)).all()


def brute_whitening(rows, dims):
    usable = [(i, np.floor(np.array(v, dtype=float) * 64) + 1e6) for i, v, _ in rows if v is not None and len(v) == dims and all(x is not None and abs(x) < 1e6 for x in v)]
    fit = np.array(sorted({tuple(x) for _, x in usable}))
    n, sums = len(fit), fit.astype(np.int64).sum(0)
    v = np.cov((fit - 1e6).T, bias=True).reshape(dims, dims)
    values, directions = np.linalg.eigh(v)
    return usable, fit, n, sums, v, values[::-1], directions[:, ::-1]


@pytest.mark.parametrize("kind", ["float", "double"])
def test_whitening_equals_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(whitening, "FAN", 2)  # states are merged in trees
    dims, wide = 8, 5
    rows = odd_vectors(dims)
    found = whitening.whiten(vectors(spark, rows, kind).repartition(7), wide).collect()
    usable, fit, n, sums, v, values, directions = brute_whitening(rows, dims)
    assert len(found) == len(usable) * wide
    by_row = {}
    for r in found:
        by_row.setdefault((r["vec_id"], tuple(r["embedding"])), {})[r["component"]] = r
    signs = None
    for i, x in usable:
        key = next(k for k in by_row if k[0] == i and (np.floor(np.array(k[1]) * 64) + 1e6 == x).all())
        got = by_row[key]
        assert sorted(got) == list(range(1, wide + 1))
        ours = np.array([got[c]["whitened"] for c in range(1, wide + 1)])
        theirs = (x - sums / n) @ directions[:, :wide] / np.sqrt(values[:wide])
        if signs is None:
            signs = np.sign(ours * theirs)
        assert np.abs(ours - signs * theirs).max() < 1e-8
        deviation = sum((n * int(a) - int(s)) ** 2 for a, s in zip(x, sums, strict=True))
        for c, r in got.items():
            assert r["n"] == n and r["deviation"] == deviation and abs(r["explained"] / (values[c - 1] / v.trace()) - 1) < 1e-9 and 0 <= r["identity_error"] < 1e-9


def test_degenerate_vectors_have_fewer_components(spark):
    same, two = [(k, [0.5, 0.25], 0) for k in range(4)], [(1, [0.0, 1.0], 0), (2, [1.0, 1.0], 0), (3, [1.0, 1.0], 0)]
    assert whitening.whiten(vectors(spark, same)).count() == 0
    found = whitening.whiten(vectors(spark, two)).collect()
    assert sorted((r["vec_id"], r["component"], r["n"], round(abs(r["whitened"]), 9), r["explained"]) for r in found) == [(1, 1, 2, 1.0, 1.0), (2, 1, 2, 1.0, 1.0), (3, 1, 2, 1.0, 1.0)]


def test_deviations_beyond_a_long_are_null(spark):
    rows = vectors(spark, [(k, [x, 0.0], 0) for k, x in enumerate((0.0, 1.0, 3e7, -3e7))], "double")
    found = {r["vec_id"]: r["deviation"] for r in whitening.whiten(rows, 1).collect()}
    n, xs = 4, [int(64 * x) for x in (0, 1, 3e7, -3e7)]
    exact = [(n * x - sum(xs)) ** 2 for x in xs]
    assert found == {k: e if e < 1 << 63 else None for k, e in enumerate(exact)} and None in found.values()


def test_moments_merge_as_one_stream():
    rows = np.random.default_rng(6).normal(1e3, 1, (200, 5))
    parts = [whitening.Moments(5) for _ in range(4)]
    for k, row in enumerate(rows):
        parts[k % 3].add(row)  # the last one stays empty
    whole = parts[3].merge(parts[0]).merge(parts[1]).merge(parts[2])
    assert whole.n == 200 and np.abs(whole.covariance - np.cov(rows.T, bias=True)).max() < 1e-11


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 64])
def test_symmetric_qr_solves(n):
    r = np.random.default_rng(n)
    for m in (r.normal(size=(n, n)), np.eye(n), np.zeros((n, n)), np.diag(np.arange(n, dtype=float)), r.normal(size=(n, max(n // 2, 1)))):
        m = m @ m.T
        values, vectors = whitening.symmetric_qr(m)
        scale = max(np.abs(m).max(initial=0), 1e-300)
        assert np.abs(vectors @ np.diag(values) @ vectors.T - m).max(initial=0) < 1e-12 * scale * max(n, 1)
        assert np.abs(vectors.T @ vectors - np.eye(n)).max(initial=0) < 1e-12
        assert np.allclose(values, np.linalg.eigvalsh(m)[::-1] if n else [], atol=1e-12 * scale * max(n, 1))


EMPTY = {
    "bpe": (lambda d: bpe.encode(d, decoded=True), "doc_id long, text string, ids string, n_tokens string, decoded int", (1, "a b", "x", "y", 2)),
    "decode": (lambda d: bpe.decode(d), "doc_id long, ids array<int>, decoded int", (1, [64, 65], 2)),
    "clusters": (lambda d: clustering.cluster(d, 2, 2, 2), "vec_id long, embedding array<float>, cluster string, distance string, n string", (1, [0.5, 0.25], "x", "y", "z")),
    "whitening": (lambda d: whitening.whiten(d, 2), "vec_id long, embedding array<float>, component string, n string, whitened string", (1, [0.5, 0.25], "x", "y", "z")),
}


@pytest.mark.parametrize("name", sorted(EMPTY))
def test_empty_tables_and_clashing_columns(spark, name):
    operator, schema, row = EMPTY[name]
    assert operator(spark.createDataFrame([], schema)).count() == 0
    assert operator(spark.createDataFrame([row, row], schema)).count() == (0 if name == "whitening" else 2)


def test_query_of_whitening(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], r["embedding"], 0) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    usable, fit, n, sums, v, values, directions = brute_whitening(rows, 64)
    found = queries.op13_whitening(spark, sf).toPandas()
    assert len(found) == 16 * len(usable) and found["n"].unique().tolist() == [n] and found["identity_error"].max() < 1e-9
    table = found.pivot(index="vec_id", columns="component", values="whitened").sort_index().to_numpy()
    theirs = (np.array([x for _, x in sorted(usable, key=lambda u: u[0])]) - sums / n) @ directions[:, :16] / np.sqrt(values[:16])
    assert np.abs(np.abs(table) - np.abs(theirs)).max() < 1e-6
