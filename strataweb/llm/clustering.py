"""Centroid clustering by sort-means, in exact integers.

Each round, every centroid orders the others by their distance from it.  A
vector is measured against its previous centroid; the others are scanned in
that centroid's order until one is strictly farther from it than twice the
vector's distance: by the triangle inequality nothing from there on can be as
near.  The vectors of a batch that share a previous centroid are scanned
together, nearest last, so that those still scanning are a prefix.

A round is one pass over the vectors: each task sums its vectors by cluster,
the sums are added up by cluster and dimension, and only ``k x d`` of them reach
the driver.  A vector's previous assignment is not stored but found again from
the centroids of the rounds before (a cheap scan each, and no state to lose);
every ``REPLAY`` rounds assignments are written to the shared folder beside
their vectors, and the replay starts from there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise

#: Centroids that are measured at once in a scan.
STRIP = 8
#: Rounds after which assignments are written down.
REPLAY = 8
#: Components are left out beyond this, scaled: squared distances would leave a long.
MAX_COMPONENT = 1 << 25


def integers(vectors: pa.Array, dims: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors are usable, and those as rows of ``floor(scale * x)``.

    Usable: exactly ``dims`` components, none null or non-finite, none beyond ``MAX_COMPONENT`` when scaled.
    """
    lengths = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    fits = np.flatnonzero(lengths == dims)
    flat = vectors.take(pa.array(fits)).flatten().cast(pa.float64())
    rows = np.floor(flat.to_numpy(zero_copy_only=False).reshape(len(fits), dims) * scale)  # nulls are NaN
    with np.errstate(invalid="ignore"):
        good = (np.abs(rows) <= MAX_COMPONENT).all(1)
    return fits[good], rows[good].astype(np.int64)


class Scan:
    """One set of centroids: their mutual distances and each one's order of the others."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.between = squared(centroids, centroids)
        k = len(centroids)
        order = np.argsort(self.between, axis=1, kind="stable")
        self.order = order[order != np.arange(k)[:, None]].reshape(k, k - 1) if k else order

    def assign(self, rows: np.ndarray, previous: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of each row (ties: the smaller number) and the squared distance."""
        cluster, distance = previous.copy(), np.zeros(len(rows), dtype=np.int64)
        for c in np.unique(previous):
            of = np.flatnonzero(previous == c)
            from_c = squared(rows[of], self.centroids[c : c + 1])[:, 0]
            of, from_c = (x[np.argsort(-from_c, kind="stable")] for x in (of, from_c))
            points, best, at = rows[of], from_c.copy(), np.full(len(of), c, dtype=previous.dtype)
            order = self.order[c]
            # Distances are squared: beyond twice one is beyond four times its square.
            scanning = np.searchsorted(-4 * from_c, -self.between[c, order], "right")
            for low in range(0, len(order), STRIP):
                n = scanning[low]
                if not n:
                    break
                strip = np.sort(order[low : low + STRIP])
                away = squared(points[:n], self.centroids[strip])
                least = away.argmin(1)  # the first of equals, which is the smaller number
                near, number = away[np.arange(n), least], strip[least]
                closer = (near < best[:n]) | ((near == best[:n]) & (number < at[:n]))
                best[:n][closer], at[:n][closer] = near[closer], number[closer]
            cluster[of], distance[of] = at, best
        return cluster, distance


def squared(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of integers."""
    largest = max((int(np.abs(x).max()) for x in (rows, centroids) if x.size), default=0)
    # As doubles the products run faster, as long as all sums stay exact.
    exact = 4 * largest**2 * rows.shape[1] <= 1 << 53
    a, b = (x.astype(np.float64 if exact else np.int64) for x in (rows, centroids))
    return ((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T)).astype(np.int64)


def _passes(vectors: DataFrame, dims: int, scale: int, history: list[np.ndarray], column: str):
    """The usable vectors of each batch: (batch, places, rows, cluster, distance) after all centroids of ``history``."""
    has_start = "cluster" in vectors.columns

    def walk(batches: Iterator[pa.RecordBatch]):
        scans = [Scan(c) for c in history]
        for batch in batches:
            at, rows = integers(batch.column(column), dims, scale)
            cluster, distance = (batch.column("cluster").to_numpy()[at] if has_start else np.zeros(len(at), dtype=np.int32)), None
            for scan in scans:
                cluster, distance = scan.assign(rows, cluster)
            yield batch, at, rows, cluster, distance

    return walk


def start(vectors: DataFrame, k: int, dims: int, scale: int, seed: int = 2, key: str = "vec_id", column: str = "embedding") -> np.ndarray:
    """The ``k`` usable vectors of least sha256 of ``seed:key``, in ascending order; a null key is empty text, equal keys go by their vectors."""
    # As in integers(); NaN is beyond every bound here.
    good = F.forall(column, lambda x: x.isNotNull() & (x.cast("double") * scale >= -MAX_COMPONENT) & (x.cast("double") * scale < MAX_COMPONENT + 1))
    usable = vectors.where((F.size(column) == dims) & good)
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    whole = F.transform(column, lambda x: F.floor(x.cast("double") * scale))
    found = usable.select(hashed.alias("h"), whole.alias("v")).orderBy("h", "v").limit(k).collect()
    return np.array([r["v"] for r in found], dtype=np.int64).reshape(len(found), dims)


def fit(vectors: DataFrame, k: int, rounds: int, dims: int, scale: int, seed: int = 2, key: str = "vec_id", column: str = "embedding") -> tuple[list[np.ndarray], DataFrame]:
    """Centroids of all rounds since assignments were last written (at least the first set), and the vectors with those assignments.

    The last set is the fitted one.  Fewer than ``k`` usable vectors make as many centroids.
    """
    history = [start(vectors, k, dims, scale, seed, key, column)]
    vectors = vectors.select(F.col(key), F.col(column))
    for _ in range(rounds):
        if len(history) > REPLAY:
            vectors = materialise(_assigned(vectors, dims, scale, history[:-1], key, column, with_vector=True), "clusters")
            history = history[-1:]
        history.append(_moved(vectors, dims, scale, history, column))
    return history, vectors


def _moved(vectors: DataFrame, dims: int, scale: int, history: list[np.ndarray], column: str) -> np.ndarray:
    """The centroids of the next round: floors of the means, empty clusters stay."""
    walk, k = _passes(vectors, dims, scale, history, column), len(history[0])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(k, dtype=np.int64), np.zeros((k, dims), dtype=np.int64)
        for _, _, rows, cluster, _ in walk(batches):
            order = np.argsort(cluster, kind="stable")
            found, heads = np.unique(cluster[order], return_index=True)
            if len(found):
                sums[found] += np.add.reduceat(rows[order], heads, axis=0)
                counts += np.bincount(cluster, minlength=k)
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(counts[met]), pa.array(list(sums[met]), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    used = [column, *(["cluster"] if "cluster" in vectors.columns else [])]
    parts = vectors.select(*used).mapInArrow(add, "cluster int, n long, sums array<long>")
    total = parts.select("cluster", "n", F.posexplode("sums").alias("dim", "x")).groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    moved = history[-1].copy()
    for r in total.collect():  # k x dims rows
        moved[r["cluster"], r["dim"]] = r["x"] // r["n"]
    return moved


def _assigned(vectors: DataFrame, dims: int, scale: int, history: list[np.ndarray], key: str, column: str, with_vector: bool = False) -> DataFrame:
    """key, cluster and distance of every usable vector, and the vector if wanted."""
    used = [key, column, *(["cluster"] if "cluster" in vectors.columns else [])]
    walk = _passes(vectors, dims, scale, history, column)
    kinds = vectors.schema
    names = [key, *([column] if with_vector else []), "cluster", "distance"]
    schema = T.StructType([*(kinds[c] for c in names[:-2]), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, at, _, cluster, distance in walk(batches):
            kept = [batch.column(c).take(pa.array(at)) for c in names[:-2]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(cluster.astype(np.int32)), pa.array(distance)], names)

    return vectors.select(*used).mapInArrow(work, schema)


def cluster(vectors: DataFrame, k: int, rounds: int, dims: int, scale: int = 256, seed: int = 2, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """key, cluster (int), distance (squared), cluster_inertia, inertia, centroid and centroid_sha256 of every usable vector.

    The digest is of the centroid's components, in decimal, joined by commas.

    Vectors count as rows of ``floor(scale * x)``.  Those of another length than
    ``dims``, null ones, ones with null or non-finite components or (scaled)
    beyond ``MAX_COMPONENT`` are left out.  Repeated rows each count; no usable
    vectors, no rows.  Columns but key and vector are not kept.  A sum that no
    long holds is null.
    """
    history, held = fit(vectors, k, rounds, dims, scale, seed, key, column)
    final, spark = history[-1], vectors.sparkSession
    facts_schema = "cluster int, cluster_inertia long, inertia long, centroid array<long>, centroid_sha256 string"
    assigned = materialise(_assigned(held, dims, scale, history, key, column), "clustered")
    sums = {r["cluster"]: r["s"] for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    as_long = lambda x: int(x) if x < 1 << 63 else None
    whole = as_long(sum(sums.values()))
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in final.tolist()]
    facts = [(c, as_long(s), whole, final[c].tolist(), digests[c]) for c, s in sums.items()]
    # One row a centroid: k of them at most.
    return assigned.join(F.broadcast(spark.createDataFrame(facts, facts_schema)), "cluster").select(key, "cluster", "distance", "cluster_inertia", "inertia", "centroid", "centroid_sha256")
