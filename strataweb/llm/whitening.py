"""Embedding whitening: a streamed covariance and its principal components.

Vectors count as integers ``floor(scale * c) + shift``.  The fit list has each
distinct one once.  Every task goes over its part of the list by Welford's
rank-one updates of mean and scatter; the tasks' states are merged by the
parallel formula, in a tree whose merges read ``FAN`` states each, so that no
task and not the driver holds more than that many ``d x d`` matrices.  The
covariance then goes through the symmetric QR method: Householder steps to
tridiagonal form, implicit shifted QR steps to the eigenvalues.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise

SCALE, SHIFT = 64, 1_000_000
#: States that are merged at once.
FAN = 64
#: Integers beyond this are left out, as non-finite entries are: their sums would leave a long.
MAX_COMPONENT = 1 << 31
#: Components whose share of the variance is not above this are rounding errors.
NEGLIGIBLE = 1e-13
_STATE = "n long, mean binary, scatter binary, sums binary"


class Moments:
    """Count, mean and scatter (sum of centred outer products) of the rows seen, and their exact sums."""

    def __init__(self, dims: int):
        self.n, self.mean, self.scatter, self.sums = 0, np.zeros(dims), np.zeros((dims, dims)), np.zeros(dims, dtype=np.int64)
        self._outer = np.empty((dims, dims))

    def add(self, row: np.ndarray) -> None:
        """Welford's rank-one update."""
        self.n += 1
        before = row - self.mean
        self.mean += before / self.n
        np.multiply.outer(before, row - self.mean, out=self._outer)
        self.scatter += self._outer

    def merge(self, other: Moments) -> Moments:
        """The parallel formula: the scatters' sum and that of the means' distance."""
        if other.n:
            n, apart = self.n + other.n, other.mean - self.mean
            self.scatter += other.scatter + np.outer(apart, apart) * (self.n * other.n / n)
            self.mean += apart * (other.n / n)
            self.sums += other.sums
            self.n = n
        return self

    @property
    def covariance(self) -> np.ndarray:
        """Divisor n; made symmetric, as rounding may leave it uneven."""
        return (self.scatter + self.scatter.T) / (2 * max(self.n, 1))

    def row(self) -> pa.RecordBatch:
        values = [[self.n], *([x.tobytes()] for x in (self.mean, self.scatter, self.sums))]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, [pa.int64(), *[pa.binary()] * 3], strict=True)], ["n", "mean", "scatter", "sums"])

    @classmethod
    def of(cls, row) -> Moments:
        mean = np.frombuffer(row["mean"])
        self = cls(len(mean))
        self.n, self.mean, self.scatter = row["n"], mean.copy(), np.frombuffer(row["scatter"]).reshape(len(mean), len(mean)).copy()
        self.sums = np.frombuffer(row["sums"], dtype=np.int64).copy()
        return self


def merged(states: DataFrame, dims: int) -> Moments:
    """All states in one: by trees of ``FAN`` until no more than that are left."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = Moments(dims)
        for batch in batches:
            for row in batch.to_pylist():
                whole.merge(Moments.of(row))
        if whole.n:
            yield whole.row()

    states = materialise(states, "moments")
    while (n := states.count()) > FAN:
        # Dealt out by their place in a written table, so that a task that is run again gets the same states.
        states = materialise(states.repartition(math.ceil(n / FAN), F.xxhash64("mean", "n")).mapInArrow(merge, _STATE), "moments")
    whole = Moments(dims)
    for row in states.orderBy("n", "mean").collect():
        whole.merge(Moments.of(row))
    return whole


def symmetric_qr(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns; each one's largest entry is positive."""
    a, n = matrix.astype(np.float64).copy(), len(matrix)
    q = np.eye(n)
    for k in range(n - 2):  # Householder reflections to tridiagonal form
        v = a[k + 1 :, k].copy()
        length = np.linalg.norm(v)
        if length == 0:
            continue
        v[0] += math.copysign(length, v[0])
        v /= np.linalg.norm(v)
        a[k + 1 :] -= 2 * np.outer(v, v @ a[k + 1 :])
        a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ v, v)
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    d, e = np.diag(a).copy(), np.append(np.diag(a, -1), 0.0)
    q = np.ascontiguousarray(q.T)  # rows are rotated
    high, tiny = n - 1, np.finfo(float).eps
    while high > 0:
        small = np.abs(e[:high]) <= tiny * (np.abs(d[:high]) + np.abs(d[1 : high + 1]))
        e[:high][small] = 0.0
        if e[high - 1] == 0:
            high -= 1
            continue
        low = high - 1
        while low and e[low - 1]:
            low -= 1
        # One implicit step on the block low..high, shifted by the eigenvalue of its last two rows that is nearer to the last.
        half = (d[high - 1] - d[high]) / 2
        shift = d[high] - e[high - 1] ** 2 / (half + math.copysign(math.hypot(half, e[high - 1]), half or 1.0))
        x, z = d[low] - shift, e[low]
        for k in range(low, high):
            r = math.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > low:
                e[k - 1] = r
            dk, ek, dn = d[k], e[k], d[k + 1]
            d[k] = c * c * dk + 2 * c * s * ek + s * s * dn
            d[k + 1] = s * s * dk - 2 * c * s * ek + c * c * dn
            e[k] = c * s * (dn - dk) + (c * c - s * s) * ek
            if k + 1 < high:
                x, z = e[k], s * e[k + 1]
                e[k + 1] *= c
            q[k], q[k + 1] = c * q[k] + s * q[k + 1], c * q[k + 1] - s * q[k]
    order = np.argsort(-d, kind="stable")
    vectors = q[order].T
    signs = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(n)]) if n else np.ones(0)
    return d[order], vectors * np.where(signs == 0, 1, signs)


def _usable(vectors: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the usable vectors, and those as rows of integers."""
    lengths = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    fits = np.flatnonzero(lengths == dims)
    flat = vectors.take(pa.array(fits)).flatten().cast(pa.float64())
    rows = np.floor(flat.to_numpy(zero_copy_only=False).reshape(len(fits), dims) * SCALE)  # nulls are NaN
    with np.errstate(invalid="ignore"):
        good = (np.abs(rows) <= MAX_COMPONENT).all(1)
    return fits[good], rows[good].astype(np.int64) + SHIFT


def common_length(vectors: DataFrame, column: str) -> int:
    """The most frequent length of vectors without null or non-finite entries (ties: the greater); 0 if there are none."""
    whole = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    found = vectors.where((F.size(column) > 0) & whole).groupBy(F.size(column).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return found["d"] if found else 0


def distinct_integers(vectors: DataFrame, dims: int, column: str) -> DataFrame:
    """x (array of int, without the shift) of each distinct usable vector once."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, rows = _usable(batch.column(0), dims)
            rows = np.unique(rows - SHIFT, axis=0).astype(np.int32)
            offsets = np.arange(len(rows) + 1, dtype=np.int32) * dims
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel()))], ["x"])

    return vectors.select(column).mapInArrow(work, "x array<int>").distinct()


def _moments(fit: DataFrame, dims: int, project: np.ndarray | None = None, centre: np.ndarray | None = None) -> Moments:
    """Moments of the fit list, or of its whitened rows, with the sums of the integers.

    The shift is left out: a covariance does not depend on it, and small numbers keep more digits.
    """
    width = dims if project is None else project.shape[1]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = Moments(width)
        for batch in batches:
            rows = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dims).astype(np.int64)
            if project is None:
                here.sums += rows.sum(0)
            for row in rows.astype(np.float64) if project is None else (rows - centre) @ project:
                here.add(row)
        if here.n:
            yield here.row()

    return merged(fit.mapInArrow(work, _STATE), width)


def whiten(vectors: DataFrame, components: int = 16, keep: list[str] | None = None, column: str = "embedding") -> DataFrame:
    """One row of every usable vector and component: component (from 1), n, deviation, whitened, explained, identity_error.

    Usable are vectors without null or non-finite entries, of the most frequent
    length, whose integers stay within ``MAX_COMPONENT``.  Repeated rows come
    out repeated, but count once in the fit.  A deviation that no long holds is
    null.  Components without variance (fewer distinct vectors than
    components, constant dimensions) have no whitening and are left out; so one
    distinct vector, or none, gives no rows.  Columns ``keep``: of the others
    (all of them, unless given), but an added name is replaced.
    """
    fields = T.StructType.fromDDL("component int, n long, deviation long, whitened double, explained double, identity_error double").fields
    added = [f.name for f in fields]
    keep = [c for c in (vectors.columns if keep is None else keep) if c not in added]
    rows = vectors.select(*(F.col(f"`{c}`") for c in keep), F.col(column).alias("_white_vector"))
    schema = T.StructType([*rows.schema.fields[:-1], *fields])
    dims = common_length(rows, "_white_vector")
    fit = materialise(distinct_integers(rows, dims, "_white_vector"), "distinct-vectors")
    moments = _moments(fit, dims)
    n, sums = moments.n, moments.sums
    values, directions = symmetric_qr(moments.covariance)
    trace = float(moments.covariance.trace())
    count = int((values[:components] > NEGLIGIBLE * trace).sum()) if n > 1 else 0
    mean = sums / max(n, 1)
    project = directions[:, :count] / np.sqrt(values[:count])
    error = float(np.abs(_moments(fit, dims, project, mean).covariance - np.eye(count)).max()) if count else 0.0
    explained = values[:count] / trace if count else values[:0]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = _usable(batch.column(batch.num_columns - 1), dims)
            found -= SHIFT
            apart = n * found - sums
            large = (apart.astype(np.float64) ** 2).sum(1) >= 2.0**63 * (1 - 1e-9)
            deviation = (apart * apart).sum(1)
            for i in np.flatnonzero(large):  # near a long's end they are summed without bound
                whole = sum(int(x) ** 2 for x in apart[i])
                large[i], deviation[i] = whole >= 1 << 63, whole if whole < 1 << 63 else 0
            whitened = (found - mean) @ project
            many = np.repeat(np.arange(len(at)), count)
            kept = [c.take(pa.array(at[many])) for c in batch.columns[:-1]]
            out = [np.tile(np.arange(1, count + 1, dtype=np.int32), len(at)), np.full(len(many), n), pa.array(deviation[many], mask=large[many]), whitened.ravel(), np.tile(explained, len(at)), np.full(len(many), error)]
            yield pa.RecordBatch.from_arrays([*kept, *map(pa.array, out)], schema.names)

    return rows.mapInArrow(work, schema)
