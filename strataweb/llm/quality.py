"""Quality classifier on document statistics.

A Gaussian kernel over standardised statistics is approximated by random
Fourier features; ridge regression on them is fitted from normal equations
summed by partition; cross-fitted scores are calibrated by isotonic
regression.  Scoring is one pass over the texts without a shuffle.

Training takes labelled rows only, at most about ``max_train`` of them (a
documented bound; the sample is by hash of the id), so what is broadcast (ids
and labels) and what the driver gathers (two ``features x features`` matrices,
at most ``BINS`` calibration sums) are bounded whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import ragged
from .common import hashed_fold, materialise

FEATURES = 256
RIDGE = 1e-2
MAX_TRAIN = 200_000
BINS = 512
_PARTS = 16
_OWN = "_quality_"
#: Byte classes that are counted.
_CLASSES = {"lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "space": b" \t\r\x0b\x0c", "line": b"\n", "stop": b".,;:?'\"-()", "shout": b"!", "bar": b"|", "symbol": b"#*$%&<>"}


def _class_table() -> np.ndarray:
    table = np.full(256, len(_CLASSES), dtype=np.uint8)  # other ASCII
    for k, chars in enumerate(_CLASSES.values()):
        table[list(chars)] = k
    table[0x80:0xC0] = len(_CLASSES) + 1  # continuation bytes
    table[0xC0:] = len(_CLASSES) + 2  # non-ASCII characters
    return table


_TABLE = _class_table()
_N_CLASSES = len(_CLASSES) + 3


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of document statistics for each text, from the whole text; null counts as empty."""
    parts = [_statistics(texts.slice(a, b - a)) for a, b in ragged.groups(texts)]
    return np.concatenate(parts) if parts else np.zeros((0, N_STATISTICS))


def _statistics(texts: pa.Array) -> np.ndarray:
    data, offsets = ragged.text_bytes(texts)
    n = len(texts)
    owner = np.repeat(np.arange(n, dtype=np.int32), np.diff(offsets))
    counts = np.bincount(owner * _N_CLASSES + _TABLE[data], minlength=n * _N_CLASSES).reshape(n, _N_CLASSES).astype(float)
    del owner
    kind = dict(zip([*_CLASSES, "other", "tail", "wide"], counts.T, strict=True))
    chars = np.maximum(counts.sum(1) - kind["tail"], 1)
    letters = np.maximum(kind["lower"] + kind["upper"] + kind["wide"], 1)

    starts, ends, docs = ragged.word_spans(data, offsets, ragged.NONSPACE)
    words = np.bincount(docs, minlength=n).astype(float)
    some = np.maximum(words, 1)
    lengths = (ends - starts).astype(float)
    mean = np.bincount(docs, lengths, n) / some
    spread = np.sqrt(np.maximum(np.bincount(docs, lengths**2, n) / some - mean**2, 0))
    final = _TABLE[data[ends - 1]] if len(ends) else np.zeros(0, np.uint8)
    names = [*_CLASSES]
    odd_end = np.bincount(docs, np.isin(final, [names.index(x) for x in ("shout", "symbol", "bar")]), n) / some
    short = np.bincount(docs, lengths <= 3, n) / some
    hashes = ragged.span_hashes(ragged.LOWER[data], starts, ends)
    again = ragged.repeats(hashes, docs, n) / some
    grams, at = ragged.ngram_hashes(hashes, docs, 3)
    gram_docs = docs[at]
    grams_again = ragged.repeats(grams, gram_docs, n) / np.maximum(np.bincount(gram_docs, minlength=n), 1)
    share = counts / np.maximum(counts.sum(1, keepdims=True), 1)
    entropy = -(share * np.log(np.maximum(share, 1e-12))).sum(1)
    return np.stack(
        [
            np.log1p(chars * (counts.sum(1) > 0)),
            np.log1p(words),
            kind["upper"] / letters,
            kind["digit"] / chars,
            np.sqrt(kind["symbol"] / chars),
            np.sqrt(kind["shout"] / chars),
            np.sqrt(kind["bar"] / chars),
            kind["stop"] / chars,
            (kind["space"] + kind["line"]) / chars,
            kind["wide"] / chars,
            np.sqrt(kind["other"] / chars),
            kind["line"] / some,
            mean,
            spread,
            odd_end,
            short,
            again - 0.08 * np.log1p(words),
            grams_again,
            entropy,
        ],
        axis=1,
    )


N_STATISTICS = 19


@dataclass
class QualityModel:
    """Everything that scoring needs; a few hundred kilobytes at most."""

    mean: np.ndarray
    scale: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def fourier(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -6, 6)
        return np.hstack([np.ones((len(z), 1)), np.sqrt(2 / len(self.phases)) * np.cos(z @ self.frequencies + self.phases)])

    def raw(self, stats: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        return self.fourier(stats) @ (self.weights if weights is None else weights)

    def score(self, stats: np.ndarray) -> np.ndarray:
        """Calibrated scores; a thousandth of the raw score's rank keeps an order within isotonic steps."""
        raw = self.raw(stats)
        level = np.interp(raw, self.knots, self.levels)
        return np.clip(0.999 * level + 0.001 / (1 + np.exp(-4 * (raw - 0.5))), 0, 1)


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted isotonic regression by pooling adjacent violators; the pools' centres and levels, both rising."""
    pools: list[list[float]] = []
    for a, b, c in zip(x, y, w, strict=True):
        pools.append([a * c, b * c, c])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last, strict=True)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


def training_rows(docs: DataFrame, labels: DataFrame, trainable: Column, max_train: int = MAX_TRAIN) -> DataFrame:
    """Statistics, label y and cross-fitting half of the labelled rows for which ``trainable`` (of doc_id) holds.

    Labels other than 0 and 1 and null ids are left out, repeated labels of a
    document are averaged.  Beyond ``max_train`` labels a sample by hash of the
    id is taken.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).where(trainable)
    known = known.groupBy("doc_id").agg(F.avg("quality").alias("y"))
    count = known.count()
    if count > max_train:
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit("train")), F.lit(1_000_000)) < int(1_000_000 * max_train / count))
    known = known.select(F.col("doc_id").alias(f"{_OWN}id"), "y")
    # At most about max_train pairs of a long and a double.
    rows = docs.select(F.col("doc_id").alias(f"{_OWN}id"), F.col("text").alias("text")).join(F.broadcast(known), f"{_OWN}id")
    half = F.pmod(F.xxhash64(f"{_OWN}id", F.lit("half")), F.lit(2)).cast("int")
    rows = rows.select("text", "y", half.alias("half"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = statistics(batch.column("text"))
            flat = pa.array(stats.ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, N_STATISTICS), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([lists, batch.column("y"), batch.column("half")], ["stats", "y", "half"])

    return materialise(rows.mapInArrow(measure, "stats array<double>, y double, half int"), "quality-train").repartition(_PARTS)


def _stats_of(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("stats").flatten().to_numpy().reshape(-1, N_STATISTICS)


def fit(docs: DataFrame, labels: DataFrame, trainable: Column | None = None, max_train: int = MAX_TRAIN, features: int = FEATURES, seed: int = 11) -> QualityModel:
    """Fit on the labelled rows (all, or those for which ``trainable`` holds).

    Without any labelled row every score is one half.
    """
    rows = training_rows(docs, labels, F.lit(True) if trainable is None else trainable, max_train)
    each = F.posexplode("stats").alias("k", "v")
    moments = {r["k"]: r for r in rows.select(each).groupBy("k").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("scale")).collect()}
    rng = np.random.default_rng(seed)
    model = QualityModel(
        mean=np.array([moments[k]["mean"] if k in moments else 0.0 for k in range(N_STATISTICS)]),
        scale=np.array([max(moments[k]["scale"], 1e-9) if k in moments else 1.0 for k in range(N_STATISTICS)]),
        frequencies=rng.normal(0, 1 / np.sqrt(N_STATISTICS), (N_STATISTICS, features)),
        phases=rng.uniform(0, 2 * np.pi, features),
        weights=np.zeros(features + 1),
        knots=np.array([0.0, 1.0]),
        levels=np.array([0.5, 0.5]),
    )
    if not moments:
        return model
    width = features + 1

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, width, width + 1))
        for batch in batches:
            z, y, half = model.fourier(_stats_of(batch)), batch.column("y").to_numpy(), batch.column("half").to_numpy()
            for h in (0, 1):
                part = z[half == h]
                sums[h] += np.hstack([part.T @ part, (part.T @ y[half == h])[:, None]])
        flat = pa.array(sums.ravel())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, width + 1), pa.int32()), flat)
        half, row = np.divmod(np.arange(2 * width), width)
        yield pa.RecordBatch.from_arrays([pa.array(half, pa.int32()), pa.array(row, pa.int32()), lists], ["half", "row", "sums"])

    partial = rows.mapInArrow(equations, "half int, row int, sums array<double>")
    zero = F.array_repeat(F.lit(0.0), width + 1)
    # One list of _PARTS arrays a row of the matrices.
    summed = partial.groupBy("half", "row").agg(F.aggregate(F.collect_list("sums"), zero, lambda a, b: F.zip_with(a, b, lambda u, v: u + v)).alias("sums"))
    halves = np.zeros((2, width, width + 1))
    for r in summed.collect():
        halves[r["half"], r["row"]] = r["sums"]

    def solve(both: np.ndarray) -> np.ndarray:
        gram, right = both[:, :width], both[:, width]
        ridge = RIDGE * max(gram[0, 0], 1) ** 0.5 * np.eye(width)
        ridge[0, 0] = 1e-6
        return np.linalg.solve(gram + ridge, right)

    model.weights = solve(halves.sum(0))
    crossed = [solve(halves[1]), solve(halves[0])]  # the other half's

    def cross_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats, half = _stats_of(batch), batch.column("half").to_numpy()
            raw = np.where(half == 0, model.raw(stats, crossed[0]), model.raw(stats, crossed[1]))
            yield pa.RecordBatch.from_arrays([pa.array(np.clip(raw, -0.5, 1.5)), batch.column("y")], ["raw", "y"])

    scored = rows.mapInArrow(cross_scores, "raw double, y double")
    binned = scored.groupBy(F.floor((F.col("raw") + 0.5) * (BINS / 2)).alias("bin")).agg(F.avg("raw").alias("raw"), F.avg("y").alias("y"), F.count(F.lit(1)).alias("n"))
    curve = sorted(binned.collect(), key=lambda r: r["bin"])
    model.knots, model.levels = isotonic(np.array([r["raw"] for r in curve]), np.array([r["y"] for r in curve]), np.array([float(r["n"]) for r in curve]))
    return model


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """Adds score (0 to 1) and predicted (1 if score >= 0.5, else 0) to every row; same-named input columns are replaced.

    Empty and null texts get the score of an empty text's statistics.
    """
    docs = docs.drop("score", "predicted")
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.score(statistics(batch.column(batch.schema.get_field_index("text"))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array((s >= 0.5).astype(np.int32))], [*batch.schema.names, "score", "predicted"])

    return docs.mapInArrow(judge, schema)


def keep_good(docs: DataFrame, model: QualityModel) -> DataFrame:
    """The rows of ``docs`` that the model predicts to be of label 1; columns as they were."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.score(statistics(batch.column(batch.schema.get_field_index("text"))))
            yield batch.filter(pa.array(s >= 0.5))

    return docs.mapInArrow(choose, docs.schema)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned: crc32 of the id as text leaves 1 modulo 3."""
    return hashed_fold(doc_id) == 1
