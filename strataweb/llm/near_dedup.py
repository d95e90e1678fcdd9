"""Near-duplicate documents by consistent weighted sampling.

Documents are bags of five-word shingles weighted by TF-IDF.  Improved
consistent weighted sampling (Ioffe, 2010) gives signatures whose agreement
probability is the weighted Jaccard similarity; signatures are cut into bands,
documents that share a band are candidates, candidates are verified by their
exact weighted Jaccard similarity, and linked documents form classes.

* Equal texts collapse to one node (the first 64 bits of their MD5) first.
* The IDF of a shingle is the mean over its words.  Document frequencies of
  words are counted exactly, over the whole corpus, by a shuffle.  The weight
  depends on the share of documents that hold a word, whatever the size of the
  corpus; words in fewer than ``RARE`` of them have the greatest weight, 2, so
  only the others are broadcast: at most the mean number of distinct words a
  document divided by ``RARE``.
* Candidates of a bucket are verified as :mod:`.linking` describes: nobody
  emits all its pairs, and no link between different texts is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ragged
from .common import materialise, temporary
from .linking import link

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 12, 4
#: Words of this share of the documents, or less, are rare.
RARE = 1e-3
#: Words that may be broadcast; beyond that the share that counts as rare grows until they fit.
MAX_WORDS = 4_000_000
_TABLE_BITS = 16
_GROUP = 512 << 10

_rng = np.random.default_rng(1001)
_n = 1 << _TABLE_BITS
_r = _rng.gamma(2.0, 1.0, _n)
_beta = _rng.uniform(0, 1, _n)
_log_c = np.log(_rng.gamma(2.0, 1.0, _n))
_R, _INVERSE_R, _BETA = _r.astype(np.float32), (1 / _r).astype(np.float32), _beta.astype(np.float32)
_SHIFT, _LOG_C = (_r * (_beta - 1)).astype(np.float32), _log_c.astype(np.float32)
_A = _rng.integers(1, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
del _rng, _n, _r, _beta, _log_c


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (ASCII letters and digits, A-Z lower-cased, and non-ASCII characters) and their texts."""
    data, offsets = ragged.text_bytes(texts)
    starts, ends, docs = ragged.word_spans(data, offsets, ragged.ALNUM)
    return ragged.span_hashes(ragged.LOWER[data], starts, ends), docs


class Idf:
    """Weights of hashed words between 1 and 2: 1 + ln(share) / ln(rare), where share is that of the documents with the word.

    A hash table of the words that are not rare, by the leading 48 bits of
    their hashes; those that share a slot with another lie in a sorted list.
    """

    def __init__(self, ids: np.ndarray, counts: np.ndarray, rows: int, rare: float = RARE):
        order = np.argsort(ids)
        ids, share = ids[order].astype(np.uint64), np.minimum(counts[order] / max(rows, 1), 1)
        values = 1 + np.clip(np.log(np.maximum(share, 1e-300)) / np.log(rare), 0, 1)
        bits = max(int(4 * len(ids)).bit_length(), 4)
        self.shift = np.uint64(64 - bits)
        slot = (ids >> (self.shift - np.uint64(16))).astype(np.int64)
        _, first = np.unique(slot, return_index=True)
        later = np.ones(len(ids), dtype=bool)
        later[first] = False
        self.ids, self.values, self.crowded = np.full(1 << bits, np.uint64(1) << np.uint64(63)), np.full(1 << bits, 2.0), np.zeros(1 << bits, dtype=bool)
        self.ids[slot[first]], self.values[slot[first]] = ids[first], values[first]
        self.crowded[slot[later]] = True
        self.more_ids, self.more_values = ids[later], values[later]

    def __call__(self, words: np.ndarray) -> np.ndarray:
        slot = words >> self.shift
        ids = words >> np.uint64(16)
        known = self.ids[slot] == ids
        out = np.where(known, self.values[slot], 2.0)
        if len(self.more_ids):
            rest = np.flatnonzero(self.crowded[slot] & ~known)
            at = np.minimum(np.searchsorted(self.more_ids, ids[rest]), len(self.more_ids) - 1)
            same = self.more_ids[at] == ids[rest]
            out[rest[same]] = self.more_values[at[same]]
        return out


def _word_counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """Leading 48 bits of each word's hash, the number of texts that hold it, and the number of texts with words."""
    ids, counts, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    for a, b in ragged.groups(texts):
        for x in range(a, b, 1 << 16):
            words, owner = _words(texts.slice(x, min(b - x, 1 << 16)))
            keys = np.sort(words >> np.uint64(16) << np.uint64(16) | owner.astype(np.uint64))
            keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])] >> np.uint64(16) if len(keys) else keys
            heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
            ids.append(keys[heads])
            counts.append(np.diff(np.append(heads, len(keys))))
            rows += len(np.unique(owner))
    return *_summed(np.concatenate(ids), np.concatenate(counts)), rows


def _summed(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(ids, kind="stable")
    ids, counts = ids[order], counts[order]
    heads = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else np.zeros(0, np.int64)
    return ids[heads], np.add.reduceat(counts, heads) if len(heads) else counts


def shingles(texts: pa.Array, idf: Idf) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, hash and weight (term frequency times IDF) of each distinct shingle, by text and hash.

    A text of fewer than five words, but not none, is one shingle.
    """
    owner, grams, weight, times = _counted(texts, idf)
    return owner, grams, np.round(weight, 6) * times


def _counted(texts: pa.Array, idf: Idf) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, hash, IDF and term frequency of each distinct shingle, by text and hash."""
    words, docs = _words(texts)
    n = len(texts)
    counts = np.bincount(docs, minlength=n)
    if len(words) and (short := (counts > 0) & (counts < WORDS)).any():
        # Pad short texts with a filler word, so that each has one shingle.
        missing = np.where(short, WORDS - counts, 0)
        at = np.repeat(np.cumsum(counts), missing)
        words = np.insert(words, at, np.uint64(1))
        docs = np.insert(docs, at, np.repeat(np.arange(n), missing))
    grams, at = ragged.ngram_hashes(words, docs, WORDS)
    owner = docs[at]
    weight = idf(words)
    sums = np.zeros(len(weight) + 1)
    np.cumsum(weight, out=sums[1:])
    mean = (sums[at + WORDS] - sums[at]) / WORDS
    order = ragged.by_owner(owner, grams)
    grams, owner, mean = grams[order], owner[order], mean[order]
    first = np.ones(len(grams), dtype=bool)
    first[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    heads = np.flatnonzero(first)
    return owner[heads], grams[heads], mean[heads], np.diff(np.append(heads, len(grams)))


def occurrences(texts: pa.Array, idf: Idf) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As :func:`shingles`, with the second, third ... time a text has a shingle as shingles of their own.

    Sets of those have the weighted similarity of the bags: what two texts
    share of a shingle is the lesser number of times.
    """
    owner, grams, weight, times = _counted(texts, idf)
    place = np.repeat(np.arange(len(grams)), times)
    nth = np.arange(len(place)) - np.repeat(np.cumsum(times) - times, times)
    again = nth > 0
    if not again.any():
        return owner, grams, np.round(weight, 6)
    owner, tokens = owner[place], grams[place]
    tokens[again] = ragged.mix(tokens[again] + nth[again].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = ragged.by_owner(owner, tokens)
    return owner[order], tokens[order], np.round(weight, 6)[place][order]


def band_keys(texts: pa.Array, idf: Idf) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (texts x bands) of the sampled signatures, and which texts have words at all."""
    owner, grams, weight = shingles(texts, idf)
    n = len(texts)
    has = np.bincount(owner, minlength=n) > 0
    keys = np.zeros((n, BANDS), dtype=np.uint64)
    if not len(grams):
        return keys, has
    heads = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    low, high = (grams & np.uint64(0xFFFFFFFF)).astype(np.uint32), (grams >> np.uint64(32)).astype(np.uint32)
    log_s = np.log(weight).astype(np.float32)
    signature = np.empty((len(heads), BANDS * ROWS), dtype=np.uint32)
    # Buffers are reused: the loop below is nearly all of the operator's time.
    hashed, cell = np.empty(len(low), np.uint32), np.empty(len(low), np.intp)
    t, x, r = (np.empty(len(low), np.float32) for _ in range(3))

    def cells(half: np.ndarray, k: int) -> np.ndarray:
        np.multiply(half, _A[k], out=hashed)
        np.add(hashed, _B[k], out=hashed)
        return np.right_shift(hashed, np.uint32(32 - _TABLE_BITS), out=cell, casting="unsafe")

    for k in range(BANDS * ROWS):
        # t = floor(ln S / r + beta); ln a = ln c - r (t - beta + 1)
        cells(low, k)
        np.multiply(np.take(_INVERSE_R, cell, out=t, mode="clip"), log_s, out=t)
        np.floor(np.add(t, np.take(_BETA, cell, out=x, mode="clip"), out=t), out=t)
        np.multiply(t, np.take(_R, cell, out=r, mode="clip"), out=t)
        np.subtract(np.take(_SHIFT, cell, out=x, mode="clip"), t, out=t)
        np.add(t, np.take(_LOG_C, cells(high, k), out=x, mode="clip"), out=t)
        # The least ln a identifies its sample (shingle and t).
        signature[:, k] = np.minimum.reduceat(t, heads).view(np.uint32)
    rows = signature.astype(np.uint64).reshape(len(heads), BANDS, ROWS)
    mixed = np.zeros((len(heads), BANDS), dtype=np.uint64)
    for j in range(ROWS):
        mixed = ragged.mix(mixed * np.uint64(31) + rows[:, :, j] + np.uint64(j))
    keys[owner[heads]] = ragged.mix(mixed + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return keys, has


def document_frequencies(docs: DataFrame) -> Idf:
    """The weights of words, from the exact document frequencies of all rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, counts, rows = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
        for batch in batches:
            more, n, some = _word_counts(batch.column("text"))
            ids, counts = _summed(np.append(ids, more), np.append(counts, n))
            rows += some
            if len(ids) > 1 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(ids.view(np.int64)), pa.array(counts)], ["id", "n"])
                ids, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(ids.view(np.int64), -1)), pa.array(np.append(counts, rows))], ["id", "n"])

    counted = docs.select("text").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    with temporary(docs.sparkSession):
        counted = materialise(counted, "near-words")
        rows = counted.where("id = -1").agg(F.sum("n")).first()[0] or 0
        held = counted.where("id <> -1").agg(F.sum("n")).first()[0] or 0
        # At most held / least words have that count.
        least = max(RARE * rows, held / MAX_WORDS)
        found = counted.where((F.col("id") != -1) & (F.col("n") > least)).toArrow()
    return Idf(found.column("id").to_numpy().view(np.uint64), found.column("n").to_numpy(), rows, max(RARE, least / max(rows, 1)))


def idf_of_texts(texts: list[str | None]) -> Idf:
    """The same of a small corpus in memory."""
    ids, counts, rows = _word_counts(pa.array(texts, pa.string()))
    return Idf(ids, counts, rows)


def text_node(text: Column) -> Column:
    """The first 64 bits of the text's MD5 as a long; null text as empty."""
    return F.conv(F.substring(F.md5(F.coalesce(text, F.lit("")).cast("binary")), 1, 16), 16, -10).cast("long")


def signatures(docs: DataFrame, idf) -> DataFrame:
    """doc_id, node (64 bits of the text's MD5; null text as empty) and bands (empty for texts without words) of every row."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            keys, has = [np.zeros((0, BANDS), dtype=np.uint64)], [np.zeros(0, dtype=bool)]
            for a, b in ragged.groups(texts, _GROUP):
                k, h = band_keys(texts.slice(a, b - a), idf.value)
                keys.append(k)
                has.append(h)
            k, h = np.concatenate(keys), np.concatenate(has)
            offsets = np.concatenate([[0], np.cumsum(h * BANDS)]).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(offsets), pa.array(k[h].ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("node"), bands], ["doc_id", "node", "bands"])

    rows = docs.select("doc_id", "text", text_node(F.col("text")).alias("node"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(sign, f"doc_id {kind}, node long, bands array<bigint>")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Every row's class: doc_id, node, class_id (least doc_id of the class), class_size (rows) and kept.

    ``kept`` is true for the row of the class's id (and least node, should
    texts share the id); exactly repeated rows share it.  Null text counts as empty, and texts without words are alike only if
    equal.  A null id sorts before all others and makes a null class_id.
    """
    spark = docs.sparkSession
    idf = spark.sparkContext.broadcast(document_frequencies(docs))
    signed = materialise(signatures(docs, idf), "near-signed")
    # Null ids first: a struct of (is it set, id) compares as wanted.
    order = F.struct(F.col("doc_id").isNotNull().alias("set"), F.col("doc_id").alias("id"))
    nodes = materialise(signed.groupBy("node").agg(F.min(order).alias("least"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands")), "near-nodes")

    def fetch(wanted: DataFrame) -> DataFrame:
        wanted = wanted.join(nodes.select("node", F.col("least.id").alias("_near_id")), "node")
        by_id = docs.select("doc_id", "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("_near_id"))).where(text_node(F.col("text")) == F.col("node"))
        return materialise(by_id.select("node", "text").dropDuplicates(["node"]), "near-texts")

    members = nodes.select("node", F.explode("bands").alias("band"))
    labels = link(members, fetch, lambda texts: occurrences(texts, idf.value), similarity, "near")
    labelled = nodes.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"), "least", "copies")
    keeper = F.min(F.struct("least", "node")).alias("keeper")
    classes = labelled.groupBy("label").agg(keeper, F.sum("copies").alias("class_size"))
    of_node = labelled.select("node", "label").join(classes, "label")
    of_node = of_node.select("node", F.col("keeper.least.id").alias("class_id"), "class_size", F.col("keeper.node").alias("class_node"))
    kept = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("node") == F.col("class_node"))
    return signed.select("doc_id", "node").join(of_node, "node").select("doc_id", "node", "class_id", "class_size", kept.alias("kept"))


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each class of near duplicates: the one of the least doc_id; columns as they were."""
    found = near_duplicates(docs, similarity)
    rows = found.groupBy("doc_id", "node").agg(F.first("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    # Written first, so that Spark broadcasts it only within its own threshold.
    away = materialise(rows.where("not kept or n > 1").select(F.col("doc_id").alias("_near_id"), F.col("node").alias("_near_node"), F.col("kept").alias("_near_kept")), "near-away")
    node = text_node(F.col("text"))
    same = docs["doc_id"].eqNullSafe(away["_near_id"]) & (node == away["_near_node"])
    once = docs.join(away, same, "left_anti")
    repeated = away.where("_near_kept")
    if repeated.isEmpty():
        return once
    # Kept rows that the input holds several times: one of each.
    again = docs.join(repeated, docs["doc_id"].eqNullSafe(repeated["_near_id"]) & (node == repeated["_near_node"]))
    return once.union(again.dropDuplicates(["_near_id", "_near_node"]).select(docs.columns))
