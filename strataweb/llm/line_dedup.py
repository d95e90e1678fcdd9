"""Fuzzy line deduplication by MinHash.

Lines are normalised (A-Z lower-cased, words joined by one space) and become
sets of ``SHINGLE`` characters.  MinHash signatures are cut into bands for a
recall of 0.998 at the threshold; lines that share a band are verified by their exact
Jaccard similarity and linked; a distributed union-find gives components, of
which the line ranked first (doc_id, then place) stays.

Equal normalised lines collapse to one node first, so signatures' buckets hold
distinct lines only.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import ragged
from .common import materialise, temporary
from .linking import gather, link_gathered
from .substring_dedup import cut_spans

SHINGLE = 8
SIMILARITY = 0.8
BANDS, ROWS = 12, 4
#: Bands are gathered, and documents searched for lines, in so many parts one after another; the disk holds one part's shuffle.
BAND_PARTS, TEXT_PARTS = 3, 3
#: Bytes of texts whose lines are signed at once, so that the arrays stay in a core's cache, and lines that are sent on together.
GROUP_BYTES, SENT_LINES = 128 << 10, 1 << 14
#: Shorter normalised lines are left alone.
MIN_CHARS = 20
_rng = np.random.default_rng(2718)
_A = _rng.integers(1, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
del _rng


def _characters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts and each text's offset in them; null is empty."""
    texts = ["" if t is None else t for t in texts.to_pylist()]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32), offsets


def _point_tables() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point: whether words hold it, and the hash of its normalised character."""
    points = np.arange(0x110000, dtype=np.uint64)
    inside = ragged.ALNUM[np.minimum(points, 255).astype(np.uint8)]
    points[65:91] += np.uint64(32)
    return inside, ragged.mix(np.where(inside, points, np.uint64(32)) + np.uint64(1))


_INSIDE, _HASHED = _point_tables()


class Lines:
    """The lines of a group of texts that are long enough, and their normalised characters."""

    def __init__(self, texts: pa.Array, min_chars: int):
        points, offsets = _characters(texts)
        points = points.astype(np.intp)
        inside = _INSIDE[points]
        filled = points != 10
        before = np.zeros(len(points), dtype=bool)
        before[:-1] = inside[1:]
        # The next text's first word is no part of this text's last line.
        before[offsets[1:][offsets[1:] > 0] - 1] = False
        starts, ends, docs = ragged.run_spans(filled, offsets)
        before &= filled
        kept = np.flatnonzero(inside | before)
        lo, hi = np.searchsorted(kept, starts), np.searchsorted(kept, ends)
        use = hi - lo >= max(min_chars, SHINGLE)
        self.doc = docs[use]
        self.start = starts[use] - offsets[self.doc]
        self.end = np.minimum(ends[use] + 1, offsets[self.doc + 1]) - offsets[self.doc]
        lo, hi = lo[use], hi[use]
        sums, inverse = ragged.prefix_sums(_HASHED[points[kept]])
        self.node = ragged.summed_hashes(sums, inverse, lo, hi)
        # Every shingle of every used line, line after line.
        n = hi - lo - SHINGLE + 1
        self.heads = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
        at = np.repeat(lo - self.heads[:-1], n) + np.arange(self.heads[-1])
        runs = sums[SHINGLE:] - sums[:-SHINGLE]
        runs *= inverse[: len(runs)]
        self.shingles = ragged.mix(runs[at])

    @property
    def line(self) -> np.ndarray:
        """The line's number of each shingle."""
        return np.repeat(np.arange(len(self.node)), np.diff(self.heads))

    def band_keys(self) -> np.ndarray:
        """The keys of every line, a row for each band."""
        keys = np.zeros((BANDS, len(self.node)), dtype=np.uint64)
        if not len(self.node):
            return keys
        low = (self.shingles >> np.uint64(32)).astype(np.uint32)
        least, buffer = np.empty((BANDS * ROWS, len(self.node)), dtype=np.uint32), np.empty_like(low)
        for k in range(BANDS * ROWS):
            np.multiply(low, _A[k], out=buffer)
            np.add(buffer, _B[k], out=buffer)
            np.minimum.reduceat(buffer, self.heads[:-1], out=least[k])
        for r in range(ROWS):
            keys = ragged.mix(keys * np.uint64(31) + least[r::ROWS])
        return ragged.mix(keys + (np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None])


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, hash and weight (1) of each distinct shingle of the texts' only lines, by text and hash."""
    lines = Lines(texts, SHINGLE)
    owner = lines.doc[lines.line]
    order = ragged.by_owner(owner, lines.shingles)
    owner, values = owner[order], lines.shingles[order]
    first = np.ones(len(values), dtype=bool)
    first[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return owner[first], values[first], np.ones(int(first.sum()))


def signed_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, node (64-bit hash of the text), line (of the normalised line), start, end (character offsets) and a column for each band (band0, band1, ...) of every line that counts."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("node"), "text")
    long, integer = T.LongType(), T.IntegerType()
    kinds = {"node": long, "line": long, "start": integer, "end": integer} | {f"band{k}": long for k in range(BANDS)}
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(c, t) for c, t in kinds.items())])

    def sent(batch: pa.RecordBatch, found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        at, line, start, end, bands = (np.concatenate(x, axis=-1) for x in zip(*found, strict=True))
        columns = [pa.array(line.view(np.int64)), pa.array(start, pa.int32()), pa.array(end, pa.int32()), *map(pa.array, bands.view(np.int64))]
        return pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(at)) for c in ("doc_id", "node")] + columns, schema.names)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found, n = batch.column("text"), [], 0
            for x, y in ragged.groups(texts, GROUP_BYTES):
                lines = Lines(texts.slice(x, y - x), min_chars)
                found.append((lines.doc + x, lines.node, lines.start, lines.end, lines.band_keys()))
                n += len(lines.node)
                if n >= SENT_LINES or y == len(texts):
                    yield sent(batch, found)
                    found, n = [], 0

    return rows.mapInArrow(sign, schema)


def line_texts(docs: DataFrame, lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """node and text of the wanted lines, each cut from one document that holds it."""
    one = lines.join(wanted.withColumnRenamed("node", "line"), "line").dropDuplicates(["line"])
    spans = one.groupBy(F.col("doc_id").alias("_line_doc"), F.col("node").alias("_line_node")).agg(F.collect_list(F.struct("line", "start", "end")).alias("spans"))
    spans = materialise(spans, "line-spans")
    same = F.col("doc_id").eqNullSafe(F.col("_line_doc")) & (F.xxhash64("text") == F.col("_line_node"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column("spans")
            flat, counts = spans.flatten(), spans.value_lengths().to_pylist()
            places, found = zip(flat.field("start").to_pylist(), flat.field("end").to_pylist(), strict=True), []
            for text, n in zip(batch.column("text"), counts, strict=True):
                text = text.as_py()
                found += [text[start:end].rstrip("\n") for start, end in islice(places, n)]
            yield pa.RecordBatch.from_arrays([flat.field("line"), pa.array(found, pa.string())], ["node", "text"])

    def part(k: int) -> DataFrame:
        mine = [t.where(F.pmod(F.xxhash64(c), F.lit(TEXT_PARTS)) == k) for t, c in ((docs.select("doc_id", "text"), "doc_id"), (spans, "_line_doc"))]
        rows = mine[0].join(mine[1], same).select("text", "spans")
        return materialise(rows.mapInArrow(cut, "node long, text string").dropDuplicates(["node"]), "line-texts")

    # A line is cut from one document, so it is in one part.
    return reduce(DataFrame.union, [part(k) for k in range(TEXT_PARTS)])


def repeated_lines(docs: DataFrame, similarity: float = SIMILARITY, min_chars: int = MIN_CHARS) -> tuple[DataFrame, DataFrame]:
    """(spans, lines): the lines to remove, as doc_id, node and removed (start, end, first_doc_id by start), and all lines that count.

    Rank is the doc_id, then the place in the text; a null id comes first.
    Rows that share id and text are one document.
    """
    # The bands, most of the signed lines' bytes, go as soon as they are gathered.
    with temporary(docs.sparkSession):
        # Hashes have nothing that a dictionary saves.
        signed = materialise(signed_lines(docs, min_chars), "line-signed", options={"parquet.enable.dictionary": "false"})
        bands = [f"band{k}" for k in range(BANDS)]
        lines = materialise(signed.drop(*bands), "line-places", keep=True)
        each = -(-BANDS // BAND_PARTS)
        members = [signed.select(F.col("line").alias("node"), *bands[k : k + each]) for k in range(0, BANDS, each)]
        gathered = gather(members, "line")
    labels = link_gathered(*gathered, lambda wanted: line_texts(docs, lines, wanted), shingles, similarity, "line")
    # Only lines that are not the only one of their component go further: those with a label, whose component has two nodes or more, and repeated ones.
    counted = lines.groupBy("line").agg(F.count(F.lit(1)).alias("n")).join(labels.withColumnRenamed("node", "line"), "line", "left")
    several = materialise(counted.where("label is not null or n > 1").select("line", F.coalesce("label", "line").alias("label")), "line-several")
    held = materialise(lines.select("doc_id", "node", "line", "start", "end").join(several, "line").drop("line"), "line-held")
    rank = F.struct(F.col("doc_id").isNotNull().alias("set"), F.col("doc_id").alias("id"), "start", "node")
    firsts = held.groupBy("label").agg(F.min(rank).alias("least"), F.max(rank).alias("last")).where("least <> last").select("label", "least")
    firsts = materialise(firsts, "line-firsts")
    later = held.join(firsts, "label").where(~(F.col("doc_id").eqNullSafe(F.col("least.id")) & (F.col("start") == F.col("least.start")) & (F.col("node") == F.col("least.node"))))
    span = F.struct("start", "end", F.col("least.id").alias("first_doc_id"))
    return later.groupBy("doc_id", "node").agg(F.sort_array(F.collect_set(span)).alias("removed")), lines


def report(docs: DataFrame, similarity: float = SIMILARITY, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, n_removed and removed (the lines to cut, with their original character offsets) of every row.

    Null and empty texts have no lines.
    """
    spans, _ = repeated_lines(docs, similarity, min_chars)
    rows = docs.select("doc_id", F.xxhash64("text").alias("node"))
    named = spans.select(F.col("doc_id").alias("_line_doc"), F.col("node").alias("_line_node"), "removed")
    joined = rows.join(named, rows["doc_id"].eqNullSafe(named["_line_doc"]) & (rows["node"] == named["_line_node"]), "left")
    removed = F.coalesce("removed", F.array().cast(named.schema["removed"].dataType))
    return joined.select("doc_id", F.size(removed).alias("n_removed"), removed.alias("removed"))


def deduplicate(docs: DataFrame, similarity: float = SIMILARITY, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with the repeated lines cut from their texts; adds removed, n_removed and removed_chars."""
    spans, _ = repeated_lines(docs, similarity, min_chars)
    return cut_spans(docs, spans)
