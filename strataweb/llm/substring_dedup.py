"""Substring deduplication by hashing normalised text units.

A unit is a line and, in lines of several sentences, each sentence.  A sentence
ends at the first white space after a stop with no word between them, or, after
a wide stop (U+3002 and the like), where the next word begins.  Units are
normalised (A-Z lower-cased, only words kept) and hashed to 128 bits; the
digests are grouped over the corpus, the occurrence ranked first (by doc_id)
stays, and all others are removed from their texts, unless they stand alone and
are short: a stock phrase is no repeated passage.  Their offsets in the
original text are kept.

Only digests, ids and offsets are shuffled to find repeats.  Minima are
aggregated before the shuffle, so a line that a third of all documents hold
costs one row a task; the join back to the occurrences is one that Spark can
split when a digest is that frequent.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import ragged
from .common import materialise

#: Shorter units have no digest; ``CHARS`` characters count as a word in scripts without spaces.
MIN_WORDS = 5
CHARS = 4
#: Repeated units that follow each other are removed if they have so many words together, ...
MIN_RUN = 20
#: ... where so many characters between them (too short a sentence, say) don't end a run.
GAP = 16
#: Stops that need no white space behind them.
WIDE_STOPS = "\u3002\uff01\uff0e\uff1f\uff61\u0964\u0965"
#: Thai to Myanmar, Khmer, kana and Chinese characters.
UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3041, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF))
_WORD, _SPACE, _STOP, _WIDE, _UNSPACED = 0, 1, 2, 4, 8
_MARK = 16


def _kinds() -> np.ndarray:
    """What each code point of the first two planes is: a mark (anything between words), white space, a stop; others belong to words."""
    kinds = np.zeros(1 << 17, dtype=np.uint8)
    for point in range(128, len(kinds)):
        if unicodedata.category(chr(point))[0] in "PSZ":
            kinds[point] = _MARK | (_SPACE if chr(point).isspace() else 0)
    kinds[:128] = np.where(ragged.ALNUM[:128], _WORD, _MARK)
    kinds[[9, 11, 12, 13, 32]] |= _SPACE
    kinds[[ord(c) for c in ".!?"]] |= _STOP
    kinds[[ord(c) for c in WIDE_STOPS]] |= _STOP | _WIDE
    for low, high in UNSPACED:
        kinds[low : high + 1][kinds[low : high + 1] == _WORD] = _UNSPACED
    return kinds


_KINDS = _kinds()


def _byte_kinds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(kinds, last): the kind of the character that each byte belongs to, and which bytes end a character."""
    if not len(data) or data.max() < 128:
        return _KINDS[data], np.ones(len(data), dtype=bool)
    kinds = _KINDS[data & 0x7F]
    heads = np.flatnonzero((data >= 0xC0))
    sizes = 2 + (data[heads] >= 0xE0) + (data[heads] >= 0xF0)
    points = data[heads].astype(np.int64) & (0x7F >> sizes)
    for k in range(1, 4):
        more = sizes > k
        points[more] = points[more] << 6 | (data[heads[more] + k] & 0x3F)
    found = np.where(points < len(_KINDS), _KINDS[np.minimum(points, len(_KINDS) - 1)], _WORD)
    for k in range(4):
        at = sizes > k
        kinds[heads[at] + k] = found[at]
    last = data < 128
    last[heads + sizes - 1] = True
    return kinds, last


def _pauses(kinds: np.ndarray, last: np.ndarray, newline: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The bytes that end a sentence within a line."""
    pause = np.zeros(len(kinds), dtype=bool)
    r0, r1, _ = ragged.run_spans((kinds & _MARK != 0) & ~newline, offsets)

    def first(mask: np.ndarray, since: np.ndarray) -> np.ndarray:
        """The first byte of the mask not before ``since``, or the end of all."""
        at = np.flatnonzero(mask)
        return np.append(at, len(kinds))[np.searchsorted(at, since)]

    stop = first(last & (kinds & _STOP != 0), r0)
    r0, r1, stop = r0[stop < r1], r1[stop < r1], stop[stop < r1]
    space = first(last & (kinds & _SPACE != 0), stop)
    pause[space[space < r1]] = True
    wide = first(last & (kinds & _WIDE != 0), r0)
    # At a line's end the newline ends the sentence too.
    pause[r1[(space >= r1) & (wide < r1) & ~np.append(newline, False)[r1]] - 1] = True
    return pause


_OTHER = np.uint64(0x5851F42D4C957F2D)


def text_units(texts: pa.Array, min_words: int = MIN_WORDS) -> dict[str, np.ndarray]:
    """Units of at least ``min_words`` words: text number, 128-bit digest, character offsets [start, end), and whether an earlier unit of the text is equal.

    A unit's span takes in the newline, space or mark that ends it.  Words are
    runs without white space, punctuation or symbols; ``CHARS`` characters of a
    script without spaces count as a word.
    """
    data, offsets = ragged.text_bytes(texts)
    newline = data == 10
    kinds, last = _byte_kinds(data)
    pause = _pauses(kinds, last, newline, offsets)
    s0, s1, s_doc = ragged.run_spans(~(newline | pause), offsets)
    l0, l1, l_doc = ragged.run_spans(~newline, offsets)
    # Lines of one sentence are that sentence already.
    several = np.searchsorted(s0, l1) - np.searchsorted(s0, l0) > 1
    begin, end, doc = np.append(s0, l0[several]), np.append(s1, l1[several]), np.append(s_doc, l_doc[several])
    w0, w1, _ = ragged.run_spans(kinds & _MARK == 0, offsets)
    words = ragged.span_hashes(ragged.LOWER[data], w0, w1)
    a, b = np.searchsorted(w0, begin), np.searchsorted(w0, end)
    unspaced = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(last & (kinds == _UNSPACED), out=unspaced[1:])
    long = np.maximum(b - a, (unspaced[end] - unspaced[begin]) // CHARS)
    use = long >= min_words
    begin, end, doc, a, b, long = begin[use], end[use], doc[use], a[use], b[use], long[use]
    order = np.lexsort((begin, doc))
    begin, end, doc, a, b, long = begin[order], end[order], doc[order], a[order], b[order], long[order]
    high, low = ragged.run_hashes(words, a, b), ragged.run_hashes(ragged.mix(words ^ _OTHER), a, b)
    chars = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=chars[1:])
    base = chars[offsets[doc]]
    closed = np.minimum(end + 1, offsets[doc + 1])
    key = ragged.mix(high + doc.astype(np.uint64) * _OTHER)
    again = np.ones(len(key), dtype=bool)
    again[np.unique(key, return_index=True)[1]] = False
    return {"doc": doc, "high": high, "low": low, "start": chars[begin] - base, "end": chars[closed] - base, "words": long, "again": again}


def units(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, node (64-bit hash of the text), high, low (the digest), start, end, words and again of every unit."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("node"), "text")
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in ("node", "high", "low")), *(T.StructField(c, T.IntegerType()) for c in ("start", "end", "words")), T.StructField("again", T.BooleanType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for x, y in ragged.groups(texts):
                found = text_units(texts.slice(x, y - x), min_words)
                at = pa.array(found["doc"] + x)
                digests = [pa.array(found[c].view(np.int64)) for c in ("high", "low")]
                places = [pa.array(found[c].astype(np.int32)) for c in ("start", "end", "words")]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("node").take(at), *digests, *places, pa.array(found["again"])], schema.names)

    return rows.mapInArrow(cut, schema)


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS, min_run: int = MIN_RUN) -> DataFrame:
    """doc_id, node and removed: the spans (start, end, first_doc_id) that repeat an earlier unit, by start.

    Only documents with such spans have a row.  Rank is the doc_id, of any type
    that has an order, then the text's hash, then the place in the text; a null
    id comes first.  Rows that share id and text are one document.  Repeated
    units that follow each other count together; runs of fewer than
    ``min_run`` words stay.
    """
    found = materialise(units(docs, min_words), "substring-units")
    digest, once = ["high", "low"], found.where("not again")
    firsts = once.groupBy(*digest).agg(
        F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.bool_or(F.col("doc_id").isNull()).alias("unset"), F.min("node").alias("n1"), F.max("node").alias("n2")
    )
    several = (F.col("first") != F.col("last")) | (F.col("n1") != F.col("n2")) | (F.col("unset") & F.col("first").isNotNull())
    firsts = firsts.where(several).select(*digest, F.when(~F.col("unset"), F.col("first")).alias("first_doc_id"))
    # Written, so that both sides of the join below are plain shuffles.
    firsts = materialise(firsts, "substring-firsts")
    met = once.join(firsts, digest)
    spans = ["doc_id", "node", "start", "end", "words", "first_doc_id"]
    held = F.col("doc_id").eqNullSafe(F.col("first_doc_id"))
    away = met.where(~held).select(*spans).union(found.where("again").withColumn("first_doc_id", F.col("doc_id")).select(*spans))
    # Texts that share an id (or have none): of those ranked first, the least hash keeps the unit.
    shared = docs.groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("n1"), F.max(F.xxhash64("text")).alias("n2")).where("n1 <> n2")
    shared = materialise(shared.select(F.col("doc_id").alias("_shared_id")), "substring-shared")
    if not shared.isEmpty():
        tied = met.where(held).join(shared, F.col("doc_id").eqNullSafe(F.col("_shared_id")), "left_semi")
        tied = tied.join(tied.groupBy(*digest).agg(F.min("node").alias("n1")), digest).where(F.col("node") != F.col("n1"))
        away = away.union(tied.select(*spans))
    rows = away.groupBy("doc_id", "node").agg(F.collect_set(F.struct("start", "end", "words", "first_doc_id")).alias("removed"))
    kind = docs.schema["doc_id"].dataType
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("first_doc_id", kind)])
    schema = T.StructType([docs.schema["doc_id"], T.StructField("node", T.LongType()), T.StructField("removed", T.ArrayType(span))])

    def long_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("removed")
            row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            start, end, words = (lists.flatten().field(c).to_numpy() for c in ("start", "end", "words"))
            order = np.lexsort((-end, start, row))
            row, start, end, words = row[order], start[order], end[order], words[order]
            use = in_long_runs(row, start, end, words, min_run)
            firsts = lists.flatten().field("first_doc_id").take(pa.array(order[use]))
            kept = pa.StructArray.from_arrays([pa.array(start[use]), pa.array(end[use]), firsts], ["start", "end", "first_doc_id"])
            counts = np.bincount(row[use], minlength=len(lists))
            some = pa.array(np.flatnonzero(counts))
            listed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts[counts > 0])]), pa.int32()), kept)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(some), batch.column("node").take(some), listed], schema.names)

    return rows.mapInArrow(long_runs, schema)


def in_long_runs(row: np.ndarray, start: np.ndarray, end: np.ndarray, words: np.ndarray, min_run: int) -> np.ndarray:
    """Which spans (by row, start and falling end) lie in runs of ``min_run`` words; nested spans' words count once.

    A run goes on over at most ``GAP`` characters that are no repeated unit.
    """
    if not len(row):
        return np.zeros(0, dtype=bool)
    # The furthest end so far within the row.
    shift = row.astype(np.int64) << 32
    far = np.maximum.accumulate(shift + end)
    before = np.concatenate([[-1], far[:-1]])
    fresh = shift + start > before + GAP
    fresh |= np.concatenate([[True], row[1:] != row[:-1]])
    run = np.cumsum(fresh) - 1
    top = fresh | (shift + start >= before)
    return np.bincount(run, np.where(top, words, 0))[run] >= min_run


def deduplicate(docs: DataFrame, min_words: int = MIN_WORDS, min_run: int = MIN_RUN, keep: list[str] | None = None) -> DataFrame:
    """Every row with its text cut, removed (the cut units with their original offsets), n_removed and removed_chars.

    Spans may nest (a line and its sentences); characters count once.  A null
    text stays null, an empty one empty.  Null ids and repeated rows as in
    :func:`repeated_spans`.  An input column of an added name is replaced.
    """
    return cut_spans(docs, repeated_spans(docs, min_words, min_run), keep)


def cut_spans(docs: DataFrame, spans: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``docs`` without the spans (doc_id, node, removed), as :func:`deduplicate` says."""
    added = ["removed", "n_removed", "removed_chars"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in added]
    spans = spans.select(F.col("doc_id").alias("_cut_id"), F.col("node").alias("_cut_node"), "removed")
    rows = docs.drop(*added).join(spans, F.col("doc_id").eqNullSafe(F.col("_cut_id")) & (F.xxhash64("text") == F.col("_cut_node")), "left")
    rows = rows.select(*(F.col(f"`{c}`") for c in keep), F.coalesce("removed", F.array().cast(spans.schema["removed"].dataType)).alias("removed"))
    schema = T.StructType([*rows.schema.fields, T.StructField("n_removed", T.IntegerType()), T.StructField("removed_chars", T.LongType())])
    place = rows.columns.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(batch.num_columns - 1)
            count = pa.array(spans.value_lengths().fill_null(0), pa.int32())
            texts, gone = batch.column(place).to_pylist(), np.zeros(batch.num_rows, dtype=np.int64)
            for i in np.flatnonzero(count.to_numpy()):
                left, at = [], 0
                for span in spans[i].as_py():
                    left.append(texts[i][at : max(at, span["start"])])
                    gone[i] += max(0, span["end"] - max(at, span["start"]))
                    at = max(at, span["end"])
                texts[i] = "".join(left) + texts[i][at:]
            columns = list(batch.columns)
            columns[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, count, pa.array(gone)], schema.names)

    return rows.mapInArrow(cut, schema)
