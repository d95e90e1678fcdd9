"""Quality rules: word and line counts, and repetition from a suffix array.

For every text a suffix array over its words is built (prefix doubling, for
all texts of a group at once).  Intervals of equal prefixes, that is of the
longest-common-prefix array, give the maximal repeated word sequences; their
occurrences' spans are united, and a text fails when they cover too much of
it or when one is too long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import ragged

#: Rules on the counts.
MIN_WORDS = 20
WINDOW = 8
MAX_WINDOW_PERCENT = 30
#: Rules on maximal repeats: those of at least so many words (more than WINDOW: passages, not phrases) count, ...
MIN_REPEAT = 12
#: ... may cover this share of the words, ...
MAX_COVERED = 0.2
#: ... and be this long, unless they make up less than MIN_LONG_SHARE of the text.
MAX_REPEAT = 100
_GROUP = 2 << 20
_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_LINE = np.ones(256, dtype=bool)
_LINE[10] = False


def _ranks(keys: np.ndarray) -> np.ndarray:
    """Dense ranks of the keys."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    step = np.zeros(len(keys), dtype=np.int64)
    step[1:] = np.cumsum(ranked[1:] != ranked[:-1])
    out = np.empty(len(keys), dtype=np.int64)
    out[order] = step
    return out


def suffix_array(words: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of the word sequences of all texts and the longest common prefix of each suffix with the one before.

    A suffix ends with its text; no common prefix spans two texts.  Prefix
    doubling sorts only the suffixes whose order is still open.
    """
    n = len(words)
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    # First by text, then by word.
    rank = _ranks(ragged.mix(words + docs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    order = np.argsort(rank, kind="stable")
    end = np.searchsorted(docs, docs, "right")  # where each word's text ends
    # Positions in the order of the groups of equal prefixes; a rank is its group's first position.
    heads = np.ones(n, dtype=bool)
    heads[1:] = rank[order][1:] != rank[order][:-1]
    first = np.flatnonzero(heads)
    rank[order] = first[np.cumsum(heads) - 1]
    lcp_floor = np.zeros(n, dtype=np.int64)  # of a suffix with the one before it in the order
    h = 1
    while True:
        tied = np.zeros(n, dtype=bool)
        tied[1:] = ~heads[1:]
        tied[:-1] |= ~heads[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        who = order[at]
        ahead = who + h
        inside = ahead < end[who]
        second = np.where(inside, rank[np.minimum(ahead, n - 1)] + 1, 0)
        sub = np.lexsort((second, rank[who]))
        who, second, group = who[sub], second[sub], rank[who][sub]
        order[at] = who
        new = np.ones(len(at), dtype=bool)
        new[1:] = (group[1:] != group[:-1]) | (second[1:] != second[:-1]) | (second[1:] == 0)
        opened = at[new & ~heads[at]]
        heads[opened] = True
        lcp_floor[opened] = h
        starts = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        rank[who] = starts
        h *= 2
    return order, _exact_lcp(words, order, lcp_floor, end)


def _exact_lcp(words: np.ndarray, order: np.ndarray, known: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Longest common prefixes of neighbours: at least ``known`` and less than twice it, so found by halving steps."""
    lcp = known.copy()
    open_ = np.flatnonzero(known)
    if not len(open_):
        return lcp
    one, two = order[open_ - 1], order[open_]
    have = known[open_]
    # Prefix sums of a polynomial compare runs of one length at once.
    sums, inverse = ragged.prefix_sums(words)
    step = int(have.max())
    while step >= 1:
        trial = have + step
        fits = (one + trial <= end[one]) & (two + trial <= end[two]) & (step <= known[open_])
        k = np.flatnonzero(fits)
        a, b = one[k] + have[k], two[k] + have[k]
        same = (sums[a + step] - sums[a]) * inverse[a] == (sums[b + step] - sums[b]) * inverse[b]
        have[k[same]] += step
        step //= 2
    lcp[open_] = have
    return lcp


def measures(texts: pa.Array) -> dict[str, np.ndarray]:
    """The counts, covered words and longest repeat of each whole text; null has no words."""
    parts = [_measures(texts.slice(a, b - a)) for a, b in ragged.groups(texts, _GROUP)]
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "longest_repeat"]
    return {k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, dtype=np.int64) for k in names}


def _covered(starts: np.ndarray, lengths: np.ndarray, docs: np.ndarray, n: int) -> np.ndarray:
    """Words of each text inside the union of the spans."""
    edges = np.zeros(len(docs) + 1, dtype=np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + lengths, -1)
    return np.bincount(docs[np.cumsum(edges[:-1]) > 0], minlength=n)


def _measures(texts: pa.Array) -> dict[str, np.ndarray]:
    data, offsets = ragged.text_bytes(texts)
    n = len(texts)
    starts, ends, docs = ragged.word_spans(data, offsets, ragged.NONSPACE)
    words = ragged.span_hashes(data, starts, ends)
    sums = np.zeros(len(data) + 1, dtype=np.int64)

    def count(mask: np.ndarray) -> np.ndarray:
        np.cumsum(mask, out=sums[1:])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    symbols = count(_SYMBOLS[data])
    chars = count(ragged.NONSPACE[data] & ((data & 0xC0) != 0x80))
    line_starts, line_ends, line_docs = ragged.word_spans(data, offsets, _LINE)
    np.cumsum(ragged.NONSPACE[data], out=sums[1:])
    worded = sums[line_ends] > sums[line_starts]
    lines = ragged.span_hashes(data, line_starts[worded], line_ends[worded])

    order, lcp = suffix_array(words, docs)
    longest = lcp.copy()
    longest[:-1] = np.maximum(longest[:-1], lcp[1:])
    repeat = np.zeros(len(words), dtype=np.int64)  # longest repeated prefix of each suffix
    repeat[order] = longest
    windows = np.flatnonzero(repeat >= WINDOW)
    spans = np.flatnonzero(repeat >= MIN_REPEAT)
    most = np.zeros(n, dtype=np.int64)
    np.maximum.at(most, docs, repeat)
    return {
        "n_words": np.bincount(docs, minlength=n),
        "word_chars": chars,
        "n_symbols": symbols,
        "n_dup_lines": ragged.repeats(lines, line_docs[worded], n),
        "n_repeat_words": _covered(windows, np.full(len(windows), WINDOW), docs, n),
        "n_covered": _covered(spans, repeat[spans], docs, n),
        "longest_repeat": most,
    }


def judge(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Adds the counts (long), longest_repeat, base_failed and kept to every row.

    ``base_failed``: fewer than ``MIN_WORDS`` words, or over
    ``MAX_WINDOW_PERCENT`` of the words in windows of ``WINDOW`` words found
    twice.  ``kept``: not that, maximal repeats of at least ``MIN_REPEAT``
    words cover at most ``MAX_COVERED`` of the words, and the longest is
    within ``MAX_REPEAT`` words or within a tenth of the text.  Null and empty texts have no words and
    fail.  Repeated rows are judged alike; an input column of an added name is
    replaced.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "longest_repeat"]
    added = [*names, "base_failed", "kept"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in added]
    kept = docs.select(*(F.col(f"`{c}`") for c in keep), F.col("text").alias("_rules_text"))
    schema = T.StructType([*kept.schema.fields[:-1], *(T.StructField(c, T.LongType()) for c in names)])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = measures(batch.column(batch.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(found[c].astype(np.int64)) for c in names)], schema.names)

    rows = kept.mapInArrow(measure, schema)
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_WINDOW_PERCENT)
    own = (F.col("n_covered") <= F.col("n_words") * MAX_COVERED) & (F.col("longest_repeat") <= F.greatest(F.lit(MAX_REPEAT), F.col("n_words") * 0.1))
    return rows.select("*", failed.alias("base_failed"), (~failed & own).alias("kept"))
