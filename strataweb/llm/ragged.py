"""Vectorised work on an Arrow batch of texts: words, their hashes, n-grams.

A batch is a flat byte array and the texts' offsets into it; everything below
is NumPy over those, in bounded segments, so that one very long text costs a
few bytes of memory for each of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Rows of a batch are taken in groups of about this many bytes.
GROUP_BYTES = 2 << 20
_SEGMENT = 1 << 20
_P = 0x9E3779B97F4A7C15 | 1
_P_INVERSE = pow(_P, -1, 1 << 64)
_WORDS = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_MULTIPLIERS = np.random.default_rng(7).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def lower_table() -> np.ndarray:
    """Bytes with A-Z lower-cased."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def alnum_table() -> np.ndarray:
    """Which bytes belong to words of ASCII letters, digits and non-ASCII characters."""
    table = np.zeros(256, dtype=bool)
    for lo, hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
        table[lo:hi] = True
    return table


def nonspace_table() -> np.ndarray:
    """Which bytes are not ASCII white space."""
    table = np.ones(256, dtype=bool)
    table[[32, 9, 10, 11, 12, 13]] = False
    return table


LOWER, ALNUM, NONSPACE = lower_table(), alnum_table(), nonspace_table()


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offsets of each; null is empty."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if texts.buffers()[2] is None or len(texts) == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(texts) + 1, dtype=np.int64)
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def groups(texts: pa.Array, most: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes each, one row at least."""
    _, offsets = text_bytes(texts)
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, min(to, n)
        at = to


def word_spans(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the maximal runs of ``member`` bytes; no run crosses two texts."""
    return run_spans(member[data], offsets)


def run_spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As :func:`word_spans`, for a mask over the bytes."""
    if not len(inside):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    edge = np.zeros(len(inside) + 1, dtype=bool)
    edge[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    finishes = inside.copy()
    finishes[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def _power(n: int, base: int, name: str) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        steps = np.full(max(n, _SEGMENT), base, dtype=np.uint64)
        steps[0] = 1
        have = _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    t = h >> np.uint64(33)
    h = h ^ t
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= np.right_shift(h, np.uint64(29), out=t)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= np.right_shift(h, np.uint64(32), out=t)
    return h


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes: a polynomial's prefix sums, then a mixer."""
    out = np.zeros(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        low = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, low + _SEGMENT, "right")))
        high = ends[to - 1]
        part = _WORDS[data[low:high]] * _power(high - low, _P, "up")
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(part, out=sums[1:])
        out[at:to] = (sums[ends[at:to] - low] - sums[starts[at:to] - low]) * _power(high - low, _P_INVERSE, "down")[starts[at:to] - low]
        out[at:to] += (ends[at:to] - starts[at:to]).astype(np.uint64) * _MULTIPLIERS[63]
        at = to
    return mix(out)


def ngram_hashes(words: np.ndarray, docs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``n`` words within one text, and where each begins."""
    if len(words) < n:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    whole = len(words) - n + 1
    sums = np.zeros(whole, dtype=np.uint64)
    for j in range(n):
        sums += words[j : j + whole] * _MULTIPLIERS[j]
    at = np.flatnonzero(docs[:whole] == docs[n - 1 :])
    return mix(sums[at]), at


def by_owner(owner: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The order by owner, then hash (its leading 40 bits at least)."""
    bits = np.uint64(int(owner.max()).bit_length() if len(owner) else 0)
    if not bits:
        return np.argsort(hashes)
    return np.argsort((owner.astype(np.uint64) << (np.uint64(64) - bits)) | (hashes >> bits))


def per_text(docs: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(docs, weights=weights, minlength=n)


def repeats(hashes: np.ndarray, docs: np.ndarray, n: int) -> np.ndarray:
    """How many entries of each text equal an earlier entry of the same text."""
    if not len(hashes):
        return np.zeros(n, dtype=np.int64)
    keys = mix(hashes + docs.astype(np.uint64) * _MULTIPLIERS[62])
    order = np.sort(keys)
    firsts = np.ones(len(order), dtype=bool)
    firsts[1:] = order[1:] != order[:-1]
    # Counted back by text: distinct keys of each text come from the sorted keys' owners.
    owner = docs[np.argsort(keys, kind="stable")]
    return np.bincount(docs, minlength=n) - np.bincount(owner[firsts], minlength=n)


def prefix_sums(items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Polynomial prefix sums and inverse powers: ``(sums[b] - sums[a]) * inverse[a]`` identifies ``items[a:b]`` among runs of its length."""
    sums = np.zeros(len(items) + 1, dtype=np.uint64)
    np.cumsum(items * _power(len(items), _P, "up"), out=sums[1:])
    return sums, _power(len(items) + 1, _P_INVERSE, "down")


def run_hashes(items: np.ndarray, begins: np.ndarray, finishes: np.ndarray) -> np.ndarray:
    """A hash of each run ``items[begin:finish]`` of 64-bit hashes."""
    return summed_hashes(*prefix_sums(items), begins, finishes)


def summed_hashes(sums: np.ndarray, inverse: np.ndarray, begins: np.ndarray, finishes: np.ndarray) -> np.ndarray:
    """:func:`run_hashes` from the items' :func:`prefix_sums`."""
    return mix((sums[finishes] - sums[begins]) * inverse[begins] + (finishes - begins).astype(np.uint64) * _MULTIPLIERS[61])
