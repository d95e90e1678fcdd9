"""Edit-aware token counts.

Each document keeps a segment tree over its pre-tokens: leaves hold the
characters and tokens of ``LEAF`` pre-tokens, inner nodes the sums.  An edit
re-encodes from the leaf before its first character on, until a pre-token
boundary falls on an old leaf boundary behind it; those leaves are replaced
and only the sums above them change.

The vocabulary is a rank file; its path is a parameter, the same on every
executor, and the file is read once by each worker.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where the rank file lies, unless another path is given.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern that splits texts before the merges of that file: fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEAF = 64
_CACHED = 500_000


class PieceCounts(dict):
    """Tokens of a pre-token, encoded at its first use; emptied when it grows beyond a bound."""

    def __init__(self, path: str, pattern: str = PATTERN):
        super().__init__()
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("strataweb", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)

    def __missing__(self, piece: str) -> int:
        if len(self) >= _CACHED:
            self.clear()
        n = self[piece] = len(self.encoding.encode_ordinary(piece))
        return n


_loaded: dict[tuple[str, str], PieceCounts] = {}


def piece_counts(path: str = RANKS, pattern: str = PATTERN) -> PieceCounts:
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = PieceCounts(path, pattern)
    return _loaded[path, pattern]


class TokenTree:
    """The segment tree of one text: sums of characters and tokens over its leaves."""

    def __init__(self, chars: np.ndarray, tokens: np.ndarray):
        self.leaves = len(chars)
        self.size = 1 << max(0, (self.leaves - 1).bit_length())
        self.sums = np.zeros((2 * self.size, 2), dtype=np.int64)
        self.sums[self.size : self.size + self.leaves, 0] = chars
        self.sums[self.size : self.size + self.leaves, 1] = tokens
        for level in range(self.size.bit_length() - 2, -1, -1):
            low = 1 << level
            self.sums[low : 2 * low] = self.sums[2 * low : 4 * low : 2] + self.sums[2 * low + 1 : 4 * low : 2]

    @classmethod
    def of(cls, text: str, counts: PieceCounts) -> TokenTree:
        pieces = counts.pattern.findall(text)
        return cls(*leaves_of([len(p) for p in pieces], [counts[p] for p in pieces]))

    @property
    def chars(self) -> np.ndarray:
        return self.sums[self.size : self.size + self.leaves, 0]

    @property
    def tokens(self) -> np.ndarray:
        return self.sums[self.size : self.size + self.leaves, 1]

    @property
    def n_chars(self) -> int:
        return int(self.sums[1, 0])

    @property
    def n_tokens(self) -> int:
        return int(self.sums[1, 1])

    def leaf_at(self, char: int) -> tuple[int, int]:
        """The leaf that holds a character, and the leaf's first character: a walk from the root."""
        node, before = 1, 0
        while node < self.size:
            node *= 2
            if char >= before + self.sums[node, 0] and self.sums[node + 1, 0]:
                before += int(self.sums[node, 0])
                node += 1
        return node - self.size, before

    def replace(self, first: int, last: int, chars: list[int], tokens: list[int]) -> TokenTree:
        """The tree with the leaves [first, last) replaced by pre-tokens of these sizes.

        As long as those leaves can hold them (twice ``LEAF`` each at most),
        their number stays, and only the sums above them are updated; else the
        leaves are cut anew and the sums of all are built again.
        """
        n = last - first
        if n and n <= len(chars) <= 2 * LEAF * n:
            cuts = np.arange(n) * len(chars) // n
            new_chars, new_tokens = (np.add.reduceat(np.array(x, dtype=np.int64), cuts) for x in (chars, tokens))
        else:
            new_chars, new_tokens = leaves_of(chars, tokens)
        if n == len(new_chars):
            self.sums[self.size + first : self.size + last, 0] = new_chars
            self.sums[self.size + first : self.size + last, 1] = new_tokens
            lo, hi = (self.size + first) // 2, (self.size + max(last, first + 1) - 1) // 2
            while lo >= 1:
                nodes = np.arange(lo, hi + 1)
                self.sums[nodes] = self.sums[2 * nodes] + self.sums[2 * nodes + 1]
                lo, hi = lo // 2, hi // 2
            return self
        kept = [(self.chars, new_chars), (self.tokens, new_tokens)]
        return TokenTree(*(np.concatenate([old[:first], new, old[last:]]) for old, new in kept))


def leaves_of(chars: list[int], tokens: list[int]) -> tuple[np.ndarray, np.ndarray]:
    if not chars:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    heads = np.arange(0, len(chars), LEAF)
    return np.add.reduceat(np.array(chars, dtype=np.int64), heads), np.add.reduceat(np.array(tokens, dtype=np.int64), heads)


def edited(text: str, tree: TokenTree, start: int, end: int, replacement: str, counts: PieceCounts) -> tuple[str, TokenTree, int]:
    """Text and tree after ``text[start:end]`` gave way to ``replacement``, and how many characters were re-encoded.

    Offsets beyond the text are its end; an end before the start is the start.
    """
    start = max(0, min(start, len(text)))
    end = max(start, min(end, len(text)))
    new = text[:start] + replacement + text[end:]
    if not tree.leaves:
        return new, TokenTree.of(new, counts), len(new)
    # A pre-token looks two characters beyond its end at most (white space before a word, "'" before "re"), so those that end before ``start - 1`` stand.
    first, at = tree.leaf_at(max(0, start - 2))
    moved, settled = len(new) - len(text), start + len(replacement)
    last, bound = first, at  # the old leaf boundary that the walk may meet next
    chars, tokens, here = [], [], at
    for match in counts.pattern.finditer(new, at):
        here = match.end()
        chars.append(here - match.start())
        tokens.append(counts[match.group()])
        if here >= settled:
            while last < tree.leaves and bound + moved < here or bound < end and last < tree.leaves:
                bound += int(tree.chars[last])
                last += 1
            if bound + moved == here and bound >= end:
                break
    else:
        last = tree.leaves
    return new, tree.replace(first, last, chars, tokens), here - at


def with_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """``docs`` with the column ``edits``: those of ``edits`` (doc_id, seq, start, end, replacement) for its doc_id, by seq."""
    step = F.struct("seq", "start", "end", "replacement")
    listed = edits.groupBy(F.col("doc_id").alias("_edit_id")).agg(F.array_sort(F.collect_list(step)).alias("edits"))
    named = F.transform("edits", lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), e["replacement"].alias("replacement")))
    joined = docs.drop("edits").join(listed, F.col("doc_id").eqNullSafe(F.col("_edit_id")), "left")
    return joined.withColumn("edits", named).drop("_edit_id")


LEAVES = ["n_tokens", "leaf_chars", "leaf_tokens"]
_KINDS = {"text": T.StringType(), "n_tokens": T.LongType(), "leaf_chars": T.ArrayType(T.IntegerType()), "leaf_tokens": T.ArrayType(T.IntegerType()), "edited_chars": T.LongType(), "reencoded_chars": T.LongType()}


def _columns(out: dict[str, list]) -> list[pa.Array]:
    kinds = {T.LongType: pa.int64(), T.StringType: pa.string(), T.ArrayType: pa.list_(pa.int32())}
    return [pa.array(v, kinds[type(_KINDS[c])]) for c, v in out.items()]


def count(docs: DataFrame, path: str = RANKS, pattern: str = PATTERN, keep: list[str] | None = None) -> DataFrame:
    """Adds n_tokens, leaf_chars and leaf_tokens: the leaves of each text's tree, from which :func:`apply_edits` goes on.

    Null text counts as empty: no tokens.  Repeated rows are counted alike; an
    input column of an added name is replaced.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in LEAVES]
    rows = docs.select(*(F.col(f"`{c}`") for c in keep), F.col("text").alias("_count_text"))
    schema = T.StructType([*rows.schema.fields[:-1], *(T.StructField(c, _KINDS[c]) for c in LEAVES)])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = piece_counts(path, pattern)
        for batch in batches:
            out: dict[str, list] = {c: [] for c in LEAVES}
            for text in batch.column(batch.num_columns - 1):
                tree = TokenTree.of(text.as_py() or "", counts)
                out["n_tokens"].append(tree.n_tokens)
                out["leaf_chars"].append(tree.chars.astype(np.int32))
                out["leaf_tokens"].append(tree.tokens.astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *_columns(out)], schema.names)

    return rows.mapInArrow(measure, schema)


def apply_edits(counted: DataFrame, path: str = RANKS, pattern: str = PATTERN, keep: list[str] | None = None) -> DataFrame:
    """Counted texts after their edits, from the stored leaves: only what an edit touches, and its boundary, is encoded.

    ``counted`` has text, leaf_chars and leaf_tokens as :func:`count` (or this
    function) left them, and edits (array of start, end, replacement; null:
    none), applied in order, offsets in the text as it then is.  Text, n_tokens
    and the leaves are those after the edits; edited_chars is the new length,
    reencoded_chars how much was encoded.  Null text counts as empty, but stays
    null if nothing is put in.  Columns ``keep``: of the others.
    """
    added = ["text", *LEAVES, "edited_chars", "reencoded_chars"]
    used = ["text", "leaf_chars", "leaf_tokens", "edits"]
    keep = [c for c in (counted.columns if keep is None else keep) if c not in (*added, "edits")]
    rows = counted.select(*(F.col(f"`{c}`") for c in keep), *(F.col(c).alias(f"_edit_{c}") for c in used))
    schema = T.StructType([*rows.schema.fields[: -len(used)], *(T.StructField(c, _KINDS[c]) for c in added)])
    n_used = len(used)

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = piece_counts(path, pattern)
        for batch in batches:
            out: dict[str, list] = {c: [] for c in added}
            for text, chars, tokens, edits in zip(*(c for c in batch.columns[-n_used:]), strict=True):
                text, again = text.as_py(), 0
                new, tree = text or "", TokenTree(*(np.array(x.as_py() or [], dtype=np.int64) for x in (chars, tokens)))
                for e in edits.as_py() or []:
                    new, tree, n = edited(new, tree, e["start"] or 0, e["end"] or 0, e["replacement"] or "", counts)
                    again += n
                values = [text if text is None and not new else new, tree.n_tokens, tree.chars.astype(np.int32), tree.tokens.astype(np.int32), len(new), again]
                for c, v in zip(added, values, strict=True):
                    out[c].append(v)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-n_used], *_columns(out)], schema.names)

    return rows.mapInArrow(edit, schema)
