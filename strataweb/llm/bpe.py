"""Byte-level BPE: texts to token ids and back, exactly as a tokenizer file says.

A text is split at its added tokens, then into words by the file's pattern.
Each short word is a contiguous array of its parts and, beside it, one of the
ranks at the boundaries where two parts meet.  The least rank is looked for by
a scan; its boundary goes, and the ranks at its two neighbours are looked up
anew, until no boundary has a rank.  Words longer than ``LONG`` bytes, where such
scans would be quadratic, keep the same boundaries in a heap by rank and place,
with the same result.

The tokenizer file is JSON; its path is a parameter, the same on every
executor, and each worker reads it once.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import ragged

#: Where the tokenizer file lies, unless another path is given.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: How byte-level tokenizers of this kind split a text into words: fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of a word up to which its boundaries are scanned.
LONG = 256
#: Words whose ids a worker keeps; they are at most _KEPT_CHARS long.
_CACHED, _KEPT_CHARS = 400_000, 64
#: Words that are taken from a text at once.
_WORDS = 1 << 18
#: Ids are below this; what ``pairs`` holds is below _NONE.
_IDS_MOST = 1 << 20
_NONE = 1 << 60
#: Up to here texts are split by an expression with the classes spelled out.
_LATIN = "\u024f"
# Letters, digits and white space of these blocks are the same in all versions of Unicode in use; texts
# with other characters are split by the tokenizers library, whose version is the one that counts.
_SETTLED = "\u0000-\u0530\u2010-\u2060\u3000-\u30ff\u4e00-\u9fa5\uac00-\ud7a3\uff00-\uffef"


def latin_pattern() -> str:
    """``PATTERN`` for texts up to ``_LATIN``, with the classes spelled out: the standard library's expressions are twice as fast."""
    kinds = {"L": "", "N": "", "white": ""}
    for c in map(chr, range(ord(_LATIN) + 1)):
        kind = "white" if regex.match(r"\s", c) else unicodedata.category(c)[0]
        if kind in kinds:
            kinds[kind] += re.escape(c)
    return PATTERN.replace(r"[^\s\p{L}\p{N}]", f"[^{''.join(kinds.values())}]").replace(r"\p{L}", f"[{kinds['L']}]").replace(r"\p{N}", f"[{kinds['N']}]").replace(r"\S", f"[^{kinds['white']}]").replace(r"\s", f"[{kinds['white']}]")


def byte_characters() -> list[str]:
    """The character that stands for each byte in a tokenizer file: itself where it is printable, else the next one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class ByteBpe(dict):
    """A tokenizer file; as a dictionary, the ids of the words met lately."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, kinds = spec["model"], [(spec.get(k) or {}).get("type") for k in ("pre_tokenizer", "decoder")]
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        if kinds != ["ByteLevel"] * 2 or spec.get("normalizer") or spec["pre_tokenizer"].get("add_prefix_space") or not spec["pre_tokenizer"].get("use_regex", True) or odd:
            raise ValueError(f"{path} is no plain byte-level BPE tokenizer")
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        if any(t.get(k) for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError(f"{path} has added tokens that take in what stands around them")
        self.path = path
        back = {c: b for b, c in enumerate(byte_characters())}
        as_bytes = lambda token: bytes(back[c] for c in token)
        ids = {as_bytes(token): i for token, i in model["vocab"].items() if token not in added}
        if max(ids.values(), default=0) >= _IDS_MOST or any(bytes([b]) not in ids for b in range(256)):
            raise ValueError(f"{path} lacks bytes, or has more than {_IDS_MOST} ids")
        self.singles = [ids[bytes([b])] for b in range(256)]
        halves = ([as_bytes(half) for half in (m.split(" ") if isinstance(m, str) else m)] for m in model["merges"])
        self.pairs = {ids[a] * _IDS_MOST + ids[b]: rank * _IDS_MOST + ids[a + b] for rank, (a, b) in enumerate(halves)}
        self.tokens = {i: t for t, i in ids.items()} | {i: t.encode() for t, i in added.items()}
        self.added = added
        self.at_added = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.words, self.unsettled = regex.compile(PATTERN), re.compile(f"[^{_SETTLED}]")
        self.latin_words, self.beyond_latin = re.compile(latin_pattern()), re.compile(f"[^\x00-{_LATIN}]")
        self.splitter = None

    def __missing__(self, word: str) -> tuple[int, ...]:
        data = word.encode()
        ids = tuple((merged if len(data) <= LONG else merged_long)(data, self.singles, self.pairs))
        if len(word) <= _KEPT_CHARS:
            if len(self) >= _CACHED:
                self.clear()
            self[word] = ids
        return ids

    def split(self, text: str) -> Iterator[list[str]]:
        """The words of a text without added tokens, in bounded lists."""
        latin = not self.beyond_latin.search(text)
        words = self.latin_words if latin else self.words
        if not latin and self.unsettled.search(text):
            if self.splitter is None:
                from tokenizers import Tokenizer

                self.splitter = Tokenizer.from_file(self.path).pre_tokenizer
            yield [text[a:b] for _, (a, b) in self.splitter.pre_tokenize_str(text)]
        elif len(text) <= _WORDS:
            yield words.findall(text)
        else:
            found = words.finditer(text)
            while some := [m.group() for m in islice(found, _WORDS)]:
                yield some

    def encode(self, text: str) -> np.ndarray:
        parts = []
        for piece in self.at_added.split(text) if self.at_added and text else [text]:
            if piece in self.added:
                parts.append(np.array([self.added[piece]], dtype=np.uint32))
            elif piece:
                parts += [np.fromiter(chain.from_iterable(map(self.__getitem__, words)), dtype=np.uint32) for words in self.split(piece)]
        return np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint32)

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids; ids without a token are skipped, bytes that are no UTF-8 become U+FFFD."""
        token = self.tokens.get
        return b"".join(token(i, b"") for i in ids.tolist()).decode("utf-8", "replace")


def merged(word: bytes, singles: list[int], pairs: dict[int, int]) -> list[int]:
    """The ids of a word's parts: one contiguous array of parts beside one of the ranks at the boundaries between them.

    ``beside[i]`` belongs to the boundary behind part i; ``pairs`` has, for a pair of ids, its rank and (in the lowest bits) the id of both together.
    """
    parts = [singles[b] for b in word]
    beside = [pairs.get(a * _IDS_MOST + b, _NONE) for a, b in zip(parts, parts[1:], strict=False)]
    while beside and (least := min(beside)) < _NONE:
        i = beside.index(least)
        new = parts[i] = least % _IDS_MOST
        del parts[i + 1], beside[i]
        if i:
            beside[i - 1] = pairs.get(parts[i - 1] * _IDS_MOST + new, _NONE)
        if i < len(beside):
            beside[i] = pairs.get(new * _IDS_MOST + parts[i + 1], _NONE)
    return parts


def merged_long(word: bytes, singles: list[int], pairs: dict[int, int]) -> list[int]:
    """As :func:`merged`, with the boundaries in a heap by rank and place."""
    n = len(word)
    parts, after, before = [singles[b] for b in word], [*range(1, n), -1], list(range(-1, n - 1))

    def boundary(a: int, b: int) -> tuple[int, int, int, int, int]:
        """The boundary between the parts that begin at a and b, and what they are."""
        return pairs.get(parts[a] * _IDS_MOST + parts[b], _NONE), a, b, parts[a], parts[b]

    heap = [x for x in (boundary(i, i + 1) for i in range(n - 1)) if x[0] < _NONE]
    heapify(heap)
    while heap:
        least, a, b, left, right = heappop(heap)
        if parts[a] != left or after[a] != b or parts[b] != right:
            continue  # one of the parts has grown since
        c = after[b]
        parts[a], parts[b], after[a], after[b] = least % _IDS_MOST, -1, c, -1
        if c >= 0:
            before[c] = a
        for x in [boundary(before[a], a)] * (before[a] >= 0) + [boundary(a, c)] * (c >= 0):
            if x[0] < _NONE:
                heappush(heap, x)
    return [p for p in parts if p >= 0]


_loaded: dict[str, ByteBpe] = {}


def tokenizer(path: str = TOKENIZER) -> ByteBpe:
    if path not in _loaded:
        _loaded[path] = ByteBpe(path)
    return _loaded[path]


_IDS = {True: (T.BinaryType(), pa.binary()), False: (T.ArrayType(T.IntegerType()), pa.list_(pa.int32()))}


def encode(docs: DataFrame, path: str = TOKENIZER, keep: list[str] | None = None, packed: bool = False, decoded: bool = False) -> DataFrame:
    """Adds n_tokens (long) and ids (array of int) of each text; with ``packed`` the ids are binary, little-endian unsigned 32-bit integers.

    With ``decoded`` also the text that :func:`decode` makes of the ids, in the
    same pass over the rows.  A null text counts as empty: no ids.  Repeated
    rows are encoded alike; an input column of an added name is replaced.
    Columns ``keep``: of the others (all of them, unless given).
    """
    added = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", _IDS[packed][0]), *([T.StructField("decoded", T.StringType())] if decoded else [])]
    names = [f.name for f in added]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in names]
    rows = docs.select(*(F.col(f"`{c}`") for c in keep), F.col("text").alias("_bpe_text"))
    schema = T.StructType([*rows.schema.fields[:-1], *added])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for a, b in ragged.groups(texts):
                found = [bpe.encode(t.as_py() or "") for t in texts.slice(a, b - a)]
                out = [pa.array([len(x) for x in found], pa.int64())]
                out.append(pa.array([x.astype("<u4").tobytes() for x in found] if packed else [x.astype(np.int32) for x in found], _IDS[packed][1]))
                if decoded:
                    out.append(pa.array([bpe.decode(x) for x in found], pa.string()))
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[:-1]), *out], schema.names)

    return rows.mapInArrow(work, schema)


def decode(rows: DataFrame, path: str = TOKENIZER, keep: list[str] | None = None) -> DataFrame:
    """Adds decoded, the text of each row's ids (array of int, or packed); null ids are none, ids without a token are skipped."""
    keep = [c for c in (rows.columns if keep is None else keep) if c != "decoded"]
    packed = isinstance(rows.schema["ids"].dataType, T.BinaryType)
    used = rows.select(*(F.col(f"`{c}`") for c in keep), F.col("ids").alias("_bpe_ids"))
    schema = T.StructType([*used.schema.fields[:-1], T.StructField("decoded", T.StringType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            ids = batch.column(batch.num_columns - 1)
            if packed:
                found = (np.frombuffer(x.as_py() or b"", dtype="<u4") for x in ids)
            else:
                found = (np.array([i for i in x.as_py() or [] if i is not None], dtype=np.int64) for x in ids)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([bpe.decode(x) for x in found], pa.string())], schema.names)

    return used.mapInArrow(work, schema)
