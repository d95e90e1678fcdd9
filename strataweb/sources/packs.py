"""Packs as a data source that reads what a filter asks for and no more.

``spark.read.format("project_packs")`` has id, body and size.  Comparisons of
the id with constants are pushed into the reader: ids that are named lead
straight to their packs, without a listing; ranges leave out folders and packs
outside.  Of a pack only the end is read, which holds its directory, and then
the bytes of the entries that are asked for: two reads for one body.
"""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from .recorded import place

PACK = 16
#: Bytes that are read from a pack's end at first; the directory of 16 entries is within.
TAIL = 2048
#: What follows the name of a pack that was moved aside while it is replaced: fixed value.
ASIDE = ".replacing"
#: Bytes that an entry's own header may be longer than its directory entry says.
_SLACK = 64
#: Bytes of bodies in one batch of rows.
_BATCH = 32 << 20
_ENDS = 1 << 60
#: What the archive module raises on entries that are broken, encrypted or packed by an unknown method.
UNREADABLE = (zipfile.BadZipFile, zlib.error, NotImplementedError, RuntimeError, ValueError, EOFError, OSError)


class IdRange:
    """The ids that pushed filters leave: a range, and maybe a list."""

    def __init__(self) -> None:
        self.low, self.high, self.listed = -_ENDS, _ENDS, None

    def push(self, f: Filter) -> bool:
        """Take a filter in; whether it is one of the id that is met in full."""
        if getattr(f, "attribute", None) != ("id",):
            return False
        if isinstance(f, EqualTo):
            self._only({f.value})
        elif isinstance(f, In):
            self._only(set(f.value))
        elif isinstance(f, GreaterThan):
            self.low = max(self.low, f.value + 1)
        elif isinstance(f, GreaterThanOrEqual):
            self.low = max(self.low, f.value)
        elif isinstance(f, LessThan):
            self.high = min(self.high, f.value)
        elif isinstance(f, LessThanOrEqual):
            self.high = min(self.high, f.value + 1)
        else:
            return False
        return True

    def _only(self, ids: set) -> None:
        ids = {i for i in ids if i is not None}
        self.listed = ids if self.listed is None else self.listed & ids

    def has(self, id_: int) -> bool:
        return self.low <= id_ < self.high and (self.listed is None or id_ in self.listed)

    def meets(self, first: int, n: int) -> bool:
        """Whether any of ``n`` ids from ``first`` on may be asked for."""
        return first < self.high and first + n > self.low

    @property
    def named(self) -> list[int] | None:
        return None if self.listed is None else sorted(i for i in self.listed if self.low <= i < self.high)


class RangeFile(io.RawIOBase):
    """A file of which spans are fetched whole and read from there; ``reads`` counts the fetches."""

    def __init__(self, file: pa.NativeFile):
        self.file, self.size, self.at, self.reads = file, file.size(), 0, 0
        self.fetch(max(0, self.size - TAIL), self.size)

    def fetch(self, low: int, high: int) -> None:
        self.low, self.data = low, self.file.read_at(max(0, min(high, self.size) - low), low)
        self.reads += 1

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, offset: int, whence: int = 0) -> int:
        self.at = max(0, offset + (0, self.at, self.size)[whence])
        return self.at

    def read(self, n: int = -1) -> bytes:
        n = self.size - self.at if n is None or n < 0 else min(n, self.size - self.at)
        if n <= 0:
            return b""
        if not (self.low <= self.at and self.at + n <= self.low + len(self.data)):
            self.fetch(self.at, self.at + n)
        found = self.data[self.at - self.low : self.at - self.low + n]
        self.at += len(found)
        return found


def entries(first: int, file: RangeFile, wanted: IdRange, with_bodies: bool = True) -> Iterator[tuple[int, int, bytes | None]]:
    """Id, size and body of a pack's readable entries that are wanted; an entry's name has the last three hex digits of its id."""
    try:
        archive = zipfile.ZipFile(file)
    except UNREADABLE:
        return
    with archive:
        for info in archive.infolist():
            try:
                id_ = (first >> 12 << 12) + int(info.filename, 16)
                if not wanted.has(id_):
                    continue
                if with_bodies:
                    file.fetch(info.header_offset, info.header_offset + 30 + len(info.orig_filename) + _SLACK + info.compress_size)
                yield id_, info.file_size, archive.read(info) if with_bodies else None
            except UNREADABLE:
                continue


def open_pack(store: fs.FileSystem, path: str) -> RangeFile | None:
    """A pack, or what was moved aside of it when it is not in its place; null if neither is there."""
    for name in (path, path + ASIDE):
        try:
            return RangeFile(store.open_input_file(name))
        except OSError:
            continue
    return None


def pack_name(first: int) -> str:
    digits = f"{first:015x}"
    return "/".join(digits[k : k + 3] for k in range(0, 12, 3)) + f"/{digits[12:14]}_.zip"


@dataclass
class _Packs(InputPartition):
    """The packs of these first ids."""

    firsts: list[int]


class PackReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.with_bodies = options["path"], options.get("bodies", "true") == "true"
        self.wanted = IdRange()

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        return [f for f in filters if not self.wanted.push(f)]

    def partitions(self) -> list[_Packs]:
        named = self.wanted.named
        if named is not None:
            firsts = sorted({i // PACK * PACK for i in named})
            return [_Packs(firsts[k : k + PACK]) for k in range(0, len(firsts), PACK)] or [_Packs([])]
        # 16 packs a partition, whether they are there or not: only folders are listed, tasks find the files.
        store, root = place(self.path)
        found, span = [(f"{root}/revisions", 0)], 1 << 60
        for _ in range(4):
            span >>= 12
            below = ((f, base) for folder, base in found for f in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if f.type == fs.FileType.Directory)
            found = [(f.path, base + int(f.base_name, 16) * span) for f, base in below if len(f.base_name) == 3 and all(c in "0123456789abcdef" for c in f.base_name)]
            found = [(p, base) for p, base in found if self.wanted.meets(base, span)]
        groups = [base + k * PACK * PACK for _, base in sorted(found) for k in range(PACK)]
        return [_Packs([g + k * PACK for k in range(PACK)]) for g in groups if self.wanted.meets(g, PACK * PACK)] or [_Packs([])]

    def read(self, partition: _Packs) -> Iterator[pa.RecordBatch]:
        store, root = place(self.path)
        held, n = [], 0
        for first in partition.firsts:
            if not self.wanted.meets(first, PACK) or (file := open_pack(store, f"{root}/revisions/{pack_name(first)}")) is None:
                continue
            for row in entries(first, file, self.wanted, self.with_bodies):
                held.append(row)
                n += row[1]
                if n >= _BATCH:
                    yield _batch(held)
                    held, n = [], 0
        yield _batch(held)


def _batch(rows: list[tuple[int, int, bytes | None]]) -> pa.RecordBatch:
    ids, sizes, found = ([r[k] for r in rows] for k in range(3))
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.binary()), pa.array(sizes, pa.int64())], ["id", "body", "size"])


class PackSource(DataSource):
    """Options: path (of the project) and bodies (``false``: bodies are null, and no entry is read)."""

    @classmethod
    def name(cls) -> str:
        return "project_packs"

    def schema(self) -> str:
        return "id long, body binary, size long"

    def reader(self, schema) -> PackReader:
        return PackReader(dict(self.options))


def read(spark: SparkSession, project: str, with_bodies: bool = True) -> DataFrame:
    """id, body and size of every readable entry of the packs; filters of the id reach the reader."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PackSource)
    return spark.read.format("project_packs").option("path", project).option("bodies", str(with_bodies).lower()).load()
