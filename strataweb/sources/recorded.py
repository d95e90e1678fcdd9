"""Revisions recorded as one: rows and bodies become visible together, or not at all.

``spark.write.format("project_revisions")`` has two phases.  Tasks write their
rows and bodies as Parquet files that nothing names yet.  The commit then
writes one small log entry, numbered by its place in the log, that names all
files and gives each a range of ids behind the last entry's.  Entries are
created only if their number is free, so of two writers one takes the number
and the other goes on behind it: ids never meet.  A job that is killed before
its entry leaves files that no reader sees and :func:`vacuum` removes.

Files hold a row's place in its file; the id is the file's first id plus that.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

ROWS = "resource_id long, request_cookie string, error string, metadata string"
SCHEMA = f"{ROWS}, body binary"
#: Rows of a file; bodies of a batch are written as they come.
FILE_ROWS = 100_000
_LOG, _DATA, _TRIES = "_log", "data", 1000


def place(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder named by a path or URI."""
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith(("/", "file:")) else os.path.abspath(path))


def create(store: fs.FileSystem, path: str, data: bytes) -> bool:
    """Write a file as a whole, unless there is one of that name; whether it was written.

    Local (and network) folders link a finished file to the name; other stores
    rename, which fails on HDFS where the name is taken.  Object stores whose
    rename replaces files allow one writer at a time.
    """
    part = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        out.write(data)
    if isinstance(store, fs.LocalFileSystem):
        try:
            os.link(part, path)
        except FileExistsError:
            return False
        finally:
            os.unlink(part)
        return True
    try:
        if store.get_file_info(path).type != fs.FileType.NotFound:
            return False
        store.move(part, path)
        return True
    except OSError:
        return False
    finally:
        if store.get_file_info(part).type != fs.FileType.NotFound:
            store.delete_file(part)


def entries(store: fs.FileSystem, root: str, start: int = 0) -> list[str]:
    """Paths of the log's entries from number ``start`` on, in order."""
    found = store.get_file_info(fs.FileSelector(f"{root}/{_LOG}", allow_not_found=True))
    return sorted(f.path for f in found if f.base_name.endswith(".json") and int(f.base_name[:-5]) >= start)


@dataclass
class Written(WriterCommitMessage):
    """The files of one task: (name, rows)."""

    files: list[tuple[str, int]]


class RevisionWriter(DataSourceArrowWriter):
    def __init__(self, path: str, after: int):
        self.path, self.after, self.job = path, after, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = place(self.path)
        folder = f"{root}/{_DATA}"
        store.create_dir(folder, recursive=True)
        files: list[tuple[str, int]] = []
        writers: dict[str, pq.ParquetWriter] = {}

        def finish() -> None:
            """Files get their names when they are whole, so that no reader of the folder meets half of one."""
            for kind, w in writers.items():
                w.close()
                store.move(f"{folder}/_{files[-1][0]}.{kind}", f"{folder}/{files[-1][0]}.{kind}.parquet")
            writers.clear()

        for batch in iterator:
            if not batch.num_rows:
                continue
            if not writers or files[-1][1] + batch.num_rows > FILE_ROWS:
                finish()
                files.append((f"{self.job}-{uuid.uuid4().hex}", 0))
            name, n = files[-1]
            at, body = pa.array(range(n, n + batch.num_rows), pa.int64()), batch.column("body")
            tables = {
                "rows": pa.table({"place": at, **{c: batch.column(c) for c in ("resource_id", "request_cookie", "error", "metadata")}}),
                "body": pa.table({"place": at, "body": body, "size": pc.binary_length(body).cast(pa.int64())}).filter(body.is_valid()),
            }
            for kind, t in tables.items():
                if kind not in writers:
                    writers[kind] = pq.ParquetWriter(f"{folder}/_{name}.{kind}", t.schema, filesystem=store)
                writers[kind].write_table(t)
            files[-1] = (name, n + batch.num_rows)
        finish()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        """All files of the job under the next free number of the log."""
        store, root = place(self.path)
        store.create_dir(f"{root}/{_LOG}", recursive=True)
        files = sorted(f for m in messages if m is not None for f in m.files)
        for _ in range(_TRIES):
            log = entries(store, root)
            number, last = 0, self.after
            if log:
                with store.open_input_stream(log[-1]) as entry:
                    last = json.load(entry)["last_id"]
                number = int(os.path.basename(log[-1])[:-5]) + 1
            made, first = [], last + 1
            for name, n in files:
                made.append({"name": name, "n": n, "first_id": first})
                first += n
            entry = json.dumps({"job": self.job, "files": made, "last_id": first - 1})
            if create(store, f"{root}/{_LOG}/{number:012d}.json", entry.encode()):
                return
        raise RuntimeError(f"no free number in the log of {self.path}")

    def abort(self, messages: list[Written | None]) -> None:
        """The files of this job go; they were never visible."""
        store, root = place(self.path)
        for f in store.get_file_info(fs.FileSelector(f"{root}/{_DATA}", allow_not_found=True)):
            if f.base_name.lstrip("_").startswith(self.job):
                store.delete_file(f.path)


class RevisionSink(DataSource):
    """``df.write.format("project_revisions").mode("append").save(path)`` for rows of ``SCHEMA``."""

    @classmethod
    def name(cls) -> str:
        return "project_revisions"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> RevisionWriter:
        if overwrite:
            raise ValueError("revisions are only ever appended")
        if schema.fieldNames() != [c.split()[0] for c in SCHEMA.split(", ")]:
            raise ValueError(f"revisions have the columns {SCHEMA}")
        return RevisionWriter(self.options["path"], int(self.options.get("after", 0)))


def append(rows: DataFrame, path: str, after: int = 0) -> None:
    """Record rows of ``SCHEMA`` below ``path``, all or none; the very first id follows ``after``."""
    rows.sparkSession.dataSource.register(RevisionSink)
    rows.select(*(c.split()[0] for c in SCHEMA.split(", "))).write.format("project_revisions").option("after", after).mode("append").save(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    """name, n and first_id of every file that the log names."""
    log = spark.read.schema("files array<struct<name:string,n:long,first_id:long>>").option("pathGlobFilter", "*.json").json(f"{path}/{_LOG}")
    return log.select(F.inline("files"))


def _read(spark: SparkSession, path: str, kind: str, columns: str) -> DataFrame:
    store, root = place(path)
    names = [c.split()[0] for c in columns.split(", ")]
    if not entries(store, root):
        return spark.createDataFrame([], f"id long, {columns}")
    held = spark.read.schema(f"place long, {columns}").option("pathGlobFilter", f"*.{kind}.parquet").parquet(f"{path}/{_DATA}")
    name = F.regexp_extract(F.col("_metadata.file_name"), rf"^(.*)\.{kind}\.parquet$", 1)
    # Files that no entry names meet nothing: they are of jobs that did not end, or have not yet.
    named = _files(spark, path).select("name", "first_id")
    return held.withColumn("name", name).join(named, "name").select((F.col("first_id") + F.col("place")).alias("id"), *names)


def read_revisions(spark: SparkSession, path: str) -> DataFrame:
    """id and the columns of ``ROWS`` of every recorded revision; none where nothing was recorded yet."""
    return _read(spark, path, "rows", ROWS)


def read_recorded_bodies(spark: SparkSession, path: str) -> DataFrame:
    """id, body and size of every recorded body."""
    return _read(spark, path, "body", "body binary, size long")


def vacuum(path: str, older_than: float) -> list[str]:
    """Delete the files that no entry names and that were last changed before ``older_than`` (seconds since the epoch); their names.

    Jobs that still run must have begun after that.
    """
    store, root = place(path)
    named = set()
    for entry in entries(store, root):
        with store.open_input_stream(entry) as text:
            named |= {f["name"] for f in json.load(text)["files"]}
    gone = []
    for f in store.get_file_info(fs.FileSelector(f"{root}/{_DATA}", allow_not_found=True)):
        if f.base_name.lstrip("_").split(".")[0] not in named and f.mtime.timestamp() < older_than:
            store.delete_file(f.path)
            gone.append(f.base_name)
    return sorted(gone)
