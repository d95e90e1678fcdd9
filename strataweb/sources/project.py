"""A project's tables: read from SQLite by ranges of ids, or from Parquet."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from ..functions import http
from . import recorded
from .packs import IdRange

#: The tables and the columns that any version of the format has, with the defaults of later ones.
TABLES = {
    "project_property": "name string, value string",
    "resource": "id long, url string",
    "root_resource": "id long, name string, resource_id long",
    "resource_group": "id long, name string, url_pattern string, source_type string, source_id long, do_not_download long",
    "resource_revision": "id long, resource_id long, request_cookie string, error string, metadata string",
    "alias": "id long, source_url_prefix string, target_url_prefix string, target_is_external long",
}
#: Where revisions are recorded within a project's folder.
RECORDED = "recorded"
#: Ids that are looked up one by one, and texts that are put into a query.
_MOST_TEXTS = 64
_FLAGS = {"do_not_download", "target_is_external"}


class _Range(InputPartition):
    def __init__(self, low: int | None, high: int | None):
        self.low, self.high = low, high


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str]):
        self.path, self.table = options["path"], options["table"]
        self.parts, self.columns = int(options.get("partitions", 8)), columns
        self.ids, self.texts = IdRange(), []

    def _connect(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Ranges and lists of ids narrow the partitions; equal and listed texts (a URL, a name) go into the query, where an index may answer them."""
        left = []
        for f in filters:
            texts = [f.value] if isinstance(f, EqualTo) else list(f.value) if isinstance(f, In) else []
            if "id" in self.columns and self.ids.push(f):
                continue
            if 0 < len(texts) <= _MOST_TEXTS and all(isinstance(t, str) for t in texts) and len(f.attribute) == 1 and f.attribute[0] in self.columns:
                self.texts.append((f.attribute[0], texts))
            else:
                left.append(f)
        return left

    def partitions(self) -> list[_Range]:
        if "id" not in self.columns:
            return [_Range(None, None)]
        if self.ids.named is not None and len(self.ids.named) <= _MOST_TEXTS:
            return [_Range(i, i + 1) for i in self.ids.named] or [_Range(0, 0)]
        with self._connect() as db:
            if not db.execute("select 1 from sqlite_master where name = ?", (self.table,)).fetchone():
                return [_Range(0, 0)]
            low, high = db.execute(f"select min(id), max(id) from {self.table}").fetchone()
        if low is None:
            return [_Range(0, 0)]
        low, high = max(low, self.ids.low), min(high, self.ids.high - 1)
        if self.ids.named is not None:
            low, high = max(low, self.ids.named[0]), min(high, self.ids.named[-1])
        if low > high:
            return [_Range(0, 0)]
        step = -(-(high - low + 1) // self.parts)
        return [_Range(a, min(a + step, high + 1)) for a in range(low, high + 1, step)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        with self._connect() as db:
            have = {row[1] for row in db.execute(f"pragma table_info({self.table})")}
            if not have:
                return
            picked = ", ".join(c if c in have else f"{0 if c in _FLAGS else 'null'} as {c}" for c in self.columns)
            asked = [] if partition.low is None else [f"id >= {int(partition.low)} and id < {int(partition.high)}"]
            texts = [t for c, ts in self.texts if c in have for t in ts]
            asked += [f"{c} in ({', '.join('?' * len(ts))})" for c, ts in self.texts if c in have]
            asked += ["0" for c, _ in self.texts if c not in have]  # null everywhere
            rows = db.execute(f"select {picked} from {self.table}" + (" where " + " and ".join(asked) if asked else ""), texts)
            at = self.columns.index("id") if self.ids.named is not None else None
            yield from rows if at is None else (r for r in rows if self.ids.has(r[at]))


class SqliteTable(DataSource):
    """``spark.read.format("project_sqlite")`` with options path, table and partitions."""

    @classmethod
    def name(cls) -> str:
        return "project_sqlite"

    def schema(self) -> str:
        return TABLES[self.options["table"]]

    def reader(self, schema) -> SqliteReader:
        return SqliteReader(dict(self.options), schema.fieldNames())


def _typed(df: DataFrame) -> DataFrame:
    for c in _FLAGS & set(df.columns):
        df = df.withColumn(c, F.coalesce(F.col(c), F.lit(0)) != 0)
    return df


def read_sqlite(spark: SparkSession, path: str, table: str, partitions: int = 8) -> DataFrame:
    """A table of a project's database, a path that every executor can open; missing tables and columns get their defaults."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SqliteTable)
    return _typed(spark.read.format("project_sqlite").option("path", path).option("table", table).option("partitions", partitions).load())


def export(spark: SparkSession, path: str, folder: str) -> None:
    """Copy a project's tables to Parquet, revisions sorted by resource for pruning."""
    for name in TABLES:
        df = read_sqlite(spark, path, name)
        if name == "resource_revision":
            df = df.repartitionByRange("resource_id").sortWithinPartitions("resource_id", "id")
        elif name == "resource":
            df = df.repartitionByRange("url").sortWithinPartitions("url")
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of an exported project, whatever version of the format its files are of.

    Files of several versions are read together.  Columns that a version lacks
    get their defaults, a table that is not there has no rows, and columns that
    are not of the format stay out.
    """
    kinds = T.StructType.fromDDL(TABLES[name])
    if not _exists(spark, f"{folder}/{name}"):
        return _typed(spark.createDataFrame([], kinds))
    held = spark.read.option("mergeSchema", "true").parquet(f"{folder}/{name}")
    have = set(held.columns)
    flag = lambda f: F.col(f.name).cast("long") if f.name in have else F.lit(0).cast("long")
    return _typed(held.select(*((flag(f) if f.name in _FLAGS else F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in kinds)))


def open_project(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of an exported project, with the revisions recorded since (:func:`record_revisions`)."""
    found = {name: read_table(spark, folder, name) for name in TABLES}
    if _exists(spark, f"{folder}/{RECORDED}"):
        found["resource_revision"] = found["resource_revision"].unionByName(recorded.read_revisions(spark, f"{folder}/{RECORDED}"))
    return found


def revision_rows(fetched: DataFrame) -> DataFrame:
    """Responses and failures as rows of ``resource_revision`` with their bodies, but for the id.

    ``fetched`` has resource_id, request_cookie, http_version, status_code,
    reason_phrase, headers, body, error (struct of type and message, null for
    a response) and fetched_at.  A response without a Date header gets one; a
    failure has no metadata and no body.
    """
    failed = F.col("error").isNotNull()
    headers = http.with_date(F.col("headers"), F.col("fetched_at"))
    metadata = http.encode(F.struct("http_version", "status_code", "reason_phrase", headers.alias("headers")))
    return fetched.select(
        "resource_id", "request_cookie", F.when(failed, F.to_json("error")).otherwise("null").alias("error"),
        F.when(~failed, metadata).alias("metadata"), F.when(~failed, F.col("body")).alias("body"),
    )


def record_revisions(spark: SparkSession, fetched: DataFrame, folder: str) -> None:
    """Add responses and failures to the project in ``folder``: all rows with their bodies, or nothing.

    Ids go on gaplessly behind those of the exported revisions and of what was
    recorded before; any number of writers may record at once (see :mod:`.recorded`).
    """
    table = f"{folder}/resource_revision"
    last = spark.read.parquet(table).agg(F.max("id")).first()[0] if _exists(spark, table) else None
    recorded.append(revision_rows(fetched), f"{folder}/{RECORDED}", last or 0)
