"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is what the session names in ``spark.checkpoint.dir``.  Only a session
    on ``local[...]``, where driver and executors are one process, falls back
    to a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="strataweb-")
    return _LOCAL[app]


_TEMPORARY: list[tuple[SparkSession, list[str]]] = []


def _home(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/strataweb/{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables that :func:`materialise` writes in this block go when it ends, but those it is told to keep."""
    paths: list[str] = []
    _TEMPORARY.append((spark, paths))
    try:
        yield
    finally:
        _TEMPORARY.pop()
        for path in paths:
            _delete(spark, path)


#: With it Spark removes a query's shuffle files when the query ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of queries in this block go with them, not when the driver happens to collect its garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def materialise(df: DataFrame, name: str, keep: bool = False, options: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage: later passes read the columns they need from Parquet,
    and a lost executor costs no recomputation; its shuffle files go at once.  In a :func:`temporary` block
    the table goes at the block's end, with ``keep`` at the end of the block
    around it.  Other tables stay as long as results may read them; a job that
    has written its results calls :func:`clean`.  ``options`` are the writer's.
    """
    spark = df.sparkSession
    path = f"{_home(spark)}/{name}-{uuid.uuid4().hex}"
    at = len(_TEMPORARY) - (2 if keep else 1)
    if at >= 0:
        _TEMPORARY[at][1].append(path)
    with _shuffles_removed(spark):
        df.write.options(**(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> None:
    """Remove all tables that this application has written to the shared folder and not removed yet."""
    _delete(spark, _home(spark))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc32_text(col) -> F.Column:
    """Unsigned CRC-32 of the UTF-8 bytes; null counts as empty."""
    return F.crc32(F.coalesce(col, F.lit("")).cast("binary"))


def hashed_fold(doc_id, folds: int = 3) -> F.Column:
    """``crc32(doc_id as text) mod folds``; a null id falls into fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(0).cast("long"))
