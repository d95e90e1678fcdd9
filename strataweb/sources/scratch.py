"""Where intermediate tables go, and joins of texts with their prefixes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: what ``spark.checkpoint.dir`` names.

    Only on ``local[...]``, where driver and executors are one process, a
    temporary folder takes its place.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local[") and context.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _LOCAL:
        _LOCAL[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="strataweb-")
    return _LOCAL[context.applicationId]


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/strataweb/{name}-{uuid.uuid4().hex}"


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, if it is there."""
    place, store = _place(spark, path)
    store.delete(place, True)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders within a folder."""
    place, store = _place(spark, path)
    return sorted(f.getPath().getName() for f in store.listStatus(place) if f.isDirectory())


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: lineage ends there, and lost executors cost no recomputation."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_prefixes(rows: DataFrame, text: Column, table: DataFrame, prefix: str) -> DataFrame:
    """Each row with every row of ``table`` whose ``prefix`` begins its ``text``.

    An equi-join whatever the sizes: a text meets the table under its prefixes
    of the lengths that occur there (distinct numbers, at most the length of
    the longest prefix; gathered by the driver).
    """
    found = table.where(F.col(prefix).isNotNull()).select(F.length(prefix).alias("n")).distinct().collect()
    lengths = sorted(r["n"] for r in found)
    wanted = F.filter(F.array(*(F.lit(n) for n in lengths)) if lengths else F.array().cast("array<int>"), lambda n: n <= F.length(text))
    keyed = rows.withColumn("_prefix_key", F.explode(F.transform(wanted, lambda n: F.substring(text, F.lit(1), n))))
    return keyed.join(table.withColumn("_prefix_key", F.col(prefix)), "_prefix_key").drop("_prefix_key")
