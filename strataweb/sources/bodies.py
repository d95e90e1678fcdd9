"""Bodies of revisions in their three layouts, read and written by Spark.

``flat``: one file named by the id.  ``hierarchical``: the id as 15 hex digits
in folders of three.  ``pack16``: archives of 16 consecutive revisions.
"""

from __future__ import annotations

import io
import os
import uuid
import zipfile

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import packs as packed
from .packs import PACK
from .scratch import written


def hex_id(id_: Column) -> Column:
    return F.lower(F.lpad(F.hex(id_), 15, "0"))


def _split3(digits: Column, n: int) -> Column:
    return F.concat_ws("/", *(F.substr(digits, F.lit(3 * k + 1), F.lit(3)) for k in range(n)))


def flat_path(id_: Column) -> Column:
    return F.concat(F.lit("revisions/"), id_.cast("string"))


def hierarchical_path(id_: Column) -> Column:
    """Null beyond 15 hex digits."""
    return F.when(id_ < (1 << 60), F.concat(F.lit("revisions/"), _split3(hex_id(id_), 5)))


def pack_path(id_: Column) -> Column:
    digits = hex_id(id_)
    return F.when(id_ < (1 << 60), F.concat(F.lit("revisions/"), _split3(digits, 4), F.lit("/"), F.substr(digits, F.lit(13), F.lit(2)), F.lit("_.zip")))


def entry_name(id_: Column) -> Column:
    return F.lower(F.lpad(F.hex(F.pmod(id_, F.lit(4096))), 3, "0"))


def pack_id(id_: Column) -> Column:
    return F.floor(id_ / PACK).cast("long")


def packs(revisions: DataFrame) -> DataFrame:
    """pack_id, n_revisions and complete (its last revision is there)."""
    return revisions.groupBy(pack_id(F.col("id")).alias("pack_id")).agg(F.count(F.lit(1)).alias("n_revisions"), F.bool_or(F.col("id") % PACK == PACK - 1).alias("complete"))


def read_loose(spark: SparkSession, project: str, hierarchical: bool = True) -> DataFrame:
    """id and body of the loose files of a project."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{project}/revisions")
    if hierarchical:
        digits = F.replace(F.regexp_extract("path", r"/revisions/((?:[0-9a-f]{3}/){4}[0-9a-f]{3})$", 1), F.lit("/"), F.lit(""))
        id_ = F.conv(F.nullif(digits, F.lit("")), 16, 10).cast("long")
    else:
        id_ = F.nullif(F.regexp_extract("path", r"/revisions/([0-9]+)$", 1), F.lit("")).cast("long")
    return files.select(id_.alias("id"), F.col("content").alias("body"), F.col("length").alias("size")).where(F.col("id").isNotNull())


def read_packs(spark: SparkSession, project: str) -> DataFrame:
    """id, body and size of every entry of the packs; entries that cannot be read are skipped, others of their pack are not.

    Filters of the id are pushed down: see :mod:`.packs`.
    """
    return packed.read(spark, project)


def pack_entries(spark: SparkSession, project: str) -> DataFrame:
    """The ids that the packs' directories name; nothing is unpacked."""
    return packed.read(spark, project, with_bodies=False).select("id")


def read_bodies(spark: SparkSession, project: str) -> DataFrame:
    """Bodies of a project in packs, with loose files where a pack lacks them."""
    held, loose = read_packs(spark, project), read_loose(spark, project)
    return held.union(loose.join(pack_entries(spark, project), "id", "left_anti").select("id", "body", "size"))


def write_packs(bodies: DataFrame, folder: str) -> DataFrame:
    """Write id and body as packs below ``folder``; returns path and n of each pack, and writes when that is computed.

    ``folder`` is a path or URI of a file system that all executors share
    (local paths only where they are mounted everywhere; ``hdfs://``, ``s3://``
    and ``gs://`` by PyArrow's file systems).  Entries are stored, not
    deflated; a pack is written beside its place and renamed, so readers never
    see half of one and a task that runs again replaces its pack.
    """

    def pack(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("id").to_pylist(), table.column("body").to_pylist(), strict=True))
        digits = f"{rows[0][0]:015x}"
        name = "/".join(digits[k : k + 3] for k in range(0, 12, 3)) + f"/{digits[12:14]}_.zip"
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w", zipfile.ZIP_STORED) as archive:
            for id_, body in rows:
                archive.writestr(f"{id_ % 4096:03x}", body)
        store, root = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("/") else os.path.abspath(folder))
        target = f"{root}/revisions/{name}"
        store.create_dir(os.path.dirname(target), recursive=True)
        part = f"{target}.part-{uuid.uuid4().hex}"
        with store.open_output_stream(part) as out:
            out.write(held.getvalue())
        store.move(part, target)
        return pa.table({"path": [name], "n": pa.array([len(rows)], pa.int64())})

    readable = bodies.where(F.col("body").isNotNull()).select("id", "body", pack_id(F.col("id")).alias("pack_id"))
    return readable.groupBy("pack_id").applyInArrow(pack, "path string, n long")


def rewrite_packs(spark: SparkSession, project: str, gone: DataFrame, folder: str) -> DataFrame:
    """The packs of ``project`` that hold a body to delete (``gone``: id), written to ``folder`` without those.

    path and n of each; packs of which nothing is left have n = 0, are not
    written, and are to be deleted.  Packs that hold none of ``gone`` are not
    touched.
    """
    touched = gone.select(pack_id(F.col("id")).alias("pack_id")).distinct()
    bodies = read_packs(spark, project).withColumn("pack_id", pack_id(F.col("id"))).join(touched, "pack_id", "left_semi")
    left = bodies.join(gone.select("id"), "id", "left_anti")
    written = write_packs(left.select("id", "body"), folder)
    names = touched.select(F.regexp_replace(pack_path(F.col("pack_id") * PACK), "^revisions/", "").alias("path"))
    return names.join(written, "path", "left").select("path", F.coalesce("n", F.lit(0)).alias("n"))


def write_missing_packs(spark: SparkSession, bodies: DataFrame, folder: str) -> DataFrame:
    """As :func:`write_packs`, but only the packs that ``folder`` lacks, or of which it lacks an entry.

    A pack that is there is there as a whole, so what is in ``folder`` is the
    manifest: a job that was stopped goes on where it ended, and one that had
    ended writes nothing.  Entries that such a pack holds beyond ``bodies`` stay.
    Only ids are compared; bodies of packs that are done are not read.
    """
    ids = bodies.where(F.col("body").isNotNull()).select("id")
    there = pack_entries(spark, folder)
    lacking = written(ids.join(there, "id", "left_anti").select(pack_id(F.col("id")).alias("pack_id")).distinct(), "lacking-packs")
    own = bodies.select("id", "body", pack_id(F.col("id")).alias("pack_id")).join(lacking, "pack_id", "left_semi")
    held = read_packs(spark, folder).withColumn("pack_id", pack_id(F.col("id"))).join(lacking, "pack_id", "left_semi").join(ids, "id", "left_anti")
    return write_packs(own.select("id", "body").union(held.select("id", "body")), folder)


def migrate(spark: SparkSession, project: str, folder: str, hierarchical: bool = True) -> DataFrame:
    """A project of loose files (flat or hierarchical) as packs in ``folder``: path and n of each pack that was written.

    Each body is read once.  Stopped half-way, the next call writes the rest.
    """
    return write_missing_packs(spark, read_loose(spark, project, hierarchical).select("id", "body"), folder)


def missing_packs(revisions: DataFrame, loose: DataFrame, entries: DataFrame) -> DataFrame:
    """pack_id and n_loose of the packs that should be there and are not.

    A pack is due once its last revision is recorded (``revisions``: id); it is
    missing if none of its ids is an entry of a pack (``entries``: id) while
    bodies of it still lie about (``loose``: id), as a full disk or a crash
    between both leaves them.
    """
    due = revisions.where(F.col("id") % PACK == PACK - 1).select(pack_id(F.col("id")).alias("pack_id"))
    held = entries.select(pack_id(F.col("id")).alias("pack_id")).distinct()
    lying = loose.groupBy(pack_id(F.col("id")).alias("pack_id")).agg(F.count(F.lit(1)).alias("n_loose"))
    return lying.join(due, "pack_id", "left_semi").join(held, "pack_id", "left_anti")


def rebuild_packs(spark: SparkSession, project: str, revisions: DataFrame) -> DataFrame:
    """Write the missing packs of a project from its loose files; path and n of each."""
    loose = read_loose(spark, project)
    gone = missing_packs(revisions, loose.select("id"), pack_entries(spark, project))
    due = loose.withColumn("pack_id", pack_id(F.col("id"))).join(gone, "pack_id", "left_semi")
    return write_packs(due.select("id", "body"), project)
