"""Revisions of resources: the default one, freshness, ETags, 304 responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import http


def newest(revisions: DataFrame, where: Column | None = None) -> DataFrame:
    """The revision of the greatest id of each resource, among those for which ``where`` holds.

    A hash aggregation of ids with partial maxima, whose result picks the rows;
    headers and bodies are shuffled only if that result is too large to broadcast.
    """
    rows = revisions if where is None else revisions.where(where)
    latest = rows.groupBy("resource_id").agg(F.max("id").alias("id")).select("id")
    return rows.join(latest, "id", "left_semi").select(rows.columns)


def of_resource(revisions: DataFrame, resource_id: int, newest_first: bool = False) -> DataFrame:
    return revisions.where(F.col("resource_id") == resource_id).orderBy(F.desc("id") if newest_first else F.asc("id"))


def latest_ok(revisions: DataFrame, error: Column, n: int = 3) -> DataFrame:
    """The ``n`` newest revisions before the last that are without error."""
    last = revisions.agg(F.max("id").alias("_last"))  # one row
    return revisions.crossJoin(F.broadcast(last)).where((F.col("id") < F.col("_last")) & ~error).drop("_last").orderBy(F.desc("id")).limit(n)


def with_any(resources: DataFrame, revisions: DataFrame) -> DataFrame:
    return resources.join(revisions.select(F.col("resource_id").alias("id")), "id", "left_semi")


def without_any(resources: DataFrame, revisions: DataFrame) -> DataFrame:
    return resources.join(revisions.select(F.col("resource_id").alias("id")), "id", "left_anti")


def by_etag(revisions: DataFrame) -> DataFrame:
    """The latest revision that is no 304, of each resource and ETag: resource_id, etag, revision_id, n_revisions."""
    known = revisions.where(F.col("etag").isNotNull() & ~http.is_not_modified(F.col("status_code")))
    return known.groupBy("resource_id", "etag").agg(F.max("id").alias("revision_id"), F.count(F.lit(1)).alias("n_revisions"))


def resolve_not_modified(revisions: DataFrame) -> DataFrame:
    """Each revision with target_id: what a 304 stands for, else itself, and the headers as served.

    Needs id, resource_id, status_code, etag and headers.  Only what a 304
    stands for is joined: rows without a target would all have the same key,
    null, and so be one task's work.
    """
    targets = by_etag(revisions).select("resource_id", "etag", F.col("revision_id").alias("_target"))
    bodies = revisions.select(F.col("id").alias("_target"), F.col("headers").alias("_headers"))
    asking = F.coalesce(http.is_not_modified(F.col("status_code")) & F.col("etag").isNotNull(), F.lit(False))
    asked, key = revisions.where(asking), ["resource_id", "etag"]
    found = asked.join(targets, key).join(bodies, "_target")
    found = found.select(*revisions.columns, F.col("_target").alias("target_id"), http.overlay(F.col("_headers"), F.col("headers")).alias("served_headers"))
    others = revisions.where(~asking).unionByName(asked.join(targets, key, "left_anti"))
    return found.unionByName(others.withColumn("target_id", F.col("id")).withColumn("served_headers", F.col("headers")))


def fill_etag(revisions: DataFrame) -> DataFrame:
    """304 revisions without ETag get their resource's, if exactly one is known."""
    single = by_etag(revisions).groupBy("resource_id").agg(F.min("etag").alias("_only"), F.count(F.lit(1)).alias("_n")).where("_n = 1")
    joined = revisions.join(single, "resource_id", "left")
    filled = F.when(http.is_not_modified(F.col("status_code")) & F.col("etag").isNull(), F.col("_only")).otherwise(F.col("etag"))
    return joined.withColumn("etag", filled).select(revisions.columns)


def cookies_by_recency(revisions: DataFrame) -> DataFrame:
    """Distinct request cookies, the most recently used first."""
    return revisions.where(F.col("request_cookie").isNotNull()).groupBy("request_cookie").agg(F.max("id").alias("last_id")).orderBy(F.desc("last_id"))


def orphans(revisions: DataFrame, bodies: DataFrame) -> DataFrame:
    """Revisions without a body, and bodies without a revision: id and problem.  Errors need no body."""
    lacking = revisions.where(~http.has_error(F.col("error"))).join(bodies.select("id"), "id", "left_anti").select("id", F.lit("missing body").alias("problem"))
    stray = bodies.join(revisions.select("id"), "id", "left_anti").select("id", F.lit("missing revision").alias("problem"))
    return lacking.union(stray)


def repairs(revisions: DataFrame, bodies: DataFrame, n: int = 3) -> DataFrame:
    """The id of the newest revision, if its body is missing and those of the ``n`` good ones before it are there: what a repair removes.

    Where earlier bodies are missing too, the store itself is away or broken,
    and nothing is named.
    """
    error = http.has_error(F.col("error"))
    before = latest_ok(revisions, error, n).join(bodies.select("id"), "id", "left_semi").agg(F.count(F.lit(1)).alias("_readable"))
    last = revisions.where(~error).orderBy(F.desc("id")).limit(1).join(revisions.agg(F.max("id").alias("id")), "id", "left_semi")
    return last.join(bodies.select("id"), "id", "left_anti").crossJoin(F.broadcast(before)).where(F.col("_readable") == n).select("id")


def deleted(revisions: DataFrame, bodies: DataFrame, resources: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Resources, revisions and bodies without the resources of ``gone`` (id) and what belongs to them."""
    ids = gone.select("id")
    mine = revisions.join(ids.withColumnRenamed("id", "resource_id"), "resource_id", "left_semi")
    kept = revisions.join(ids.withColumnRenamed("id", "resource_id"), "resource_id", "left_anti").select(revisions.columns)
    return resources.join(ids, "id", "left_anti").select(resources.columns), kept, bodies.join(mine.select("id"), "id", "left_anti").select(bodies.columns)


def renamed(table: DataFrame, names: DataFrame, key: str = "id") -> DataFrame:
    """A table of roots, groups or the like with the new names of ``names`` (key, name); others stay."""
    new = names.select(key, F.col("name").alias("_name"), F.lit(True).alias("_new"))
    joined = table.join(new, key, "left")
    return joined.withColumn("name", F.when(F.col("_new"), F.col("_name")).otherwise(F.col("name"))).select(table.columns)
