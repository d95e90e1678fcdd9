"""Project tables laid out for lookups and joins that shuffle nothing.

Resources are bucketed by id, revisions by their resource: the join of both is
bucket against bucket.  Within a bucket rows are sorted, so page statistics
prune ranges of ids, and URLs have Bloom filters, so that a lookup of one URL
skips the row groups without it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Bucketing and sorting columns, and columns with Bloom filters, of each table that is laid out.
LAYOUT = {
    "resource": (["id"], ["id"], ["url"]),
    "resource_revision": (["resource_id"], ["resource_id", "id"], ["request_cookie"]),
}
#: Distinct values that a file's Bloom filter is sized for; more of them only make it less sharp.
_DISTINCT = 1_000_000


def lay_out(tables: dict[str, DataFrame], folder: str, buckets: int = 64, prefix: str = "") -> dict[str, DataFrame]:
    """Write the tables of ``LAYOUT`` among ``tables`` below ``folder``; returns them as they read from there.

    One shuffle a table, by its bucketing column, so each bucket is one file.
    The tables are named in the session's catalogue, with ``prefix``.
    """
    for name in LAYOUT.keys() & tables.keys():
        by, order, blooms = LAYOUT[name]
        write = tables[name].repartition(buckets, *by).write.mode("overwrite").bucketBy(buckets, *by).sortBy(*order)
        for c in blooms:
            write = write.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.bloom.filter.expected.ndv#{c}", str(_DISTINCT))
        write.option("path", f"{folder}/{name}").format("parquet").saveAsTable(f"{prefix}{name}")
    return {name: next(iter(tables.values())).sparkSession.table(f"{prefix}{name}") for name in LAYOUT.keys() & tables.keys()}


def open_layout(spark: SparkSession, folder: str, schemas: dict[str, str], buckets: int = 64, prefix: str = "") -> dict[str, DataFrame]:
    """Tables that another session has laid out; ``schemas`` and ``buckets`` as they were written."""
    for name, schema in schemas.items():
        by, order, _ = LAYOUT[name]
        spark.sql(f"CREATE TABLE IF NOT EXISTS {prefix}{name} ({schema}) USING parquet CLUSTERED BY ({', '.join(by)}) SORTED BY ({', '.join(order)}) INTO {buckets} BUCKETS LOCATION '{folder}/{name}'")
    return {name: spark.table(f"{prefix}{name}") for name in schemas}


def resources_with_revisions(resources: DataFrame, revisions: DataFrame) -> DataFrame:
    """Each revision with its resource's URL; without an exchange where both are laid out."""
    return revisions.join(resources.withColumnRenamed("id", "resource_id"), "resource_id")
