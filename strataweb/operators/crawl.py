"""Crawl over stored captures: from pages to links to pages, round by round.

The frontier and the visited set are one table, partitioned by depth, in the
folder that the cluster shares.  A round joins the last depth with the
captures' resolved links (hash join on the URL), aggregates the new URLs,
removes the visited ones by an anti-join, and appends what is left: no round
writes what an earlier one has written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.scratch import folders, new_folder, remove, written
from .groups import Group, fitting

#: Longest chain of resources that embed one another, the first included.
MAX_EMBEDDING = 3


def _steps(links: DataFrame, groups: list[Group] | None, embedded_only: bool = False) -> DataFrame:
    """The distinct steps from URL to URL, without those into do-not-download groups, written down."""
    steps = links.where("embedded") if embedded_only else links
    steps = steps.select("url", "target_url").where("url <> target_url").distinct()
    banned = [g for g in groups or [] if g.do_not_download]
    if banned:
        steps = steps.where(F.size(fitting(F.col("target_url"), banned)) == 0)
    return written(steps, "crawl-links")


def _unseen(last: DataFrame, steps: DataFrame, seen: DataFrame) -> DataFrame:
    """The URLs one step from the last that were not seen.  Merge joins: broadcasts of every round would add up in the driver."""
    found = last.join(steps.hint("merge"), "url").select(F.col("target_url").alias("url")).distinct()
    return found.join(seen.select("url").hint("merge"), "url", "left_anti")


def _walk(seeds: DataFrame, steps: DataFrame, folder: str, visited: Callable[[], DataFrame], max_depth: int | None = None) -> None:
    """Write what the seeds reach to ``folder``, a folder a depth; ``visited`` reads all that was reached so far."""
    spark = seeds.sparkSession
    seeds.select("url").distinct().write.parquet(f"{folder}/depth=0")
    depth = 0
    while max_depth is None or depth < max_depth:
        last = spark.read.schema("url string").parquet(f"{folder}/depth={depth}")
        size = Observation()  # counted as it is written
        fresh = _unseen(last, steps, visited()).observe(size, F.count(F.lit(1)).alias("n"))
        depth += 1
        fresh.write.parquet(f"{folder}/depth={depth}")
        if not size.get["n"]:
            break


def frontier(seeds: DataFrame, links: DataFrame, max_depth: int | None = None, groups: list[Group] | None = None, embedded_only: bool = False) -> DataFrame:
    """Every URL that the seeds reach: url and depth (least number of links).

    ``links`` has url and target_url (and embedded).  Do-not-download groups
    are never entered.  The crawl ends at the fixpoint or at ``max_depth``.
    """
    spark, folder = seeds.sparkSession, new_folder(seeds.sparkSession, "crawl")

    def reached() -> DataFrame:
        return spark.read.schema("url string, depth int").option("basePath", folder).parquet(folder)

    _walk(seeds, _steps(links, groups, embedded_only), folder, reached, max_depth)
    return reached().select("url", "depth")


def standing(seeds: DataFrame, links: DataFrame, path: str, checkpoint: str, groups: list[Group] | None = None) -> StreamingQuery:
    """Crawl on from a stream of seeds (url): each micro-batch walks from its URLs to what was not visited yet, whenever they come.

    Work done so far is the state: a folder an epoch and depth below ``path``,
    which :func:`visited` reads.  A stopped crawl goes on where it ended; an
    epoch that is run again replaces its own folder.  Runs on all that has
    arrived, then stops; ``links`` are those of the start.
    """
    steps = _steps(links, groups)
    # A crawl without seeds has visited nothing, which can be read as well.
    seeds.sparkSession.createDataFrame([], "url string, epoch int, depth int").write.mode("ignore").partitionBy("epoch", "depth").parquet(path)

    def advance(batch: DataFrame, epoch: int) -> None:
        spark, folder = batch.sparkSession, f"{path}/epoch={epoch}"
        remove(spark, folder)  # what a run of this epoch may have left
        seen = written(visited(spark, path).select("url"), "crawl-visited")
        own = batch.select("url").where("url is not null").distinct().join(seen, "url", "left_anti")
        reached = lambda: seen.union(spark.read.schema("url string").parquet(*(f"{folder}/{d}" for d in folders(spark, folder))))
        _walk(own, steps, folder, reached)

    query = seeds.writeStream.foreachBatch(advance).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def visited(spark: SparkSession, path: str) -> DataFrame:
    """url, epoch and depth (links from that epoch's seeds) of everything a standing crawl has visited."""
    return spark.read.schema("url string, epoch int, depth int").option("basePath", path).parquet(path)


def embedding_chains(seeds: DataFrame, links: DataFrame, most: int = MAX_EMBEDDING) -> DataFrame:
    """Chains of embedded resources: url, path (the chain with itself) and depth; no resource twice in a chain.

    Only chains of fewer than ``most`` resources are expanded, so the paths
    stay short and the loop ends.
    """
    embedded = links.where("embedded").groupBy("url", "target_url").agg(F.min("pos").alias("pos"))
    chains = seeds.select("url", F.array("url").alias("path"), F.lit(1).alias("depth"))
    found = chains
    for depth in range(2, most + 1):
        met = chains.join(embedded, "url").where(~F.array_contains("path", F.col("target_url")))
        chains = met.select(F.col("target_url").alias("url"), F.concat("path", F.array("target_url")).alias("path"), F.lit(depth).alias("depth"))
        found = found.union(chains)
    return found


def pending(work: DataFrame, fresh_revisions: DataFrame) -> DataFrame:
    """The URLs of the resources of a work list (id, url, priority) that have no fresh revision (resource_id), each once, the most urgent first."""
    left = work.join(fresh_revisions.select(F.col("resource_id").alias("id")), "id", "left_anti")
    return left.groupBy("url").agg(F.max("priority").alias("priority")).orderBy(F.desc("priority"), "url")


def resume(members: DataFrame, last_done: int | None) -> DataFrame:
    """Members after the last one that is done, in member order."""
    return members if last_done is None else members.where(F.col("id") > last_done)
