"""Standing queries over growing tables: membership, work lists, progress."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..operators.groups import Group, membership


def resource_stream(spark: SparkSession, path: str, schema: str, glob: str | None = None, max_files: int | None = None) -> DataFrame:
    """A Parquet folder as a stream of resources."""
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def standing_membership(resources: DataFrame, groups: list[Group]) -> DataFrame:
    """Each new resource with every group that contains it: a stateless projection, so it appends."""
    return membership(resources, groups)


def member_counts(resources: DataFrame, groups: list[Group]) -> DataFrame:
    """Running member counts of each group (complete or update mode); state is one row a group."""
    return membership(resources, groups).groupBy("group_id").agg(F.count(F.lit(1)).alias("n_members"))


def first_seen(resources: DataFrame, column: str = "url", event_time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Each value once in a session.  With an event time the state is bounded by the watermark."""
    if event_time:
        return resources.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([column])
    return resources.dropDuplicates([column])


def run_available(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append all that has arrived to a Parquet folder, then stop; the checkpoint folder resumes there the next time."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()
    query.awaitTermination()
    return query


_LOG = "id long, url string, group_id long, seq long"


def maintain(changes: DataFrame, groups: list[Group], path: str, checkpoint: str) -> StreamingQuery:
    """Members under changes: rows (seq, id, url, deleted) replace what was known of their ids.

    Each micro-batch appends what changed to a log, in a folder of its own: the
    new groups of every changed id, and one row without a group that retracts
    the old ones.  Nothing that is there is read or rewritten; a batch that is
    run again replaces its own folder.  :func:`current_members` reads the log,
    :func:`compact` shortens it.
    """

    def apply(batch: DataFrame, epoch: int) -> None:
        last = batch.groupBy("id").agg(F.max_by("url", "seq").alias("url"), F.max_by("deleted", "seq").alias("deleted"), F.max("seq").alias("seq"))
        changed = last.select("id", "url", F.lit(None).cast("long").alias("group_id"), "seq")
        members = membership(last.where("not deleted"), groups).select("id", "url", "group_id", "seq")
        changed.union(members).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    query = changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def current_members(spark: SparkSession, path: str) -> DataFrame:
    """id, url and group_id as the last change of each id left them."""
    log = spark.read.schema(f"{_LOG}, epoch int").option("basePath", path).parquet(path)
    last = log.groupBy("id").agg(F.max("seq").alias("seq"))
    return log.where(F.col("group_id").isNotNull()).join(last, ["id", "seq"], "left_semi").select("id", "url", "group_id")


def compact(spark: SparkSession, path: str, to: str) -> None:
    """Write the log of ``path`` with only what still holds, as the first folder of a new log at ``to``."""
    log = spark.read.schema(f"{_LOG}, epoch int").option("basePath", path).parquet(path)
    last = log.groupBy("id").agg(F.max("seq").alias("seq"))
    log.join(last, ["id", "seq"], "left_semi").select("id", "url", "group_id", "seq").write.parquet(f"{to}/epoch=-1")


class ProgressFeed(StreamingQueryListener):
    """Calls ``report`` with (name, batch, input rows, rows a second) after each micro-batch."""

    def __init__(self, report: Callable[[str, int, int, float], None]):
        self.report = report

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.report(p.name or str(p.id), p.batchId, p.numInputRows, p.processedRowsPerSecond)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
