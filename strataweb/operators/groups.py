"""Pattern groups: standing predicates over URLs and what follows from membership.

Patterns are few against URLs.  A list of patterns known to the driver becomes
one projection: an array of the fitting patterns, each tested by prefix and
regular expression, with no join at all.  Patterns in a table, however many, are
found by an index of their literals (:mod:`.pattern_index`).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns
from ..sources.scratch import written
from . import pattern_index


@dataclass(frozen=True)
class Group:
    """A pattern group; ``source`` names the kind and id of what links to its members."""

    id: int
    name: str
    pattern: str
    do_not_download: bool = False
    source_type: str | None = None
    source_id: int | None = None


def members(resources: DataFrame, pattern: str, at_wildcard: bool = False) -> DataFrame:
    """The resources of a pattern; the literal prefix is pushed to the scan, and a pattern without wildcard is a point lookup."""
    if patterns.is_literal(pattern):
        return resources.where(F.col("url") == pattern)
    return resources.where(patterns.matches(F.col("url"), pattern, at_wildcard))


def preview(resources: DataFrame, pattern: str, limit: int = 100) -> DataFrame:
    """The first ``limit`` URLs by URL, and a row that counts the further rows of the prefix, if there are any."""
    found = members(resources, pattern)
    shown = found.select("url").orderBy("url").limit(limit + 1)
    kept = shown.orderBy("url").limit(limit)
    if patterns.is_literal(pattern):
        return kept.select("url", F.lit(None).cast("long").alias("more"))
    bound = resources.where(F.col("url").startswith(patterns.literal_prefix(pattern))).agg(F.count(F.lit(1)).alias("n"))
    more = shown.agg(F.count(F.lit(1)).alias("shown")).crossJoin(bound).where(F.col("shown") > limit)  # two single rows
    return kept.select("url", F.lit(None).cast("long").alias("more")).union(more.select(F.lit(None).cast("string"), F.col("n") - limit))


def prefix_count(resources: DataFrame, pattern: str) -> DataFrame:
    """An upper bound of a pattern's members: the rows of its prefix."""
    return resources.where(F.col("url").startswith(patterns.literal_prefix(pattern))).agg(F.count(F.lit(1)).alias("n"))


def fitting(url: Column, groups: list[Group]) -> Column:
    """Ids of the groups that contain the URL, in the groups' order."""
    if not groups:
        return F.array().cast("array<bigint>")
    return F.array_compact(F.array(*(F.when(patterns.matches(url, g.pattern), F.lit(g.id).cast("long")) for g in groups)))


def group_table(spark: SparkSession, groups: list[Group]) -> DataFrame:
    rows = [(g.id, g.name, g.pattern, g.do_not_download, g.source_type, g.source_id, patterns.literal_prefix(g.pattern), patterns.pattern_regex(g.pattern)) for g in groups]
    return spark.createDataFrame(rows, "group_id long, name string, url_pattern string, do_not_download boolean, source_type string, source_id long, prefix string, regex string")


def membership(resources: DataFrame, groups: list[Group]) -> DataFrame:
    """One row a resource and group that contains it: the resource's columns and group_id."""
    return resources.withColumn("group_id", F.explode(fitting(F.col("url"), groups)))


def membership_by_table(resources: DataFrame, groups: DataFrame) -> DataFrame:
    """As :func:`membership` for a table of groups (group_id, url_pattern, regex) of any size, by an index of their rarest literals."""
    return pattern_index.membership(resources, groups)


def without_do_not_download(resources: DataFrame, groups: list[Group]) -> DataFrame:
    """Resources that no do-not-download group contains: a filter, not a join."""
    banned = [g for g in groups if g.do_not_download]
    return resources.where(F.size(fitting(F.col("url"), banned)) == 0)


def only_do_not_download(url: Column, groups: list[Group]) -> Column:
    """For display: in a do-not-download group and in no other."""
    banned, others = [g for g in groups if g.do_not_download], [g for g in groups if not g.do_not_download]
    return (F.size(fitting(url, banned)) > 0) & (F.size(fitting(url, others)) == 0)


def status_badge(url: Column, groups: list[Group], revision_id: Column, stale: Column, error: Column) -> Column:
    """dnd, new, stale, ok or warning, the first that holds."""
    return F.when(only_do_not_download(url, groups), "dnd").when(revision_id.isNull(), "new").when(stale, "stale").when(~error, "ok").otherwise("warning")


def member_counts(resources: DataFrame, groups: list[Group]) -> DataFrame:
    """Members of every group, groups without any too."""
    spark = resources.sparkSession
    counted = membership(resources, groups).groupBy("group_id").agg(F.count(F.lit(1)).alias("n_members"))
    return group_table(spark, groups).select("group_id", "name").join(counted, "group_id", "left").select("group_id", "name", F.coalesce("n_members", F.lit(0)).cast("long").alias("n_members"))


def narrowest(urls: DataFrame, groups: list[Group]) -> DataFrame:
    """The most specific group that contains each URL (columns kept), as group_id; null if none."""
    specificity = F.array(*(F.struct(patterns.genericity(F.lit(g.pattern)).alias("g"), F.lit(g.id).cast("long").alias("id"), patterns.matches(F.col("url"), g.pattern).alias("fits")) for g in groups))
    best = F.array_min(F.filter(specificity, lambda s: s["fits"]))
    return urls.withColumn("group_id", best["id"])


def source_of(referrers: DataFrame, roots: DataFrame, groups: list[Group], on: str = "url") -> DataFrame:
    """What a referrer belongs to: the root of its URL (or of its other column ``on``), else its URL's narrowest group (source_type, source_id)."""
    found = narrowest(referrers, groups).join(roots.select(on, "root_id"), on, "left")
    kind = F.when(F.col("root_id").isNotNull(), "root_resource").when(F.col("group_id").isNotNull(), "resource_group")
    return found.select(*referrers.columns, kind.alias("source_type"), F.coalesce("root_id", "group_id").alias("source_id"))


def sources(groups: DataFrame, roots: DataFrame) -> DataFrame:
    """Each group with the name of its source, whichever kind that is; ``source_ok`` is false for a dangling one."""
    root = roots.select(F.col("root_id").alias("source_id"), F.col("name").alias("_root"), F.lit("root_resource").alias("source_type"))
    group = groups.select(F.col("group_id").alias("source_id"), F.coalesce(F.nullif("name", F.lit("")), "url_pattern").alias("_group"), F.lit("resource_group").alias("source_type"))
    joined = groups.join(root, ["source_type", "source_id"], "left").join(group, ["source_type", "source_id"], "left")
    name = F.coalesce("_root", "_group")
    return joined.select("group_id", "source_type", "source_id", name.alias("source_name"), (F.col("source_type").isNull() | name.isNotNull()).alias("source_ok"))


def source_closure(groups: DataFrame) -> DataFrame:
    """Every group with every group it comes from, directly or through others, and the distance.

    By path doubling: a round knows all sources within d steps and each
    group's one source (a group has at most one) at exactly d steps, and joins
    both to get those within 2 d, so a chain of n groups takes about log2(n)
    rounds.  It ends when a round finds nothing new, cycles included.  A group
    is no ancestor of itself; on a cycle the least distance counts.
    """
    steps = groups.where("source_type = 'resource_group' and group_id <> source_id").select("group_id", F.col("source_id").alias("ancestor_id")).distinct()
    jumps = written(steps, "group-sources")
    found, d = written(jumps.withColumn("depth", F.lit(1)), "group-sources"), 1
    while True:
        over = jumps.select("group_id", F.col("ancestor_id").alias("_at"))
        beyond = over.join(found.select(F.col("group_id").alias("_at"), "ancestor_id", F.col("depth").alias("_more")), "_at")
        beyond = beyond.where("group_id <> ancestor_id").groupBy("group_id", "ancestor_id").agg((F.min("_more") + d).cast("int").alias("depth"))
        fresh = written(beyond.join(found, ["group_id", "ancestor_id"], "left_anti"), "group-sources")
        if fresh.isEmpty():
            return found
        found = written(found.union(fresh), "group-sources")
        jumps = written(over.join(jumps.select(F.col("group_id").alias("_at"), "ancestor_id"), "_at").select("group_id", "ancestor_id").distinct(), "group-sources")
        d *= 2


def link_clusters(links: DataFrame, roots: DataFrame, groups: list[Group], default_domain: str | None = None) -> DataFrame:
    """Each link's cluster: embedded, root resource, group (one row each), offsite or other."""
    site = F.regexp_extract("url", r"^https?://([^/?#]*)", 1)
    other_site = F.regexp_extract("target_url", r"^https?://([^/?#]*)", 1) != (F.lit(default_domain) if default_domain else site)
    met = links.join(roots.select(F.col("url").alias("target_url"), "root_id"), "target_url", "left").withColumn("_groups", fitting(F.col("target_url"), groups))
    plain = F.when(F.col("embedded"), "embedded").when(F.col("root_id").isNotNull(), "root").when(other_site, "offsite").otherwise("other")
    in_group = ~F.col("embedded") & F.col("root_id").isNull() & (F.size("_groups") > 0)
    labels = F.when(in_group, F.transform("_groups", lambda g: F.concat(F.lit("group "), g.cast("string")))).otherwise(F.array(plain))
    return met.withColumn("cluster", F.explode(labels)).drop("_groups", "root_id")


def whole_site(url: Column) -> Column:
    """The pattern of everything under a URL."""
    return F.concat(url, F.lit("**"))
