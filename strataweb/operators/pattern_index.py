"""Membership of URLs in very many patterns: an inverted index of their rarest literals.

A URL that fits a pattern holds all the pattern's literal pieces.  So each
pattern is filed under one key: its literal prefix, or a run of ``GRAM``
characters of one of its pieces, whichever the fewest URLs have.  Each URL then
meets only the patterns filed under its own keys, and the expressions decide.
However many patterns begin alike, candidates stay in proportion to what really
shares a rare literal.

Keys are 64-bit hashes; one that two literals share only makes a candidate more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written

#: Characters of the literals that are looked up anywhere in a URL.
GRAM = 6
#: Keys, and bytes of the filed patterns, that are broadcast; beyond that the joins shuffle, and skewed keys are split by AQE.
MAX_BROADCAST_KEYS, MAX_BROADCAST_BYTES = 1 << 20, 64 << 20


def _prefix_key(text: Column) -> Column:
    return F.xxhash64(F.lit("^"), text)


def _gram_key(text: Column) -> Column:
    return F.xxhash64(F.lit("~"), text)


def _grams(text: Column, n: int) -> Column:
    """All runs of ``n`` characters, in one pass over the text."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))


def keys_of_patterns(groups: DataFrame) -> DataFrame:
    """url_pattern and each key that its pattern may be filed under, with the length of the text behind it (prefixes negative).

    A pattern of wildcards alone has the key of the empty prefix, which every URL has.
    """
    prefix = F.regexp_extract("url_pattern", r"^([^*#@]*)", 1)
    pieces = F.filter(F.split("url_pattern", "[*#@]+"), lambda p: p != "")
    whole = F.filter(pieces, lambda p: F.length(p) >= GRAM)
    runs = F.flatten(F.transform(whole, lambda p: _grams(p, GRAM)))
    # Short pieces count only where there is nothing longer.
    texts = F.when(F.size(whole) > 0, runs).otherwise(pieces)
    keys = F.concat(
        F.array(F.struct(_prefix_key(prefix).alias("key"), (-F.length(prefix)).alias("length"))),
        F.transform(texts, lambda t: F.struct(_gram_key(t).alias("key"), F.length(t).alias("length"))),
    )
    return groups.select("url_pattern").distinct().select("url_pattern", F.inline(F.array_distinct(keys)))


def keys_of_urls(url: Column, lengths: list[int]) -> Column:
    """The keys of a URL for texts of these lengths (prefixes negative), each once."""
    prefixes = [-n for n in lengths if n <= 0]
    first = F.filter(F.array(*(F.lit(n) for n in prefixes)) if prefixes else F.array().cast("array<int>"), lambda n: n <= F.length(url))
    parts = [F.transform(first, lambda n: _prefix_key(F.substring(url, F.lit(1), n)))]
    parts += [F.transform(_grams(url, n), _gram_key) for n in lengths if n > 0]
    return F.array_distinct(F.concat(*parts))


def index(resources: DataFrame, groups: DataFrame) -> tuple[DataFrame, list[int]]:
    """Each pattern (group_id, url_pattern, regex) filed under the key that the fewest URLs have: key, group_id, regex; and the keys' lengths.

    Patterns with a key that no URL has fit none and are left out.
    """
    groups = groups.where(F.col("url_pattern").isNotNull())
    keys = written(keys_of_patterns(groups), "pattern-keys")
    asked = keys.select("key").distinct()
    asked = F.broadcast(asked) if asked.count() <= MAX_BROADCAST_KEYS else asked
    # At most the longest prefix and GRAM different numbers.
    lengths = sorted(r["length"] for r in keys.select("length").distinct().collect())
    met = resources.select(F.explode(keys_of_urls(F.col("url"), lengths)).alias("key"))
    counts = met.join(asked, "key", "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    # A key without a count has no URL, and its patterns have no member.
    rated = keys.join(counts, "key", "left").groupBy("url_pattern").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key", "length")).alias("best"))
    filed = groups.select("group_id", "url_pattern", "regex").join(rated.where("best.n > 0"), "url_pattern").select("best.key", "best.length", "group_id", "regex")
    filed = written(filed, "pattern-index")
    return filed.select("key", "group_id", "regex"), sorted(r["length"] for r in filed.select("length").distinct().collect())


def candidates(resources: DataFrame, filed: DataFrame, lengths: list[int]) -> DataFrame:
    """Each resource with every pattern filed under one of its keys: the resource's columns, group_id and regex."""
    size = filed.agg(F.sum(F.length("regex") + 32).alias("b")).first()["b"] or 0
    filed = F.broadcast(filed) if size <= MAX_BROADCAST_BYTES else filed
    keyed = resources.where(F.col("url").isNotNull()).withColumn("_pattern_key", F.explode(keys_of_urls(F.col("url"), lengths)))
    return keyed.join(filed.withColumnRenamed("key", "_pattern_key"), "_pattern_key").drop("_pattern_key")


def membership(resources: DataFrame, groups: DataFrame) -> DataFrame:
    """One row a resource and group of a table of groups (group_id, url_pattern, regex) that contains it: the resource's columns and group_id.

    Null URLs and null patterns meet nothing; repeated resources come out
    repeated, repeated groups too.  Each pattern is filed and tested once,
    however many groups have it (its regex is the same in all of them); the
    groups join what fits.
    """
    groups = groups.where(F.col("url_pattern").isNotNull())
    patterns = written(groups.groupBy("url_pattern").agg(F.first("regex").alias("regex")), "pattern-texts")
    filed, lengths = index(resources, patterns.withColumn("group_id", F.col("url_pattern")))
    fitting = candidates(resources, filed, lengths).where(F.expr("url rlike regex")).select(*resources.columns, F.col("group_id").alias("_pattern"))
    return fitting.join(groups.select("group_id", F.col("url_pattern").alias("_pattern")), "_pattern").select(*resources.columns, "group_id")
