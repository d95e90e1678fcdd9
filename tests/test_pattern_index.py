"""Membership in tables of patterns: against brute force, and how many candidates the index makes."""

import random

from pyspark.sql import functions as F

from strataweb.functions import patterns
from strataweb.operators import pattern_index

URLS = "id long, url string"
GROUPS = "group_id long, url_pattern string, regex string"


def table(spark, given):
    return spark.createDataFrame([(k, p, None if p is None else patterns.pattern_regex(p)) for k, p in given], GROUPS)


def test_membership_equals_brute_force(spark):
    r = random.Random(11)
    words = ["a", "ab", "item", "archive", "über", "page", "x.y", "q=1", "1", "27", "305"]
    urls = ["https://" + "/".join(r.choice(words) for _ in range(r.randint(1, 5))) + r.choice(["", "/", "?q=1", "\n"]) for _ in range(400)] + [None, "", "7", "https://"]
    given = ["https://" + "/".join(r.choice([*words, "*", "**", "#", "a*", "#b"]) for _ in range(r.randint(1, 4))) + r.choice(["", "**", "/"]) for _ in range(300)]
    given += [None, "", "**", "*", "#", "@", "https://**", "**/page/**", "**27", "https://über/a@b", "https://nowhere/**"]
    rows, many = spark.createDataFrame(list(enumerate(urls)) + [(0, urls[0])], URLS), list(enumerate(given)) + [(7, given[7])]
    regexes = [(k, p) for k, p in many if p is not None]
    tested = spark.createDataFrame([(k, patterns.pattern_regex(p)) for k, p in regexes], "group_id long, regex string")
    wanted = rows.crossJoin(tested).where(F.expr("url rlike regex")).select("id", "url", "group_id")
    found = pattern_index.membership(rows, table(spark, many))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, wanted.collect()))


def test_shuffled_joins_give_the_same(spark, monkeypatch):
    rows = spark.range(500).select("id", F.concat(F.lit("https://s.test/"), F.col("id") % 50, F.lit("/p"), F.col("id")).alias("url"))
    given = table(spark, [(k, f"https://s.test/{k}/**") for k in range(100)])
    wanted = sorted(map(tuple, pattern_index.membership(rows, given).collect()))
    assert len(wanted) == 500
    monkeypatch.setattr(pattern_index, "MAX_BROADCAST_KEYS", 0)
    monkeypatch.setattr(pattern_index, "MAX_BROADCAST_BYTES", 0)
    assert sorted(map(tuple, pattern_index.membership(rows, given).collect())) == wanted


def test_candidates_stay_near_the_hits(spark):
    rows = spark.range(3000).select("id", F.concat(F.lit("https://one.test/"), F.when(F.col("id") % 3 == 0, "en").otherwise("fr"), F.lit("/item"), F.col("id"), F.lit("/")).alias("url"))
    many = spark.range(10_000).select(F.col("id").alias("group_id"), F.concat(F.lit("https://**/item"), F.col("id"), F.lit("/")).alias("url_pattern"))
    many = many.withColumn("regex", patterns.regex_of(F.col("url_pattern")))
    filed, lengths = pattern_index.index(rows, many)
    met = pattern_index.candidates(rows, filed, lengths)
    hits = met.where(F.expr("url rlike regex")).count()
    assert hits == 3000
    assert met.count() <= 12 * hits and filed.count() <= 10_000


def test_regexes_of_columns_equal_those_of_texts(spark):
    given = ["https://a.b/*/c#?x=1&y=**", "***", "#*", "a+b(c)[d]{e}|^$\\-~<>!, é@", "", "https://x/~u:8080/"]
    rows = spark.createDataFrame([(p,) for p in given], "p string").select("p", patterns.regex_of(F.col("p")).alias("r")).collect()
    assert [r["r"] for r in rows] == [patterns.pattern_regex(r["p"]) for r in rows]


def test_a_pattern_of_many_groups_is_tested_once(spark, monkeypatch):
    rows = spark.range(40).select("id", F.concat(F.lit("https://s.test/p"), F.col("id")).alias("url"))
    given = [(k, "https://s.test/**") for k in range(50)]
    tested, candidates = [], pattern_index.candidates

    def counted(*args):
        tested.append(candidates(*args).count())
        return candidates(*args)

    monkeypatch.setattr(pattern_index, "candidates", counted)
    assert pattern_index.membership(rows, table(spark, given)).count() == 2000
    assert tested == [40]
