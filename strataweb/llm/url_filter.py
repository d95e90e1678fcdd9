"""URL filter: host and path rules, then a weighted vocabulary.

Terms are found by one Aho-Corasick automaton over the lower-cased URL and
count only at boundaries: no ASCII letter or digit on either side.  Terms have
weights; a page is rejected when the distinct terms of its URL weigh ``LIMIT``
or more.  A strict term weighs that much alone, soft ones only together.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The verdict, host and path of each rule.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
STRICT = ("porn", "xxx", "warez", "escort", "spam-farm", "cheap-pills", "free-casino", "viagra", "phishing", "malware")
SOFT = ("casino", "poker", "pills", "cheap", "loan", "bet", "adult", "sexy", "dating", "torrent", "crack", "spam", "farm", "replica", "lottery", "jackpot", "nude", "cialis")
LIMIT = 2.0
#: Terms with their weights: strict ones reject alone, soft ones from two distinct ones on.
VOCABULARY = {**dict.fromkeys(STRICT, LIMIT), **dict.fromkeys(SOFT, LIMIT / 2)}
#: A table of terms with more rows than this is refused: the automaton is built on the driver and sent to every task.
MAX_TERMS = 500_000


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    after = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(after, r"^([^/?#]*)", 1)
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_verdict(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (as ``host/path``; null if none) and its verdict.

    A rule fits its host and all subdomains, if the path starts with the rule's.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    # From the shortest on, so that the longest is asked first.
    for kind, name, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule = F.when(fits, F.lit(name + start)).otherwise(rule)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def vocabulary_of(terms: DataFrame) -> dict[str, float]:
    """The vocabulary of a table (term, weight), A-Z lower-cased; the greatest weight of a repeated term.

    Null and empty terms, and weights that are null or not above zero, are left
    out.  At most ``MAX_TERMS`` rows.
    """
    lowered = F.translate("term", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    usable = terms.where((F.col("term") != "") & (F.col("weight") > 0)).groupBy(lowered.alias("term")).agg(F.max("weight").cast("double").alias("weight"))
    rows = usable.limit(MAX_TERMS + 1).collect()
    if len(rows) > MAX_TERMS:
        raise ValueError(f"more than {MAX_TERMS} terms")
    return {r["term"]: r["weight"] for r in rows}


_LOWERED = {k: k + 32 for k in range(65, 91)}
_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def terms_in(url: str | None, automaton: ahocorasick.Automaton) -> set[str]:
    """The distinct terms that stand in a URL with no ASCII letter or digit on either side."""
    if not url or not len(automaton):
        return set()
    text = url.translate(_LOWERED)
    return {term for end, term in automaton.iter(text) if text[end - len(term) : end - len(term) + 1] not in _WORD and text[end + 1 : end + 2] not in _WORD}


def vocabulary_hits(url: Column, vocabulary: dict[str, float], limit: float = LIMIT) -> Column:
    """strict and soft (how many distinct terms weigh ``limit`` or more, or less) and score (what all weigh); null has none."""
    automaton = ahocorasick.Automaton()
    for term in vocabulary:
        automaton.add_word(term, term)
    automaton.make_automaton()

    def counts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [[vocabulary[t] for t in sorted(terms_in(u, automaton))] for u in batch]
            strict = [sum(w >= limit for w in x) for x in found]
            soft = [len(x) - k for x, k in zip(found, strict, strict=True)]
            yield pd.DataFrame({"strict": strict, "soft": soft, "score": [sum(x) for x in found]}).astype({"strict": "int64", "soft": "int64", "score": "float64"})

    return F.pandas_udf(counts, "strict long, soft long, score double")(url)


def judge(pages: DataFrame, rules=RULES, vocabulary: dict[str, float] | DataFrame = VOCABULARY, limit: float = LIMIT, keep: list[str] | None = None) -> DataFrame:
    """Adds host, path, rule, verdict (allow or block), strict_hits, soft_hits and score to every page.

    A rule that fits decides; else distinct terms of the vocabulary (a table
    of term and weight, or a dict) that weigh ``limit`` together block.  A null
    or empty URL has no terms and is allowed.  Repeated rows are judged alike;
    an input column of an added name is replaced.
    """
    added = ["host", "path", "rule", "verdict", "strict_hits", "soft_hits", "score"]
    keep = [c for c in (pages.columns if keep is None else keep) if c not in added]
    vocabulary = vocabulary_of(vocabulary) if isinstance(vocabulary, DataFrame) else vocabulary
    host, path = url_parts(F.col("url"))
    rows = pages.select(*(F.col(f"`{c}`") for c in keep), host.alias("host"), path.alias("path"), vocabulary_hits(F.col("url"), vocabulary, limit).alias("_url_hits"))
    rule, verdict = rule_verdict(F.col("host"), F.col("path"), rules)
    found = F.col("_url_hits")
    own = F.when(found["score"] >= limit, "block").otherwise("allow")
    return rows.select(
        *(F.col(f"`{c}`") for c in keep), "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"),
        found["strict"].alias("strict_hits"), found["soft"].alias("soft_hits"), found["score"].alias("score"),
    )
