"""URL patterns: ``**`` any text, ``*`` within a path or query part, ``#`` digits.

A pattern is a standing predicate.  It becomes two predicates that Catalyst
sees: ``startswith`` of the literal prefix, which Parquet row groups are pruned
by, and an anchored regular expression.  ``@`` is a literal by default, as
observed in practice; ``at_wildcard=True`` makes it the letters wildcard.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What each wildcard stands for: fixed values.
WILDCARDS = {"**": "(.*)", "*": "([^/?=&]*)", "#": "([0-9]+)", "@": "([a-zA-Z]+)"}
_JAVA_SPECIAL = frozenset(r"\.[]{}()*+-?^$|&#~<>=!:,/ ")


def tokens(pattern: str, at_wildcard: bool = False) -> list[tuple[bool, str]]:
    """The pattern as (is it a wildcard, text) pieces."""
    marks = r"(\*\*|\*|#|@)" if at_wildcard else r"(\*\*|\*|#)"
    return [(i % 2 == 1, t) for i, t in enumerate(re.split(marks, pattern)) if t]


def pattern_regex(pattern: str, at_wildcard: bool = False) -> str:
    """A Java regular expression that matches whole URLs; lines end only at newlines."""
    body = "".join(WILDCARDS[t] if wild else "".join("\\" + c if c in _JAVA_SPECIAL else c for c in t) for wild, t in tokens(pattern, at_wildcard))
    return f"(?d)^{body}$"


def regex_of(pattern: Column) -> Column:
    """As :func:`pattern_regex`, for a column of patterns: literals quoted, wildcards as they stand for."""
    body = F.regexp_replace(pattern, r"([\\\.\[\]{}()+\-?^$|&~<>=!:,/ ])", r"\\$1")
    # A single star is what is left when the double ones are away.
    body = F.replace(body, F.lit("**"), F.lit("\u0000"))
    for mark, meaning in (("*", WILDCARDS["*"]), ("#", WILDCARDS["#"]), ("\u0000", WILDCARDS["**"])):
        body = F.replace(body, F.lit(mark), F.lit(meaning))
    return F.concat(F.lit("(?d)^"), body, F.lit("$"))


def literal_prefix(pattern: str) -> str:
    """The text before the first wildcard character, ``@`` counted as one."""
    return re.split(r"[*#@]", pattern, maxsplit=1)[0]


def is_literal(pattern: str) -> bool:
    return literal_prefix(pattern) == pattern


def matches(url: Column, pattern: str, at_wildcard: bool = False) -> Column:
    """Whether the URL is a member: the prefix first, since it is pushed to the scan."""
    return url.startswith(literal_prefix(pattern)) & url.rlike(pattern_regex(pattern, at_wildcard))


def genericity(pattern: Column) -> Column:
    """A struct that orders patterns from the most specific to the most generic."""
    double = F.regexp_count(pattern, F.lit(r"\*\*"))
    rest = F.regexp_replace(pattern, r"\*\*", "")
    single = F.regexp_count(rest, F.lit(r"\*"))
    rest = F.regexp_replace(rest, r"\*", "")
    marks = F.regexp_count(rest, F.lit("[#@]"))
    literal = F.regexp_replace(rest, "[#@]", "")
    return F.struct(double.alias("star_star"), single.alias("star"), marks.alias("mark"), (-F.length(literal)).alias("minus_literal"), literal.alias("literal"))


def display_name(name: Column, pattern: Column) -> Column:
    return F.coalesce(F.nullif(name, F.lit("")), pattern)
