"""Benchmark decontamination by a broadcast hash set of word n-grams.

The benchmark items' windows of ten words become a table of hashes, broadcast
when its checked row count is within ``MAX_BROADCAST_WINDOWS`` and joined by
shuffle beyond that.  Documents are split into words once; every window's hash is looked up in a
bitmap of the set inside the row, and only the few that are marked leave the
row, each with its own words, to probe the set.  Every probe that hits is
verified by comparing the words, and the verified windows' spans are united.

Everything is DataFrame expressions; the text is read and split once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

NGRAM = 10
#: Beyond this many distinct benchmark windows the join is left to shuffle.
MAX_BROADCAST_WINDOWS = 2_000_000
#: Bits of the map that sorts windows out before the join: four megabytes.
MAX_BITS = 25
#: What separates words: ASCII other than digits and letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_OWN = "_decon_"


def words_of(text: Column) -> Column:
    """Words as written: runs of ASCII letters, digits and non-ASCII characters; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SEPARATORS), lambda w: w != "")


def benchmark_windows(benchmark: DataFrame, ngram: int = NGRAM) -> DataFrame:
    """Distinct windows: key (hash), length, window (words joined by a space, A-Z lower-cased), items (ids as text).

    An item shorter than ``ngram`` words is one window; one without words, or
    whose id is null, has none.
    """
    items = benchmark.where(F.col("item_id").isNotNull()).select(
        F.col("item_id").cast("string").alias("item"),
        F.transform(words_of(F.col("text")), lambda w: F.translate(w, _UPPER, _LOWER)).alias("words"),
    )
    n = F.size("words")
    windows = items.where(n > 0).select(
        "item", "words", F.least(n, F.lit(ngram)).alias("length"), F.explode(F.sequence(F.lit(1), F.greatest(n - ngram + 1, F.lit(1)))).alias("start")
    )
    windows = windows.select("item", "length", F.slice("words", F.col("start"), F.col("length")).alias("window"))
    return windows.groupBy("length", F.array_join("window", " ").alias("window")).agg(
        F.collect_set("item").alias("items"), F.first(F.xxhash64(F.transform("window", lambda w: F.xxhash64(F.lower(w))))).alias("key"), F.first(F.xxhash64(*(F.xxhash64(F.lower(F.element_at("window", k))) for k in (1, -1)))).alias("ends")
    )


def bitmap(windows: DataFrame, column: str, count: int) -> tuple[Column, int]:
    """A bit for each hash of the windows' ``column``, named by its leading bits, as a literal array of longs; and how many bits name one.

    Sixteen bits a window, ``2 ** MAX_BITS`` at most; a window that is not
    marked is no benchmark window, and the join and the words decide about the
    others.
    """
    bits = max(10, min(MAX_BITS, (16 * count).bit_length()))
    bit = F.shiftrightunsigned(column, 64 - bits)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit.cast("int").bitwiseAND(F.lit(63)))
    held = windows.groupBy(F.shiftrightunsigned(column, 64 - bits + 6).alias("at")).agg(F.bit_or(one).alias("bits"))
    longs = [0] * (1 << (bits - 6))
    for r in held.collect():  # at most as many rows as longs
        longs[r["at"]] = r["bits"]
    return F.split(F.lit(",".join(map(str, longs))), ",").cast("array<bigint>"), bits


def scan(docs: DataFrame, benchmark: DataFrame, ngram: int = NGRAM, keep: list[str] | None = None) -> DataFrame:
    """Adds n_words, n_hit, n_items, items, spans and contaminated to every row of ``docs`` (columns ``keep``).

    ``n_hit`` counts the words inside any occurrence of a benchmark window,
    ``spans`` holds the united runs of them as word positions [start, end) from
    0, ``items`` the distinct ids, sorted as strings.  Null or empty text has
    no words and is clean.  Repeated rows are judged one by one.  An input
    column of an added name is replaced.
    """
    added = ["n_words", "n_hit", "n_items", "items", "spans", "contaminated"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in added]
    windows = materialise(benchmark_windows(benchmark, ngram), "decon-windows")
    # Checked sizes: a count and the set of lengths (at most ngram integers).
    sizes = {r["length"]: r["n"] for r in windows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    keys = windows.groupBy("key").agg(F.collect_list(F.struct("length", "window", "items")).alias(f"{_OWN}found"))
    if sum(sizes.values()) <= MAX_BROADCAST_WINDOWS:
        keys = F.broadcast(keys)
    # Cheapest first: a window's first and last word, then all of them.
    marks = [bitmap(windows, c, sum(sizes.values())) for c in ("ends", "key")]

    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in keep)).alias(f"{_OWN}row"),
        F.monotonically_increasing_id().alias(f"{_OWN}id"),
        words_of(F.col("text")).alias(f"{_OWN}words"),
    )
    # Unicode lower case of a word is the probe: equal A-Z-lowered words have equal probes, and the words decide.
    rows = rows.withColumn(f"{_OWN}hashes", F.transform(f"{_OWN}words", lambda w: F.xxhash64(F.lower(w))))
    words, hashes, n = F.col(f"{_OWN}words"), F.col(f"{_OWN}hashes"), F.size(f"{_OWN}words")

    def key(start: Column, k: int) -> Column:
        return F.xxhash64(F.slice(hashes, start + 1, k))

    def ends(start: Column, k: int) -> Column:
        return F.xxhash64(F.get(hashes, start), F.get(hashes, start + (k - 1)))

    def is_marked(h: Column, marked: Column, bits: int) -> Column:
        """Whether the bit is set that the leading ``bits`` bits of the hash name."""
        held = F.get(marked, F.shiftrightunsigned(h, 64 - bits + 6).cast("int"))
        return F.call_function("shiftright", held, F.shiftrightunsigned(h, 64 - bits).cast("int").bitwiseAND(F.lit(63))).bitwiseAND(F.lit(1).cast("long")) != 0

    def marked_starts(k: int) -> Column:
        starts = F.when(n >= k, F.sequence(F.lit(0), n - k)).otherwise(F.array().cast("array<int>"))
        return F.filter(F.filter(starts, lambda i: is_marked(ends(i, k), *marks[0])), lambda i: is_marked(key(i, k), *marks[1]))

    for k in sorted(sizes):
        rows = rows.withColumn(f"{_OWN}starts{k}", marked_starts(k))

    def probe(k: int) -> Column:
        def window(i: Column) -> Column:
            text = F.translate(F.array_join(F.slice(words, i + 1, k), " "), _UPPER, _LOWER)
            return F.struct(i.alias("start"), F.lit(k).alias("length"), key(i, k).alias("key"), text.alias("window"))

        return F.transform(f"{_OWN}starts{k}", window)

    probes = F.flatten(F.array(*map(probe, sorted(sizes)))) if sizes else F.array().cast("array<struct<start:int,length:int,key:bigint,window:string>>")
    # A document without a probe stays as one row.
    probed = rows.select(f"{_OWN}row", f"{_OWN}id", n.cast("long").alias("n_words"), F.explode_outer(probes).alias("p"))
    met = probed.select(f"{_OWN}row", f"{_OWN}id", "n_words", "p.*").join(keys, "key", "left")
    verified = F.filter(f"{_OWN}found", lambda f: (f["length"] == F.col("length")) & (f["window"] == F.col("window")))
    met = met.select(
        f"{_OWN}row",
        f"{_OWN}id",
        "n_words",
        F.flatten(F.transform(verified, lambda f: f["items"])).alias("items"),
        F.when(F.size(verified) > 0, F.struct("start", (F.col("start") + F.col("length")).alias("end"))).alias("span"),
    )
    per_row = met.groupBy(f"{_OWN}id").agg(
        F.first(f"{_OWN}row").alias(f"{_OWN}row"),
        F.first("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_sort(F.collect_list("span")).alias("hits"),
    )
    united = F.aggregate(
        "hits",
        F.array().cast("array<struct<start:int,end:int>>"),
        lambda runs, s: F.when(
            (F.size(runs) > 0) & (F.try_element_at(runs, F.lit(-1))["end"] >= s["start"]),
            F.concat(
                F.slice(runs, 1, F.greatest(F.size(runs) - 1, F.lit(0))),
                F.array(F.struct(F.try_element_at(runs, F.lit(-1))["start"].alias("start"), F.greatest(F.try_element_at(runs, F.lit(-1))["end"], s["end"]).alias("end"))),
            ),
        ).otherwise(F.concat(runs, F.array(s))),
    )
    judged = per_row.select(f"{_OWN}row", "n_words", "items", united.alias("spans"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return judged.select(
        *(F.col(f"{_OWN}row")[c].alias(c) for c in keep),
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        "items",
        "spans",
        (F.size("spans") > 0).alias("contaminated"),
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """The documents of ``docs`` that share no benchmark window, all columns as they were.

    Works by doc_id and text (null ids compare equal): other texts of the same
    id stay.  ``verdicts`` may hold the materialised ids and text hashes to remove.
    """
    bad, node = F.col(f"{_OWN}bad"), F.col(f"{_OWN}node")
    if verdicts is None:
        named = docs.select("doc_id", "text", F.xxhash64("text").alias(f"{_OWN}node"))
        found = scan(named, benchmark, keep=["doc_id", f"{_OWN}node"]).where("contaminated").select(F.col("doc_id").alias(f"{_OWN}bad"), f"{_OWN}node").distinct()
        # Written first, so that Spark knows its size and broadcasts it only within its own threshold.
        verdicts = materialise(found, "contaminated")
    return docs.join(verdicts, docs["doc_id"].eqNullSafe(bad) & (F.xxhash64(docs["text"]) == node), "left_anti")
