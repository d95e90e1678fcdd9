"""Mixing sources to target weights by Pfair scheduling.

A source of weight w (its share of all weights) owns blocks of ``block`` rows.
Its j-th block (from 0) is released at slot floor(j / w) and due by slot
ceil((j + 1) / w).  Each slot takes the released block with the earliest
deadline (ties: lane).  Every block meets its window, so after any slot each
source's count is within one block of its weight's share.  Weights are whole
numbers out of ``SCALE``; windows are exact.

Chunks of slots are scheduled apart, one a row.  Where a chunk begins, each
source has had floor or ceil of its share; which of the two depends on the
longest window before it only: blocks open at the start of that window are due
within it, so the schedule run from any valid state meets the same one.  A
chunk is as long as that window at least, which doubles the work at most.

All else is distributed too: rows are ranked within (source, bucket) groups of
bounded size, and a block's position is the closed form sum over sources of
min(rows, block * blocks) before its frame and a running sum within it, so no
global sort or window is needed.  A source that runs out leaves its slots
empty and the others go on in order; nothing is dropped or repeated.

Everything is DataFrame expressions.  Sent to the driver, and broadcast: the
sources' names and counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise

#: Slots that one row of the schedule lists.
FRAME = 1000
BLOCK = 16
#: Default weights: proportional to rows ** TEMPERATURE.
TEMPERATURE = 0.5
#: Rows of a ranking group, about.
BUCKET_ROWS = 2048
#: Ranking groups whose offsets one task sums.
RUN = 4096
#: Weights are rounded to parts of this, which is a block in about 10 ** 12 slots.
SCALE = 1 << 40
#: The column that :func:`with_layout_position` adds.
POSITION = "mix_position"
_OWN = "_mix_"


def whole_weights(shares: list[float]) -> list[int]:
    """The shares as whole numbers that sum to about ``SCALE``; a share of zero or less is zero."""
    total = sum(max(w, 0) for w in shares)
    return [max(1, round(w / total * SCALE)) if w > 0 else 0 for w in shares]


def _longs(values: list[int]) -> Column:
    """The values as one literal, whatever their number."""
    listed = F.split(F.lit(",".join(map(str, values))), ",") if values else F.array()
    return listed.cast("array<bigint>")


def n_slots(weights: list[int], sizes: list[int], block: int) -> int:
    """The slots until every lane with a weight has run out."""
    return max((-(-(-(-n // block)) * sum(weights) // w) for n, w in zip(sizes, weights, strict=True) if w), default=0)


def schedule(spark: SparkSession, weights: list[int], sizes: list[int], block: int = BLOCK) -> DataFrame:
    """One row a block: lane, block, slot and first (the position of its first row).

    ``weights`` are whole numbers above zero, ``sizes`` the rows of each lane.
    """
    whole, slots = sum(weights), n_slots(weights, sizes, block)
    window = max((-(-whole // w) for w in weights), default=0) + 1
    # Frames of a chunk: what the longest window takes, but not more than there are.
    frames = max(1, min(-(-window // FRAME), -(-slots // FRAME)))
    chunk = frames * FRAME
    q, total = F.col("q"), F.lit(whole).cast("long")

    def wide(c: Column) -> Column:
        return c.cast("decimal(19,0)")

    # A lane's lag is its weight times the slot, less the whole for each block it has had; within (-whole, whole).
    def due(lag: Column, w: Column) -> Column:
        """Slots to the deadline of the lane's next block; the division of numbers below 2 ** 42 is exact enough for its floor."""
        return F.floor((total - lag + w - 1) / w)

    def chosen(lags: Column) -> Column:
        """The lane of the released block with the earliest deadline."""
        dues = F.zip_with(lags, q, lambda lag, w: F.when(lag + w > 0, due(lag, w)))
        return F.array_min(F.transform(dues, lambda d, i: F.when(d.isNotNull(), F.struct(d.alias("due"), i.alias("lane")))))["lane"]

    def after(lags: Column, lane: Column) -> Column:
        grown = F.zip_with(lags, q, lambda lag, w: lag + w)
        return F.transform(grown, lambda lag, i: F.when(i == lane, lag - total).otherwise(lag)).cast("array<bigint>")

    def step(lags: Column, _: Column) -> Column:
        return F.transform(F.array(chosen(lags)), lambda lane: after(lags, lane))[0]

    def run(lags: Column, n: int) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(n)), lags, step)

    # The chunk before, from a valid state: the blocks due first are those that came early.
    chunks = spark.range(-(-slots // chunk)).select(F.col("id").alias("c"), _longs(weights).alias("q"), (F.greatest(F.col("id") - 1, F.lit(0)) * chunk).alias("from"))
    chunks = chunks.withColumn("rest", F.transform("q", lambda w: ((wide(F.col("from")) * wide(w)) % wide(total)).cast("long")))
    early = F.aggregate("rest", wide(F.lit(0)).cast("decimal(38,0)"), lambda acc, r: (acc + r).cast("decimal(38,0)"))
    dues = F.transform(F.zip_with("rest", q, lambda r, w: F.when(r > 0, due(r, w))), lambda d, i: F.when(d.isNotNull(), F.struct(d.alias("due"), i.alias("lane"))))
    dues = F.array_sort(F.filter(dues, lambda x: x.isNotNull()))
    chunks = chunks.withColumn("early", F.slice(dues, F.lit(1), F.floor(early / total).cast("int"))["lane"])
    lags = F.transform("rest", lambda r, i: F.when(F.array_contains("early", i), r - total).otherwise(r)).cast("array<bigint>")
    chunks = chunks.withColumn("lags", lags)
    begun = F.when(F.col("c") == 0, F.col("lags")).otherwise(run(F.col("lags"), chunk))
    states = F.array(begun)
    if frames > 1:
        states = F.aggregate(F.sequence(F.lit(1), F.lit(frames - 1)), states, lambda acc, _: F.concat(acc, F.array(run(F.element_at(acc, -1), FRAME))))
    starts = chunks.select("c", "q", F.posexplode(states).alias("f", "lags")).select("q", "lags", (F.col("c") * chunk + F.col("f") * FRAME).alias("start"))
    starts = starts.where(F.col("start") < slots)
    if frames > 1:
        starts = starts.repartition("start")

    kind = "struct<lags:array<bigint>,order:array<struct<lane:int,lag:bigint>>>"
    empty = F.array().cast("array<struct<lane:int,lag:bigint>>")

    def turn(acc: Column, _: Column) -> Column:
        def take(lane: Column) -> Column:
            new = F.array(F.struct(lane.alias("lane"), F.get(acc["lags"], lane).alias("lag")))
            return F.struct(after(acc["lags"], lane).alias("lags"), F.concat(acc["order"], new).alias("order")).cast(kind)

        return F.transform(F.array(chosen(acc["lags"])), take)[0]

    def had(slot: Column, w: Column, lag: Column) -> Column:
        """The blocks that a lane has had before the slot."""
        return F.floor((wide(slot) * wide(w) - lag) / wide(total)).cast("long")

    order = F.aggregate(F.sequence(F.lit(1), F.lit(FRAME)), F.struct(F.col("lags").alias("lags"), empty.alias("order")).cast(kind), turn)["order"]
    n = _longs(sizes)
    placed = F.zip_with(F.zip_with(q, "lags", lambda w, lag: had(F.col("start"), w, lag)), n, lambda b, most: F.least(b * block, most))
    before = F.aggregate(placed, F.lit(0).cast("long"), lambda acc, x: acc + x)
    turns = starts.select("start", before.alias("before"), "q", F.posexplode(order).alias("at", "x"))
    turns = turns.select("start", "before", (F.col("start") + F.col("at")).alias("slot"), F.col("x.lane").alias("lane"), F.col("x.lag").alias("lag"), F.get("q", F.col("x.lane")).alias("w"))
    turns = turns.withColumn("block", had(F.col("slot"), F.col("w"), F.col("lag")))
    turns = turns.withColumn("rows", F.least(F.get(n, F.col("lane")) - F.col("block") * block, F.lit(block))).where("rows > 0")
    ahead = Window.partitionBy("start").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("before") + F.coalesce(F.sum("rows").over(ahead), F.lit(0))
    return turns.select("lane", "block", "slot", first.alias("first"))


def row_key(docs: DataFrame) -> Column:
    """What orders a source's rows: the MD5 of id and text (nulls as empty), so that rows without an id, or of one id, are spread like all others."""
    text = F.coalesce("text", F.lit("")) if "text" in docs.columns else F.lit("")
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(text.cast("binary"))).cast("binary"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK, keep: list[str] | None = None) -> DataFrame:
    """Every row with block (from 0 within its source), slot and position (gapless from 0) in the mixed order.

    ``weights`` gives the share of each source; without it a source's share
    is its rows to the power ``TEMPERATURE``.  Sources that ``weights`` lacks
    share one lane, with the mean share of the others.  Sources of weight zero
    follow all others, by name.  Null source is the empty string.  Within a
    lane rows go by :func:`row_key`.  Repeated rows keep places of their own.  An empty table
    gives an empty result; an input column of an added name is replaced.
    """
    added = ["block", "slot", "position"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in added]
    placed = _placed(docs, weights, block, keep)
    return placed.select(*(F.col(f"{_OWN}row")[c].alias(c) for c in keep), *added)


def _placed(docs: DataFrame, weights: dict[str, float] | None, block: int, keep: list[str]) -> DataFrame:
    spark = docs.sparkSession
    name = F.coalesce(F.col("source").cast("string"), F.lit(""))
    counted = docs.groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("n"))
    counted = materialise(counted, "mix-sources")
    total = counted.agg(F.sum("n")).first()[0] or 0
    eligible = counted if weights is None else counted.where(F.col("name").isin(list(weights)))
    held = {r["name"]: r["n"] for r in eligible.collect()}
    names: list[str | None] = sorted(held)
    shares = [float(held[s]) ** TEMPERATURE if weights is None else float(weights[s]) for s in names]
    sizes = [held[s] for s in names]
    if total > sum(sizes):
        names.append(None)
        shares.append(sum(shares) / len(shares) if shares else 1.0)
        sizes.append(total - sum(sizes))
    whole = whole_weights(shares)
    # Lanes with a weight come first, by name.
    lane_of = sorted(range(len(names)), key=lambda k: whole[k] == 0)
    names, whole, sizes = [names[k] for k in lane_of], [whole[k] for k in lane_of], [sizes[k] for k in lane_of]
    lanes = spark.createDataFrame(list(zip(names, range(len(names)), strict=True)), "name string, lane int")

    rest = names.index(None) if None in names else None
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias(f"{_OWN}row"), name.alias("name"), row_key(docs).alias("key"))
    known = F.broadcast(lanes.where("name is not null").select("name", F.col("lane").alias("own")))
    rows = rows.join(known, "name", "left").withColumn("lane", F.coalesce("own", F.lit(rest)))
    # Ranking groups are ranges of the leading bits of the key, as many as the lane's rows ask for.
    h = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    parts = _longs([max(1, -(-n // BUCKET_ROWS)) for n in sizes] or [1])
    rows = rows.withColumn("h", h).withColumn("bucket", F.shiftright(F.col("h") * F.get(parts, F.col("lane")), 32))
    groups = rows.groupBy("lane", "bucket").agg(F.count(F.lit(1)).alias("n"))
    groups = materialise(groups.withColumn("run", F.expr(f"bucket div {RUN}")), "mix-groups")
    # Running sums in two steps, within runs of groups and over runs, so that a hot lane is many tasks' work.
    runs = groups.groupBy("lane", "run").agg(F.sum("n").alias("all"))
    before = Window.partitionBy("lane").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("lane", "run", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("lane", "run").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = groups.withColumn("in_run", F.coalesce(F.sum("n").over(within), F.lit(0))).join(runs, ["lane", "run"])
    offsets = offsets.select("lane", "bucket", "n", (F.col("ahead") + F.col("in_run")).alias("first"))
    # The schedule of each group's blocks, so that the rows themselves stay where they were ranked.
    timed = [k for k, w in enumerate(whole) if w]
    turns = materialise(schedule(spark, [whole[k] for k in timed], [sizes[k] for k in timed], block), "mix-schedule")
    after, done, late = n_slots(whole, sizes, block), sum(sizes[k] for k in timed), []
    for k in range(len(timed), len(names)):
        late.append((k, after, done))
        after, done = after + -(-sizes[k] // block), done + sizes[k]
    low, high = F.expr(f"first div {block}"), F.expr(f"(first + n - 1) div {block}")
    wanted = offsets.withColumn("low", low).withColumn("block", F.explode(F.sequence(low, high))).withColumnRenamed("first", "ahead")
    wanted = wanted.join(turns, ["lane", "block"], "left").join(F.broadcast(spark.createDataFrame(late, "lane int, after long, done long")), "lane", "left")
    wanted = wanted.withColumn("slot", F.coalesce("slot", F.col("after") + F.col("block")))
    wanted = wanted.withColumn("first", F.coalesce("first", F.col("done") + F.col("block") * block))
    wanted = wanted.groupBy("lane", "bucket", "ahead", "low").agg(F.array_sort(F.collect_list(F.struct("block", "slot", "first"))).alias("turns"))
    inner = Window.partitionBy("lane", "bucket").orderBy("key")
    ranked = rows.withColumn("at", F.row_number().over(inner) - 1).join(wanted, ["lane", "bucket"]).withColumn("rank", F.col("ahead") + F.col("at"))
    own = F.get("turns", (F.expr(f"rank div {block}") - F.col("low")).cast("int"))
    return ranked.select(
        f"{_OWN}row",
        own["block"].alias("block"),
        own["slot"].alias("slot"),
        (own["first"] + F.col("rank") % block).alias("position"),
    )


def in_mixed_order(docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK) -> DataFrame:
    """``docs`` laid out in the mixed order: files and rows follow the position; columns as they were."""
    placed = _placed(docs, weights, block, docs.columns)
    return placed.repartitionByRange("position").sortWithinPartitions("position").select(*(F.col(f"{_OWN}row")[c].alias(c) for c in docs.columns))


def with_layout_position(docs: DataFrame) -> DataFrame:
    """Adds mix_position (gapless from 0): each row's place in the files that ``docs`` reads, which :func:`in_mixed_order` laid out.

    Places come from the files' names, which follow the written partitions, and
    from the rows' numbers in them; what is broadcast is one row a file.  An
    input column of that name is replaced.
    """
    names = [c for c in docs.columns if c != POSITION]
    rows = docs.select(*(F.col(f"`{c}`") for c in names), F.col("_metadata.file_name").alias(f"{_OWN}file"), F.col("_metadata.row_index").alias(f"{_OWN}at"))
    counts = rows.groupBy(f"{_OWN}file").agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.orderBy(f"{_OWN}file").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    starts = counts.select(f"{_OWN}file", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias(f"{_OWN}start"))
    placed = rows.join(F.broadcast(starts), f"{_OWN}file")
    return placed.select(*(F.col(f"`{c}`") for c in names), (F.col(f"{_OWN}start") + F.col(f"{_OWN}at")).alias(POSITION))
