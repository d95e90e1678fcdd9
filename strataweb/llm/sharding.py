"""Shards cut from a Hilbert-curve order of the rows' metadata.

Each metadata dimension is quantised to ``bits`` bits, the cell's index on the
Hilbert curve is looked up, rows are range-partitioned and sorted by that
index, and the sorted sequence is cut into runs.  Rows near each other in all
dimensions land in the same few shards, so min/max statistics of the files
prune on any of the dimensions.

Everything is DataFrame expressions.  The only broadcast is the curve's table,
``2 ** (bits * dimensions)`` rows whatever the corpus, and the partitions'
start ranks (one row a partition).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import crc32_text, materialise

BITS = 5
#: The curve's table is broadcast; its size is fixed by this bound.
MAX_CURVE_BITS = 18
_OWN = "_shard_"


def size_of(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 8 for the id."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")


def category_level(col: Column, bits: int = BITS) -> Column:
    """A category's quantised coordinate: the leading bits of its MD5; null as the empty string."""
    first = F.conv(F.substring(F.md5(F.coalesce(col.cast("string"), F.lit("")).cast("binary")), 1, 4), 16, 10)
    return F.shiftright(first.cast("int"), 16 - bits)


def size_level(size: Column, bits: int = BITS) -> Column:
    """Half-octave level of a size of at least 8: twice its bit length and the next bit below the leading one."""
    binary = F.bin(size)
    level = (F.length(binary) - 4) * 2 + F.substring(binary, 2, 1).cast("int")
    return F.least(F.lit((1 << bits) - 1), F.greatest(F.lit(0), level))


def hilbert_table(spark: SparkSession, dims: int, bits: int = BITS) -> DataFrame:
    """``cell`` (coordinates packed, first dimension highest) to ``curve`` for every cell of the grid.

    Skilling's transposition: undo the excess rotations from the highest bit
    down, Gray-decode, then interleave the bits; a fold over the bits.
    """
    if dims * bits > MAX_CURVE_BITS:
        raise ValueError(f"{dims} dimensions of {bits} bits exceed the broadcast bound of {MAX_CURVE_BITS} bits")
    cell = F.col("id").cast("int")
    mask = (1 << bits) - 1
    axes = F.array(*(F.shiftright(cell, bits * (dims - 1 - i)).bitwiseAND(F.lit(mask)) for i in range(dims)))

    def put(x: Column, i: int, v: Column) -> Column:
        return F.array(*(v if j == i else x[j] for j in range(dims)))

    table = spark.range(1 << (dims * bits)).select(cell.alias("cell"), axes.alias("x"))
    for b in range(bits - 1, 0, -1):
        # One projection a bit keeps the expression tree linear in the bits.
        for i in range(dims):
            q, p = F.lit(1 << b), F.lit((1 << b) - 1)
            x = F.col("x")
            set_bit = x[i].bitwiseAND(q) != 0
            t = x[0].bitwiseXOR(x[i]).bitwiseAND(p)
            new0 = F.when(set_bit, x[0].bitwiseXOR(p)).otherwise(x[0].bitwiseXOR(t))
            new = put(x, 0, new0) if i == 0 else put(put(x, i, F.when(set_bit, x[i]).otherwise(x[i].bitwiseXOR(t))), 0, new0)
            table = table.select("cell", new.alias("x"))
    for i in range(1, dims):
        x = F.col("x")
        table = table.select("cell", put(x, i, x[i].bitwiseXOR(x[i - 1])).alias("x"))
    turn = F.lit(0)
    for b in range(bits - 1, 0, -1):
        turn = turn.bitwiseXOR(F.when(F.col("x")[dims - 1].bitwiseAND(F.lit(1 << b)) != 0, F.lit((1 << b) - 1)).otherwise(F.lit(0)))
    table = table.select("cell", "x", turn.alias("t"))
    curve = F.lit(0)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            bit = F.shiftright(F.col("x")[i].bitwiseXOR(F.col("t")), b).bitwiseAND(F.lit(1))
            curve = F.shiftleft(curve, 1) + bit
    return table.select("cell", curve.alias("curve"))


def document_cell(docs: DataFrame, size: Column, bits: int = BITS) -> Column:
    """The cell of a document: language, source and size level."""
    levels = [category_level(F.col("lang"), bits), category_level(F.col("source"), bits), size_level(size, bits)]
    cell = F.lit(0)
    for level in levels:
        cell = F.shiftleft(cell, bits) + level
    return cell


def shard(docs: DataFrame, shards: int = 24, keep: list[str] | None = None, ties: tuple[str, ...] = ()) -> DataFrame:
    """Put every row into one of ``shards`` runs of the Hilbert order.

    Law ``rows``: the row of rank r (from 0) of N goes to shard
    ``floor(r * shards / N)``, so row counts differ by one at most.  Rank
    follows (curve, size, text_crc32, doc_id), nulls first; equal texts of one
    cell are neighbours.  ``ties`` names kept columns that order the rows of one
    curve index before these.  Adds size, text_crc32, law, curve, shard, slot (gapless from 0 in each shard)
    and grown_shard (null under this law) to the columns in ``keep`` (all by
    default); an input column of the same name is replaced.  Null text counts
    as empty, null lang and source as the empty string; repeated rows are all
    kept; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    added = ["size", "text_crc32", "law", "curve", "shard", "slot", "grown_shard"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in added]
    rows = docs.select(
        *(F.col(f"`{c}`") for c in keep),
        *([] if "doc_id" in keep else ["doc_id"]),
        size_of(F.col("text")).alias("size"),
        crc32_text(F.col("text")).alias("text_crc32"),
        document_cell(docs, size_of(F.col("text"))).alias(f"{_OWN}cell"),
    )
    curve = hilbert_table(spark, 3).select(F.col("cell").alias(f"{_OWN}cell"), "curve")
    rows = rows.join(F.broadcast(curve), f"{_OWN}cell").drop(f"{_OWN}cell")
    order = ["curve", *ties, "size", "text_crc32", "doc_id"]
    placed = materialise(
        rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(f"{_OWN}at", F.monotonically_increasing_id()),
        "shard-order",
    )
    part = F.shiftright(F.col(f"{_OWN}at"), 33)
    counts = placed.groupBy(part.alias(f"{_OWN}part")).agg(F.count(F.lit(1)).alias(f"{_OWN}n"))
    ahead = Window.orderBy(f"{_OWN}part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        f"{_OWN}part",
        F.coalesce(F.sum(f"{_OWN}n").over(ahead), F.lit(0)).alias(f"{_OWN}start"),
        F.sum(f"{_OWN}n").over(Window.partitionBy()).alias(f"{_OWN}total"),
    )
    rank, total = F.col(f"{_OWN}rank"), F.col(f"{_OWN}total")
    ranked = placed.withColumn(f"{_OWN}part", part).join(F.broadcast(starts), f"{_OWN}part")
    ranked = ranked.withColumn(f"{_OWN}rank", F.col(f"{_OWN}start") + F.col(f"{_OWN}at").bitwiseAND(F.lit((1 << 33) - 1)))
    ranked = ranked.withColumn("shard", F.expr(f"({_OWN}rank * {shards}) div {_OWN}total").cast("int"))
    first = F.expr(f"(shard * {_OWN}total + {shards - 1}) div {shards}")
    return ranked.select(
        *(F.col(f"`{c}`") for c in keep),
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "curve",
        "shard",
        (rank - first).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
