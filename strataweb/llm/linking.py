"""Linked nodes from bucketed candidates, without emitting a bucket's pairs.

``members`` has the nodes of every band bucket.  Three passes find the links:

1. Each member is compared with its bucket's leader, the node that meets most
   others over all its buckets.
2. Buckets whose nodes are not one component then form groups, by the
   component of their leader.  A group's centre, the nearest node to the leader
   of its largest bucket (near copies of one text are nearest to that text), is
   compared with the others.  How each differs from it is kept: the shingles it
   lacks and those it has beyond.
3. What two nodes of a group share follows from those differences alone::

       shared = centre - lacks(x) - lacks(y) + lacked by both + beyond in both

   so nodes of different components are matched as small matrices, chunk of the
   group against chunk.  A group's chunk pairs are dealt out by cells of a few
   chunks each, whatever the group, so that its work is spread over tasks and
   each cell is of bounded size.  A cell returns no pairs but the edges that
   join components (a forest); their texts decide.

So every pair of a bucket is verified, connected or proven unlike; no link is
lost.  A group's chunks meet each other, but only where one holds nodes outside
the largest component, and only within a factor of weight that similarity
allows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import ragged
from .common import materialise, temporary
from .components import connected_components

#: Text number, shingle and weight of each distinct shingle of the texts, by text and shingle; a shingle's weight is the same in all texts.
Sets = Callable[[pa.Array], tuple[np.ndarray, np.ndarray, np.ndarray]]

#: Crowded bands (longs) that are broadcast, about 40 MB as a hash table; beyond that they are joined by a shuffle.
MAX_BROADCAST_BANDS = 1 << 19
#: Members that are sent together.
_MEMBERS = 1 << 19
#: Bytes of differences that one chunk of a group holds, about.
CHUNK_BYTES = 1 << 20
#: Chunks that a cell of a group's matrix has on each side.
SIDE = 4
#: A pass over the cells sends about so many times the bytes of all differences.
PASS_TIMES = 2
#: Columns of the matrices that are multiplied at once.
_COLUMNS = 4096
_PAIRS = 4096
#: Bytes of texts that are compared at once, so that the arrays stay in a core's cache.
_GROUP_BYTES = 256 << 10
#: Weights in millionths, to which all weights are rounded, so that sums of them are exact.
_UNIT = 1e-6
_DELTA = np.dtype([("token", np.uint64), ("weight", np.uint32)])


def link(members: DataFrame | Sequence[DataFrame], fetch: Callable[[DataFrame], DataFrame], sets: Sets, threshold: float, name: str) -> DataFrame:
    """``node`` and ``label`` (the least node of its component) of every node linked to another.

    ``members``: as of :func:`gather`.  ``fetch`` gives the texts of a table
    of nodes, ``sets`` the shingles of texts; pairs whose weighted Jaccard
    similarity is at least ``threshold`` are links.
    """
    spark = (members if isinstance(members, DataFrame) else members[0]).sparkSession
    with temporary(spark):
        with temporary(spark):
            gathered = gather(members, name)
        return materialise(_linked(*gathered, fetch, sets, threshold, name), f"{name}-labels", keep=True)


def link_gathered(buckets: DataFrame, crowded: DataFrame, fetch: Callable[[DataFrame], DataFrame], sets: Sets, threshold: float, name: str) -> DataFrame:
    """:func:`link` of what :func:`gather` found."""
    with temporary(buckets.sparkSession):
        return materialise(_linked(buckets, crowded, fetch, sets, threshold, name), f"{name}-labels", keep=True)


def gather(members: DataFrame | Sequence[DataFrame], name: str) -> tuple[DataFrame, DataFrame]:
    """(buckets, crowded): a, b (least and greatest node) and n (nodes, 3 for more) of the buckets with two nodes or more, and the distinct members of those with more than two.

    ``members``: node and one or several columns of bands, repeated or not; or
    several such tables, each with bands of its own, which are taken one after
    another, so that the disk holds the shuffle of one at a time.  They are not
    read again.
    """
    found = [_gathered(part, name) for part in ([members] if isinstance(members, DataFrame) else members)]
    return tuple(reduce(DataFrame.union, side) for side in zip(*found, strict=True))


def _gathered(members: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    buckets = materialise(meetings(members), f"{name}-buckets", keep=True)
    wanted = buckets.where("n > 2").select("band")
    # Few bands of all: where they fit, the members are picked without a shuffle.
    wanted = F.broadcast(wanted) if wanted.count() <= MAX_BROADCAST_BANDS else wanted
    bands = [c for c in members.columns if c != "node"]
    each = members.select("node", F.explode(F.array(*bands)).alias("band"))
    return buckets, materialise(each.join(wanted, "band", "left_semi").distinct(), f"{name}-crowded", keep=True)


def meetings(members: DataFrame) -> DataFrame:
    """band, a, b and n (as of :func:`gather`) of each band with two nodes or more."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.stack([batch.column(c).flatten().to_numpy() for c in ("band", "node")]) for batch in batches]
        if held:
            band, node, heads = few(*np.concatenate(held, axis=1))
            n = np.diff(np.append(heads, len(band)))
            at, n = heads[n > 1], n[n > 1]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (band[at], node[at], node[at + n - 1], n)], ["band", "a", "b", "n"])

    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return packed(members, n).repartitionById(n, "of").mapInArrow(meet, "band long, a long, b long, n long")


def packed(members: DataFrame, n: int) -> DataFrame:
    """of (one of ``n`` ranges of the bands), and the bands and nodes of it as arrays.

    Nearly all bands have one node, so members are shuffled as arrays: a task
    makes a row for each range and half a million members.  Of one band it has
    three nodes at most, which is all that :func:`meetings` tells of it.
    """
    bands = [c for c in members.columns if c != "node"]

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        """band and node (two rows) of several batches at a time."""
        held, size = [], 0
        for batch in batches:
            node, *keys = (batch.column(c).to_numpy() for c in ["node", *bands])
            held += [np.stack([key, node]) for key in keys]
            size += batch.num_rows * len(keys)
            if size >= _MEMBERS:
                yield np.concatenate(held, axis=1)
                held, size = [], 0
        if size:
            yield np.concatenate(held, axis=1)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in arrays(batches):
            band, node, _ = few(*found)
            # Bands are in order, and so are the ranges of their leading 32 bits.
            of = ((band.view(np.uint64) >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)
            heads = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            ends = pa.array(np.append(heads, len(of)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (band, node)]
            yield pa.RecordBatch.from_arrays([pa.array(of[heads].astype(np.int32)), *lists], ["of", "band", "node"])

    return members.select("node", *bands).mapInArrow(pack, "of int, band array<long>, node array<long>")


def few(band: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows in order of the bands (unsigned) and nodes, and where each band begins; of a band with more than three nodes two and the greatest."""
    order = np.argsort(band.view(np.uint64))
    band, node = band[order], node[order]
    same = band[1:] == band[:-1]
    # Most bands have one row; only the others' nodes are sorted.
    several = np.flatnonzero(np.append(same, False) | np.concatenate([[False], same]))
    b, n = band[several], node[several]
    node[several] = n[np.lexsort((n, b.view(np.uint64)))]
    kept = np.concatenate([[True], ~same | (node[1:] != node[:-1])])
    band, node = band[kept], node[kept]
    first = np.concatenate([[True], band[1:] != band[:-1]])
    heads = np.flatnonzero(first)
    n = np.diff(np.append(heads, len(band)))
    if (n <= 3).all():
        return band, node, heads
    at = np.arange(len(band)) - np.repeat(heads, n)
    kept = (at < 2) | (at == np.repeat(n, n) - 1)
    return band[kept], node[kept], np.concatenate([[0], np.cumsum(np.minimum(n, 3))[:-1]])


def _linked(buckets: DataFrame, crowded: DataFrame, fetch: Callable[[DataFrame], DataFrame], sets: Sets, threshold: float, name: str) -> DataFrame:
    sizes = crowded.groupBy("band").agg(F.count(F.lit(1)).alias("n"))
    met = crowded.join(sizes, "band").groupBy("node").agg(F.sum("n").alias("met"))
    leaders = crowded.join(met, "node").groupBy("band").agg(F.max(F.struct("met", "node"))["node"].alias("a"))
    crowded = materialise(crowded.join(leaders, "band"), f"{name}-led")
    pairs = buckets.where("n = 2").select("a", "b").union(crowded.where("a <> node").select("a", F.col("node").alias("b")))
    pairs = materialise(pairs.distinct(), f"{name}-pairs")
    texts = fetch(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    scored = materialise(compare(pairs, texts, sets), f"{name}-scored")
    linked = F.col("similarity") >= threshold - 1e-9
    labels = materialise(connected_components(scored.where(linked).select("a", "b")), f"{name}-labels")
    of = {x: labels.select(F.col("node").alias(x), F.col("label").alias(f"{x}_label")) for x in ("a", "b")}

    # Buckets whose leaders are of one component form a group, named by that.
    held = crowded.withColumnRenamed("node", "b").join(of["b"], "b", "left").join(of["a"], "a", "left")
    held = held.select("band", "a", F.col("b").alias("node"), F.coalesce("a_label", "a").alias("group"), F.coalesce("b_label", "b").alias("label"))
    mixed = held.where("label <> group").select("band").distinct()
    left = materialise(held.join(mixed, "band", "left_semi"), f"{name}-open")
    if left.isEmpty():
        return labels
    # Its centre: the nearest node to the leader of its largest bucket.
    largest = left.groupBy("group", "band", "a").agg(F.count(F.lit(1)).alias("n")).groupBy("group").agg(F.max(F.struct("n", "band", "a")).alias("x"))
    largest = largest.select("group", F.col("x.band").alias("band"), F.col("x.a").alias("a"))
    near = left.join(largest, ["group", "band", "a"]).join(scored.withColumnRenamed("b", "node"), ["a", "node"])
    near = near.groupBy("group").agg(F.max(F.struct("similarity", "node"))["node"].alias("centre"))
    left = materialise(left.select("group", "node").distinct().join(near, "group"), f"{name}-groups")
    again = left.where("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    again = again.join(of["a"], "a", "left").join(of["b"], "b", "left")
    # Labels go through the comparison: the differences, which are most of the bytes, are shuffled only by their groups.
    measured = materialise(compare(again, texts, sets, deltas=True), f"{name}-measured")

    # Nodes linked to the centre are of its component by now.
    label = F.when(linked, F.coalesce("a_label", "a")).otherwise(F.coalesce("b_label", "b"))
    rows = measured.select(F.col("a").alias("centre"), F.col("b").alias("node"), label.alias("label"), "weight", "lacks", "deltas", (F.col("weight") + F.col("lacks") - F.col("extra")).alias("whole"))
    fresh = materialise(joining_edges(rows, threshold), f"{name}-rest")
    more = measured.where(linked).select("a", "b").union(compare(fresh, texts, sets).where(linked).select("a", "b"))
    # Components of components: only edges between different labels are left.
    across = more.join(of["a"], "a", "left").join(of["b"], "b", "left").select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b"))
    across = materialise(across.where("a <> b").distinct(), f"{name}-across")
    if across.isEmpty():
        return labels
    joined = materialise(connected_components(across).select(F.col("node").alias("label"), F.col("label").alias("least")), f"{name}-joined")
    fresh_nodes = joined.join(labels.select("label").distinct(), "label", "left_anti").select(F.col("label").alias("node"), "least")
    old = labels.join(joined, "label", "left").select("node", F.coalesce("least", "label").alias("label"))
    return old.union(fresh_nodes.select("node", F.col("least").alias("label")))


def joining_edges(rows: DataFrame, threshold: float) -> DataFrame:
    """Distinct pairs (a, b) that reach the threshold and join the labels of each group; enough of them, not all.

    ``rows``: centre (which names the group), node, label, weight, lacks and
    deltas as of :func:`compare`, whole (the centre's weight).
    """

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, q, whole in zip(_chunks(batch.column("p")), _chunks(batch.column("q")), batch.column("whole").to_pylist(), strict=True):
                ends = forest(p, q, whole, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(ends.min(0)), pa.array(ends.max(0))], ["a", "b"])

    placed = place(rows, threshold)
    n = passes(placed)
    found = [met_chunks(placed, k, n).mapInArrow(match, "a long, b long").distinct() for k in range(n)]
    return found[0] if n == 1 else reduce(DataFrame.union, [materialise(x, "pass-edges") for x in found]).distinct()


def chunk_pairs(rows: DataFrame, threshold: float) -> DataFrame:
    """The chunks p and q of each group that have to meet, one row a pair, and whole.

    Similar nodes differ in weight by a factor of ``1 / threshold`` at most, so
    chunks are made by level of the weight and meet those of the same and the
    next levels; only nodes outside the largest component ask (p), all are
    asked (q).  Pairs are dealt out by cell: a band of ``SIDE`` chunks' bytes of
    one side by a band of the other, each cell under a key of its own.  So a
    large group is the work of as many tasks as it has cells, no task holds
    more than a cell's chunks, and a group of one band is sent once.
    """
    return met_chunks(place(rows, threshold))


def place(rows: DataFrame, threshold: float) -> DataFrame:
    """``rows`` of the groups with several labels, written down with level, main (the group's largest label), and the numbers of chunks of either side."""
    sizes = rows.groupBy("centre", "label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("deltas")).alias("bytes"))
    sizes = sizes.groupBy("centre").agg(F.max(F.struct("n", "label", "bytes")).alias("main"), F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
    # Chunks of the group, and of what asks in it.
    many = [F.ceil((b + 1) / CHUNK_BYTES).alias(c) for c, b in (("q_parts", F.col("bytes")), ("p_parts", F.col("bytes") - F.col("main.bytes")))]
    level = F.floor(F.log(F.greatest("weight", F.lit(1e-6))) / (1.0001 * math.log(1 / threshold))).cast("int")
    return materialise(rows.join(sizes.select("centre", F.col("main.label").alias("main"), *many), "centre").withColumn("level", level), "placed")


def passes(placed: DataFrame) -> int:
    """In how many passes the cells are matched: each sends about ``PASS_TIMES`` times the bytes of all differences, however large the groups."""
    size = F.length("deltas")
    # A chunk is sent to each band of the other side.
    bands = {c: F.expr(f"({c}_parts - 1) div {SIDE} + 1") for c in ("p", "q")}
    sent = size * bands["p"] + F.when(F.col("label") != F.col("main"), size * bands["q"]).otherwise(0)
    found = placed.agg(F.sum(sent).alias("sent"), F.sum(size).alias("all")).first()
    return max(1, math.ceil((found["sent"] or 0) / (PASS_TIMES * (found["all"] or 1))))


def met_chunks(placed: DataFrame, k: int = 0, n: int = 1) -> DataFrame:
    """The chunk pairs (:func:`chunk_pairs`) of the ``k``-th of ``n`` parts of the cells."""
    item = F.collect_list(F.struct("node", "label", "weight", "lacks", "deltas"))
    cell = ["centre", "p_band", "q_band"]

    def chunks(some: DataFrame, mine: str, other: str) -> DataFrame:
        """The chunks of one side, one row for each cell they belong to."""
        part = F.pmod(F.xxhash64("node"), F.col(f"{mine}_parts"))
        others = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"({other}_parts - 1) div {SIDE}"))).alias(f"{other}_band")
        dealt = some.withColumn("part", part).select("*", F.expr(f"part div {SIDE}").alias(f"{mine}_band"), others)
        # Sent once, by cell; grouping and join need no further shuffle.
        dealt = dealt.where(F.pmod(F.xxhash64(*cell), F.lit(n)) == k).repartition(*cell)
        return dealt.groupBy(*cell, F.col("level").alias(f"{mine}_level"), "part").agg(item.alias(mine), F.max("whole").alias("whole")).drop("part", *(["whole"] if mine == "q" else []))

    met = chunks(placed.where("label <> main"), "p", "q").join(chunks(placed, "q", "p"), cell)
    return met.where(F.abs(F.col("p_level") - F.col("q_level")) <= 1).select("p", "q", "whole")


class _Chunk(NamedTuple):
    """Nodes of a group and how they differ from its centre: row (the node's number), token and value (the root of its weight) of each difference."""

    node: np.ndarray
    label: np.ndarray
    weight: np.ndarray
    lacks: np.ndarray
    row: np.ndarray
    token: np.ndarray
    value: np.ndarray


def _chunks(cells: pa.Array) -> Iterator[_Chunk]:
    items = cells.flatten()
    if not len(items):
        return
    columns = [items.field(c).to_numpy() for c in ("node", "label", "weight", "lacks")]
    deltas = items.field("deltas").cast(pa.large_binary())
    ends = np.frombuffer(deltas.buffers()[1], dtype=np.int64)[deltas.offset : deltas.offset + len(deltas) + 1]
    found = np.frombuffer(deltas.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]].view(_DELTA) if ends[-1] > ends[0] else np.zeros(0, _DELTA)
    ends = (ends - ends[0]) // _DELTA.itemsize
    heads = np.append(0, np.cumsum(cells.value_lengths().to_numpy()))
    for x, y in zip(heads[:-1], heads[1:], strict=True):
        row = np.repeat(np.arange(y - x), np.diff(ends[x : y + 1]))
        mine = found[ends[x] : ends[y]]
        yield _Chunk(*(c[x:y] for c in columns), row, mine["token"], np.sqrt(mine["weight"] * _UNIT))


def forest(p: _Chunk, q: _Chunk, whole: float, threshold: float) -> np.ndarray:
    """Pairs of nodes (two rows) that reach the threshold, as many as join the labels of the chunks that such pairs can join."""
    none = np.zeros((2, 0), dtype=np.int64)
    if len(np.union1d(p.label, q.label)) < 2:
        return none
    # Only differences that both chunks hold add to what two nodes share.
    both = np.concatenate([p.token, q.token])
    order = np.argsort(both)
    both, of_q = both[order], order >= len(p.token)
    first = np.append(True, both[1:] != both[:-1])[: len(both)]
    heads = np.flatnonzero(first)
    met = np.logical_or.reduceat(of_q, heads) & np.logical_or.reduceat(~of_q, heads) if len(heads) else np.zeros(0, dtype=bool)
    n_tokens, columns, group = int(met.sum()), np.cumsum(met) - 1, np.cumsum(first) - 1
    shared = whole - p.lacks[:, None] - q.lacks[None]
    sides, use = [], met[group]
    for c, mine, base in ((p, ~of_q, 0), (q, of_q, len(p.token))):
        mine = np.flatnonzero(mine & use)
        at = order[mine] - base
        sides.append((c.row[at], columns[group[mine]], c.value[at], len(c.node)))
    for low in range(0, n_tokens, _COLUMNS):
        width, parts = min(_COLUMNS, n_tokens - low), []
        for row, column, value, n in sides:
            x, y = np.searchsorted(column, [low, low + width])
            part = np.zeros((n, width))
            part[row[x:y], column[x:y] - low] = value[x:y]
            parts.append(part)
        shared += parts[0] @ parts[1].T
    total = p.weight[:, None] + q.weight[None]
    near = shared * (1 + threshold) >= threshold * total - _UNIT / 10
    labels = np.concatenate([p.label, q.label])
    edges = []
    near &= p.label[:, None] != q.label[None]
    for i, j in np.argwhere(near):
        one, other = labels[i], labels[len(p.node) + j]
        if one != other:
            edges.append((p.node[i], q.node[j]))
            labels[labels == other] = one
    return np.array(edges, dtype=np.int64).T if edges else none


def compare(pairs: DataFrame, texts: DataFrame, sets: Sets, deltas: bool = False) -> DataFrame:
    """The exact similarity of each pair (a, b) of nodes, given their texts; what else ``pairs`` holds goes along.

    With ``deltas`` also b's weight, the weights of what it lacks of a and of
    what it has beyond (extra), and both as tokens: the shingles' 64-bit hashes
    but for the lowest bit, which tells one kind from the other, with their weights.
    """

    pairs_columns = pairs.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = batch.column("a_text"), batch.column("b_text")
            for x, y in ragged.groups(two, _GROUP_BYTES):
                for u, v in ragged.groups(one.slice(x, y - x), _GROUP_BYTES):
                    for at in range(x + u, x + v, _PAIRS):
                        n = min(_PAIRS, x + v - at)
                        found = overlaps(one.slice(at, n), two.slice(at, n), sets, deltas)
                        yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(at, n) for c in pairs_columns), *found], names)

    right = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("b_text")), "b")
    # The side of frequent nodes is joined last, so that their texts are not shuffled with each pair.
    both = right.join(texts.select(F.col("node").alias("a"), F.col("text").alias("a_text")), "a").select(*pairs_columns, "a_text", "b_text")
    found = ["similarity", *(["weight", "lacks", "extra"] if deltas else [])]
    fields = [T.StructField(c, T.DoubleType()) for c in found] + [T.StructField("deltas", T.BinaryType())] * deltas
    schema = T.StructType([pairs.schema[c] for c in pairs_columns] + fields)
    names = schema.names
    return both.mapInArrow(work, schema)


def overlaps(one: pa.Array, two: pa.Array, sets: Sets, deltas: bool = False) -> list[pa.Array]:
    """The columns that :func:`compare` adds, for a batch of pairs; a text that occurs in many pairs is taken apart once."""
    n = len(one)
    coded = pa.concat_arrays([one.cast(pa.large_string()), two.cast(pa.large_string())]).fill_null("").dictionary_encode()
    codes = coded.indices.to_numpy()
    owner, shingle, weight = sets(coded.dictionary)
    heads = np.searchsorted(owner, np.arange(len(coded.dictionary) + 1))
    totals = np.bincount(owner, weight, len(coded.dictionary))
    bits = np.uint64(max(n - 1, 1).bit_length())

    def spread(texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each pair's text: the pair, the place of each shingle, and a key of both in rising order."""
        counts = heads[texts + 1] - heads[texts]
        pair = np.repeat(np.arange(n), counts)
        at = np.arange(len(pair)) + np.repeat(heads[texts] - (np.cumsum(counts) - counts), counts)
        return pair, at, (pair.astype(np.uint64) << (np.uint64(64) - bits)) | (shingle[at] >> bits)

    a_pair, a_at, a_keys = spread(codes[:n])
    pair, at, keys = spread(codes[n:])
    hit, a_hit = np.zeros(len(keys), dtype=bool), np.zeros(len(a_keys), dtype=bool)
    if len(a_keys):
        place = np.minimum(np.searchsorted(a_keys, keys), len(a_keys) - 1)
        hit = a_keys[place] == keys
        a_hit[place[hit]] = True
    common = np.bincount(pair[hit], weight[at[hit]], n)
    union = totals[codes[:n]] + totals[codes[n:]] - common
    out = [pa.array(np.where(union > 0, common / np.where(union > 0, union, 1), 0.0))]
    if deltas:
        gone, more = np.flatnonzero(~a_hit), np.flatnonzero(~hit)
        owner = np.concatenate([a_pair[gone], pair[more]])
        place = np.concatenate([a_at[gone], at[more]])
        found = np.empty(len(owner), dtype=_DELTA)
        found["token"] = ragged.mix(shingle[place]) & ~np.uint64(1)
        found["token"][len(gone) :] |= np.uint64(1)
        found["weight"] = np.rint(weight[place] / _UNIT)
        order = np.argsort(owner, kind="stable")
        ends = np.searchsorted(owner[order], np.arange(n + 1)) * _DELTA.itemsize
        flat = pa.py_buffer(found[order].tobytes())
        lacks, extra = totals[codes[:n]] - common, totals[codes[n:]] - common
        out += [pa.array(totals[codes[n:]]), pa.array(lacks), pa.array(extra), pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), flat])]
    return out
