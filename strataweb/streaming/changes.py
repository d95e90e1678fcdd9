"""Keyed state over streams: members that come and go, and how fast tasks get on.

Both are ``transformWithState`` processors: one state a key, in the state
store, so a restart goes on where the checkpoint left off.  They need the
RocksDB state store, which :func:`use_state_store` sets.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from ..operators.groups import Group, fitting

CHANGES = "id long, url string, group_id long, change string, seq long"
RATES = "task_id string, seconds double, done long, total long, rate double, eta_seconds double, stalled boolean"
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)


class _Members(StatefulProcessor):
    """What an id is a member of; emits what a batch of its changes adds and removes."""

    def init(self, handle) -> None:
        self.held = handle.getValueState("held", "seq long, url string, members array<bigint>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = self.held.get()
        seq, url, members = (before[0], before[1], list(before[2])) if before is not None else (None, None, [])
        last = max(rows, key=lambda r: r["seq"])
        if seq is not None and last["seq"] <= seq:
            return  # late: something newer is known
        new_url, new = (None, []) if last["deleted"] else (last["url"], list(last["_members"]))
        # A member that has moved leaves with its old URL and comes with its new one.
        moved = url != new_url
        for g in members:
            if moved or g not in new:
                yield Row(id=key[0], url=url, group_id=g, change="removed", seq=last["seq"])
        for g in new:
            if moved or g not in members:
                yield Row(id=key[0], url=new_url, group_id=g, change="added", seq=last["seq"])
        self.held.update((last["seq"], new_url, new))

    def close(self) -> None:
        pass


def member_changes(changes: DataFrame, groups: list[Group]) -> DataFrame:
    """A stream of members that changes (seq, id, url, deleted) add and remove: ``CHANGES``.

    A change replaces what was known of its id; of those of one micro-batch the
    last counts, and one that comes after a newer one is left out.  Deleted ids
    keep a state without members, so that late changes do not bring them back.
    """
    use_state_store(changes.sparkSession)
    with_members = changes.where("id is not null and seq is not null").select("id", "seq", "url", F.coalesce("deleted", F.lit(False)).alias("deleted"), F.coalesce(fitting(F.col("url"), groups), F.array().cast("array<bigint>")).alias("_members"))
    return with_members.groupBy("id").transformWithState(_Members(), T.StructType.fromDDL(CHANGES), "append", "none")


def members_of(changes: DataFrame) -> DataFrame:
    """id, url and group_id that a table of emitted changes leaves."""
    sign = F.when(F.col("change") == "added", 1).otherwise(-1)
    return changes.groupBy("id", "url", "group_id").agg(F.sum(sign).alias("n")).where("n > 0").select("id", "url", "group_id")


class _Rates(StatefulProcessor):
    """Decayed sums of what a task gained and how long that took; a timer tells when it has gone quiet."""

    def __init__(self, half_life: float, quiet: float | None):
        self.half_life, self.quiet = half_life, quiet

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "seconds double, done long, total long, gained double, passed double, timer long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.held.get()
        state = tuple(held) if held is not None else None
        for r in sorted(rows, key=lambda r: r["seconds"]):
            at, done, total = r["seconds"], r["done"], r["total"]
            if state is not None and at <= state[0]:
                continue  # late, or the same sample again
            gained = passed = 0.0
            if state is not None:
                step = at - state[0]
                fade = 2.0 ** (-step / self.half_life)
                # What was gained counts in the interval's length, as the time passed does.
                gained, passed = state[3] * fade + (done - state[1]) - (total - state[2]), state[4] * fade + step
            timer = state[5] if state is not None else 0
            rate = gained / passed if passed > 0 else None
            state = (at, done, total, gained, passed, timer)
            yield Row(task_id=key[0], seconds=at, done=done, total=total, rate=rate, eta_seconds=(total - done) / rate if rate is not None and rate > 0 else None, stalled=False)
        if self.quiet is not None and state is not None and (held is None or state[0] > held[0]):
            if state[5]:
                self.handle.deleteTimer(state[5])
            timer = int((state[0] + self.quiet) * 1000)
            self.handle.registerTimer(timer)
            state = (*state[:5], timer)
        if state is not None:
            self.held.update(state)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        state = self.held.get()
        if state is not None and state[5] == expiredTimerInfo.getExpiryTimeInMs():
            self.held.update((*tuple(state)[:5], 0))
            if state[1] < state[2]:
                yield Row(task_id=key[0], seconds=state[0] + self.quiet, done=state[1], total=state[2], rate=0.0, eta_seconds=None, stalled=True)

    def close(self) -> None:
        pass


def rates(progress: DataFrame, half_life: float = 60.0, quiet: float | None = None) -> DataFrame:
    """As :func:`..operators.resources.rates` for a stream of samples (task_id, seconds, done, total): ``RATES``.

    With ``quiet`` a task that is not done and sends no sample for so many
    seconds of event time (the watermark of ``at``, the samples' time, tells)
    gets one row more, of rate 0 and ``stalled``.
    """
    use_state_store(progress.sparkSession)
    rows = progress.where("task_id is not null and seconds is not null")
    mode = "none"
    if quiet is not None:
        rows = rows.withColumn("at", F.timestamp_millis((F.col("seconds") * 1000).cast("long"))).withWatermark("at", "0 seconds")
        mode = "eventTime"
    return rows.groupBy("task_id").transformWithState(_Rates(half_life, quiet), T.StructType.fromDDL(RATES), "append", mode)
