"""Life of clusters under events of their members, as keyed state with timers.

A cluster is open until it is merged or one of its members is deleted; what a
merge took in can be restored within a window, which opens the cluster again.
State is a value (status and number of changes) and a map of what was taken in
and when; a timer for each merge removes what can no longer be restored once
the watermark has passed the window.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewater.storage import importable

#: State stores of keyed state with maps and timers.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
KINDS = ("deletion", "merge", "restore")
DAY_MS = 86_400_000


@dataclass
class Cluster:
    """What is known of a cluster; times in milliseconds."""

    window: int
    status: str = "open"
    version: int = 0

    def becomes(self, status: str) -> None:
        self.version += status != self.status
        self.status = status

    def take(self, kind: str, member: str, other: str | None, at: int, taken: Any) -> bool:
        """Whether a merge was recorded.  ``taken`` has get, put: when a member was last taken in."""
        if kind == "deletion" and self.status != "merged":
            self.becomes("invalid")
        elif kind == "merge" and self.status == "open" and other is not None:
            self.becomes("merged")
            taken.put(other, at)
            return True
        elif kind == "restore" and (when := taken.get(member)) is not None and at - when <= self.window:
            self.becomes("open")
        return False


class _Taken:
    def __init__(self, state: Any):
        self.state = state

    def get(self, member: str) -> int | None:
        found = self.state.getValue((member,))
        return found[0] if found else None

    def put(self, member: str, at: int) -> None:
        self.state.updateValue((member,), (at,))

    def expire(self, before: int) -> int:
        """Remove what was taken in before an instant; how much is left."""
        held = [(k[0], v[0]) for k, v in self.state.iterator()]
        for member, at in held:
            if at < before:
                self.state.removeKey((member,))
        return sum(at >= before for _, at in held)


class Tracker(StatefulProcessor):
    def __init__(self, window: int):
        self.window = window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("cluster", "status string, version int")
        self.taken = handle.getMapState("taken", "member string", "at bigint")

    def _row(self, key: tuple, cluster: Cluster, held: int, why: str) -> Row:
        return Row(cluster=key[0], status=cluster.status, version=cluster.version, held=held, why=why)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        known = self.value.get()
        cluster, taken = Cluster(self.window, *(known or ("open", 0))), _Taken(self.taken)
        for r in sorted(rows, key=lambda r: (r["ms"], r["event"])):  # one micro-batch of one cluster
            if cluster.take(r["kind"], r["member"], r["other"], r["ms"], taken):
                self.handle.registerTimer(r["ms"] + self.window + 1)
        self.value.update((cluster.status, cluster.version))
        yield self._row(key, cluster, taken.expire(-(1 << 62)), "events")

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        left = _Taken(self.taken).expire(expiredTimerInfo.getExpiryTimeInMs() - self.window)
        yield self._row(key, Cluster(self.window, *(self.value.get() or ("open", 0))), left, "expired")

    def close(self) -> None:
        pass


class LastEffect(StatefulProcessor):
    """The status that the latest of the listed kinds makes, and how many such events there were."""

    def __init__(self, effects: dict[str, str]):
        self.effects = effects

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("last", "at bigint, status string, version int")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        at, status, version = self.value.get() or (None, None, 0)
        for r in sorted((r for r in rows if r["kind"] in self.effects), key=lambda r: (r["micros"], r["kind"])):
            version += 1
            if at is None or r["micros"] >= at:
                at, status = r["micros"], self.effects[r["kind"]]
        if status is not None:
            self.value.update((at, status, version))
            yield Row(key=key[0], status=status, version=version)

    def close(self) -> None:
        pass


def last_effects(events: DataFrame, key: str, kind: str, at: str, effects: dict[str, str]) -> DataFrame:
    """Updates (key, status, version) of a stream, one small value for each key."""
    importable(events.sparkSession)
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    rows = events.select(F.col(key).alias("key"), F.col(kind).alias("kind"), F.unix_micros(F.col(at).cast("timestamp")).alias("micros"))
    schema = f"key {events.schema[key].dataType.simpleString()}, status string, version int"
    return rows.groupBy("key").transformWithState(LastEffect(effects), schema, "Update", "None").withColumnRenamed("key", key)


def tracked(events: DataFrame, window_days: float = 30, late: str = "1 minute") -> DataFrame:
    """Updates of clusters from a stream: cluster, status, version, held (what can still be restored), why (events or expired).

    Events have event (an order among those of one instant), cluster, kind, member, other (what a merge takes in) and
    ts; other kinds, and rows without a cluster, are passed over.  Events of one cluster are taken in the order of
    time within what arrives together; later ones than the watermark allows are dropped by the stream.
    """
    spark = events.sparkSession
    importable(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    own = events.filter(F.col("kind").isin(*KINDS) & F.col("cluster").isNotNull() & F.col("member").isNotNull())
    own = own.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    rows = own.select(F.col("cluster").cast("string").alias("cluster"), F.col("event").cast("bigint").alias("event"), "kind", F.col("member").cast("string").alias("member"), F.col("other").cast("string").alias("other"), "ts", F.unix_millis("ts").alias("ms"))
    schema = "cluster string, status string, version int, held int, why string"
    return rows.groupBy("cluster").transformWithState(Tracker(round(window_days * DAY_MS)), schema, "Update", "EventTime")


def latest(updates: DataFrame) -> DataFrame:
    """The last state of each cluster out of stored updates."""
    return updates.groupBy("cluster").agg(F.max("version").alias("version"), F.max_by("status", "version").alias("status")).select("cluster", "status", "version")
