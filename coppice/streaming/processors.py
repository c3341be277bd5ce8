"""State machines and leases of a stream, held in Spark's state store by session."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MINUTE = 60_000


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """State with timers needs the RocksDB store; a query takes the setting at its start, and the session gets its own back."""
    was = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(STORE) if was is None else spark.conf.set(STORE, was)


def in_order(rows: Iterator[pd.DataFrame], *columns: str) -> Iterator[tuple]:
    """One key's rows of a micro-batch, by seq. A micro-batch is bounded by its trigger."""
    parts = [r[["seq", *columns]] for r in rows]
    if parts:
        yield from pd.concat(parts).sort_values("seq").itertuples(index=False, name=None)


class Lifecycle(StatefulProcessor):
    """STR-5: state, transitions and refused of each session; a transition that is not allowed is counted and changes nothing."""

    OUT = "session long, state string, transitions long, refused long, seq long"

    def __init__(self, allowed: dict[str, tuple[str, ...]]) -> None:
        self.allowed = allowed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("machine", "state string, transitions long, refused long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state, done, refused = self.held.get() if self.held.exists() else (None, 0, 0)
        last = None
        for seq, kind in in_order(rows, "kind"):
            last = seq
            if kind in (self.allowed if state is None else self.allowed[state]):
                state, done = kind, done + 1
            else:
                refused += 1
        if last is not None:
            self.held.update((state, done, refused))
            yield pd.DataFrame({"session": [key[0]], "state": [state], "transitions": [done], "refused": [refused], "seq": [last]})

    def close(self) -> None:
        pass


class Leases(StatefulProcessor):
    """STR-4: the open lease of each session. It ends with the session's next event; if that comes too late, or if the watermark passes the lease's end, it leaves an event."""

    OUT = "session long, seq long, event string, outcome string"

    def __init__(self, lengths: dict[str, int], dropped: tuple[str, ...]) -> None:
        self.lengths, self.dropped = lengths, dropped

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("lease", "seq long, kind string, until long")

    def _gone(self, key, leases: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame({"session": [key[0]] * len(leases), "seq": [s for s, _, _ in leases], "event": ["lease_expired"] * len(leases), "outcome": ["cancelled" if k in self.dropped else "requeued" for _, k, _ in leases]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        was = lease = tuple(self.open.get()) if self.open.exists() else None
        gone = []
        for seq, kind, tick in in_order(rows, "kind", "tick"):
            if lease and tick * MINUTE >= lease[2]:
                gone.append(lease)
            lease = (int(seq), kind, int(tick + self.lengths[kind]) * MINUTE) if kind in self.lengths else None
        if was != lease:
            if was:
                self.handle.deleteTimer(was[2])
            if lease:
                self.open.update(lease)
                self.handle.registerTimer(lease[2])
            else:
                self.open.clear()
        if gone:
            yield self._gone(key, gone)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.open.exists():
            lease = tuple(self.open.get())
            if lease[2] <= expiredTimerInfo.getExpiryTimeInMs():
                self.open.clear()
                yield self._gone(key, [lease])

    def close(self) -> None:
        pass


def lifecycles(feed: DataFrame, allowed: dict[str, tuple[str, ...]]) -> DataFrame:
    """feed: session, kind, seq. A row for each session that a micro-batch touches; the one with the largest seq is its newest."""
    return feed.groupBy("session").transformWithStateInPandas(Lifecycle(allowed), Lifecycle.OUT, "Append", "None")


def leases(feed: DataFrame, lengths: dict[str, int], dropped: tuple[str, ...] = ("click",), delay: str = "0 seconds") -> DataFrame:
    """feed: session, kind, seq, tick (minutes), at (timestamp). A row for each lease that expires, when it does."""
    return feed.withWatermark("at", delay).groupBy("session").transformWithStateInPandas(Leases(lengths, dropped), Leases.OUT, "Append", "EventTime")
