"""Sessions over time (L4, L6): registrations in any order within the watermark, with timers for the end of a session.

transformWithState keeps, per service, the registrations whose time has not come and the session in
force.  A timer stands at the earliest of them, so they are decided in order of time once the
watermark passes them, whatever their order of arrival; another one stands at the end of the
session in force, which then expires and leaves no state behind.  The state store must be RocksDB's
(`with_timers` sets it).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cinetide.operators.folds import Step

#: A session ends after 11 h 40.
LIMIT_MS = 42_000_000
EVENT = "service string, at_ms bigint, seq bigint, host string, session_start bigint, event string"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_timers(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def decided(current: tuple | None, host: str, start: int, force: bool, tunnel: bool, at: int) -> tuple[tuple, bool]:
    """L4: the session in force (host, start, at) after a registration, and whether it was accepted; a missing start counts as 0 and is stored as the time."""
    start = start or 0
    if current and not force and tunnel and start < current[1]:
        return current, False
    return (host, start or at, at), True


class Sessions(StatefulProcessor):
    def __init__(self, limit_ms: int = LIMIT_MS):
        self.limit = limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at long, seq long", "host string, session_start long, force boolean, is_tunnel boolean")
        self.current = handle.getValueState("current", "host string, session_start long, at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first = None
        for frame in rows:
            for r in frame.itertuples(index=False):
                start = 0 if pd.isna(r.session_start) else int(r.session_start)
                self.waiting.updateValue((int(r.at_ms), int(r.seq)), (r.host, start, bool(r.force), bool(r.is_tunnel)))
                first = int(r.at_ms) if first is None else min(first, int(r.at_ms))
        if first is not None:
            self.handle.registerTimer(first)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """All that the watermark has passed is decided at once; the earliest that waits on gets the next timer."""
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        waiting = sorted((tuple(at), tuple(value)) for at, value in self.waiting.iterator())
        before = self.current.get() if self.current.exists() else None
        current, events = tuple(before) if before else None, []
        for (at, seq), (host, start, force, tunnel) in waiting:
            if at > now:
                self.handle.registerTimer(at)
                break
            current = self.ended(key[0], current, at, events)
            current, accepted = decided(current, host, start, force, tunnel, at)
            self.waiting.removeKey((at, seq))
            events.append((key[0], at, seq, host, start, "ACCEPTED" if accepted else "REJECTED"))
        current = self.ended(key[0], current, now, events)
        if current is None:
            self.current.clear()
        elif current != before:
            self.current.update(current)
            self.handle.registerTimer(current[2] + self.limit)
        yield pd.DataFrame(events, columns=[c.split()[0] for c in EVENT.split(", ")]) if events else pd.DataFrame()

    def ended(self, service: str, current: tuple | None, now: int, events: list[tuple]) -> tuple | None:
        """The session in force, unless its end has come, which is an event."""
        if current is None or current[2] + self.limit > now:
            return current
        events.append((service, current[2] + self.limit, -1, current[0], current[1], "EXPIRED"))
        return None

    def close(self) -> None:
        pass


def live(registrations: DataFrame, delay: str = "10 minutes", limit_ms: int = LIMIT_MS) -> DataFrame:
    """Rows of EVENT as they are decided, from a stream (service, at timestamp, seq, host, session_start, force, is_tunnel)."""
    rows = registrations.withColumn("at_ms", F.unix_millis("at")).withWatermark("at", delay)
    return rows.groupBy("service").transformWithStateInPandas(Sessions(limit_ms), EVENT, "Append", "EventTime")


def step(limit_ms: int = LIMIT_MS) -> Step:
    """The same over (host, session_start, force, is_tunnel, at_ms) in order, for folds.folded(): the result is (accepted, whether a session had expired before)."""

    def run(state, row):
        host, start, force, tunnel, at = row
        expired = state is not None and state[2] + limit_ms <= at
        after, accepted = decided(None if expired else state, host, start, force, tunnel, at)
        return (after if accepted or not expired else None), (accepted, expired)

    return run
