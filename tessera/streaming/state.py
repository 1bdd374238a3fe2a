"""Arbitrary state in streams: sessions closed by event-time timers, and first sightings that are forgotten.

A processor sees the rows of one key and keeps what it needs in the state store, in lists, maps and values. Rows come
in any order within the watermark; what a processor keeps does not grow with the rows of a key, only with what is open.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.registry import Registry
from tessera.streaming.queries import event_stream, run

R = Registry()
_PROVIDER, _IDLE = "spark.sql.streaming.stateStore.providerClass", "spark.sql.streaming.noDataMicroBatches.enabled"


@contextlib.contextmanager
def rocks(spark: SparkSession, idle: bool = True) -> Iterator[None]:
    """State in RocksDB, which processors need, while a stream runs; the session's own choice afterwards.

    Without idle, no batch runs that has no rows: state by processing time asks for one again and again, so a stream
    that is to end with its source (availableNow) would not.
    """
    before = {c: spark.conf.get(c) for c in (_PROVIDER, _IDLE)}
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set(_IDLE, str(idle).lower())
    try:
        yield
    finally:
        for c, value in before.items():
            spark.conf.set(c, value)


class Sessions(StatefulProcessor):
    """Sessions of a key: rows at most gap microseconds apart, told once no row can come that would prolong them.

    One list holds the open sessions in order of time: first and last row, number of rows and their kinds. A row between
    two open sessions joins them. A key has one timer, for the first of its sessions that the watermark will close. So
    a batch takes a few calls to the state for each key, however many sessions there are: each call is a message to the JVM.
    """

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "opening long, latest long, n long, kinds array<string>")

    def _sessions(self) -> list[tuple[int, int, int, list[str]]]:
        return [(int(r[0]), int(r[1]), int(r[2]), list(r[3])) for r in self.open.get()]

    def _closing(self, sessions: list) -> int | None:
        """When the first session closes; timers count milliseconds."""
        return -(-(min(s[1] for s in sessions) + self.gap) // 1000) if sessions else None

    def _keep(self, sessions: list, timer: int | None) -> None:
        """Store the open sessions and set their timer; timer is the one that is still set."""
        if sessions:
            self.open.put(sessions)
        else:
            self.open.clear()
        closing = self._closing(sessions)
        if closing != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if closing is not None:
                self.handle.registerTimer(closing)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self._sessions()
        found = list(before)
        for frame in rows:
            at, kind = frame["at"].to_numpy(), frame["kind"].fillna("").to_numpy()
            order = np.argsort(at, kind="stable")
            at, kind = at[order], kind[order]
            cuts = [0, *(np.flatnonzero(np.diff(at) > self.gap) + 1).tolist(), len(at)]
            found += [(int(at[low]), int(at[high - 1]), high - low, sorted(set(map(str, kind[low:high])))) for low, high in zip(cuts[:-1], cuts[1:], strict=True)]
        sessions: list[tuple[int, int, int, list[str]]] = []
        for opening, latest, n, kinds in sorted(found):
            if sessions and opening - self.gap <= sessions[-1][1]:
                first, last, more, others = sessions.pop()
                opening, latest, n, kinds = first, max(latest, last), n + more, sorted({*kinds, *others})
            sessions.append((opening, latest, n, kinds))
        self._keep(sessions, self._closing(before))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        sessions = self._sessions()
        over = [s for s in sessions if s[1] + self.gap <= passed]
        # the timer that called is gone
        self._keep([s for s in sessions if s[1] + self.gap > passed], None)
        if over:
            yield pd.DataFrame([(key[0], *s[:3], len(s[3])) for s in over], columns=["key", "opening", "latest", "n", "kinds"])

    def close(self) -> None:
        pass


def stream_sessions_of(stream: DataFrame, key: str, ts: str, kind: str, gap_seconds: int, delay: str) -> DataFrame:
    """key, opening, latest, n (rows) and kinds (different values of kind) of every session that the watermark has closed. Rows without a key or time belong to none; a null kind counts as one."""
    rows = stream.filter(F.col(key).isNotNull() & F.col(ts).isNotNull()).withWatermark(ts, delay)
    rows = rows.select(F.col(key).cast("long").alias("key"), ts, F.unix_micros(ts).alias("at"), F.col(kind).alias("kind"))
    schema = "key long, opening long, latest long, n long, kinds long"
    told = rows.groupBy("key").transformWithStateInPandas(statefulProcessor=Sessions(gap_seconds * 1_000_000), outputStructType=schema, outputMode="Append", timeMode="EventTime")
    instant = lambda c: F.timestamp_micros(c).cast("timestamp_ntz").alias(c)
    return told.select(F.col("key").alias(key), instant("opening"), instant("latest"), "n", "kinds")


@R.query("""
    WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
         s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM g),
         c AS (SELECT user_id, min(ts) AS opening, max(ts) AS latest, count(*) AS n, count(DISTINCT event_type) AS kinds FROM s GROUP BY user_id, session)
    SELECT * FROM c WHERE latest + INTERVAL 6 HOUR <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 HOUR FROM events)""")
def stream_sessions(spark, sf_dir):
    """Users' sessions with gaps of six hours at most, each told by its timer."""
    with rocks(spark):
        return run(stream_sessions_of(event_stream(spark, sf_dir), "user_id", "ts", "event_type", 6 * 3600, "1 hour"))


class FirstSeen(StatefulProcessor):
    """The first row of each kind that a key has; a kind is forgotten a while after it was last noted, by processing time."""

    def __init__(self, forget_ms: int):
        self.forget_ms = forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "kind string", "id long", self.forget_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first: dict[str, int] = {}
        for frame in rows:
            for kind, i in frame.groupby("kind")["id"].min().items():
                first[kind] = min(int(i), first.get(kind, int(i)))
        new = {k: i for k, i in first.items() if not self.seen.containsKey((k,))}
        for kind, i in new.items():
            self.seen.updateValue((kind,), (i,))
        if new:
            yield pd.DataFrame({"key": [key[0]] * len(new), "kind": list(new), "id": list(new.values())})

    def close(self) -> None:
        pass


def first_seen(stream: DataFrame, key: str, kind: str, row_id: str, forget_ms: int) -> DataFrame:
    """key, kind and id of the first row of every kind of every key; a kind comes again once it has been forgotten."""
    rows = stream.filter(F.col(key).isNotNull() & F.col(kind).isNotNull() & F.col(row_id).isNotNull())
    rows = rows.select(F.col(key).cast("long").alias("key"), F.col(kind).alias("kind"), F.col(row_id).cast("long").alias("id"))
    # of a key with very many rows, each task sends on its first of each kind only
    rows = rows.mapInPandas(lambda frames: (f.groupby(["key", "kind"], as_index=False)["id"].min() for f in frames), "key long, kind string, id long")
    told = rows.groupBy("key").transformWithStateInPandas(statefulProcessor=FirstSeen(forget_ms), outputStructType="key long, kind string, id long", outputMode="Append", timeMode="ProcessingTime")
    return told.select(F.col("key").alias(key), F.col("kind").alias(kind), F.col("id").alias(row_id))


@R.query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY user_id, event_type")
def stream_first_seen(spark, sf_dir):
    """Each user's first event of each type, remembered for a day of processing time."""
    with rocks(spark, idle=False):
        return run(first_seen(event_stream(spark, sf_dir), "user_id", "event_type", "event_id", 86_400_000))
