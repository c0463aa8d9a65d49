"""Streams by event time: windows and sessions with late rows kept apart, and sequences without gaps.

Open windows are a map with an entry each, the few open sessions of a key one value, and
waiting events runs of some thousands, so a batch calls its state as few times as it
can. Timers remove what the watermark has passed. Rows that come after their window was closed are not lost: they
are passed on as ``late``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "kind string, key string, start timestamp, stop timestamp, n long, total double"
_COLUMNS = ["kind", "key", "start", "stop", "n", "total"]
_US = 1_000_000


def _long(*names: str) -> StructType:
    return StructType([StructField(n, LongType()) for n in names])


_SUMS = StructType([StructField("stop", LongType()), StructField("n", LongType()), StructField("total", DoubleType())])

_SESSION_TYPES = (np.int64, np.int64, np.int64, np.float64)


def _arrays(*names: str, kind=None) -> list[StructField]:
    return [StructField(n, ArrayType(kind or LongType())) for n in names]


_SESSIONS = StructType([*_arrays("start", "stop", "n"), *_arrays("total", kind=DoubleType())])
_INDEX = StructType([*_long("after", "number").fields, *_arrays("runs", "firsts")])
_RUN = StructType([*_arrays("seq", "came"), *_arrays("payload", kind=StringType())])


def _sums(kind: str, key: str | None, start: np.ndarray, stop: np.ndarray, n: np.ndarray, total: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"kind": kind, "key": key, "start": start.astype("datetime64[us]"), "stop": stop.astype("datetime64[us]"), "n": n, "total": total})


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=_COLUMNS)
    for c in ("start", "stop"):
        out[c] = pd.to_datetime(out[c], unit="us")
    return out


class Windows(StatefulProcessor):
    """Counts and sums in windows of ``length`` that begin every ``slide`` (both in microseconds)."""

    def __init__(self, length: int, slide: int) -> None:
        self.length, self.slide = length, slide

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", _long("start"), _SUMS)

    def starts(self, at: int) -> range:
        last = at - at % self.slide
        return range(last, at - self.length, -self.slide)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        new: dict[int, list] = {}
        late = []
        for pdf in rows:
            for at, value in zip(pdf["at"], pdf["value"], strict=True):
                begun = [s for s in self.starts(int(at)) if s + self.length > passed]
                if not begun:
                    s = next(iter(self.starts(int(at))))
                    late.append(("late", key[0], s, s + self.length, 1, value))
                for s in begun:
                    sums = new.setdefault(s, [0, 0.0])
                    sums[0] += 1
                    sums[1] += value
        for s, (n, total) in new.items():
            if self.open.containsKey((s,)):
                _, n0, t0 = self.open.getValue((s,))
                n, total = n + n0, total + t0
            else:
                self.handle.registerTimer(-(-(s + self.length) // 1000))
            self.open.updateValue((s,), (s + self.length, n, total))
        if late:
            yield _frame(late)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = expiredTimerInfo.getExpiryTimeInMs() * 1000
        done = [(s, *v) for (s,), v in self.open.iterator() if v[0] <= until]
        for s, *_ in done:
            self.open.removeKey((s,))
        if done:
            yield _frame([("window", key[0], s, stop, n, total) for s, stop, n, total in done])

    def close(self) -> None:
        pass


class Sessions(StatefulProcessor):
    """Counts and sums of rows that follow one another within ``gap`` (microseconds); a session ends a gap after its last row.

    Most keys have few sessions open, so a key's are one value, and it has one timer, of the first to end.
    """

    def __init__(self, gap: int) -> None:
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", _SESSIONS)

    def held(self) -> list[np.ndarray]:
        found = self.open.get() or ([], [], [], [])
        return [np.array(c, t) for c, t in zip(found, _SESSION_TYPES, strict=True)]

    def keep(self, sessions: list[np.ndarray]) -> None:
        if len(sessions[0]):
            self.open.update(tuple(c.tolist() for c in sessions))
            self.handle.registerTimer(int(-(-sessions[1].min() // 1000)))
        else:
            self.open.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        sessions = self.held()
        for pdf in rows:
            at, value = pdf["at"].to_numpy(np.int64), pdf["value"].to_numpy(np.float64)
            fresh = at + self.gap > passed
            if not fresh.all():
                yield _sums("late", key[0], at[~fresh], at[~fresh] + self.gap, np.ones((~fresh).sum(), np.int64), value[~fresh])
            new = (at[fresh], at[fresh] + self.gap, np.ones(fresh.sum(), np.int64), value[fresh])
            sessions = self.merged([np.concatenate(c) for c in zip(sessions, new, strict=True)])
        self.keep(sessions)

    @staticmethod
    def merged(sessions: list[np.ndarray]) -> list[np.ndarray]:
        order = np.argsort(sessions[0], kind="stable")
        start, stop, n, total = (c[order] for c in sessions)
        if not len(start):
            return [start, stop, n, total]
        reach = np.maximum.accumulate(stop)
        # A row that comes exactly when a session ends begins another.
        first = np.flatnonzero(np.concatenate([[True], start[1:] >= reach[:-1]]))
        return [start[first], reach[np.append(first[1:], len(start)) - 1], np.add.reduceat(n, first), np.add.reduceat(total, first)]

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        sessions = self.held()
        done = sessions[1] <= timerValues.getCurrentWatermarkInMs() * 1000
        self.keep([c[~done] for c in sessions])
        if done.any():
            yield _sums("window", key[0], *(c[done] for c in sessions))

    def close(self) -> None:
        pass


class Gate(StatefulProcessor):
    """Events in gap-free order; what follows a gap waits until it is filled.

    Events wait in runs, sorted by number. A run is read when its first number is
    reached; what still waits is written as new runs. ``came`` says which of repeated events is the last.
    """

    RUN = 4096

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.index = handle.getValueState("index", _INDEX)
        self.waiting = handle.getMapState("waiting", _long("run"), _RUN)

    @staticmethod
    def newest(seq: np.ndarray, came: np.ndarray, payload: np.ndarray, after: int) -> tuple[np.ndarray, ...]:
        """Events behind ``after`` in order, the last that came of each number."""
        order = np.lexsort((came, seq))
        order = order[seq[order] > after]
        last = np.append(seq[order][1:] != seq[order][:-1], True) if len(order) else np.zeros(0, bool)
        return tuple(c[order[last]] for c in (seq, came, payload))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        after, number, runs, firsts = self.index.get() or (0, 0, [], [])
        index = dict(zip(runs, firsts, strict=True))
        for pdf in rows:
            number += 1
            seq = pdf["seq"].to_numpy(np.int64)
            held = self.newest(seq, np.full(len(seq), number), pdf["payload"].to_numpy(object), after)
            while True:
                gaps = np.flatnonzero(held[0] != after + 1 + np.arange(len(held[0])))
                ready = int(gaps[0]) if len(gaps) else len(held[0])
                due = [r for r, first in index.items() if first <= after + ready + 1]
                if not due:
                    break
                for r in due:
                    old = self.waiting.getValue((r,))
                    self.waiting.removeKey((r,))
                    del index[r]
                    more = (np.array(old[0], np.int64), np.array(old[1], np.int64), np.array(old[2], object))
                    held = tuple(np.concatenate(c) for c in zip(held, more, strict=True))
                held = self.newest(*held, after)
            if ready:
                yield pd.DataFrame({"project": key[0], "seq": held[0][:ready], "payload": held[2][:ready]})
                after += ready
            for i in range(ready, len(held[0]), self.RUN):
                number += 1
                index[number] = int(held[0][i])
                self.waiting.updateValue((number,), tuple(c[i : i + self.RUN].tolist() for c in held))
        self.index.update((after, number, list(index), list(index.values())))

    def close(self) -> None:
        pass


def _stateful(rows: DataFrame, key: str, processor: StatefulProcessor, schema: str, time_mode: str) -> DataFrame:
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return rows.groupBy(key).transformWithStateInPandas(processor, schema, "Append", time_mode)


def _by_event_time(stream: DataFrame, key: str, at: str, value: str, delay: str, processor: StatefulProcessor) -> DataFrame:
    marked = stream.select(F.col(key).cast("string").alias("key"), F.col(at).cast("timestamp").alias("t"), F.col(value).cast("double").alias("value")).withWatermark("t", delay)
    # As a plain number the time does not let Spark drop late rows unseen; rows without a time have no window.
    rows = marked.filter("t is not null").select("key", F.unix_micros("t").alias("at"), F.coalesce("value", F.lit(0.0)).alias("value"))
    return _stateful(rows, "key", processor, OUT, "EventTime")


def windows(stream: DataFrame, key: str, at: str, value: str, delay: str, length_seconds: int, slide_seconds: int | None = None) -> DataFrame:
    """``kind, key, start, stop, n, total``: windows (``window``) that the watermark has passed, once each, and late rows (``late``).

    A row is late if all its windows were passed by the watermark of the batch before.
    """
    return _by_event_time(stream, key, at, value, delay, Windows(length_seconds * _US, (slide_seconds or length_seconds) * _US))


def sessions(stream: DataFrame, key: str, at: str, value: str, delay: str, gap_seconds: int) -> DataFrame:
    """Like ``windows``, for sessions that end ``gap_seconds`` after their last row."""
    return _by_event_time(stream, key, at, value, delay, Sessions(gap_seconds * _US))


def gated(stream: DataFrame, project: str, seq: str, payload: str) -> DataFrame:
    """A stream's events in gap-free order of each project, ``project, seq, payload``; repeated ones are dropped."""
    rows = stream.select(F.col(project).cast("string").alias("project"), F.col(seq).cast("long").alias("seq"), F.col(payload).cast("string").alias("payload")).filter("seq is not null")
    return _stateful(rows, "project", Gate(), "project string, seq long, payload string", "None")


def run_to_end(made: Callable[[DataFrame], DataFrame], stream: DataFrame, path: str, checkpoint: str) -> None:
    """Runs what is there and stops; ``path`` has the rows once each, whatever is repeated."""
    query = made(stream).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
