"""When a file of a watch folder is handed on: settled, with data at its start, once, and once more if that failed.

The rules, for each path and its newest version (length, mtime):

* it is ready when it has not changed for ``settle``; a change starts anew;
* a file that begins with nothing but zeros waits for its data, ``zero_wait`` from the time its version was first seen at most;
* a version is handed on once; if it fails the first time, once more after ``retry``, whatever else is seen of it;
* a version that comes back after it was handed on is not handed on again until ``forget`` has passed without a sign of the path.

``ready_stream`` keeps that in Structured Streaming, one small state a path with up to three timers (settle, zeros, retry) at a time; a state
that nothing has asked for in ``forget`` expires. ``ready`` replays a log of the same observations in batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What is seen: a version of a file with its time, whether it begins with zeros only; or the failure of its conversion.
OBSERVED = "path string, at timestamp, length bigint, mtime bigint, zeros boolean, failed boolean"
READY = "path string, length bigint, mtime bigint, attempt int, ready_ms bigint"


@dataclass(frozen=True)
class Waits:
    """Milliseconds."""

    settle: int = 2_000
    zero_wait: int = 30_000
    retry: int = 10_000
    forget: int = 86_400_000


@dataclass
class File:
    """What is known of a path. Times are in milliseconds; -1 is no time."""

    length: int = -1
    mtime: int = -1
    first: int = -1  # when this version was first seen
    zeros: bool = False
    tries: int = 0
    settles: int = -1
    gives_up: int = -1  # when zeros are handed on all the same
    again: int = -1

    def see(self, now: int, length: int, mtime: int, zeros: bool, failed: bool, waits: Waits, handed_on: Callable[[int, int], bool]) -> None:
        """Takes one observation in. ``handed_on`` tells whether a version of this path was handed on before."""
        if failed:
            if (length, mtime) == (self.length, self.mtime) and self.tries == 1 and self.again < 0:
                self.again = now + waits.retry
            return
        if (length, mtime) != (self.length, self.mtime):
            self.length, self.mtime, self.first, self.tries, self.again = length, mtime, now, 0, -1
            self.settles, self.gives_up = now + waits.settle, -1
            if handed_on(length, mtime):
                self.tries, self.settles = 2, -1
        self.zeros = zeros
        if self.tries == 0:
            self.gives_up = self.first + waits.zero_wait if zeros else -1
            if not zeros and self.settles < 0:
                self.settles = now  # it had settled, and its data has come

    def due(self, now: int) -> tuple[int, int] | None:
        """Takes the next thing out that falls due up to ``now``: (attempt, time) if the file is to be handed on then."""
        if 0 <= self.again <= now:
            at, self.again, self.tries = self.again, -1, 2
            return 2, at
        if self.tries == 0 and 0 <= self.settles <= now and not self.zeros:
            return self._handed_on(self.settles)
        if self.tries == 0 and 0 <= self.settles <= now:
            self.settles = -1
        if self.tries == 0 and 0 <= self.gives_up <= now:
            return self._handed_on(max(self.gives_up, self.first))
        return None

    def _handed_on(self, at: int) -> tuple[int, int]:
        self.tries, self.settles, self.gives_up = 1, -1, -1
        return 1, at

    def next(self) -> list[int]:
        """The times at which something may fall due."""
        return sorted({t for t in (self.settles if self.tries == 0 else -1, self.gives_up if self.tries == 0 else -1, self.again) if t >= 0})


_STATE = "length bigint, mtime bigint, first bigint, zeros boolean, tries int, settles bigint, gives_up bigint, again bigint"


class Watch(StatefulProcessor):
    """One ``File`` a path, with a timer for each time in ``next``."""

    def __init__(self, waits: Waits) -> None:
        self.waits = waits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("file", _STATE, self.waits.forget)
        self.done = handle.getMapState("done", "length bigint, mtime bigint", "at bigint", self.waits.forget)

    def close(self) -> None:
        pass

    def _load(self) -> File:
        return File(*self.state.get()) if self.state.exists() else File()

    def _save(self, key: Any, file: File, now: int) -> Iterator[pd.DataFrame]:
        out = []
        while (found := file.due(now)) is not None:
            out.append((key[0], file.length, file.mtime, *found))
            self.done.updateValue((file.length, file.mtime), (now,))
        self.state.update((file.length, file.mtime, file.first, file.zeros, file.tries, file.settles, file.gives_up, file.again))
        wanted, there = set(file.next()), {int(t) for t in self.handle.listTimers()}
        for t in there - wanted:
            self.handle.deleteTimer(t)
        for t in wanted - there:
            self.handle.registerTimer(t)
        if out:
            yield pd.DataFrame(out, columns=["path", "length", "mtime", "attempt", "ready_ms"])

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802
        now, file = timerValues.getCurrentProcessingTimeInMs(), self._load()
        frames = pd.concat(rows).sort_values(["at", "mtime", "length"], kind="stable")
        for r in frames.itertuples():
            file.see(now, int(r.length), int(r.mtime), bool(r.zeros), bool(r.failed), self.waits, lambda *v: self.done.containsKey(v))
        yield from self._save(key, file, now)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802
        yield from self._save(key, self._load(), timerValues.getCurrentProcessingTimeInMs())


def stateful(spark: SparkSession) -> SparkSession:
    """``spark``, told to keep state where timers and expiry are possible."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


def ready_stream(observed: DataFrame, waits: Waits = Waits()) -> DataFrame:
    """path, length, mtime, attempt, ready_ms of files to hand on, from a stream of observations; times are of processing."""
    stateful(observed.sparkSession)
    return observed.groupBy("path").transformWithStateInPandas(Watch(waits), READY, "append", "processingTime")


def ready(observed: DataFrame, waits: Waits = Waits()) -> DataFrame:
    """The same from a log of observations, whose ``at`` are the times; what is due after the last observation comes too.

    A path's observations are read in their order, one after the other; a task holds what is known of one path.
    """

    def replay(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path, file, done, out = None, File(), set(), []

        def until(end: float) -> None:
            while file.next() and file.next()[0] < end:
                now = file.next()[0]
                while (found := file.due(now)) is not None:
                    done.add((file.length, file.mtime))
                    out.append((path, file.length, file.mtime, *found))

        for t in frames:
            for r in t.itertuples():
                if r.path != path:
                    until(float("inf"))
                    path, file, done = r.path, File(), set()
                until(r.ms)
                file.see(r.ms, int(r.length), int(r.mtime), bool(r.zeros), bool(r.failed), waits, lambda *v: v in done)  # noqa: B023
            yield pd.DataFrame(out, columns=["path", "length", "mtime", "attempt", "ready_ms"])
            out.clear()
        until(float("inf"))
        yield pd.DataFrame(out, columns=["path", "length", "mtime", "attempt", "ready_ms"])

    rows = observed.where("path is not null").select("path", F.unix_millis("at").alias("ms"), "length", "mtime", "zeros", "failed")
    rows = rows.repartition("path").sortWithinPartitions("path", "ms", "mtime", "length")
    return rows.mapInPandas(replay, READY)
