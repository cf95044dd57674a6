"""Sample-and-hold on a stream: each slot gets the latest update, also while nothing arrives."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The setting for the state store, and the one that stateful processors with timers need.
SETTING, STORE = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Seconds of a chunk of time at least; one holds at least HALOS times the greatest age.
CHUNK, HALOS = 3_600, 8

_HELD = "symbol string, ts timestamp, value double, seen timestamp"


@contextmanager
def store(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside have the state store that `held` needs."""
    before = spark.conf.get(SETTING)
    spark.conf.set(SETTING, STORE)
    try:
        yield
    finally:
        spark.conf.set(SETTING, before)


class Hold(StatefulProcessor):
    """State of a symbol and chunk of time: its last update and the next slot that it has to answer, in microseconds.

    The next update answers the slots up to its own time; a timer answers those that are left when the update has reached its greatest age.
    Only slots of the chunk are answered. Its updates are all that are at most `halo` before or after it, so what holds at its begin and
    what ends the last one is among them; when the watermark is past these, the state is cleared.
    """

    def __init__(self, step: int, max_age: int, width: int, halo: int):
        self.step, self.max_age, self.width, self.halo = (x * 1_000_000 for x in (step, max_age, width, halo))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "at long, value double, slot long")

    def _answered(self, key: tuple, at: np.ndarray, value: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pd.DataFrame:
        """Rows for the chunk's slots from start to before stop of each update."""
        symbol, begin = key[0], key[1] * self.width
        start, stop = np.maximum(start, -(-begin // self.step) * self.step), np.minimum(stop, begin + self.width)
        counts = np.maximum(0, -(-(stop - start) // self.step))
        nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        slots = np.repeat(start, counts) + nth * self.step
        time = lambda micros: pd.to_datetime(micros, unit="us")
        return pd.DataFrame({"symbol": symbol, "ts": time(slots), "value": np.repeat(value, counts), "seen": time(np.repeat(at, counts))})

    def _hold(self, at: int, value: float, slot: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.held.update((at, value, slot))
        # in milliseconds, after the last slot that the update may answer
        self.handle.registerTimer((at + self.max_age) // 1_000 + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values(["ts", "value"])
        at, value = new["ts"].astype("datetime64[us]").astype("int64").to_numpy(), new["value"].to_numpy(dtype=float)
        start = -(-at // self.step) * self.step
        if self.held.exists():
            last, before, slot = self.held.get()
            later = at >= last  # what is older than the held update comes too late
            at, value, start = (np.concatenate([[first], x[later]]) for first, x in ((last, at), (before, value), (slot, start)))
            at, start = at.astype(np.int64), start.astype(np.int64)
        ends = np.minimum(at + self.max_age + 1, np.append(at[1:], at[-1]))
        yield self._answered(key, at[:-1], value[:-1], start[:-1], ends[:-1])
        self._hold(int(at[-1]), float(value[-1]), int(start[-1]))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, value, slot = self.held.get()
        rows = self._answered(key, *(np.array([x]) for x in (at, value, slot, at + self.max_age + 1)))
        end = at + self.max_age + 1
        over = ((key[1] + 1) * self.width + self.halo) // 1_000 + 1
        if timerValues.getCurrentWatermarkInMs() >= over:
            self.held.clear()
        else:
            self.held.update((at, value, max(slot, -(-end // self.step) * self.step)))
            self.handle.registerTimer(over)
        yield rows

    def close(self) -> None:
        pass


def held(updates: DataFrame, step: int = 1, max_age: int = 10, lateness: str = "0 seconds") -> DataFrame:
    """(symbol, ts, value, seen) of a stream of updates (symbol, ts timestamp, value): a row per slot of `step` seconds that an update of at most `max_age` seconds is known for.

    Slots are whole multiples of `step` since the epoch. A slot is answered when the next update of its symbol has come or the watermark has passed the held one's age.
    A symbol is dealt into chunks of time, each with a state of its own; updates near an edge stand in both chunks.
    """
    # timers count in whole milliseconds: the next update is within the halo, or surely later than the timer
    width, halo = max(CHUNK, HALOS * max_age), max_age + 1
    chunk = lambda seconds: F.floor((F.unix_micros("ts") + seconds * 1_000_000) / (width * 1_000_000))
    marked = updates.select("symbol", "ts", "value").withWatermark("ts", lateness)
    dealt = marked.withColumn("chunk", F.explode(F.array_distinct(F.array(*map(chunk, (0, -halo, halo))))))
    return dealt.groupBy("symbol", "chunk").transformWithStateInPandas(Hold(step, max_age, width, halo), _HELD, "Append", "EventTime")
