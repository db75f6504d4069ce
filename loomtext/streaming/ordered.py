"""Streams folded in the order of event time, key by key, with state that expires.

Rows wait in a key's state until the watermark has passed them, so a fold sees them
in order however late they came (within the watermark's delay; later ones are
dropped). An event-time timer wakes a key when its earliest waiting row is due, and
again when its state has been idle for so long that it may go.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from loomtext.streaming.monitor import timed

#: Keeps the timers and lists that these operators need.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class Fold:
    """``step(state, row)`` gives the next state and the row to put out, or None. State is a
    tuple of ``state`` fields, None at first and once ``idle_ms`` have passed without a row;
    rows are tuples of the ``value`` fields, the first the time in microseconds."""

    step: Callable[[tuple | None, tuple], tuple[tuple, tuple | None]]
    value: str
    state: str
    out: str
    idle_ms: int


class _Processor(StatefulProcessor):
    def __init__(self, fold: Fold, names: list[str], outs: list[str]):
        self.fold, self.names, self.outs = fold, names, outs

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.fold.value)
        self.state = handle.getValueState("state", f"last long, {self.fold.state}")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for batch in rows:
            batch = batch[self.names]
            got = list(batch.itertuples(index=False, name=None))
            self.waiting.appendList(got)
            first = min([first, *(r[0] for r in got)] if first is not None else [r[0] for r in got])
        if first is not None:
            self.handle.registerTimer(_due(first))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(self.waiting.get()) if self.waiting.exists() else []
        ready = [r for r in rows if r[0] <= now]
        state, found = self.state.get() if self.state.exists() else None, []
        for row in ready:
            if state is not None and row[0] - state[0] > self.fold.idle_ms * 1000:
                state = None
            after, out = self.fold.step(None if state is None else tuple(state[1:]), row)
            state = (row[0], *after)
            if out is not None:
                found.append((*key, *out))
        if ready:
            rest = rows[len(ready) :]
            if rest:
                self.waiting.put(rest)
                self.handle.registerTimer(_due(rest[0][0]))
            else:
                self.waiting.clear()
            self.state.update(state)
            self.handle.registerTimer(_due(state[0]) + self.fold.idle_ms)
        elif state is not None and now - state[0] > self.fold.idle_ms * 1000 and not rows:
            self.state.clear()
        if found:
            yield pd.DataFrame(found, columns=self.outs)

    def close(self) -> None:
        pass


def _due(micros: int) -> int:
    """The first millisecond that isn't before a time."""
    return -(-int(micros) // 1000)


def folded(stream: DataFrame, key: str, time: str, columns: list[str], fold: Fold, delay: str) -> DataFrame:
    """The rows that a fold puts out: (key, out fields). ``columns`` follow the time in
    what it sees and settle the order of equal times. Rows without a time or a key are dropped."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    kind = dict(stream.dtypes)[key]
    rows = timed(stream, time).withWatermark(time, delay)
    rows = rows.select(key, time, F.unix_micros(F.col(time)).alias("at"), *columns).filter(F.col(key).isNotNull() & F.col(time).isNotNull())
    names = ["at", *columns]
    outs = [key, *(f.split()[0] for f in fold.out.split(", "))]
    return rows.groupBy(key).transformWithStateInPandas(_Processor(fold, names, outs), f"{key} {kind}, {fold.out}", "Append", "EventTime")


def first_seen(stream: DataFrame, key: str, time: str, id_col: str, idle_ms: int, delay: str) -> DataFrame:
    """(key, at, id) of each key's first row, and of its first after it was silent for more
    than ``idle_ms``; nothing is kept of keys that are silent."""
    step = lambda state, row: ((1,), row if state is None else None)
    return folded(stream, key, time, [id_col], Fold(step, f"at long, {id_col} long", "seen int", f"at long, {id_col} long", idle_ms), delay)


def early_stop(stream: DataFrame, key: str, time: str, id_col: str, value: str, delay: str, worse: float = 1.03, patience: int = 5, bad: int = 8, idle_ms: int = 10**12) -> DataFrame:
    """(key, stop_step): the step at which a series of losses should stop (H5): one ``worse``
    times the best so far or ``patience`` in a row without a better one, or two in a row
    once ``bad`` were no better. Told once, when the watermark passes that step."""

    def step(state, row):
        n, best, streak, poor, over = state or (0, float("inf"), 0, 0, 0)
        loss, n = row[2], n + 1
        if over:
            return (n, best, streak, poor, 1), None
        if loss < best:
            return (n, loss, 0, poor, 0), None
        streak, poor = streak + 1, poor + 1
        if loss > worse * best or streak >= patience or (poor >= bad and streak >= 2):
            return (n, best, streak, poor, 1), (n,)
        return (n, best, streak, poor, 0), None

    return folded(stream, key, time, [id_col, value], Fold(step, f"at long, {id_col} long, {value} double", "n long, best double, streak long, poor long, over long", "stop_step long", idle_ms), delay)


def run_to_end(out: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Runs a stream over everything that is there, into Parquet, and reads that."""
    query = out.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return out.sparkSession.read.schema(out.schema).parquet(path)
