"""State with a bounded life over a stream of bars: each series keeps its last bars, begins from a batch table, and is dropped when idle.

A series holds at most `keep` bars. What it held before the stream began is its initial state. A bar that comes more than `idle`
after the last one begins anew, whatever batch it falls in, and an event-time timer frees the state of a series that has been
silent for so long; so results are those of a batch over the same bars, with any cut into micro-batches and after any restart. Rows
of a series are sorted inside a batch; batches must be in order of time, and rows behind the watermark are dropped.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BARS = "symbol string, time timestamp, close double"
OUTPUT = "symbol string, time timestamp, close double, kept int, mean double, previous double"


def _plain(t) -> dt.datetime:
    """A time in UTC without a zone."""
    at = pd.Timestamp(t)
    return (at if at.tzinfo is None else at.tz_convert("UTC").tz_localize(None)).to_pydatetime()


class Recent(StatefulProcessor):
    """The last `keep` bars of a series, and what they say of each new one."""

    def __init__(self, keep: int, idle_seconds: int):
        self.keep, self.idle = keep, dt.timedelta(seconds=idle_seconds)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bars = handle.getListState("bars", "time timestamp, close double")

    def _held(self) -> list[tuple[dt.datetime, float]]:
        return [(_plain(t), x) for t, x in self.bars.get()] if self.bars.exists() else []

    def _store(self, held: list[tuple[dt.datetime, float]]) -> None:
        self.bars.put(held)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        last = held[-1][0].replace(tzinfo=dt.timezone.utc) + self.idle
        self.handle.registerTimer(int(last.timestamp() * 1000) + 1)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        held: list[tuple[dt.datetime, float]] = []
        rows = initialState.sort_values("time")
        for t, x in zip(rows["time"], rows["close"], strict=True):
            held = self._grown(held, _plain(t), float(x))
        if held:
            self._store(held)

    def _grown(self, held: list, t: dt.datetime, x: float) -> list:
        if held and t - held[-1][0] > self.idle:
            held = []
        return [*held, (t, x)][-self.keep :]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = pd.concat(list(rows), ignore_index=True).sort_values("time")  # one batch of one series
        held, out = self._held(), []
        for t, x in zip(new["time"], new["close"], strict=True):
            grown = self._grown(held, _plain(t), float(x))
            before = grown[-2][1] if len(grown) > 1 else None
            out.append((key[0], t, x, len(grown), sum(v for _, v in grown) / len(grown), before))
            held = grown
        self._store(held)
        yield pd.DataFrame(out, columns=["symbol", "time", "close", "kept", "mean", "previous"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.bars.clear()
        return iter([])

    def close(self) -> None:
        pass


def start(spark: SparkSession, source: str, path: str, checkpoint: str, before: DataFrame, keep: int, idle_seconds: int) -> None:
    """Process what is in the source's folder since the last call with the same checkpoint; batches go to folders of their numbers.

    before: bars (symbol, time, close) that the series begin with; it counts when the checkpoint is new.
    """
    store, old = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set(store, STORE)
    try:
        bars = spark.readStream.schema(BARS).parquet(source).withWatermark("time", "0 seconds")
        rows = bars.groupBy("symbol").transformWithStateInPandas(Recent(keep, idle_seconds), OUTPUT, "Append", "EventTime", initialState=before.groupBy("symbol"))

        def write(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{path}/n={number}")

        rows.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        if old is None:
            spark.conf.unset(store)
        else:
            spark.conf.set(store, old)
