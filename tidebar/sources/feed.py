"""Candles from a feed that gives bars by position: a data source of its own, read in chunks that shrink where the feed refuses.

A feed is any object with bars(symbol, timeframe, start, count): rows (time, open, high, low, close, volume) from position
`start` on (0 is the newest, perhaps still open, bar), or None where it refuses. It is named by its import path.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "symbol string, timeframe string, position long, time timestamp_ntz, open double, high double, low double, close double, volume long"
MOST = 5000


def chunks(feed, symbol: str, timeframe: str, start: int, count: int, most: int = MOST) -> Iterator[tuple[int, list[tuple]]]:
    """(position, rows) of each chunk; a refused one is asked for again by halves, a short one is the last."""
    at, end, size = start, start + count, most
    while at < end:
        asked = min(size, end - at)
        rows = feed.bars(symbol, timeframe, at, asked)
        while rows is None and asked > 1:
            asked //= 2
            rows = feed.bars(symbol, timeframe, at, asked)
        if not rows:
            return
        yield at, rows
        at += len(rows)
        if len(rows) < asked:
            return


class Stored:
    """A feed over candles that `store` wrote: a folder a symbol, a file a range of positions. It refuses more than `at_once` bars.

    Tasks read the files themselves, so the folder must be one that they reach by its path (a shared or mounted folder).
    """

    def __init__(self, folder: str, at_once: int = MOST):
        self.folder, self.at_once = folder.removeprefix("file://"), at_once

    def bars(self, symbol: str, timeframe: str, start: int, count: int):
        import pyarrow.compute as pc
        import pyarrow.dataset as ds

        if count > self.at_once:
            return None
        stored = ds.dataset(f"{self.folder}/timeframe={timeframe}/symbol={symbol}", format="parquet")
        rows = stored.to_table(filter=(pc.field("position") >= start) & (pc.field("position") < start + count)).sort_by("position")
        return list(zip(*(rows.column(n).to_pylist() for n in ("time", "open", "high", "low", "close", "volume")), strict=True))


def store(bars: DataFrame, folder: str, timeframe: str, chunk: int = MOST) -> None:
    """Write bars (symbol, time, ...) for Stored, by their position from the newest on, a file a symbol and chunk."""
    place = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("time"))) - 1
    rows = bars.withColumn("position", place.cast("long")).withColumn("timeframe", F.lit(timeframe))
    dealt = rows.repartition(F.col("symbol"), F.floor(F.col("position") / chunk)).sortWithinPartitions("symbol", "position")
    dealt.write.mode("overwrite").partitionBy("timeframe", "symbol").parquet(folder)


class _Chunk(InputPartition):
    def __init__(self, symbol: str, start: int, count: int):
        self.symbol, self.start, self.count = symbol, start, count


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        first, count, size = 0 if self.options.get("live", "false") == "true" else 1, int(self.options.get("count", str(MOST))), int(self.options.get("chunk", str(MOST)))
        return [_Chunk(s, first + at, min(size, count - at)) for s in self.options["symbols"].split(",") for at in range(0, count, size)]

    def read(self, partition: _Chunk):
        module, _, name = self.options["feed"].partition(":")
        feed = getattr(importlib.import_module(module), name)(**json.loads(self.options.get("arguments", "{}")))
        timeframe = self.options.get("timeframe", "M1")
        for at, rows in chunks(feed, partition.symbol, timeframe, partition.start, partition.count, int(self.options.get("chunk", str(MOST)))):
            for k, row in enumerate(rows):
                yield (partition.symbol, timeframe, at + k, *row)


class Candles(DataSource):
    """spark.read.format("candles"): options feed (module:class), arguments (JSON, for its constructor), symbols, timeframe, count, chunk
    (bars asked for at once; each chunk of a symbol is a task) and live (from the open bar on)."""

    @classmethod
    def name(cls) -> str:
        return "candles"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))
