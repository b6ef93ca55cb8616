"""Queries over sources and sinks: candles from a feed, and bars through files of each kind."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tidebar.plans import sqlparts as q
from tidebar.plans.shared import folder
from tidebar.sources import bars as src
from tidebar.sources import feed, files

c = F.col
QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {q.bars('5 minutes')} SELECT symbol, 'M5' AS timeframe, row_number() OVER (PARTITION BY symbol ORDER BY time DESC) - 1 AS position, time, open, high, low, close, volume FROM bars QUALIFY position BETWEEN 1 AND 3000")
def candle_feed(spark, d):
    """The last 3,000 closed candles of every symbol from a feed, a task for each 1,000; the feed refuses more than 300 at once, so chunks shrink."""
    at = folder(spark, "feed")
    bars = src.event_bars(spark, d, "5 minutes")
    feed.store(bars, at, "M5", 1000)
    symbols = [r[0] for r in bars.select("symbol").distinct().orderBy("symbol").collect()]  # instruments, not bars
    spark.dataSource.register(feed.Candles)
    options = {"feed": "tidebar.sources.feed:Stored", "arguments": json.dumps({"folder": at, "at_once": 300}), "symbols": ",".join(symbols), "timeframe": "M5", "count": "3000", "chunk": "1000"}
    return spark.read.format("candles").options(**options).load()


_BARS = f"WITH {q.bars()} SELECT symbol, 'H1' AS timeframe, time, open, high, low, close, volume FROM bars"


def _h1(spark, d):
    return src.conform(src.event_bars(spark, d)).withColumn("timeframe", F.lit("H1"))


@query(_BARS)
def csv_round_trip(spark, d):
    path = folder(spark, "csv")
    files.write_csv(_h1(spark, d), path)
    return src.read_bars(spark, path, "csv")


@query(_BARS)
def json_round_trip(spark, d):
    path = folder(spark, "json")
    files.append_jsonl(_h1(spark, d), path)
    return src.read_bars(spark, path, "json")


@query(f"{_BARS} WHERE symbol = (SELECT min(event_type) FROM events) AND volume >= 2")
def pushed_filters(spark, d):
    """Bars by symbol and timeframe in folders: the first two conditions prune folders, the third is pushed to the files."""
    path = folder(spark, "parquet")
    bars = _h1(spark, d)
    src.write_bars(bars, path)
    name = bars.agg(F.min("symbol")).first()[0] or ""  # one row
    return src.read_bars(spark, path).where((c("symbol") == name) & (c("timeframe") == "H1") & (c("volume") >= 2))
