"""Queries over recursions, path-dependent operators and streams."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.operators import features, levels, memory, sequential
from tidebar.plans import sqlparts as q
from tidebar.plans.bars_and_features import base, rounded
from tidebar.plans.shared import folder
from tidebar.sources import bars as src
from tidebar.streaming import live, recent

c = F.col
QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_SMOOTH = ("ema_20", "ema_50", "macd", "macd_signal", "macd_hist", "rsi_14", "plus_di_14", "minus_di_14", "adx_14")
_SAR = """sar AS (SELECT symbol, row_idx, true AS up, 0.02::DOUBLE AS speed, high AS extreme, low AS psar FROM b WHERE row_idx = 1
UNION ALL SELECT symbol, row_idx, CASE WHEN flip THEN NOT up ELSE up END, CASE WHEN flip THEN 0.02 WHEN more THEN least(0.2, speed + 0.02) ELSE speed END, CASE WHEN flip THEN CASE WHEN up THEN low ELSE high END WHEN more THEN CASE WHEN up THEN high ELSE low END ELSE extreme END, CASE WHEN flip THEN extreme ELSE p END
FROM (SELECT *, CASE WHEN up THEN low < p ELSE high > p END AS flip, CASE WHEN up THEN high > extreme ELSE low < extreme END AS more
FROM (SELECT n.symbol, n.row_idx, n.high, n.low, s.up, s.speed, s.extreme, CASE WHEN s.up THEN least(s.psar + s.speed * (s.extreme - s.psar), n.pl, coalesce(n.pl2, n.pl)) ELSE greatest(s.psar + s.speed * (s.extreme - s.psar), n.ph, coalesce(n.ph2, n.ph)) END AS p FROM sar s JOIN bb n ON n.symbol = s.symbol AND n.row_idx = s.row_idx + 1)))"""


@query(f"WITH RECURSIVE {q.bars()}, {q.base()}, {q.smoothed()}, bb AS MATERIALIZED (SELECT *, lag(low, 2) OVER {q.W} AS pl2, lag(high, 2) OVER {q.W} AS ph2 FROM b), {_SAR} SELECT symbol, m.time, {', '.join(f'round({n}, 5) AS {n}' for n in _SMOOTH)}, round(atr, 6) AS atr_14, round(psar, 6) AS psar FROM m JOIN sar USING (symbol, row_idx)")
def recursive_indicators(spark, d):
    b = base(spark, d)
    out = features.smoothed(b).join(sequential.with_sar(b), ["symbol", "time"])
    return out.select("symbol", "time", *(F.round(n, 5).alias(n) for n in _SMOOTH), F.round("atr", 6).alias("atr_14"), F.round("psar", 6).alias("psar"))


def _remembered(spark, d) -> DataFrame:
    """Bars with all that the memory of levels reads; the energy is a stand-in of range and volume."""
    b = features.regimes(features.rolling_indicators(base(spark, d)))
    b = features.structure(features.bar_flags(b))
    energy = F.least(F.lit(100.0), 40 * F.coalesce("range_atr", F.lit(0.0)) + 20 * F.coalesce("vol_ratio", F.lit(0.0)))
    return b.withColumn("energy_score", energy)


@query()
def level_memory(spark, d):
    """No SQL: a state machine of two sides that share a counter; tests hold it against scripted bars."""
    return rounded(memory.level_memory(_remembered(spark, d)))


def _with_memory(spark, d) -> DataFrame:
    b = _remembered(spark, d).select("symbol", "time", "row_idx", "breakout_up", "breakout_down", "false_breakout_up", "false_breakout_down", "sweep_high", "sweep_low", *(n for n in ("high", "low", "close", "atr", "energy_score", "range_atr")))
    b = b.join(memory.level_memory(b), ["symbol", "time"])
    return memory.conditions(memory.failures(b))


@query()
def failure_episodes(spark, d):
    """No SQL of its own, as it stands on level_memory; a test repeats it in plain Python."""
    return _with_memory(spark, d).select("symbol", "time", "failure_episode_start", "failure_episode_side", "failure_episode_id", "failures_on_current_level", "bars_since_level_failure", "failure_memory_bucket")


@query()
def memory_conditions(spark, d):
    return _with_memory(spark, d).select("symbol", "time", "memory_condition", "attempt_bucket", "bars_since_breakout", "bars_since_false_break", "bars_since_sweep", "since_breakout_bucket", "since_false_break_bucket", "since_sweep_bucket", "since_level_failure_bucket", "breakout_episodes_12", "breakout_episodes_24", "breakout_episodes_48", "recent_failure_count_24", "attempts_since_false_break", "attempts_since_sweep", "attempts_since_level_failure")


@query(f"WITH {q.bars()} SELECT * FROM bars")
def stream_live_bars(spark, d):
    schema = src.table(spark, d, "events").schema
    # A file source reads folders: one table's file, or the folder of its parts.
    stream = live.ticks(spark, f"{d}/events.parquet*", schema)
    at = folder(spark, "live")
    out = live.run_once(live.live_bars(stream), f"{at}/bars", f"{at}/checkpoint")
    return out.select("symbol", c("time").cast("timestamp_ntz").alias("time"), "open", "high", "low", "close", "volume")


@query(f"WITH {q.bars()}, n AS (SELECT max(ts) AS now FROM events), z AS (SELECT symbol, time, open, high, low, close, volume, now, row_number() OVER (PARTITION BY symbol ORDER BY time DESC) AS k FROM bars, n) SELECT symbol, time, open, high, low, close, volume, (now < time + INTERVAL '1 hour')::INT AS is_live_bar, CASE WHEN epoch(now)::BIGINT - epoch(time)::BIGINT <= 1800 THEN 'FRESH' ELSE 'STALE' END AS freshness FROM z WHERE k = 1")
def stream_in_progress(spark, d):
    """The newest bar of each symbol from the stream, whether it still runs, and how old it is."""
    bars = stream_live_bars(spark, d).join(F.broadcast(src.table(spark, d, "events").agg(F.max("ts").alias("now"))))  # one row
    marked = levels.mark_live(bars, c("now"), 3600)
    return src.keep_last(marked, ["symbol"], [c("time")]).select("symbol", "time", "open", "high", "low", "close", "volume", "is_live_bar", live.freshness(c("time"), c("now")).alias("freshness"))


@query()
def stream_level_memory(spark, d):
    """The memory of levels over a stream of bars, its state kept by symbol; equals level_memory."""
    at = folder(spark, "memory")
    _remembered(spark, d).select(*memory.INPUT).write.parquet(f"{at}/in")
    return rounded(live.remembered(spark, f"{at}/in", f"{at}/out", f"{at}/checkpoint"))


@query(f"WITH {q.bars()} SELECT symbol, time, close, volume, avg(close) OVER (PARTITION BY symbol ORDER BY epoch_us(time) RANGE BETWEEN 21600000000 PRECEDING AND CURRENT ROW) AS mean_6h FROM bars".replace("avg(close)", "round(avg(close)").replace("CURRENT ROW) AS", "CURRENT ROW), 6) AS"))
def time_range_mean(spark, d):
    """A frame by time, not by rows: the mean of the last six hours, gaps or not."""
    from pyspark.sql import Window

    b = src.event_bars(spark, d).withColumn("_us", F.unix_micros(c("time").cast("timestamp")))
    w = Window.partitionBy("symbol").orderBy("_us").rangeBetween(-6 * 3600 * 1_000_000, 0)
    return b.select("symbol", "time", "close", "volume", F.round(F.avg("close").over(w), 6).alias("mean_6h"))


#: Bars that a series keeps in the stream, and the silence in seconds after which it begins anew.
KEEP, IDLE = 20, 3 * 3600


@query(f"""WITH {q.bars()}, g AS (SELECT *, sum((time - lag_time > INTERVAL '{IDLE} seconds')::INT) OVER (PARTITION BY symbol ORDER BY time ROWS UNBOUNDED PRECEDING) AS life FROM (SELECT *, coalesce(lag(time) OVER {q.W}, time) AS lag_time FROM bars)),
k AS (SELECT symbol, time, close, least({KEEP}, row_number() OVER w)::INT AS kept, avg(close) OVER (PARTITION BY symbol, life ORDER BY time ROWS BETWEEN {KEEP - 1} PRECEDING AND CURRENT ROW) AS mean, lag(close) OVER w AS previous FROM g WINDOW w AS (PARTITION BY symbol, life ORDER BY time)),
e AS (SELECT min(time) + (max(time) - min(time)) * 0.25 AS first FROM bars) SELECT symbol, time, close, kept, round(mean, 6) AS mean, previous FROM k, e WHERE time >= first""")
def stream_recent_bars(spark, d):
    """The last bars of each symbol over a stream that begins from a batch table and is started three times."""
    at = folder(spark, "recent")
    b = src.event_bars(spark, d).select("symbol", c("time").cast("timestamp").alias("time"), "close")
    low, high = b.agg(F.min("time"), F.max("time")).first()
    if low is None:
        return spark.createDataFrame([], "symbol string, time timestamp_ntz, close double, kept int, mean double, previous double")
    cuts = [low + (high - low) * x for x in (0.25, 0.5, 0.8)]
    edges = [F.lit(x) for x in cuts]
    parts = [b.where((c("time") >= a) & (c("time") < z if z is not None else F.lit(True))) for a, z in zip(edges, [*edges[1:], None], strict=True)]
    for part in parts:
        part.write.mode("append").parquet(f"{at}/in")
        recent.start(spark, f"{at}/in", f"{at}/out", f"{at}/checkpoint", b.where(c("time") < edges[0]), KEEP, IDLE)
    out = spark.read.schema(recent.OUTPUT).parquet(f"{at}/out")
    return rounded(out.select("symbol", c("time").cast("timestamp_ntz").alias("time"), "close", "kept", "mean", "previous"))
