"""Queries over bars and feature blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.operators import features
from tidebar.plans import sqlparts as q
from tidebar.sources import bars as src

c = F.col
QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(n, digits).alias(n) if t == "double" else c(n) for n, t in df.dtypes])


def base(spark, d: str, width: str = "1 hour") -> DataFrame:
    return features.base(src.event_bars(spark, d, width))


@query(f"WITH RECURSIVE {q.bars()} SELECT * FROM bars")
def bars_hourly(spark, d):
    return src.event_bars(spark, d)


@query("SELECT o_orderpriority AS symbol, time_bucket(INTERVAL '7 days', o_orderdate, TIMESTAMP '1970-01-01') AS time, arg_min(o_totalprice, (o_orderdate, o_orderkey)) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS close, count(*) AS volume FROM orders GROUP BY 1, 2")
def bars_weekly_priority(spark, d):
    t = src.table(spark, d, "orders")
    return src.bars_from_ticks(t, c("o_orderpriority"), c("o_orderdate"), c("o_totalprice"), "7 days", F.struct("o_orderdate", "o_orderkey"))


@query("""SELECT 'ALL' AS symbol, time_bucket(INTERVAL '1 day', l_shipdate) AS time, arg_min(l_extendedprice, (l_shipdate, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice)) AS open, max(l_extendedprice) AS high, min(l_extendedprice) AS low,
arg_max(l_extendedprice, (l_shipdate, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice)) AS close, sum(l_quantity)::BIGINT AS volume FROM lineitem GROUP BY 2""")
def bars_daily_lineitem(spark, d):
    t = src.table(spark, d, "lineitem")
    order = F.struct("l_shipdate", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    return src.bars_from_ticks(t, F.lit("ALL"), c("l_shipdate"), c("l_extendedprice"), "1 day", order, c("l_quantity"))


_RET = ", ".join(f"round(CASE WHEN lag(close, {k}) OVER {q.W} > 0 THEN ln(close / lag(close, {k}) OVER {q.W}) END, 6) AS ret_{k}" for k in (1, 3, 5))


@query(f"""WITH RECURSIVE {q.bars()}, s AS (SELECT *, nullif(high - low, 0) AS rng FROM bars)
SELECT symbol, time, {_RET}, round(rng / (close + 1e-9), 6) AS range_pct, round(abs(close - open) / (rng + 1e-9), 6) AS body_pct, round((close - open) / (rng + 1e-9), 6) AS body_signed_pct, round((close - low) / (rng + 1e-9), 6) AS close_pos,
round((high - greatest(open, close)) / (rng + 1e-9), 6) AS upper_wick_pct, round((least(open, close) - low) / (rng + 1e-9), 6) AS lower_wick_pct, sign(close - open)::INT AS body_direction FROM s""")
def price_blocks(spark, d):
    out = features.price_blocks(src.event_bars(spark, d))
    return rounded(out.drop("open", "high", "low", "close", "volume"))


@query(f"""WITH RECURSIVE {q.bars()}, {q.base()} SELECT symbol, time, {q.FLAGS}, {q.flag('close > pc', 'close_above_prev_close')}, {q.flag('close < pc', 'close_below_prev_close')}, {q.flag('high > ph', 'high_above_prev_high')}, {q.flag('low < pl', 'low_below_prev_low')},
{q.flag('high <= ph AND low >= pl', 'inside_previous_range')}, {q.flag('high > ph AND low < pl', 'outside_previous_range')}, {q.flag('high - low > ph - pl', 'range_expansion_vs_prev')}, round(CASE WHEN ph > pl THEN (high - low) / (ph - pl + 1e-9) END, 4) AS range_expansion_ratio,
round((close - ph) / (atr + 1e-9), 6) AS dist_prev_high_atr, round((close - pl) / (atr + 1e-9), 6) AS dist_prev_low_atr, round(CASE WHEN close > ph THEN (close - ph) / (atr + 1e-9) ELSE 0 END, 6) AS breakout_up_distance_atr, round(CASE WHEN close < pl THEN (pl - close) / (atr + 1e-9) ELSE 0 END, 6) AS breakout_down_distance_atr FROM b""")
def bar_flags(spark, d):
    out = features.bar_flags(base(spark, d)).withColumn("range_expansion_ratio", F.round(F.when(c("ph") > c("pl"), c("range_expansion_ratio")), 4))
    return rounded(out.drop("open", "high", "low", "close", "volume", "po", "ph", "pl", "pc", "row_idx", "tr", "atr"))


@query(f"""WITH RECURSIVE {q.bars()}, {q.base()}, s AS (SELECT *, lag(open, 2) OVER {q.W} AS o2, lag(close, 2) OVER {q.W} AS c2, high - low AS rng, abs(close - open) AS body, high - greatest(open, close) AS uw, least(open, close) - low AS lw,
CASE WHEN count(*) OVER {q.past(20)} >= 5 THEN 0.05 * quantile_cont(high - low, 0.5) OVER {q.past(20)} END AS near, avg(volume) OVER {q.past(10)} AS v10 FROM b)
SELECT symbol, time, {q.flag('lw > 2 * body AND uw < body', 'hammer')}, {q.flag('uw > 2 * body AND lw < body', 'inverted_hammer')}, {q.flag('pc < po AND close > open AND open <= pc AND close >= po', 'bullish_engulfing')}, {q.flag('pc > po AND close < open AND open >= pc AND close <= po', 'bearish_engulfing')},
{q.flag('body / nullif(rng, 0) < 0.1', 'doji')}, {q.flag('close > open AND uw / (rng + 1e-9) < 0.05 AND lw / (rng + 1e-9) < 0.05', 'bullish_marubozu')}, {q.flag('close < open AND uw / (rng + 1e-9) < 0.05 AND lw / (rng + 1e-9) < 0.05', 'bearish_marubozu')},
{q.flag('c2 < o2 AND abs(pc - po) < 0.35 * abs(c2 - o2) AND close > open AND close > (o2 + c2) / 2', 'morning_star')}, {q.flag('c2 > o2 AND abs(pc - po) < 0.35 * abs(c2 - o2) AND close < open AND close < (o2 + c2) / 2', 'evening_star')},
{q.flag('c2 > o2 AND pc > po AND close > open AND pc > c2 AND close > pc', 'three_white_soldiers')}, {q.flag('c2 < o2 AND pc < po AND close < open AND pc < c2 AND close < pc', 'three_black_crows')},
{q.flag('pc < po AND close > open AND open < pc AND close > (po + pc) / 2 AND close < po', 'piercing_line')}, {q.flag('pc > po AND close < open AND open > pc AND close < (po + pc) / 2 AND close > po', 'dark_cloud_cover')},
{q.flag('abs(high - ph) <= near', 'tweezer_tops')}, {q.flag('abs(low - pl) <= near', 'tweezer_bottoms')}, {q.flag('open > ph', 'gap_up')}, {q.flag('open < pl', 'gap_down')}, {q.flag('row_idx >= 10 AND volume > 2 * v10', 'volume_spike')} FROM s""")
def candle_patterns(spark, d):
    return features.candle_patterns(base(spark, d)).drop("open", "high", "low", "close", "volume", "po", "ph", "pl", "pc", "row_idx", "tr", "atr")


def _full(expr: str, n: int) -> str:
    return f"CASE WHEN row_idx >= {n} THEN {expr} END"


def _mid(n: int) -> str:
    return _full(f"(max(high) OVER {q.past(n)} + min(low) OVER {q.past(n)}) / 2", n)


_IND = f"""r0 AS (SELECT *, (high + low + close) / 3 AS tp, lag((high + low + close) / 3) OVER {q.W} AS ptp FROM b),
r1 AS (SELECT *, CASE WHEN tp > ptp THEN tp * volume ELSE 0 END AS up, CASE WHEN tp < ptp THEN tp * volume ELSE 0 END AS dn, abs(high - pl) AS vp, abs(low - ph) AS vm, CASE WHEN close > pc THEN volume WHEN close < pc THEN -volume ELSE 0 END AS ob FROM r0),
r AS (SELECT *, {', '.join(f"{_full(f'avg(close) OVER {q.past(k)}', k)} AS sma_{k}" for k in (10, 50, 200))}, {_full(f'avg(volume) OVER {q.past(10)}', 10)} AS volume_ma_10, {_full(f'avg(volume) OVER {q.past(20)}', 20)} AS volume_ma_20,
{_full(f'avg(close) OVER {q.past(20)}', 20)} AS bollinger_mid, {_full(f'avg(close) OVER {q.past(20)} + 2 * stddev_pop(close) OVER {q.past(20)}', 20)} AS bollinger_high, {_full(f'avg(close) OVER {q.past(20)} - 2 * stddev_pop(close) OVER {q.past(20)}', 20)} AS bollinger_low,
{_full(f'100 * (close - min(low) OVER {q.past(14)}) / nullif(max(high) OVER {q.past(14)} - min(low) OVER {q.past(14)}, 0)', 14)} AS stoch_k, {_full(f'-100 * (max(high) OVER {q.past(14)} - close) / nullif(max(high) OVER {q.past(14)} - min(low) OVER {q.past(14)}, 0)', 14)} AS williams_r,
100 * (close / nullif(lag(close, 12) OVER {q.W}, 0) - 1) AS roc_12, {_full(f'100 - 100 / (1 + sum(up) OVER {q.past(14)} / nullif(sum(dn) OVER {q.past(14)}, 0))', 15)} AS mfi_14,
{_full(f'sum(vp) OVER {q.past(14)} / nullif(sum(tr) OVER {q.past(14)}, 0)', 15)} AS vortex_plus, {_full(f'sum(vm) OVER {q.past(14)} / nullif(sum(tr) OVER {q.past(14)}, 0)', 15)} AS vortex_minus,
{_mid(9)} AS ichimoku_conversion, {_mid(26)} AS ichimoku_base, {_mid(52)} AS ichimoku_b, (sum(ob) OVER (PARTITION BY symbol ORDER BY time ROWS UNBOUNDED PRECEDING))::BIGINT AS obv, {_full(f'max(high) OVER {q.past(20)}', 20)} AS donchian_high20, {_full(f'min(low) OVER {q.past(20)}', 20)} AS donchian_low20 FROM r1)"""
_NAMES = ["sma_10", "sma_50", "sma_200", "volume_ma_10", "volume_ma_20", "bollinger_mid", "bollinger_high", "bollinger_low", "stoch_k", "williams_r", "roc_12", "mfi_14", "vortex_plus", "vortex_minus", "ichimoku_conversion", "ichimoku_base", "ichimoku_b", "donchian_high20", "donchian_low20"]


@query(f"WITH RECURSIVE {q.bars()}, {q.base()}, {_IND} SELECT symbol, time, {', '.join(f'round({n}, 6) AS {n}' for n in _NAMES)}, obv, round({_full(f'avg(stoch_k) OVER {q.past(3)}', 16)}, 6) AS stoch_d, round((ichimoku_conversion + ichimoku_base) / 2, 6) AS ichimoku_a FROM r")
def rolling_indicators(spark, d):
    return rounded(features.rolling_indicators(base(spark, d)).select("symbol", "time", *_NAMES, "obv", "stoch_d", "ichimoku_a"), 6)


@query(f"""WITH RECURSIVE {q.bars()}, {q.base()}, {_IND}, g AS (SELECT *, (bollinger_high - bollinger_low) / (close + 1e-9) AS bb_width, volume / (volume_ma_20 + 1e-9) AS vol_ratio FROM r),
z AS (SELECT *, CASE WHEN count(atr) OVER {q.past(200)} >= 200 THEN (atr - avg(atr) OVER {q.past(200)}) / (stddev_pop(atr) OVER {q.past(200)} + 1e-9) END AS atr_z, CASE WHEN count(bb_width) OVER {q.past(200)} >= 200 THEN (bb_width - avg(bb_width) OVER {q.past(200)}) / (stddev_pop(bb_width) OVER {q.past(200)} + 1e-9) END AS bb_width_z FROM g)
SELECT symbol, time, round(bb_width, 6) AS bb_width, round(vol_ratio, 6) AS vol_ratio, round(atr_z, 6) AS atr_z, round(bb_width_z, 6) AS bb_width_z, round({_full(f'avg((close > open)::INT) OVER {q.past(5)}', 5)}, 6) AS bull_ratio, round({_full(f'avg((close < open)::INT) OVER {q.past(5)}', 5)}, 6) AS bear_ratio,
{q.flag('vol_ratio >= 1.5', 'vol_spike_1p5')}, {q.flag('vol_ratio >= 2', 'vol_spike_2p0')}, {q.flag('atr_z < -1 AND bb_width_z < -1', 'compression_flag')}, {q.flag('atr_z > 1 OR bb_width_z > 1', 'expansion_flag')}, round((high - low) / (atr + 1e-9), 6) AS range_atr, round(abs(close - open) / (atr + 1e-9), 6) AS body_atr FROM z""")
def regimes(spark, d):
    out = features.regimes(features.rolling_indicators(base(spark, d)))
    return rounded(out.select("symbol", "time", "bb_width", "vol_ratio", "atr_z", "bb_width_z", "bull_ratio", "bear_ratio", "vol_spike_1p5", "vol_spike_2p0", "compression_flag", "expansion_flag", "range_atr", "body_atr"), 6)


_RUN = "(PARTITION BY symbol ORDER BY time ROWS UNBOUNDED PRECEDING)"


@query(f"""WITH RECURSIVE {q.bars()}, {q.base()}, s0 AS (SELECT *, CASE WHEN row_idx > 6 AND lag(high, 3) OVER {q.W} >= max(high) OVER {q.past(7)} THEN lag(high, 3) OVER {q.W} END AS swing_high, CASE WHEN row_idx > 6 AND lag(low, 3) OVER {q.W} <= min(low) OVER {q.past(7)} THEN lag(low, 3) OVER {q.W} END AS swing_low FROM b),
s1 AS (SELECT *, last_value(swing_high IGNORE NULLS) OVER {_RUN} AS last_swing_high, last_value(swing_low IGNORE NULLS) OVER {_RUN} AS last_swing_low FROM s0),
s2 AS (SELECT *, lag(last_swing_high) OVER {q.W} AS rh, lag(last_swing_low) OVER {q.W} AS rl, lag(high, 2) OVER {q.W} AS h2, lag(low, 2) OVER {q.W} AS l2 FROM s1),
s3 AS (SELECT *, {q.flag('close > rh AND pc <= rh', 'bos_up')}, {q.flag('close < rl AND pc >= rl', 'bos_dn')} FROM s2),
s4 AS (SELECT *, coalesce(last_value(CASE WHEN bos_up = 1 THEN 1 WHEN bos_dn = 1 THEN -1 END IGNORE NULLS) OVER {_RUN}, 0) AS structure_state FROM s3),
s5 AS (SELECT *, coalesce(lag(structure_state) OVER {q.W}, 0) AS prev FROM s4)
SELECT symbol, time, swing_high, swing_low, last_swing_high, last_swing_low, bos_up, bos_dn, structure_state::INT AS structure_state, {q.flag('bos_up = 1 AND prev = -1', 'choch_up')}, {q.flag('bos_dn = 1 AND prev = 1', 'choch_dn')}, {q.flag('high > ph AND close < ph', 'sweep_high')}, {q.flag('low < pl AND close > pl', 'sweep_low')},
{q.flag('high > rh AND close < rh', 'swing_sweep_high')}, {q.flag('low < rl AND close > rl', 'swing_sweep_low')} FROM s5""")
def structure(spark, d):
    return features.structure(base(spark, d)).drop("open", "high", "low", "close", "volume", "po", "ph", "pl", "pc", "row_idx", "tr", "atr")


_AT = "((time AT TIME ZONE 'UTC') AT TIME ZONE '{}')"
_LON, _NY, _BRT = (f"hour({_AT.format(z)})" for z in ("Europe/London", "America/New_York", "America/Sao_Paulo"))


@query(f"""WITH RECURSIVE {q.bars()}, s AS (SELECT *, {_LON}::INT AS hour_london, {_NY}::INT AS hour_ny, {_BRT}::INT AS hour_brt, minute({_AT.format('Europe/London')}) AS minute_london, minute({_AT.format('America/New_York')}) AS minute_ny, {_AT.format('America/Sao_Paulo')}::DATE AS date_brt FROM bars)
SELECT symbol, time, hour(time)::INT AS hour_utc, minute(time)::INT AS minute_utc, hour_brt, hour_london, hour_ny, (isodow(time) - 1)::INT AS day_of_week, date_brt, (hour_london < 8)::INT AS in_asia_session, (hour_london BETWEEN 8 AND 11)::INT AS in_london_session, (hour_ny BETWEEN 8 AND 16)::INT AS in_ny_session,
(hour_london BETWEEN 7 AND 9)::INT AS london_killzone, (hour_ny BETWEEN 8 AND 10)::INT AS ny_killzone, (hour_london = 8 AND minute_london = 0)::INT AS is_london_open_bar, (hour_ny = 8 AND minute_ny = 0)::INT AS is_ny_open_bar, CASE WHEN hour_ny BETWEEN 8 AND 16 THEN 'NEW_YORK' WHEN hour_london BETWEEN 8 AND 11 THEN 'LONDON' WHEN hour_london < 8 THEN 'ASIA' ELSE 'OFF_SESSION' END AS session_name,
max(high) OVER (PARTITION BY symbol, date_brt ORDER BY time ROWS UNBOUNDED PRECEDING) AS session_high, min(low) OVER (PARTITION BY symbol, date_brt ORDER BY time ROWS UNBOUNDED PRECEDING) AS session_low FROM s""")
def sessions(spark, d):
    return features.sessions(src.event_bars(spark, d)).drop("open", "high", "low", "close", "volume")


@query("SELECT * FROM (SELECT user_id, event_type, ts, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1)")
def keep_last(spark, d):
    return src.keep_last(src.table(spark, d, "events"), ["user_id", "event_type"], [c("ts"), c("event_id")]).select("user_id", "event_type", "ts", "value")


@query(f"WITH RECURSIVE {q.bars()}, {q.base()} SELECT symbol, time, level, round(price, 6) AS price, round(abs(close - price) / atr, 6) AS distance_atr FROM (SELECT symbol, time, close, atr, unnest(['PREV_HIGH', 'PREV_LOW', 'PREV_CLOSE']) AS level, unnest([ph, pl, pc]) AS price FROM b) WHERE price IS NOT NULL AND atr > 0")
def level_unpivot(spark, d):
    rows = base(spark, d).where("atr > 0").unpivot(["symbol", "time", "close", "atr"], [c("ph").alias("PREV_HIGH"), c("pl").alias("PREV_LOW"), c("pc").alias("PREV_CLOSE")], "level", "price").where("price IS NOT NULL")
    return rounded(rows.select("symbol", "time", "level", "price", (F.abs(c("close") - c("price")) / c("atr")).alias("distance_atr")))
