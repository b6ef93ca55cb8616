"""Queries over the blocks of operators.levels."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebar.operators import features, levels
from tidebar.plans import sqlparts as q
from tidebar.plans.bars_and_features import _IND, base, rounded
from tidebar.sources import bars as src

c = F.col
QUERIES, SQL = {}, {}
HOUR = 3600


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_B = f"WITH RECURSIVE {q.bars()}, {q.base()}"
_RUN = "(PARTITION BY symbol ORDER BY time ROWS UNBOUNDED PRECEDING)"


def _r(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


def _last(x: str) -> str:
    return f"last_value({x} IGNORE NULLS) OVER {_RUN}"


_SPREAD = "WITH bars AS (SELECT event_type AS symbol, time_bucket(INTERVAL '1 hour', ts) AS time, arg_max(value, event_id) AS close, arg_max((user_id % 7) / 100.0::DOUBLE, event_id) AS spread FROM events GROUP BY 1, 2)"


@query(f"{_SPREAD}, p AS (SELECT *, spread / (nullif(close, 0) + 1e-9) AS spread_pct FROM bars) SELECT symbol, time, {_r('spread_pct')}, round(CASE WHEN count(spread_pct) OVER {q.past(200)} >= 200 THEN (spread_pct - avg(spread_pct) OVER {q.past(200)}) / (stddev_pop(spread_pct) OVER {q.past(200)} + 1e-9) END, 4) AS spread_z FROM p")
def spread_block(spark, d):
    bars = src.bars_from_ticks(src.table(spark, d, "events"), c("event_type"), c("ts"), c("value"), "1 hour", c("event_id"), spread=(c("user_id") % 7) / 100)
    out = levels.spread(bars).select("symbol", "time", "spread_pct", "spread_z")
    return out.select("symbol", "time", F.round("spread_pct", 6).alias("spread_pct"), F.round("spread_z", 4).alias("spread_z"))


_SM = f"{_B}, {q.smoothed()}"


@query(f"{_SM} SELECT symbol, time, round(ln(ema_20 / lag(ema_20, 5) OVER {q.W}), 6) AS ema20_slope_5, round(ln(ema_50 / lag(ema_50, 5) OVER {q.W}), 6) AS ema50_slope_5, {q.flag('ema_20 > ema_50', 'ema20_above_ema50')}, {q.flag(f'ema_20 > ema_50 AND lag(ema_20) OVER {q.W} <= lag(ema_50) OVER {q.W}', 'ema_cross_up')}, {q.flag(f'ema_20 < ema_50 AND lag(ema_20) OVER {q.W} >= lag(ema_50) OVER {q.W}', 'ema_cross_dn')} FROM m")
def ema_trend(spark, d):
    return rounded(levels.ema_trend(features.smoothed(base(spark, d))).select("symbol", "time", "ema20_slope_5", "ema50_slope_5", "ema20_above_ema50", "ema_cross_up", "ema_cross_dn"))


_IND_M = _IND.replace("FROM b)", "FROM m)", 1)
_DIST = ", ".join(f"round((close - {x}) / (nullif(atr, 0) + 1e-9), 6) AS dist_{n}_atr" for n, x in levels.DISTANCES.items())


def _all(spark, d):
    return levels.distances(features.rolling_indicators(features.smoothed(base(spark, d))))


@query(f"{_SM}, {_IND_M} SELECT symbol, time, {_DIST} FROM r")
def atr_distances(spark, d):
    return rounded(_all(spark, d).select("symbol", "time", *(f"dist_{n}_atr" for n in levels.DISTANCES)))


_SWINGS = f"""w0 AS (SELECT *, CASE WHEN row_idx > 6 AND lag(high, 3) OVER {q.W} >= max(high) OVER {q.past(7)} THEN lag(high, 3) OVER {q.W} END AS swing_high, CASE WHEN row_idx > 6 AND lag(low, 3) OVER {q.W} <= min(low) OVER {q.past(7)} THEN lag(low, 3) OVER {q.W} END AS swing_low FROM b),
w1 AS (SELECT *, {_last('swing_high')} AS last_swing_high, {_last('swing_low')} AS last_swing_low FROM w0),
w2 AS (SELECT *, lag(last_swing_high) OVER {q.W} AS rh, lag(last_swing_low) OVER {q.W} AS rl FROM w1)"""
_ZIG = f"""{_SWINGS}, z0 AS (SELECT *, {q.flag('abs(swing_high - rl) / (abs(rl) + 1e-9) >= 0.005', 'zigzag_high_confirmed')}, {q.flag('abs(rh - swing_low) / (abs(swing_low) + 1e-9) >= 0.005', 'zigzag_low_confirmed')} FROM w2),
z1 AS (SELECT *, CASE WHEN zigzag_high_confirmed = 1 THEN swing_high END AS zigzag_high, CASE WHEN zigzag_low_confirmed = 1 THEN swing_low END AS zigzag_low, CASE WHEN zigzag_high_confirmed = 1 THEN row_idx - 4 END AS zh, CASE WHEN zigzag_low_confirmed = 1 THEN row_idx - 4 END AS zl FROM z0),
z AS (SELECT *, coalesce(zh, -1)::INT AS zigzag_high_source_idx, coalesce(zl, -1)::INT AS zigzag_low_source_idx, {_last('zigzag_high')} AS last_zigzag_high, {_last('zigzag_low')} AS last_zigzag_low, {_last('zh')}::INT AS last_zigzag_high_idx, {_last('zl')}::INT AS last_zigzag_low_idx FROM z1)"""
_ZIG_NAMES = [f"{p}zigzag_{s}{e}" for s in ("high", "low") for p, e in (("", ""), ("", "_confirmed"), ("", "_source_idx"), ("last_", ""), ("last_", "_idx"))]


@query(f"{_B}, {_ZIG} SELECT symbol, time, {', '.join(_ZIG_NAMES)} FROM z")
def zigzag(spark, d):
    return levels.zigzag(features.structure(base(spark, d))).select("symbol", "time", *_ZIG_NAMES)


_GAP = {"up": ("lag(high, 2) OVER " + q.W, "low"), "dn": ("high", "lag(low, 2) OVER " + q.W)}


@query(f"{_B}, g0 AS (SELECT symbol, time, atr, {', '.join(f'{lo} AS {s}_lo, {hi} AS {s}_hi' for s, (lo, hi) in _GAP.items())} FROM b), g1 AS (SELECT *, {', '.join(f'CASE WHEN {s}_lo IS NOT NULL AND {s}_hi IS NOT NULL THEN greatest({s}_hi - {s}_lo, 0) END AS {s}_size' for s in _GAP)} FROM g0), g AS (SELECT *, {', '.join(f'{s}_size / (nullif(atr, 0) + 1e-9) AS {s}_atr' for s in _GAP)} FROM g1) SELECT symbol, time, " + ", ".join(f"{q.flag(f'{s}_atr >= 0.1', f'fvg_{s}')}, round(CASE WHEN {s}_atr >= 0.1 THEN {s}_lo END, 6) AS fvg_{s}_low, round(CASE WHEN {s}_atr >= 0.1 THEN {s}_hi END, 6) AS fvg_{s}_high, round(CASE WHEN {s}_atr >= 0.1 THEN {s}_size ELSE 0 END, 6) AS fvg_{s}_size, round(CASE WHEN {s}_atr >= 0.1 THEN {s}_atr ELSE 0 END, 6) AS fvg_{s}_size_atr" for s in _GAP) + " FROM g")
def gap_zones(spark, d):
    names = [f"fvg_{s}{e}" for s in _GAP for e in ("", "_low", "_high", "_size", "_size_atr")]
    return rounded(levels.gap_zones(base(spark, d)).select("symbol", "time", *names))


_OB = f"""{_SWINGS}, o0 AS (SELECT *, {q.flag('close > rh AND pc <= rh AND close > open AND abs(close - open) / (nullif(atr, 0) + 1e-9) >= 0.8', 'bull_ob_candidate_event')}, {q.flag('close < rl AND pc >= rl AND close < open AND abs(close - open) / (nullif(atr, 0) + 1e-9) >= 0.8', 'bear_ob_candidate_event')} FROM w2),
o1 AS (SELECT *, {', '.join(f"{_last(f'CASE WHEN {s}_ob_candidate_event = 1 THEN {x} END')} AS {s}_ob_candidate_{n}" for s in ('bull', 'bear') for n, x in (('low', 'pl'), ('high', 'ph')))} FROM o0),
o2 AS (SELECT *, {', '.join(q.flag(f'low <= {s}_ob_candidate_high AND high >= {s}_ob_candidate_low', f'in_{s}_ob_candidate') for s in ('bull', 'bear'))} FROM o1),
o AS (SELECT *, {q.flag('in_bull_ob_candidate = 1 AND close < bull_ob_candidate_low', 'mitigated_bull_ob_candidate')}, {q.flag('in_bear_ob_candidate = 1 AND close > bear_ob_candidate_high', 'mitigated_bear_ob_candidate')} FROM o2)"""
_OB_NAMES = [f"{p}{s}_ob_candidate{e}" for s in ("bull", "bear") for p, e in (("", "_event"), ("", "_low"), ("", "_high"), ("in_", ""), ("mitigated_", ""))]


@query(f"{_B}, {_OB} SELECT symbol, time, {', '.join(_OB_NAMES)} FROM o")
def order_blocks(spark, d):
    return levels.order_blocks(features.structure(base(spark, d))).select("symbol", "time", *_OB_NAMES)


_FIB_LEVELS = {f"fib_{k}_retr": -k / 1000 for k in levels.RETRACEMENTS} | {f"fib_{k}_ext": k / 1000 - 1 for k in levels.EXTENSIONS}
_FIB = f"""{_ZIG}, f0 AS (SELECT *, CASE WHEN last_zigzag_low_idx < last_zigzag_high_idx THEN 1 WHEN last_zigzag_high_idx < last_zigzag_low_idx THEN -1 ELSE 0 END AS fib_direction, nullif(abs(last_zigzag_high - last_zigzag_low), 0) AS rg FROM z),
f AS (SELECT *, {', '.join(f'CASE fib_direction WHEN 1 THEN last_zigzag_high + ({x!r}::DOUBLE) * rg WHEN -1 THEN last_zigzag_low - ({x!r}::DOUBLE) * rg END AS {n}' for n, x in _FIB_LEVELS.items())} FROM f0)"""


@query(f"{_B}, {_FIB} SELECT symbol, time, fib_direction, {_r(*_FIB_LEVELS)}, {', '.join(f'round((close - fib_{k}_retr) / (nullif(atr, 0) + 1e-9), 6) AS dist_fib{k}_atr' for k in levels.RETRACEMENTS)} FROM f")
def fibonacci(spark, d):
    return rounded(levels.fibonacci(levels.zigzag(features.structure(base(spark, d)))).select("symbol", "time", "fib_direction", *_FIB_LEVELS, *(f"dist_fib{k}_atr" for k in levels.RETRACEMENTS)))


_Z = f"""zg AS (SELECT *, (bollinger_high - bollinger_low) / (close + 1e-9) AS bb_width, volume / (volume_ma_20 + 1e-9) AS vol_ratio, (close - sma_200) / (nullif(atr, 0) + 1e-9) AS dist_sma200_atr FROM r),
y AS (SELECT *, CASE WHEN count(atr) OVER {q.past(200)} >= 200 THEN (atr - avg(atr) OVER {q.past(200)}) / (stddev_pop(atr) OVER {q.past(200)} + 1e-9) END AS atr_z, CASE WHEN count(bb_width) OVER {q.past(200)} >= 200 THEN (bb_width - avg(bb_width) OVER {q.past(200)}) / (stddev_pop(bb_width) OVER {q.past(200)} + 1e-9) END AS bb_width_z FROM zg)"""


@query(f"{_SM}, {_IND_M}, {_Z} SELECT symbol, time, row_idx - 1 AS bar_idx, (row_idx <= 250)::INT AS is_warmup, (row_idx > 250 AND atr_z IS NOT NULL AND bb_width_z IS NOT NULL AND dist_sma200_atr IS NOT NULL AND vol_ratio IS NOT NULL)::INT AS ready_for_train, (atr IS NOT NULL AND ema_20 IS NOT NULL AND ema_50 IS NOT NULL AND vol_ratio IS NOT NULL)::INT AS ready_for_realtime FROM y")
def readiness(spark, d):
    out = levels.readiness(features.regimes(_all(spark, d)))
    return out.select("symbol", "time", c("bar_idx").cast("long").alias("bar_idx"), "is_warmup", "ready_for_train", "ready_for_realtime")


def _now(spark, d):
    """The time of the newest tick, as one row."""
    return src.table(spark, d, "events").agg(F.max("ts").alias("now"))


_LIVE = f"""n AS (SELECT max(ts) AS now FROM events), l0 AS (SELECT b.*, now, (lead(time) OVER {q.W} IS NULL AND now < time + INTERVAL '1 hour')::INT AS is_live_bar, avg(volume) OVER (PARTITION BY symbol ORDER BY time ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS usual FROM b, n),
l1 AS (SELECT *, CASE WHEN is_live_bar = 1 THEN least(1, greatest(0.01, (epoch_us(now) - epoch_us(time)) / 1e6 / 3600)) END AS e FROM l0)"""


@query(f"""{_B}, {_LIVE} SELECT symbol, time, is_live_bar, round(e, 6) AS elapsed_bar_ratio, round(usual * e, 6) AS expected_volume_at_elapsed, round(volume / nullif(usual * e, 0), 6) AS volume_pace_ratio, round(volume / e, 6) AS projected_final_volume, round(volume / e / nullif(usual, 0), 6) AS projected_volume_ratio_20,
round(CASE WHEN is_live_bar = 1 AND high > low THEN (close - low) / (high - low) END, 6) AS live_price_position, round(CASE WHEN is_live_bar = 1 AND atr > 0 THEN (high - low) / atr END, 6) AS live_range_atr, round(CASE WHEN is_live_bar = 1 AND atr > 0 THEN abs(close - open) / atr END, 6) AS live_body_atr,
CASE WHEN is_live_bar = 0 THEN 'NOT_LIVE' WHEN high > ph AND close <= ph THEN 'FALSE_BREAKOUT_UP' WHEN low < pl AND close >= pl THEN 'FALSE_BREAKOUT_DOWN' WHEN high > ph AND low < pl THEN 'OUTSIDE_RANGE' WHEN high > ph THEN 'BREAKOUT_UP_LIVE' WHEN low < pl THEN 'BREAKOUT_DOWN_LIVE' WHEN high <= ph AND low >= pl AND volume / e / nullif(usual, 0) < 0.8 THEN 'INSIDE_RANGE_LOW_PARTICIPATION' WHEN high <= ph AND low >= pl THEN 'INSIDE_RANGE' ELSE 'LIVE_RANGE_DEVELOPING' END AS live_bar_classification FROM l1""")
def live_bar(spark, d):
    b = features.bar_flags(base(spark, d)).join(F.broadcast(_now(spark, d)))  # one row
    out = levels.live_context(levels.mark_live(b, c("now"), HOUR), c("now"), HOUR)
    return rounded(out.select("symbol", "time", "is_live_bar", "elapsed_bar_ratio", "expected_volume_at_elapsed", "volume_pace_ratio", "projected_final_volume", "projected_volume_ratio_20", "live_price_position", "live_range_atr", "live_body_atr", "live_bar_classification"))


@query(f"{_B}, {_LIVE} SELECT symbol, time, open, high, low, close, volume FROM l0 WHERE is_live_bar = 0")
def closed_bars(spark, d):
    b = src.event_bars(spark, d).join(F.broadcast(_now(spark, d)))  # one row
    return src.drop_live(levels.mark_live(b, c("now"), HOUR)).select("symbol", "time", "open", "high", "low", "close", "volume")


_ASM = ["sma_50", "ema_20", "bollinger_high", "ichimoku_a", "last_swing_high", "fib_500_retr", "bull_ob_candidate_low"]


@query(f"{_SM}, {_IND_M}, {_SWINGS.replace('FROM b)', 'FROM r)', 1)}, {_ZIG.partition('z0 AS')[1]}{_ZIG.partition('z0 AS')[2]}, {_FIB.partition('f0 AS')[1]}{_FIB.partition('f0 AS')[2]}, {_OB.partition('o0 AS')[1]}{_OB.partition('o0 AS')[2].replace('FROM w2)', 'FROM f)', 1)}, x AS (SELECT *, (ichimoku_conversion + ichimoku_base) / 2 AS ichimoku_a FROM o) SELECT symbol, time, {', '.join(f'round({_last(n)}, 6) AS {n}' for n in _ASM)}, round(mfi_14, 6) AS mfi_14, fib_direction, bull_ob_candidate_event FROM x")
def post_assembly(spark, d):
    b = levels.order_blocks(levels.fibonacci(levels.zigzag(features.structure(features.rolling_indicators(features.smoothed(base(spark, d)))))))
    return rounded(levels.assembled(b, ("bull_ob_candidate_event",)).select("symbol", "time", *_ASM, "mfi_14", "fib_direction", "bull_ob_candidate_event"))


_DIR = f"""{_SWINGS.replace('FROM b)', 'FROM y)', 1)}, d0 AS (SELECT *, CASE WHEN close > rh AND pc <= rh THEN 1 WHEN close < rl AND pc >= rl THEN -1 END AS bos FROM w2),
d1 AS (SELECT *, coalesce({_last('bos')}, 0) AS state, (row_idx > 250 AND atr_z IS NOT NULL AND bb_width_z IS NOT NULL AND dist_sma200_atr IS NOT NULL AND vol_ratio IS NOT NULL) AS ready, (lead(time) OVER {q.W} IS NULL AND (SELECT max(ts) FROM events) < time + INTERVAL '1 hour') AS live, coalesce(atr_z < -1 AND bb_width_z < -1, false) AS squeeze, coalesce(atr_z > 1 OR bb_width_z > 1, false) AS wide,
hour(((time AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York')) BETWEEN 8 AND 10 AS nyk, hour(((time AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/London')) BETWEEN 7 AND 9 AS lok, lead(close) OVER {q.W} AS entry, max(row_idx) OVER (PARTITION BY symbol) AS n FROM d0),
d2 AS (SELECT *, CASE WHEN NOT ready OR live THEN 0 WHEN state <> 0 THEN state WHEN ema_20 > ema_50 THEN 1 ELSE -1 END AS dir_signal, CASE WHEN wide AND nyk THEN [1.5, 1.0, 12] WHEN wide AND (nyk OR lok) THEN [1.2, 0.8, 10] WHEN squeeze THEN [0.8, 0.6, 6] ELSE [0.9, 0.7, 8] END::DOUBLE[] AS p FROM d1),
d3 AS (SELECT *, least(n, row_idx + 1 + p[3]::BIGINT) AS last_idx FROM d2),
h AS (SELECT a.symbol, a.row_idx, x.row_idx AS k, CASE WHEN a.dir_signal > 0 THEN x.high >= a.entry + a.p[1] * a.atr ELSE x.low <= a.entry - a.p[1] * a.atr END AS won, CASE WHEN a.dir_signal > 0 THEN x.low <= a.entry - a.p[2] * a.atr ELSE x.high >= a.entry + a.p[2] * a.atr END AS lost FROM d3 a JOIN d3 x ON x.symbol = a.symbol AND x.row_idx BETWEEN a.row_idx + 1 AND a.last_idx AND NOT x.live WHERE a.dir_signal <> 0 AND a.atr > 0),
f AS (SELECT symbol, row_idx, arg_min(CASE WHEN lost THEN 'SL' ELSE 'TP' END, k) AS kind, min(k) AS k FROM h WHERE won OR lost GROUP BY ALL),
t AS (SELECT d3.symbol, d3.time, dir_signal, p, CASE WHEN NOT coalesce(dir_signal <> 0 AND d3.atr > 0 AND entry IS NOT NULL, false) THEN 'NO_TRADE' ELSE coalesce(f.kind, 'TIMEOUT') END AS tb_exit_type, f.k, last_idx, dir_signal * (e.close - entry) / d3.atr AS late FROM d3 LEFT JOIN f USING (symbol, row_idx) LEFT JOIN (SELECT symbol, row_idx AS last_idx, close FROM d3) e USING (symbol, last_idx)),
u AS (SELECT *, CASE tb_exit_type WHEN 'TP' THEN p[1] WHEN 'SL' THEN -p[2] WHEN 'TIMEOUT' THEN late END AS r FROM t)"""


@query(f"{_SM}, {_IND_M}, {_Z}, {_DIR} SELECT symbol, time, dir_signal, tb_exit_type, CASE tb_exit_type WHEN 'TP' THEN 1 WHEN 'SL' THEN -1 ELSE 0 END AS tb_y, CASE tb_exit_type WHEN 'NO_TRADE' THEN -1 WHEN 'TIMEOUT' THEN last_idx - 1 ELSE k - 1 END::INT AS tb_exit_idx, round(r, 6) AS tb_r_atr, CASE WHEN tb_exit_type <> 'NO_TRADE' THEN (r > 0)::INT END AS meta_label FROM u")
def labels(spark, d):
    b = features.sessions(levels.ema_trend(levels.readiness(features.regimes(_all(spark, d)))))
    b = levels.mark_live(features.structure(b).join(F.broadcast(_now(spark, d))), c("now"), HOUR)  # one row
    return rounded(levels.labels(levels.direction_signal(b)).select("symbol", "time", "dir_signal", "tb_exit_type", "tb_y", "tb_exit_idx", "tb_r_atr", "meta_label"))


_BLOCK = ["sma_50", "bollinger_high", "stoch_k", "mfi_14", "ichimoku_b", "vol_ratio", "atr_z", "bb_width_z", "dist_ema20_atr", "dist_sma200_atr", "adx_14", "macd_hist"]


@query(f"{_SM}, {_IND_M}, {_Z}, bk AS (SELECT *, (close - ema_20) / (nullif(atr, 0) + 1e-9) AS dist_ema20_atr FROM y) SELECT symbol, time, row_idx::INT AS row_idx, {_r(*_BLOCK)}, {q.FLAGS} FROM bk")
def block_features(spark, d):
    """The same features dealt to blocks of 300 bars with overlap, so that a series is not one task."""
    b = features.in_blocks(src.event_bars(spark, d), 300)
    return rounded(b.select("symbol", "time", "row_idx", *_BLOCK, "breakout_up", "breakout_down", "false_breakout_up", "false_breakout_down"))
