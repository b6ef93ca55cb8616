"""Queries over chart figures (on a price that walks, as the test ticks don't follow from each other): standing ones, break-outs, retests, zones of larger bars and outcomes by wall clock."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebar.functions import exprs as e
from tidebar.operators import asof, features
from tidebar.operators import figures as fig
from tidebar.plans import sqlparts as q
from tidebar.plans.bars_and_features import rounded
from tidebar.sources import bars as src

c = F.col
QUERIES, SQL = {}, {}
WIDTH = "15 minutes"
ABOVE = {"h1": "1 hour", "h4": "4 hours"}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _walk(spark, d) -> DataFrame:
    return src.walked(src.event_bars(spark, d, WIDTH))


def _bars(spark, d) -> DataFrame:
    return features.base(_walk(spark, d)).withColumn("vol_ratio", e.full(e.guarded(c("volume"), F.avg("volume").over(e.past(20))), 20, c("row_idx")))


def _standing_sql() -> str:
    parts = [q.bars(WIDTH, "raw"), q.walked(), q.base(), f"bb AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY symbol) AS n, CASE WHEN row_idx >= 20 THEN volume / (avg(volume) OVER {q.past(20)} + 1e-9) END AS vol_ratio FROM b)"]
    for w in fig.WINDOWS:
        lines = ", ".join(f"regr_slope({y}, row_idx) OVER {q.past(w)} AS {s}s, regr_intercept({y}, row_idx) OVER {q.past(w)} + regr_slope({y}, row_idx) OVER {q.past(w)} * (row_idx - {w - 1}) AS {s}0, coalesce(regr_r2({y}, row_idx) OVER {q.past(w)}, 1) AS {s}r" for s, y in (("u", "high"), ("d", "low")))
        nxt = ", ".join(f"lead({x}) OVER {q.W} AS next_{x}" for x in ("close", "atr", "time", "row_idx", "vol_ratio"))
        parts.append(f"p{w} AS (SELECT *, {lines}, quantile_cont(CASE WHEN atr > 0 THEN atr END, 0.5) OVER {q.past(w)} AS ar, list(high) OVER {q.past(w)} AS hs, list(low) OVER {q.past(w)} AS ls, {nxt} FROM bb)")
        parts.append(f"q{w} AS (SELECT *, {w} AS window_bars, u0 - d0 AS w0, u0 + us * {w - 1} - d0 - ds * {w - 1} AS w1 FROM p{w} WHERE row_idx >= {w} AND row_idx <= n - 13 AND ar > 0)")
        parts.append(f"r{w} AS (SELECT *, 1 - w1 / w0 AS compression_ratio, w1 / ar AS width_end_atr, us / ar AS upper_slope_atr, ds / ar AS lower_slope_atr FROM q{w} WHERE w0 > 0 AND w1 > 0 AND least(ur, dr) >= 0.15)")
        parts.append(f"s{w} AS (SELECT *, CASE WHEN compression_ratio >= 0.25 AND upper_slope_atr <= -0.025 AND lower_slope_atr >= 0.025 THEN 'TRIANGLE_SYMMETRIC' WHEN compression_ratio >= 0.25 AND abs(upper_slope_atr) <= 0.025 AND lower_slope_atr >= 0.025 THEN 'TRIANGLE_ASCENDING' WHEN compression_ratio >= 0.25 AND upper_slope_atr <= -0.025 AND abs(lower_slope_atr) <= 0.025 THEN 'TRIANGLE_DESCENDING' WHEN abs(upper_slope_atr) <= 0.025 AND abs(lower_slope_atr) <= 0.025 AND width_end_atr <= 2.5 THEN 'RANGE_BOX' END AS pattern_type, {', '.join(f'len(list_filter(list_transform(range({w}), lambda k: abs({a}s[k + 1] - ({b}s * k + {b}0))), lambda x: x <= 0.18 * ar)) AS {n}_touches' for n, a, b in (('upper', 'h', 'u'), ('lower', 'l', 'd')))} FROM r{w})")
    parts.append("st0 AS (" + " UNION ALL BY NAME ".join(f"SELECT * FROM s{w}" for w in fig.WINDOWS) + ")")
    parts.append("""st1 AS (SELECT *, us * window_bars + u0 AS up_line, ds * window_bars + d0 AS dn_line, CASE WHEN next_atr > 0 THEN next_atr ELSE ar END AS na, least(100, greatest(0, 25 * greatest(compression_ratio, 0) + 20 * ur + 20 * dr + 10 * least(1, upper_touches / 4.0::DOUBLE) + 10 * least(1, lower_touches / 4.0::DOUBLE))) AS quality_score FROM st0 WHERE pattern_type IS NOT NULL AND least(upper_touches, lower_touches) >= 2)""")
    parts.append("st AS MATERIALIZED (SELECT *, CASE WHEN next_close > up_line + 0.08 * na THEN 'UP' WHEN next_close < dn_line - 0.08 * na THEN 'DOWN' END AS breakout_side FROM st1)")
    return "WITH RECURSIVE " + ",\n".join(parts)


_ST = _standing_sql()


@query(f"""{_ST}, e0 AS (SELECT *, (coalesce(row_idx - lag(row_idx) OVER v, 999) > 1)::INT AS nw FROM st WHERE breakout_side IS NULL WINDOW v AS (PARTITION BY symbol, window_bars, pattern_type ORDER BY row_idx)),
e1 AS (SELECT *, sum(nw) OVER (PARTITION BY symbol, window_bars, pattern_type ORDER BY row_idx ROWS UNBOUNDED PRECEDING)::BIGINT AS episode_id FROM e0),
e2 AS (SELECT *, row_number() OVER (PARTITION BY symbol, window_bars, pattern_type, episode_id ORDER BY quality_score DESC, row_idx DESC) AS k FROM e1)
SELECT symbol, time, pattern_type, window_bars, episode_id, round(compression_ratio, 5) AS compression_ratio, round(width_end_atr, 5) AS width_end_atr, round(upper_slope_atr, 5) AS upper_slope_atr, round(lower_slope_atr, 5) AS lower_slope_atr, round(ur, 5) AS upper_r2, round(dr, 5) AS lower_r2, upper_touches::INT AS upper_touches, lower_touches::INT AS lower_touches, round(quality_score, 4) AS quality_score FROM e2 WHERE k = 1""")
def figure_episodes(spark, d):
    x = fig.episodes(_bars(spark, d))
    return x.select("symbol", "time", "pattern_type", "window_bars", "episode_id", *(F.round(n, 5).alias(n) for n in ("compression_ratio", "width_end_atr", "upper_slope_atr", "lower_slope_atr")), F.round("ur", 5).alias("upper_r2"), F.round("dr", 5).alias("lower_r2"), "upper_touches", "lower_touches", F.round("quality_score", 4).alias("quality_score"))


_BO = f"""{_ST}, c0 AS MATERIALIZED (SELECT *, next_row_idx AS bar_index, row_number() OVER (PARTITION BY symbol ORDER BY window_bars, next_row_idx) AS o FROM st WHERE breakout_side IS NOT NULL),
c1 AS (SELECT symbol, o, window_bars, bar_index FROM c0 WHERE o = 1 UNION ALL SELECT symbol, o, window_bars, bar_index FROM (SELECT n.symbol, n.o, n.window_bars, n.bar_index, row_number() OVER (PARTITION BY n.symbol ORDER BY n.o) AS k FROM c1 l JOIN c0 n ON n.symbol = l.symbol AND n.o > l.o AND n.bar_index > l.bar_index + greatest(2, n.window_bars // 5)) WHERE k = 1),
c2 AS (SELECT c0.*, CASE breakout_side WHEN 'UP' THEN up_line ELSE dn_line END AS edge FROM c0 JOIN c1 USING (symbol, o)),
c3 AS (SELECT * FROM c2 QUALIFY row_number() OVER (PARTITION BY symbol, next_time, breakout_side ORDER BY quality_score DESC, window_bars) = 1),
nx AS (SELECT c3.symbol, c3.o, x.row_idx - c3.bar_index AS k, x.time, x.high, x.low, x.close, breakout_side, edge, na FROM c3 JOIN bb x ON x.symbol = c3.symbol AND x.row_idx BETWEEN c3.bar_index + 1 AND c3.bar_index + 12),
ag AS (SELECT symbol, o, bool_or(CASE breakout_side WHEN 'UP' THEN close < edge ELSE close > edge END) FILTER (k <= 3) AS false_breakout, bool_or(abs(CASE breakout_side WHEN 'UP' THEN low ELSE high END - edge) <= 0.18 * na) FILTER (k <= 6) AS retest, {', '.join(f'max(high) FILTER (k <= {h}) AS hi_{h}, min(low) FILTER (k <= {h}) AS lo_{h}, max(close) FILTER (k = {h}) AS cl_{h}' for h in fig.HORIZONS)} FROM nx GROUP BY ALL),
bo AS MATERIALIZED (SELECT c3.*, false_breakout, retest, {', '.join(f"CASE breakout_side WHEN 'UP' THEN hi_{h} - next_close ELSE next_close - lo_{h} END / na AS mfe_{h}_atr, CASE breakout_side WHEN 'UP' THEN next_close - lo_{h} ELSE hi_{h} - next_close END / na AS mae_{h}_atr, CASE breakout_side WHEN 'UP' THEN cl_{h} - next_close ELSE next_close - cl_{h} END / na AS return_{h}_atr" for h in fig.HORIZONS)} FROM c3 JOIN ag USING (symbol, o))"""
_BO_OUT = [f"{m}_{h}_atr" for h in fig.HORIZONS for m in ("mfe", "mae", "return")]


@query(f"{_BO} SELECT symbol, next_time AS breakout_time, time AS formation_end_time, bar_index::INT AS bar_index, pattern_type, window_bars, breakout_side, round(next_close, 6) AS breakout_price, round(edge, 5) AS breakout_boundary, round(abs(next_close - edge) / na, 5) AS breakout_distance_atr, round(next_vol_ratio, 5) AS breakout_volume_ratio, round(quality_score, 4) AS quality_score, false_breakout, retest, {', '.join(f'round({n}, 5) AS {n}' for n in _BO_OUT)}, {', '.join(f'coalesce(mfe_{h}_atr >= 0.5 AND mfe_{h}_atr > mae_{h}_atr, false) AS success_{h}' for h in fig.HORIZONS)} FROM bo")
def figure_breakouts(spark, d):
    x = fig.breakouts(_bars(spark, d))
    five = ["breakout_boundary", "breakout_distance_atr", "breakout_volume_ratio", *_BO_OUT]
    return x.select("symbol", "breakout_time", "formation_end_time", "bar_index", "pattern_type", "window_bars", "breakout_side", F.round("breakout_price", 6).alias("breakout_price"), F.round("quality_score", 4).alias("quality_score"), "false_breakout", "retest", *(F.round(n, 5).alias(n) for n in five), *(f"success_{h}" for h in fig.HORIZONS))


_RT = f"""{_BO}, rt0 AS (SELECT *, CASE breakout_side WHEN 'UP' THEN close < edge - 0.18 * na ELSE close > edge + 0.18 * na END AS failed, CASE breakout_side WHEN 'UP' THEN low <= edge + 0.18 * na AND close > edge ELSE high >= edge - 0.18 * na AND close < edge END AS held FROM nx WHERE k <= 6),
rt1 AS (SELECT * FROM rt0 WHERE failed OR held QUALIFY row_number() OVER (PARTITION BY symbol, o ORDER BY k) = 1),
rt AS (SELECT bo.symbol, bo.next_time AS breakout_time, bo.breakout_side, coalesce(NOT failed, false) AS retest_confirmed, coalesce(failed, false) AS failed_before_retest, CASE WHEN NOT failed THEN k END AS bars_to_retest, CASE WHEN NOT failed THEN rt1.time END AS retest_time, CASE WHEN NOT failed THEN rt1.close END AS retest_entry_price, return_6_atr FROM bo LEFT JOIN rt1 USING (symbol, o))"""


@query(f"{_RT} SELECT symbol, breakout_time, breakout_side, retest_confirmed, failed_before_retest, bars_to_retest, retest_time, retest_entry_price FROM rt")
def figure_retests(spark, d):
    x = fig.retests(fig.breakouts(_bars(spark, d)))
    return x.select("symbol", "breakout_time", "breakout_side", "retest_confirmed", "failed_before_retest", c("bars_to_retest").cast("long").alias("bars_to_retest"), "retest_time", "retest_entry_price")


def _zoned(spark, d) -> DataFrame:
    """Break-outs with the levels of larger bars: the last closed one, the extremes of the last six, the last swing."""
    x = fig.breakouts(_bars(spark, d)).drop("next_bars")
    up = c("breakout_side") == "UP"
    levels = []
    for n, w in ABOVE.items():
        b = fig.swings(src.resampled(_walk(spark, d), w)).withColumns({"high_6": F.max("high").over(e.past(6)), "low_6": F.min("low").over(e.past(6))})
        x = asof.asof_backward(x, b, "symbol", "breakout_time", "time", ["high", "low", "high_6", "low_6"], f"{n}_", w)
        x = asof.asof_backward(x, b, "symbol", "breakout_time", "time", ["swing_up", "swing_down"], f"{n}_")
        for kind, above, below in (("PREVIOUS", "high", "low"), ("RANGE", "high_6", "low_6"), ("SWING", "swing_up", "swing_down")):
            there = c(f"{n}_high").isNotNull()
            levels.append(F.struct(F.when(there, F.when(up, c(f"{n}_{above}")).otherwise(c(f"{n}_{below}"))).alias("level"), F.lit(n).alias("tf"), F.lit(kind).alias("kind")))
    return x.withColumn("candidates", F.array(*levels))


@query()
def figure_zones(spark, d):
    """No SQL, as zones are folded level by level; a test repeats the fold in plain Python."""
    x = fig.zone_context(_zoned(spark, d), c("candidates"))
    return rounded(x.select("symbol", "breakout_time", "breakout_side", "htf_zone_count", "higher_tf_context", "breakout_zone_price", "breakout_zone_relation", "breakout_zone_sources", "next_obstacle_price", "next_obstacle_relation", "available_space_atr", "zone_strength_bucket", "zone_origin_bucket"))


_MINUTES = (60, 180, 360)


@query(f"""{_BO}, wc AS (SELECT bo.symbol, bo.next_time AS breakout_time, breakout_side, next_close AS entry, na, {', '.join(f"max(x.high) FILTER (x.time <= bo.next_time + INTERVAL '{m} minutes') AS hi_{m}, min(x.low) FILTER (x.time <= bo.next_time + INTERVAL '{m} minutes') AS lo_{m}, arg_max(x.close, x.time) FILTER (x.time <= bo.next_time + INTERVAL '{m} minutes') AS cl_{m}, count(*) FILTER (x.time <= bo.next_time + INTERVAL '{m} minutes' AND x.time IS NOT NULL) AS observed_bars_{m}m" for m in _MINUTES)}
FROM bo LEFT JOIN bb x ON x.symbol = bo.symbol AND x.time > bo.next_time AND x.time <= bo.next_time + INTERVAL '360 minutes' GROUP BY ALL)
SELECT symbol, breakout_time, breakout_side, {', '.join(f"observed_bars_{m}m, round(CASE breakout_side WHEN 'UP' THEN hi_{m} - entry ELSE entry - lo_{m} END / na, 5) AS mfe_{m}m_atr, round(CASE breakout_side WHEN 'UP' THEN entry - lo_{m} ELSE hi_{m} - entry END / na, 5) AS mae_{m}m_atr, round(CASE breakout_side WHEN 'UP' THEN cl_{m} - entry ELSE entry - cl_{m} END / na, 5) AS return_{m}m_atr" for m in _MINUTES)} FROM wc""")
def wall_clock_outcomes(spark, d):
    """What followed within minutes of the clock, by frames over time: bars may be missing."""
    b = _bars(spark, d).withColumn("_us", F.unix_micros(c("time").cast("timestamp")))
    of = Window.partitionBy("symbol").orderBy("_us")
    for m in _MINUTES:
        w = of.rangeBetween(1, m * 60_000_000)
        b = b.withColumns({f"hi_{m}": F.max("high").over(w), f"lo_{m}": F.min("low").over(w), f"cl_{m}": F.last("close").over(w), f"observed_bars_{m}m": F.count("*").over(w)})
    frame = b.select("symbol", "row_idx", *(n for m in _MINUTES for n in (f"hi_{m}", f"lo_{m}", f"cl_{m}", f"observed_bars_{m}m")))
    ev = fig.breakouts(_bars(spark, d)).select("symbol", c("bar_index").alias("row_idx"), "breakout_time", "breakout_side", "breakout_price", "atr")
    x = ev.join(frame, ["symbol", "row_idx"])  # positional: the event knows its bar
    up, entry = c("breakout_side") == "UP", c("breakout_price")
    out = ["symbol", "breakout_time", "breakout_side"]
    for m in _MINUTES:
        rise, fall = (c(f"hi_{m}") - entry) / c("atr"), (entry - c(f"lo_{m}")) / c("atr")
        x = x.withColumns({f"mfe_{m}m_atr": F.when(up, rise).otherwise(fall), f"mae_{m}m_atr": F.when(up, fall).otherwise(rise), f"return_{m}m_atr": F.when(up, 1.0).otherwise(-1.0) * (c(f"cl_{m}") - entry) / c("atr")})
        out += [f"observed_bars_{m}m", f"mfe_{m}m_atr", f"mae_{m}m_atr", f"return_{m}m_atr"]
    return rounded(x.select(*out), 5)
