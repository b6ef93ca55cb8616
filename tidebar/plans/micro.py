"""Queries over micro-breaks: bars of 15 minutes that break the bar before them, in the color of the last closed hour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebar.functions import exprs as e
from tidebar.operators import asof, sequential
from tidebar.plans import sqlparts as q
from tidebar.plans.bars_and_features import base, rounded
from tidebar.sources import bars as src

c = F.col
QUERIES, SQL = {}, {}
WIDTH, ABOVE = "15 minutes", "1 hour"
#: Horizons in bars, distances in atr.
HORIZONS, RETEST_BARS, FALSE_BARS, TOLERANCE, DOJI, MAX_GAP, EPISODE = (3, 5, 10), 5, 3, 0.10, 0.10, 15, 0.20


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _color(o: Column, cl: Column, h: Column, lo: Column) -> Column:
    """DOJI where the body is a small share of the range, else by its direction."""
    return F.when(F.abs(cl - o) / F.greatest(h - lo, F.lit(1e-12)) <= DOJI, "DOJI").when(cl > o, "GREEN").otherwise("RED")


def _events(spark, d) -> DataFrame:
    w = e.series()
    b = base(spark, d, WIDTH)
    n = F.count("*").over(Window.partitionBy("symbol"))
    coming = F.collect_list(F.struct(c("row_idx").alias("k"), "high", "low", "close", "time")).over(e.ahead(max(HORIZONS) + RETEST_BARS))
    b = b.withColumns({"n": n, "patr": F.lag("atr").over(w), "next_bars": coming})
    above = src.event_bars(spark, d, ABOVE).select("symbol", "time", F.when(c("close") > c("open"), "GREEN").when(c("close") < c("open"), "RED").otherwise("DOJI").alias("color"), (c("time") + F.expr(f"INTERVAL {ABOVE}")).alias("close_time"))
    b = asof.asof_backward(b, above, "symbol", "time", "time", ["color", "close_time"], "h1_", ABOVE, tolerance_seconds=900)
    side = F.when(c("h1_color") == "GREEN", "BUY").when(c("h1_color") == "RED", "SELL")
    b = b.withColumns({"side": side, "previous_color": _color(c("po"), c("pc"), c("ph"), c("pl"))})
    buy = c("side") == "BUY"
    expected = F.when(buy, "GREEN").otherwise("RED")
    b = b.withColumns({"level": F.when(buy, c("ph")).otherwise(c("pl")), "atr": F.when(c("atr") > 0, c("atr")).otherwise(c("patr"))})
    wick, closed = F.when(buy, c("high") > c("ph")).otherwise(c("low") < c("pl")), F.when(buy, c("close") > c("ph")).otherwise(c("close") < c("pl"))
    b = b.where(c("side").isNotNull() & wick & (c("atr") > 0) & (c("row_idx") <= c("n") - max(HORIZONS) - RETEST_BARS - 2))
    back = F.exists(F.slice("next_bars", 1, FALSE_BARS), lambda x: F.when(buy, x["close"] < c("level")).otherwise(x["close"] > c("level")))
    b = b.withColumns(
        {
            "color_relation": F.when(c("previous_color") == expected, "SAME_COLOR").when(c("previous_color") == "DOJI", "DOJI").otherwise("OPPOSITE_COLOR"),
            "break_mode": F.when(closed, "CLOSE_BREAK").otherwise("WICK_ONLY"),
            "micro_state": F.when(closed, "BREAK_ACCEPTED").otherwise("LEVEL_SWEEP"),
            "runtime_action": F.when(closed, "CONFIRMATION_CANDIDATE").otherwise("WAIT_FOR_CONFIRMATION"),
            "break_distance_atr": F.abs(c("close") - c("level")) / c("atr"),
            "false_breakout": back,
        }
    )
    tol = TOLERANCE * c("atr")

    def touched(x: Column) -> Column:
        return F.when(buy, x["low"] <= c("level") + tol).otherwise(x["high"] >= c("level") - tol)

    hit = F.try_element_at(F.filter(F.slice("next_bars", 1, RETEST_BARS), touched), F.lit(1))
    b = b.withColumn("_hit", F.when(c("break_mode") == "CLOSE_BREAK", hit))
    x = c("_hit.close")
    lost, held = F.when(buy, x < c("level") - tol).otherwise(x > c("level") + tol), F.when(buy, x >= c("level")).otherwise(x <= c("level"))
    state = F.when(c("break_mode") == "WICK_ONLY", "NOT_APPLICABLE").when(c("_hit").isNull(), "NO_RETEST").when(lost, "RETEST_FAILED").when(held, "RETEST_HELD").otherwise("RETEST_AMBIGUOUS")
    b = b.withColumns({"retest_state": state, "retest_event_time": c("_hit.time"), "retest_entry_price": x, "retest_delay_candles": c("_hit.k") - c("row_idx")})
    for h in HORIZONS:
        b = _measured(b, h, "breakout", F.slice("next_bars", 1, h), c("close"))
        b = _measured(b, h, "retest", F.when(c("retest_state") == "RETEST_HELD", F.slice("next_bars", c("retest_delay_candles") + 1, h)), c("retest_entry_price"))
    return b.drop("_hit")


def _measured(b: DataFrame, h: int, name: str, bars: Column, entry: Column) -> DataFrame:
    buy = c("side") == "BUY"
    rise, fall = (F.array_max(bars["high"]) - entry) / c("atr"), (entry - F.array_min(bars["low"])) / c("atr")
    b = b.withColumns({f"{name}_mfe_{h}_atr": F.when(buy, rise).otherwise(fall), f"{name}_mae_{h}_atr": F.when(buy, fall).otherwise(rise), f"{name}_return_{h}_atr": F.when(buy, 1.0).otherwise(-1.0) * (F.try_element_at(bars, F.lit(-1))["close"] - entry) / c("atr")})
    return b.withColumn(f"{name}_success_{h}", F.coalesce((c(f"{name}_mfe_{h}_atr") >= 0.5) & (c(f"{name}_mfe_{h}_atr") > c(f"{name}_mae_{h}_atr")), F.lit(False)))


_EV = f"""WITH RECURSIVE {q.bars(WIDTH)}, {q.base()}, {q.bars(ABOVE, 'h1')},
m0 AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY symbol) AS n, lag(atr) OVER {q.W} AS patr FROM b),
m1 AS (SELECT m0.*, CASE WHEN epoch(m0.time) - epoch(x.ct) <= 900 THEN x.col END AS h1_color FROM m0 ASOF LEFT JOIN (SELECT symbol, time + INTERVAL '1 hour' AS ct, CASE WHEN close > open THEN 'GREEN' WHEN close < open THEN 'RED' ELSE 'DOJI' END AS col FROM h1) x ON x.symbol = m0.symbol AND m0.time >= x.ct),
m2 AS (SELECT * EXCLUDE (atr), CASE h1_color WHEN 'GREEN' THEN 'BUY' WHEN 'RED' THEN 'SELL' END AS side, CASE WHEN abs(pc - po) / greatest(ph - pl, 1e-12) <= 0.1 THEN 'DOJI' WHEN pc > po THEN 'GREEN' ELSE 'RED' END AS previous_color, CASE WHEN atr > 0 THEN atr ELSE patr END AS atr FROM m1),
m3 AS (SELECT *, CASE side WHEN 'BUY' THEN ph ELSE pl END AS level, CASE side WHEN 'BUY' THEN close > ph ELSE close < pl END AS closed FROM m2 WHERE side IS NOT NULL AND atr > 0 AND CASE side WHEN 'BUY' THEN high > ph ELSE low < pl END AND row_idx <= n - 17),
nx AS MATERIALIZED (SELECT m3.symbol, m3.row_idx, x.row_idx - m3.row_idx AS k, x.time, x.high, x.low, x.close, side, level, m3.atr, closed FROM m3 JOIN b x ON x.symbol = m3.symbol AND x.row_idx BETWEEN m3.row_idx + 1 AND m3.row_idx + 15),
fb AS (SELECT symbol, row_idx, bool_or(CASE side WHEN 'BUY' THEN close < level ELSE close > level END) FILTER (k <= 3) AS false_breakout, {', '.join(f'max(high) FILTER (k <= {h}) AS hi{h}, min(low) FILTER (k <= {h}) AS lo{h}, max(close) FILTER (k = {h}) AS cl{h}' for h in HORIZONS)} FROM nx GROUP BY ALL),
rt AS (SELECT * FROM nx WHERE closed AND k <= 5 AND CASE side WHEN 'BUY' THEN low <= level + 0.1 * atr ELSE high >= level - 0.1 * atr END QUALIFY row_number() OVER (PARTITION BY symbol, row_idx ORDER BY k) = 1),
ev0 AS (SELECT m3.*, fb.* EXCLUDE (symbol, row_idx), rt.k AS rk, rt.time AS rtime, rt.close AS rclose, CASE WHEN NOT closed THEN 'NOT_APPLICABLE' WHEN rt.k IS NULL THEN 'NO_RETEST' WHEN CASE m3.side WHEN 'BUY' THEN rt.close < m3.level - 0.1 * m3.atr ELSE rt.close > m3.level + 0.1 * m3.atr END THEN 'RETEST_FAILED' WHEN CASE m3.side WHEN 'BUY' THEN rt.close >= m3.level ELSE rt.close <= m3.level END THEN 'RETEST_HELD' ELSE 'RETEST_AMBIGUOUS' END AS retest_state FROM m3 JOIN fb USING (symbol, row_idx) LEFT JOIN rt USING (symbol, row_idx, closed)),
ra AS (SELECT e.symbol, e.row_idx, {', '.join(f'max(x.high) FILTER (x.k <= rk + {h}) AS rhi{h}, min(x.low) FILTER (x.k <= rk + {h}) AS rlo{h}, max(x.close) FILTER (x.k = rk + {h}) AS rcl{h}' for h in HORIZONS)} FROM ev0 e JOIN nx x ON x.symbol = e.symbol AND x.row_idx = e.row_idx AND x.k > e.rk WHERE retest_state = 'RETEST_HELD' GROUP BY ALL),
ev AS MATERIALIZED (SELECT ev0.*, ra.* EXCLUDE (symbol, row_idx), CASE WHEN previous_color = CASE ev0.side WHEN 'BUY' THEN 'GREEN' ELSE 'RED' END THEN 'SAME_COLOR' WHEN previous_color = 'DOJI' THEN 'DOJI' ELSE 'OPPOSITE_COLOR' END AS color_relation, CASE WHEN closed THEN 'CLOSE_BREAK' ELSE 'WICK_ONLY' END AS break_mode, {', '.join(f"CASE ev0.side WHEN 'BUY' THEN {p}hi{h} - {x} ELSE {x} - {p}lo{h} END / atr AS {m}_mfe_{h}_atr, CASE ev0.side WHEN 'BUY' THEN {x} - {p}lo{h} ELSE {p}hi{h} - {x} END / atr AS {m}_mae_{h}_atr, CASE ev0.side WHEN 'BUY' THEN {p}cl{h} - {x} ELSE {x} - {p}cl{h} END / atr AS {m}_return_{h}_atr" for h in HORIZONS for m, p, x in (('breakout', '', 'close'), ('retest', 'r', 'rclose')))} FROM ev0 LEFT JOIN ra USING (symbol, row_idx))"""
_OUT = [f"{m}_{x}_{h}_atr" for h in HORIZONS for m in ("breakout", "retest") for x in ("mfe", "mae", "return")]


@query(f"{_EV} SELECT symbol, time, side, previous_color, color_relation, break_mode, CASE WHEN closed THEN 'BREAK_ACCEPTED' ELSE 'LEVEL_SWEEP' END AS micro_state, CASE WHEN closed THEN 'CONFIRMATION_CANDIDATE' ELSE 'WAIT_FOR_CONFIRMATION' END AS runtime_action, level, round(abs(close - level) / atr, 5) AS break_distance_atr, false_breakout, {', '.join(f'round({n}, 5) AS {n}' for n in _OUT)} FROM ev")
def micro_breaks(spark, d):
    cols = ["symbol", "time", "side", "previous_color", "color_relation", "break_mode", "micro_state", "runtime_action", "level", "break_distance_atr", "false_breakout"]
    return _events(spark, d).select(*cols[:8], "level", F.round("break_distance_atr", 5).alias("break_distance_atr"), "false_breakout", *(F.round(n, 5).alias(n) for n in _OUT))


@query(f"{_EV} SELECT symbol, time, side, retest_state, rtime AS retest_event_time, rclose AS retest_entry_price, rk AS retest_delay_candles FROM ev WHERE break_mode = 'CLOSE_BREAK'")
def micro_retests(spark, d):
    x = _events(spark, d).where("break_mode = 'CLOSE_BREAK'")
    return x.select("symbol", "time", "side", "retest_state", "retest_event_time", "retest_entry_price", c("retest_delay_candles").cast("long").alias("retest_delay_candles"))


_RATES = {"success_rate": "breakout_success_5", "avg_mfe": "breakout_mfe_5_atr", "avg_mae": "breakout_mae_5_atr", "avg_return": "breakout_return_5_atr", "false_rate": "false_breakout"}


@query(f"""{_EV}, g AS (SELECT side, break_mode, color_relation, count(*) AS n, avg((breakout_mfe_5_atr >= 0.5 AND breakout_mfe_5_atr > breakout_mae_5_atr)::INT) AS s, avg(breakout_return_5_atr) AS r, avg(breakout_mae_5_atr) AS a, avg(false_breakout::INT) AS f FROM ev GROUP BY ALL)
SELECT x.side, x.break_mode, x.n AS same_color_sample, y.n AS opposite_color_sample, round(x.s - y.s, 6) AS success_lift_5, round(x.r - y.r, 6) AS return_lift_5_atr, round(y.a - x.a, 6) AS mae_reduction_5_atr, round(y.f - x.f, 6) AS false_break_reduction FROM g x JOIN g y ON x.side = y.side AND x.break_mode = y.break_mode AND x.color_relation = 'SAME_COLOR' AND y.color_relation = 'OPPOSITE_COLOR'""")
def same_and_opposite(spark, d):
    """Breaks after a bar of the same color held against those after the opposite one: one aggregation instead of a self-join."""
    same, other = c("color_relation") == "SAME_COLOR", c("color_relation") == "OPPOSITE_COLOR"
    value = {"s": c("breakout_success_5").cast("int"), "r": c("breakout_return_5_atr"), "a": c("breakout_mae_5_atr"), "f": c("false_breakout").cast("int")}
    g = _events(spark, d).groupBy("side", "break_mode").agg(F.count_if(same).alias("same_color_sample"), F.count_if(other).alias("opposite_color_sample"), *(F.avg(F.when(test, x)).alias(f"{n}{k}") for n, x in value.items() for k, test in ((1, same), (2, other))))
    g = g.where("same_color_sample > 0 AND opposite_color_sample > 0")
    return rounded(g.select("side", "break_mode", "same_color_sample", "opposite_color_sample", (c("s1") - c("s2")).alias("success_lift_5"), (c("r1") - c("r2")).alias("return_lift_5_atr"), (c("a2") - c("a1")).alias("mae_reduction_5_atr"), (c("f2") - c("f1")).alias("false_break_reduction")))


def _attempts(spark, d) -> DataFrame:
    ev = _events(spark, d).select("symbol", "side", "time", "row_idx", "level", "atr", "break_mode")
    return sequential.attempt_episodes(ev, base(spark, d, WIDTH), MAX_GAP, EPISODE)


@query()
def micro_attempts(spark, d):
    """No SQL: an episode's level and recoil depend on its path; a test repeats it in plain Python."""
    return rounded(_attempts(spark, d))


@query()
def micro_episodes(spark, d):
    g = _attempts(spark, d).groupBy("symbol", "side", "episode").agg(F.min("event_time").alias("start_time"), F.max("event_time").alias("end_time"), F.max("level").alias("level"), F.count("*").alias("attempts"), F.count_if(~c("accepted")).alias("failed_attempts"), F.bool_or("accepted").alias("accepted"), F.max(F.when(c("accepted"), c("attempt_number"))).alias("accepted_on_attempt"), F.count_if("compression_before_attempt").alias("recoil_decreasing_count"))
    pressure = F.when(c("recoil_decreasing_count") >= 2, "PRESSURE_BUILDING").when(c("recoil_decreasing_count") == 1, "POSSIBLE_COMPRESSION").otherwise("NO_COMPRESSION_EVIDENCE")
    return rounded(g.withColumns({"episode_state": F.when(c("accepted"), "LEVEL_BROKEN").otherwise("UNRESOLVED_OR_REJECTED"), "pressure_state": pressure}))
