"""Outcome, event-study and validation queries."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebar.functions import exprs as e
from tidebar.operators import asof, features, sequential, touch
from tidebar.plans import sqlparts as q
from tidebar.plans.bars_and_features import _IND, base, rounded
from tidebar.plans.blocks import _Z
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


@query(f"WITH RECURSIVE {q.bars()}, {q.bars('4 hours', 'h4')} SELECT b.symbol, b.time, b.close, h.high AS h4_high, h.low AS h4_low, h.close AS h4_close FROM bars b ASOF LEFT JOIN (SELECT *, time + INTERVAL '4 hours' AS known FROM h4) h ON b.symbol = h.symbol AND b.time >= h.known")
def asof_closed(spark, d):
    left = src.event_bars(spark, d).select("symbol", "time", "close")
    return asof.asof_backward(left, src.event_bars(spark, d, "4 hours"), "symbol", "time", "time", ["high", "low", "close"], "h4_", "4 hours")


@query("""SELECT a.event_id, a.ts, CASE WHEN a.ts - b.ts <= INTERVAL '30 minutes' THEN b.value END AS m_value FROM (SELECT * FROM events WHERE event_type = (SELECT min(event_type) FROM events)) a
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = (SELECT max(event_type) FROM events)) b ON a.user_id % 10 = b.user_id % 10 AND a.ts >= b.ts""")
def asof_tolerance(spark, d):
    t = src.table(spark, d, "events").withColumn("g", c("user_id") % 10)
    edge = t.agg(F.min("event_type").alias("lo"), F.max("event_type").alias("hi"))
    t = t.join(F.broadcast(edge))  # one row
    left, right = t.where("event_type = lo").select("event_id", "g", "ts"), t.where("event_type = hi").select("g", "ts", "value")
    return asof.asof_backward(left, right, "g", "ts", "ts", ["value"], "m_", tolerance_seconds=1800).select("event_id", "ts", "m_value")


_PR = "(rank() OVER (PARTITION BY symbol ORDER BY {0} ASC NULLS LAST) + (count({0}) OVER (PARTITION BY symbol, {0}) - 1) / 2.0) / count({0}) OVER (PARTITION BY symbol)"


@query(f"""WITH RECURSIVE {q.bars()}, {q.base()}, {q.bars('4 hours', 'h4')}, {q.bars('1 day', 'd1')}, v AS (SELECT *, CASE WHEN row_idx >= 20 THEN volume / (avg(volume) OVER {q.past(20)} + 1e-9) END AS vr, (high - low) / (atr + 1e-9) AS ra, abs(close - open) / (atr + 1e-9) AS ba FROM b),
j AS (SELECT v.*, h.open AS ho, h.close AS hc FROM v ASOF LEFT JOIN (SELECT *, time + INTERVAL '4 hours' AS known FROM h4) h ON v.symbol = h.symbol AND v.time >= h.known),
k AS (SELECT j.*, x.open AS dopen, x.close AS dc FROM j ASOF LEFT JOIN (SELECT *, time + INTERVAL '1 day' AS known FROM d1) x ON j.symbol = x.symbol AND j.time >= x.known),
m AS (SELECT *, CASE WHEN vr IS NOT NULL THEN least(vr, 5) END AS e1, CASE WHEN ra IS NOT NULL THEN least(ra, 5) END AS e2, CASE WHEN ba IS NOT NULL THEN least(ba, 3) END AS e3, (sign(close - open) + coalesce(sign(hc - ho), 0) + coalesce(sign(dc - dopen), 0))::INT AS mtf_alignment_score FROM k),
n AS (SELECT *, CASE WHEN e1 IS NOT NULL THEN {_PR.format('e1')} END AS p1, CASE WHEN e2 IS NOT NULL THEN {_PR.format('e2')} END AS p2, CASE WHEN e3 IS NOT NULL THEN {_PR.format('e3')} END AS p3 FROM m),
s AS (SELECT *, least(100, 100 * (0.3 * coalesce(p1, 0) + 0.3 * coalesce(p2, 0) + 0.2 * coalesce(p3, 0))) AS energy_score FROM n)
SELECT symbol, time, mtf_alignment_score, CASE abs(mtf_alignment_score) WHEN 0 THEN 'NONE' WHEN 1 THEN 'WEAK' WHEN 2 THEN 'MIXED' ELSE 'STRONG' END AS mtf_alignment_bucket, CASE WHEN mtf_alignment_score > 0 THEN 'UP' WHEN mtf_alignment_score < 0 THEN 'DOWN' ELSE 'MIXED' END AS mtf_bias, round(energy_score, 6) AS energy_score,
CASE WHEN energy_score <= 20 THEN 'VERY_LOW' WHEN energy_score <= 40 THEN 'LOW' WHEN energy_score <= 60 THEN 'MEDIUM' WHEN energy_score <= 80 THEN 'HIGH' ELSE 'EXTREME' END AS energy_bucket FROM s""")
def mtf_alignment_energy(spark, d):
    b = base(spark, d)
    b = b.withColumns({"vr": e.full(e.guarded(c("volume"), F.avg("volume").over(e.past(20))), 20, c("row_idx")), "ra": e.guarded(c("high") - c("low"), c("atr")), "ba": e.guarded(F.abs(c("close") - c("open")), c("atr"))})
    b = asof.asof_backward(b, src.event_bars(spark, d, "4 hours"), "symbol", "time", "time", ["open", "close"], "h4_", "4 hours")
    b = asof.asof_backward(b, src.event_bars(spark, d, "1 day"), "symbol", "time", "time", ["open", "close"], "d1_", "1 day")
    score = F.signum(c("close") - c("open")) + sum((F.coalesce(F.signum(c(f"{t}_close") - c(f"{t}_open")), F.lit(0.0)) for t in ("h4", "d1")), F.lit(0.0))
    b = b.withColumns({"mtf_alignment_score": score.cast("int"), "e1": F.when(c("vr").isNotNull(), F.least(c("vr"), F.lit(5.0))), "e2": F.when(c("ra").isNotNull(), F.least(c("ra"), F.lit(5.0))), "e3": F.when(c("ba").isNotNull(), F.least(c("ba"), F.lit(3.0)))})
    energy = F.least(F.lit(100.0), 100 * sum((w * F.coalesce(e.percent_rank(c(n)), F.lit(0.0)) for n, w in (("e1", 0.3), ("e2", 0.3), ("e3", 0.2))), F.lit(0.0)))
    b = b.withColumn("energy_score", energy)
    bias = F.when(c("mtf_alignment_score") > 0, "UP").when(c("mtf_alignment_score") < 0, "DOWN").otherwise("MIXED")
    return rounded(b.select("symbol", "time", "mtf_alignment_score", e.bins(F.abs("mtf_alignment_score"), (0, 1, 2), ("NONE", "WEAK", "MIXED", "STRONG")).alias("mtf_alignment_bucket"), bias.alias("mtf_bias"), "energy_score", e.bins(c("energy_score"), (20, 40, 60, 80), ("VERY_LOW", "LOW", "MEDIUM", "HIGH", "EXTREME")).alias("energy_bucket")))


_OUT = [f"h{k}_{n}" for k in (1, 2, 3, 6, 12, 24) for n in q.OUTCOMES]


@query(f"WITH RECURSIVE {q.bars()}, {q.base()}, {q.outcomes()} SELECT symbol, time, side, {', '.join(f'round({n}, 6) AS {n}' if n.endswith('_atr') else n for n in _OUT)} FROM o")
def forward_outcomes(spark, d):
    return rounded(features.forward_outcomes(base(spark, d)).select("symbol", "time", "side", *_OUT))


_COMBOS = ((0.5, 0.25, 6), (1.0, 0.5, 12), (1.5, 0.75, 24), (2.0, 1.0, 24))


@query(f"WITH RECURSIVE {q.bars()}, {q.base()}" + "".join(f", t{n} AS ({q.touch(f'{t} * atr', f'{s} * atr', k, 'sign(close - open)')})" for n, (t, s, k) in enumerate(_COMBOS)) + " SELECT b.symbol, b.time, " + ", ".join(f'CASE WHEN atr IS NULL OR atr <= 0 OR close = open THEN \'INVALID\' ELSE coalesce(t{n}.label, \'NO_TOUCH\') END AS "rr_{t}_{s}_{k}"' for n, (t, s, k) in enumerate(_COMBOS)) + " FROM b" + "".join(f" LEFT JOIN t{n} ON t{n}.symbol = b.symbol AND t{n}.time = b.time" for n in range(4)))
def first_touch_rr(spark, d):
    return touch.reward_risk(base(spark, d)).select("symbol", "time", *[F.col(f"`rr_{t}_{s}_{k}`") for t, s, k in _COMBOS])


_PAIRS = ((1.0, 0.5, 12), (0.5, 0.25, 6))


@query(f"WITH RECURSIVE {q.bars()}, {q.base()}" + "".join(f", {n}{k} AS ({q.touch(f'{t} * atr', f'{s} * atr', h, side)})" for k, (t, s, h) in enumerate(_PAIRS) for n, side in (("u", "1"), ("v", "-1"))) + " SELECT b.symbol, b.time, " + ", ".join(f"CASE WHEN atr > 0 THEN coalesce({n}{k}.label, 'NO_TOUCH') ELSE 'INVALID' END AS \"{name}_label_{t}_{s}_{h}\", CASE WHEN atr > 0 THEN {n}{k}.place - row_idx END AS \"{name}_bars_{t}_{s}_{h}\"" for k, (t, s, h) in enumerate(_PAIRS) for n, name in (("u", "buy"), ("v", "sell"))) + " FROM b" + "".join(f" LEFT JOIN {n}{k} ON {n}{k}.symbol = b.symbol AND {n}{k}.time = b.time" for k in range(2) for n in "uv"))
def first_touch_sides(spark, d):
    b = base(spark, d)
    for t, s, h in _PAIRS:
        b = touch.both_sides(b, t, s, h)
        b = b.withColumns({f"{n}_label_{t}_{s}_{h}": c(f"{n}_label") for n in ("buy", "sell")} | {f"{n}_bars_{t}_{s}_{h}": c(f"{n}_bars").cast("long") for n in ("buy", "sell")})
    return b.select("symbol", "time", *(F.col(f"`{n}_{x}_{t}_{s}_{h}`") for t, s, h in _PAIRS for n in ("buy", "sell") for x in ("label", "bars")))


@query(f"""WITH RECURSIVE {q.bars()}, {q.base()}, x AS (SELECT *, sign(close - open) AS s, close - sign(close - open) * 0.25 * atr AS entry FROM b),
f AS (SELECT a.symbol, a.time, min(n.row_idx) AS fill FROM x a JOIN b n ON n.symbol = a.symbol AND n.row_idx BETWEEN a.row_idx + 1 AND a.row_idx + 12 WHERE CASE WHEN a.s > 0 THEN n.low <= a.entry ELSE n.high >= a.entry END GROUP BY 1, 2),
y AS (SELECT x.*, f.fill FROM x LEFT JOIN f ON f.symbol = x.symbol AND f.time = x.time),
h AS (SELECT a.symbol, a.time, n.row_idx AS k, CASE WHEN a.s > 0 THEN n.high >= a.entry + a.s * atr1 ELSE n.low <= a.entry + a.s * atr1 END AS won, CASE WHEN a.s > 0 THEN n.low <= a.entry - a.s * 0.5 * atr1 ELSE n.high >= a.entry - a.s * 0.5 * atr1 END AS lost FROM (SELECT *, atr AS atr1 FROM y) a JOIN b n ON n.symbol = a.symbol AND n.row_idx BETWEEN a.fill AND a.row_idx + 12),
g AS (SELECT symbol, time, arg_min(CASE WHEN won AND lost THEN 'AMBIGUOUS' WHEN won THEN 'TP_FIRST' ELSE 'SL_FIRST' END, k) AS label FROM h WHERE won OR lost GROUP BY 1, 2)
SELECT y.symbol, y.time, CASE WHEN NOT coalesce(atr > 0 AND s <> 0, false) THEN 'INVALID' WHEN fill IS NULL THEN 'NOT_FILLED' ELSE coalesce(g.label, 'FILLED_NO_EXIT') END AS pullback_label, CASE WHEN atr > 0 AND s <> 0 THEN fill - row_idx END AS fill_bars FROM y LEFT JOIN g ON g.symbol = y.symbol AND g.time = y.time""")
def pullback_entry(spark, d):
    return touch.pullback_entry(base(spark, d)).select("symbol", "time", "pullback_label", c("fill_bars").cast("long").alias("fill_bars"))


@query(f"""WITH RECURSIVE {q.bars()}, {q.base()}, x AS (SELECT *, sign(close - open) AS s, lead(close) OVER {q.W} AS entry, last_value(close) OVER (PARTITION BY symbol ORDER BY time ROWS BETWEEN 1 FOLLOWING AND 13 FOLLOWING) AS xit FROM b), t AS ({q.touch('1.5 * atr', '1.0 * atr', 13, 's', 'entry', source='x', tie='SL_FIRST')}),
k AS (SELECT x.*, t.place, CASE WHEN NOT coalesce(atr > 0 AND s <> 0 AND entry IS NOT NULL, false) THEN 'NO_TRADE' WHEN t.label = 'TP_FIRST' THEN 'TP' WHEN t.label = 'SL_FIRST' THEN 'SL' ELSE 'TIMEOUT' END AS kind FROM x LEFT JOIN t ON t.symbol = x.symbol AND t.time = x.time)
SELECT symbol, time, kind AS tb_exit_type, CASE WHEN kind <> 'NO_TRADE' THEN place END AS tb_exit_idx, round(CASE kind WHEN 'TP' THEN 1.5 WHEN 'SL' THEN -1.0 WHEN 'TIMEOUT' THEN s * (xit - entry) / atr END, 6) AS tb_r_atr, CASE kind WHEN 'TP' THEN 1 WHEN 'SL' THEN -1 ELSE 0 END AS tb_y FROM k""")
def triple_barrier(spark, d):
    return rounded(touch.triple_barrier(base(spark, d)).select("symbol", "time", "tb_exit_type", c("tb_exit_idx").cast("long").alias("tb_exit_idx"), "tb_r_atr", "tb_y"))


@query(f"""WITH RECURSIVE {q.bars('4 hours')}, {q.base()}, {q.bars('15 minutes', 'm15')}, t AS ({q.touch('atr', '0.5 * atr', 6, 'sign(close - open)')}), a AS (SELECT b.*, b.time + INTERVAL '4 hours' AS t0, b.time + INTERVAL '28 hours' AS t1, sign(close - open) AS s FROM b JOIN t USING (symbol, time) WHERE label = 'AMBIGUOUS' AND atr > 0 AND close <> open),
h AS (SELECT a.symbol, a.time, n.time AS k, CASE WHEN s > 0 THEN n.high >= a.close + s * atr ELSE n.low <= a.close + s * atr END AS won, CASE WHEN s > 0 THEN n.low <= a.close - s * 0.5 * atr ELSE n.high >= a.close - s * 0.5 * atr END AS lost FROM a JOIN m15 n ON n.symbol = a.symbol AND n.time >= t0 AND n.time < t1)
SELECT symbol, time, arg_min(CASE WHEN won AND lost THEN 'AMBIGUOUS' WHEN won THEN 'TP_FIRST' ELSE 'SL_FIRST' END, k) AS resolved FROM h WHERE won OR lost GROUP BY 1, 2""")
def ambiguity_cascade(spark, d):
    b = touch.reward_risk(base(spark, d, "4 hours"), ((1.0, 0.5, 6),)).where("`rr_1.0_0.5_6` = 'AMBIGUOUS'")
    b = b.select("symbol", c("time").alias("at"), (c("time") + F.expr("INTERVAL 4 HOURS")).alias("t0"), (c("time") + F.expr("INTERVAL 28 HOURS")).alias("t1"), F.signum(c("close") - c("open")).alias("s"), c("close").alias("entry"), "atr")
    met = asof.within_bars(b, src.event_bars(spark, d, "15 minutes").select("symbol", "time", "high", "low"), "symbol", "t0", "t1", "4 hours")
    tp, sl = c("entry") + c("s") * c("atr"), c("entry") - c("s") * 0.5 * c("atr")
    won, lost = F.when(c("s") > 0, c("high") >= tp).otherwise(c("low") <= tp), F.when(c("s") > 0, c("low") <= sl).otherwise(c("high") >= sl)
    label = F.when(won & lost, "AMBIGUOUS").when(won, "TP_FIRST").otherwise("SL_FIRST")
    return met.where(won | lost).groupBy(c("p.symbol").alias("symbol"), c("at")).agg(F.min_by(label, c("b.time")).alias("resolved")).withColumnRenamed("at", "time")


_HB = f"WITH RECURSIVE {q.bars()}, {q.base()}, {_IND}, {_Z}, {q.outcomes((3, 6, 12), 'y')}, x AS (SELECT *, {q.FLAGS}, coalesce(((high > ph AND close < ph) OR (low < pl AND close > pl))::INT, 0) AS sweep, coalesce((atr_z < -1 AND bb_width_z < -1)::INT, 0) AS compression_flag, coalesce((atr_z > 1 OR bb_width_z > 1)::INT, 0) AS expansion_flag FROM o)"


def _events(spark, d, horizons=(3, 6, 12)) -> DataFrame:
    """Bars with outcomes, flags, sweeps and regimes."""
    b = features.regimes(features.rolling_indicators(base(spark, d)))
    x = features.bar_flags(features.forward_outcomes(b, horizons))
    return x.withColumn("sweep", e.flag(((c("high") > c("ph")) & (c("close") < c("ph"))) | ((c("low") < c("pl")) & (c("close") > c("pl")))))


_HOUR = {"expansion_pct": "expansion_flag", "breakout_pct": "greatest(breakout_up, breakout_down)", "false_break_pct": "greatest(false_breakout_up, false_breakout_down)", "sweep_pct": "sweep", "continuation_h3": "h3_continues", "continuation_h6": "h6_continues", "continuation_h12": "h12_continues", "pullback_0p25_h6": "h6_pullback_0p25", "pullback_0p50_h6": "h6_pullback_0p50", "reach_0p50_h12": "h12_reaches_0p50", "reach_1atr_h12": "h12_reaches_1p00", "fav_h6": "h6_fav_atr"}


@query(f"{_HB} SELECT hour(time)::INT AS hour, count(*) AS bars, {', '.join(f'round(avg({x}), 6) AS {n}' for n, x in _HOUR.items())}, round(median(h6_adv_atr), 6) AS median_adv_h6 FROM x GROUP BY 1 HAVING count(*) >= 3")
def hour_behavior(spark, d):
    g = _events(spark, d).groupBy(F.hour("time").alias("hour"))
    return rounded(g.agg(F.count("*").alias("bars"), *(F.expr(f"avg({x})").alias(n) for n, x in _HOUR.items()), F.percentile("h6_adv_atr", F.lit(0.5)).alias("median_adv_h6")).where("bars >= 3"))


_STATE = "CASE WHEN breakout_up = 1 OR breakout_down = 1 THEN 'BREAKOUT' WHEN false_breakout_up = 1 OR false_breakout_down = 1 THEN 'FALSE_BREAK' WHEN sweep = 1 THEN 'SWEEP' WHEN compression_flag = 1 THEN 'COMPRESSION' WHEN expansion_flag = 1 THEN 'EXPANSION' ELSE 'NONE' END"
_RDNA = "CASE WHEN (high - low) / (atr + 1e-9) IS NULL THEN 'R_UNKNOWN' WHEN (high - low) / (atr + 1e-9) <= 0.6 THEN 'R_LOW' WHEN (high - low) / (atr + 1e-9) <= 1 THEN 'R_NORMAL' WHEN (high - low) / (atr + 1e-9) <= 1.5 THEN 'R_HIGH' WHEN (high - low) / (atr + 1e-9) <= 2 THEN 'R_EXTREME' ELSE 'R_CHAOS' END"


def event_name() -> Column:
    """The first that holds of break-out, false break, sweep, compression, expansion."""
    up_or_down = (c("breakout_up") == 1) | (c("breakout_down") == 1)
    return F.when(up_or_down, "BREAKOUT").when((c("false_breakout_up") == 1) | (c("false_breakout_down") == 1), "FALSE_BREAK").when(c("sweep") == 1, "SWEEP").when(c("compression_flag") == 1, "COMPRESSION").when(c("expansion_flag") == 1, "EXPANSION").otherwise("NONE")


def _states(spark, d, horizons=(3, 6, 12)) -> DataFrame:
    rng = e.bins(e.guarded(c("high") - c("low"), c("atr")), (0.6, 1.0, 1.5, 2.0), ("R_LOW", "R_NORMAL", "R_HIGH", "R_EXTREME", "R_CHAOS"), "R_UNKNOWN")
    return _events(spark, d, horizons).withColumns({"event_name": event_name(), "range_dna": rng, "direction": F.when(c("side") > 0, "UP").when(c("side") < 0, "DOWN").otherwise("FLAT")})


_ST = f"{_HB}, s AS (SELECT *, {_STATE} AS event_name, {_RDNA} AS range_dna, CASE WHEN side > 0 THEN 'UP' WHEN side < 0 THEN 'DOWN' ELSE 'FLAT' END AS direction FROM x)"


@query(f"""{_ST}, u AS ({q.touch('atr', '0.5 * atr', 12, '1')}), v AS ({q.touch('atr', '0.5 * atr', 12, '-1')}), z AS (SELECT s.*, CASE WHEN atr > 0 THEN coalesce(u.label, 'NO_TOUCH') ELSE 'INVALID' END AS bl, CASE WHEN atr > 0 THEN coalesce(v.label, 'NO_TOUCH') ELSE 'INVALID' END AS sl FROM s LEFT JOIN u ON u.symbol = s.symbol AND u.time = s.time LEFT JOIN v ON v.symbol = s.symbol AND v.time = s.time),
g AS (SELECT direction || '|' || event_name || '|' || range_dna AS state_key, count(*) AS bars, avg((bl = 'TP_FIRST')::INT - (bl = 'SL_FIRST')::INT) AS buy_edge, avg((sl = 'TP_FIRST')::INT - (sl = 'SL_FIRST')::INT) AS sell_edge, avg(h12_reaches_1p00) AS r, avg(h6_continues) AS k, avg(h6_pullback_0p50) AS p FROM z GROUP BY 1 HAVING count(*) >= 10)
SELECT state_key, bars, round(buy_edge, 6) AS buy_edge, round(sell_edge, 6) AS sell_edge, CASE WHEN buy_edge >= sell_edge THEN 'BUY' ELSE 'SELL' END AS best_side, round(0.35 * greatest(greatest(buy_edge, sell_edge), 0) + 0.2 * abs(buy_edge - sell_edge) + 0.2 * r + 0.1 * k - 0.15 * p + 0.1 * least(bars / 500.0, 1), 6) AS genome_score FROM g""")
def state_genome(spark, d):
    z = touch.both_sides(_states(spark, d)).withColumn("state_key", F.concat_ws("|", "direction", "event_name", "range_dna"))
    edge = {n: F.avg((c(f"{n}_label") == "TP_FIRST").cast("int") - (c(f"{n}_label") == "SL_FIRST").cast("int")) for n in ("buy", "sell")}
    g = z.groupBy("state_key").agg(F.count("*").alias("bars"), edge["buy"].alias("buy_edge"), edge["sell"].alias("sell_edge"), F.avg("h12_reaches_1p00").alias("r"), F.avg("h6_continues").alias("k"), F.avg("h6_pullback_0p50").alias("p")).where("bars >= 10")
    score = 0.35 * F.greatest("buy_edge", "sell_edge", F.lit(0.0)) + 0.2 * F.abs(c("buy_edge") - c("sell_edge")) + 0.2 * c("r") + 0.1 * c("k") - 0.15 * c("p") + 0.1 * F.least(c("bars") / 500, F.lit(1.0))
    return rounded(g.select("state_key", "bars", "buy_edge", "sell_edge", F.when(c("buy_edge") >= c("sell_edge"), "BUY").otherwise("SELL").alias("best_side"), score.alias("genome_score")))


@query(f"{_ST}, t AS (SELECT event_name AS state, lead(event_name) OVER {q.W} AS next_state FROM s), n AS (SELECT state, next_state, count(*) AS transitions FROM t WHERE next_state IS NOT NULL GROUP BY 1, 2) SELECT *, round(transitions / sum(transitions) OVER (PARTITION BY state), 6) AS probability FROM n")
def state_transitions(spark, d):
    t = _states(spark, d).select(c("event_name").alias("state"), F.lead("event_name").over(e.series()).alias("next_state")).where("next_state IS NOT NULL")
    n = t.groupBy("state", "next_state").agg(F.count("*").alias("transitions"))
    return rounded(n.withColumn("probability", c("transitions") / F.sum("transitions").over(Window.partitionBy("state"))))


@query(f"""{_ST}, i AS (SELECT *, sum((coalesce(direction <> lag_d, true))::INT) OVER (PARTITION BY symbol ORDER BY time ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, lag(direction) OVER {q.W} AS lag_d FROM s)),
rl AS (SELECT *, row_number() OVER (PARTITION BY symbol, island ORDER BY time) AS len FROM i)
SELECT symbol, time, (CASE direction WHEN 'UP' THEN len WHEN 'DOWN' THEN -len ELSE 0 END)::BIGINT AS streak, array_to_string(list(left(direction, 1)) OVER {q.past(5)}, '') AS dir_seq_5, (sum(breakout_up + breakout_down) OVER {q.past(12)})::BIGINT AS attempts_12, row_idx - max(CASE WHEN greatest(false_breakout_up, false_breakout_down) = 1 THEN row_idx END) OVER (PARTITION BY symbol ORDER BY time ROWS UNBOUNDED PRECEDING) AS bars_since_false_break FROM rl""")
def sequence_features(spark, d):
    s = _states(spark, d)
    w = e.series()
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("_new", F.coalesce(c("direction") != F.lag("direction").over(w), F.lit(True)).cast("int")).withColumn("island", F.sum("_new").over(run))
    length = F.row_number().over(Window.partitionBy("symbol", "island").orderBy("time"))
    s = s.withColumn("len", length)
    since = c("row_idx") - F.max(F.when(F.greatest("false_breakout_up", "false_breakout_down") == 1, c("row_idx"))).over(run)
    return s.select("symbol", "time", F.when(c("direction") == "UP", c("len")).when(c("direction") == "DOWN", -c("len")).otherwise(0).cast("long").alias("streak"), F.array_join(F.collect_list(F.left("direction", F.lit(1))).over(e.past(5)), "").alias("dir_seq_5"), F.sum(c("breakout_up") + c("breakout_down")).over(e.past(12)).alias("attempts_12"), since.cast("long").alias("bars_since_false_break"))


#: Bars after an event whose outcome counts: minutes over bars of one minute as published; here over bars of 15 minutes.
HORIZONS = (5, 15, 30, 60)
_WIDTH = "15 minutes"
_CONTEXTS = {"h1": "1 hour", "h4": "4 hours", "d1": "1 day"}


def _color(o: str = "open", cl: str = "close") -> Column:
    return F.when(c(cl) > c(o), "GREEN").when(c(cl) < c(o), "RED").otherwise("DOJI")


def _break_events(spark, d) -> DataFrame:
    """Single breaks of the bar before, with that bar's make-up, the colors of the last closed bars above, and outcomes by horizon."""
    far = max(HORIZONS)
    f = base(spark, d, _WIDTH)
    usual = F.when(F.count("volume").over(e.past(20)) >= 5, F.avg("volume").over(e.past(20)))
    size = F.when(c("high") != c("low"), c("high") - c("low"))
    f = f.withColumns({"body_ratio": F.abs(c("close") - c("open")) / size, "range_atr": e.over(size, c("atr")), "volume_ratio": e.over(c("volume"), usual), "n": F.count("*").over(Window.partitionBy("symbol")), "color": _color()})
    w = e.series()
    f = f.withColumns({f"previous_{x}": F.lag(x).over(w) for x in ("color", "body_ratio", "range_atr", "volume_ratio")})
    f = f.withColumns({f"_hi{h}": F.max("high").over(e.ahead(h)) for h in HORIZONS} | {f"_lo{h}": F.min("low").over(e.ahead(h)) for h in HORIZONS} | {f"_cl{h}": F.lead("close", h).over(w) for h in HORIZONS})
    up, down = c("high") > c("ph"), c("low") < c("pl")
    ev = f.where((c("atr") > 0) & (up != down) & (c("row_idx") <= c("n") - far - 1)).withColumns({"break_side": F.when(up, "UP").otherwise("DOWN"), "entry": F.when(up, c("ph")).otherwise(c("pl"))})
    buckets = {"body_ratio": ((0.35, 0.65), ("SMALL_BODY", "MEDIUM_BODY", "STRONG_BODY")), "range_atr": ((0.75, 1.25), ("LOW_RANGE", "NORMAL_RANGE", "EXPANSION_RANGE")), "volume_ratio": ((0.8, 1.5), ("LOW_VOLUME", "NORMAL_VOLUME", "HIGH_VOLUME"))}
    ev = ev.withColumns({f"previous_{n.partition('_')[0]}_bucket": e.bins(c(f"previous_{n}"), *x, right=False) for n, x in buckets.items()})
    for name, width in _CONTEXTS.items():
        above = src.event_bars(spark, d, width).withColumn("color", _color())
        ev = asof.asof_backward(ev, above, "symbol", "time", "time", ["color"], f"{name}_", width)
    wanted = F.when(c("break_side") == "UP", "GREEN").otherwise("RED")
    known = functools.reduce(lambda a, b: a + b, (c(f"{n}_color").isNotNull().cast("int") for n in _CONTEXTS))
    agree = functools.reduce(lambda a, b: a + b, (F.coalesce((c(f"{n}_color") == wanted).cast("int"), F.lit(0)) for n in _CONTEXTS))
    ev = ev.withColumn("directional_alignment", F.when(known < 3, "UNKNOWN_CONTEXT").when(agree == 3, "FULL_ALIGNMENT").when(agree > 0, "PARTIAL_ALIGNMENT").otherwise("NO_ALIGNMENT"))
    mine = Window.partitionBy("symbol")
    n = F.count("*").over(mine)
    ev = ev.withColumn("temporal_split", F.when(F.row_number().over(w) <= F.least(F.greatest(F.floor(n * 0.7), F.lit(1)), n - 1), "TRAIN").otherwise("TEST"))
    sign = F.when(c("break_side") == "UP", 1.0).otherwise(-1.0)
    for h in HORIZONS:
        rise, fall = c(f"_hi{h}") - c("entry"), c("entry") - c(f"_lo{h}")
        ev = ev.withColumns({f"mfe_{h}": F.when(sign > 0, rise).otherwise(fall) / c("atr"), f"mae_{h}": F.when(sign > 0, fall).otherwise(rise) / c("atr"), f"return_{h}": sign * (c(f"_cl{h}") - c("entry")) / c("atr")})
        ev = ev.withColumn(f"success_{h}", (c(f"mfe_{h}") >= 0.5) & (c(f"mfe_{h}") > c(f"mae_{h}")))
    return ev


_MEASURES = ("mfe", "mae", "return", "success")


def _by_horizon(ev: DataFrame) -> DataFrame:
    """A row per event and horizon."""
    keep = ("symbol", "row_idx", "time", "break_side", "previous_color", "directional_alignment", "temporal_split")
    rows = F.explode(F.array(*(F.struct(F.lit(h).alias("horizon"), *(c(f"{m}_{h}").alias(m) for m in _MEASURES)) for h in HORIZONS)))
    return ev.select(*keep, rows.alias("x")).select(*keep, "x.*")


_ABOVE = {"h1": "1 hour", "h4": "4 hours", "d1": "1 day"}
_COLOR = "CASE WHEN close > open THEN 'GREEN' WHEN close < open THEN 'RED' ELSE 'DOJI' END"
_DNA = f"""WITH RECURSIVE {q.bars(_WIDTH)}, {q.base()}, {', '.join(q.bars(x, n) for n, x in _ABOVE.items())},
f0 AS (SELECT *, count(*) OVER (PARTITION BY symbol) AS n, {_COLOR} AS color, abs(close - open) / nullif(high - low, 0) AS body_ratio, nullif(high - low, 0) / nullif(atr, 0) AS range_atr, volume / CASE WHEN count(volume) OVER {q.past(20)} >= 5 THEN avg(volume) OVER {q.past(20)} END AS volume_ratio FROM b),
f AS (SELECT *, {', '.join(f'lag({x}) OVER {q.W} AS previous_{x}' for x in ('color', 'body_ratio', 'range_atr', 'volume_ratio'))}, {', '.join(f'max(high) OVER {q.ahead(h)} AS hi{h}, min(low) OVER {q.ahead(h)} AS lo{h}, lead(close, {h}) OVER {q.W} AS cl{h}' for h in HORIZONS)} FROM f0),
e0 AS (SELECT *, CASE WHEN high > ph THEN 'UP' ELSE 'DOWN' END AS break_side, CASE WHEN high > ph THEN 1 ELSE -1 END AS sg, CASE WHEN high > ph THEN ph ELSE pl END AS entry FROM f WHERE atr > 0 AND ((high > ph) <> (low < pl)) AND row_idx <= n - 61),
e1 AS (SELECT e0.*, h1.c AS c1, h4.c AS c4, d1.c AS cd FROM e0 ASOF LEFT JOIN (SELECT symbol, time + INTERVAL '1 hour' AS t, {_COLOR} AS c FROM h1) h1 ON e0.symbol = h1.symbol AND e0.time >= h1.t ASOF LEFT JOIN (SELECT symbol, time + INTERVAL '4 hours' AS t, {_COLOR} AS c FROM h4) h4 ON e0.symbol = h4.symbol AND e0.time >= h4.t ASOF LEFT JOIN (SELECT symbol, time + INTERVAL '1 day' AS t, {_COLOR} AS c FROM d1) d1 ON e0.symbol = d1.symbol AND e0.time >= d1.t),
e2 AS (SELECT *, coalesce((c1 = w)::INT, 0) + coalesce((c4 = w)::INT, 0) + coalesce((cd = w)::INT, 0) AS agree FROM (SELECT *, CASE WHEN sg = 1 THEN 'GREEN' ELSE 'RED' END AS w FROM e1)),
ev AS (SELECT *, CASE WHEN c1 IS NULL OR c4 IS NULL OR cd IS NULL THEN 'UNKNOWN_CONTEXT' WHEN agree = 3 THEN 'FULL_ALIGNMENT' WHEN agree > 0 THEN 'PARTIAL_ALIGNMENT' ELSE 'NO_ALIGNMENT' END AS directional_alignment,
CASE WHEN row_number() OVER {q.W} <= least(greatest(floor(count(*) OVER (PARTITION BY symbol) * 0.7::DOUBLE), 1), count(*) OVER (PARTITION BY symbol) - 1) THEN 'TRAIN' ELSE 'TEST' END AS temporal_split FROM e2),
lg AS ({' UNION ALL '.join(f"SELECT *, {h} AS horizon, CASE WHEN sg = 1 THEN hi{h} - entry ELSE entry - lo{h} END / atr AS mfe, CASE WHEN sg = 1 THEN entry - lo{h} ELSE hi{h} - entry END / atr AS mae, sg * (cl{h} - entry) / atr AS ret FROM ev" for h in HORIZONS)}),
sp AS (SELECT *, ret AS return, mfe >= 0.5 AND mfe > mae AS success FROM lg)"""


def _lc(x: str, edges: tuple, names: tuple) -> str:
    return f"CASE WHEN {x} IS NULL THEN 'UNKNOWN' WHEN {x} < {edges[0]} THEN '{names[0]}' WHEN {x} < {edges[1]} THEN '{names[1]}' ELSE '{names[2]}' END"


@query(f"{_DNA} SELECT symbol, time, break_side, previous_color, {_lc('previous_body_ratio', (0.35, 0.65), ('SMALL_BODY', 'MEDIUM_BODY', 'STRONG_BODY'))} AS previous_body_bucket, {_lc('previous_range_atr', (0.75, 1.25), ('LOW_RANGE', 'NORMAL_RANGE', 'EXPANSION_RANGE'))} AS previous_range_bucket, {_lc('previous_volume_ratio', (0.8, 1.5), ('LOW_VOLUME', 'NORMAL_VOLUME', 'HIGH_VOLUME'))} AS previous_volume_bucket, directional_alignment, temporal_split, round(abs(close - entry) / atr, 6) AS break_distance_atr, round(mfe, 6) AS mfe, round(mae, 6) AS mae, round(return, 6) AS return, success FROM sp WHERE horizon = 15")
def volatility_dna(spark, d):
    ev = _break_events(spark, d).withColumn("break_distance_atr", F.abs(c("close") - c("entry")) / c("atr"))
    return rounded(ev.select("symbol", "time", "break_side", "previous_color", "previous_body_bucket", "previous_range_bucket", "previous_volume_bucket", "directional_alignment", "temporal_split", "break_distance_atr", c("mfe_15").alias("mfe"), c("mae_15").alias("mae"), c("return_15").alias("return"), c("success_15").alias("success")))


_KEYS = ("symbol", "break_side", "previous_color")


@query(f"{_DNA} SELECT {', '.join(_KEYS)}, horizon, count(*) AS sample_size, CASE WHEN count(*) >= 200 THEN 'ADEQUATE' ELSE 'INSUFFICIENT_SAMPLE' END AS sample_status, round(avg(success::INT), 6) AS success_rate, round(avg(mfe), 6) AS avg_mfe_atr, round(avg(mae), 6) AS avg_mae_atr, round(avg(return), 6) AS avg_return_atr, round(median(return), 6) AS median_return_atr FROM sp GROUP BY ALL")
def dna_by_horizon(spark, d):
    g = _by_horizon(_break_events(spark, d)).groupBy(*_KEYS, "horizon")
    out = g.agg(F.count("*").alias("sample_size"), F.avg(c("success").cast("int")).alias("success_rate"), F.avg("mfe").alias("avg_mfe_atr"), F.avg("mae").alias("avg_mae_atr"), F.avg("return").alias("avg_return_atr"), F.percentile("return", F.lit(0.5)).alias("median_return_atr"))
    return rounded(out.withColumn("sample_status", F.when(c("sample_size") >= 200, "ADEQUATE").otherwise("INSUFFICIENT_SAMPLE")))


@query(f"""{_DNA}, a AS (SELECT {', '.join(_KEYS)}, horizon, temporal_split, count(*) AS n, avg(success::INT) AS rate, avg(return) AS mean FROM sp GROUP BY ALL), t AS (SELECT * FROM a WHERE temporal_split = 'TRAIN'), u AS (SELECT * FROM a WHERE temporal_split = 'TEST')
SELECT {', '.join(f'coalesce(t.{k}, u.{k}) AS {k}' for k in (*_KEYS, 'horizon'))}, t.n AS n_train, u.n AS n_test, round(t.rate, 6) AS rate_train, round(u.rate, 6) AS rate_test, round(t.mean, 6) AS return_train, round(u.mean, 6) AS return_test,
CASE WHEN t.n >= 200 AND u.n >= 80 AND t.rate >= 0.55 AND u.rate >= 0.55 AND t.mean > 0 AND u.mean > 0 THEN 'STABLE_POSITIVE' WHEN t.n >= 200 AND u.n >= 80 AND t.rate < 0.45 AND u.rate < 0.45 AND t.mean < 0 AND u.mean < 0 THEN 'STABLE_NEGATIVE' ELSE 'NOT_STABLE' END AS status FROM t FULL JOIN u ON {' AND '.join(f't.{k} IS NOT DISTINCT FROM u.{k}' for k in (*_KEYS, 'horizon'))}""")
def dna_stability(spark, d, min_train: int = 200, min_test: int = 80):
    keys = (*_KEYS, "horizon")
    a = _by_horizon(_break_events(spark, d)).groupBy(*keys, "temporal_split").agg(F.count("*").alias("n"), F.avg(c("success").cast("int")).alias("rate"), F.avg("return").alias("mean"))
    t, u = (a.where(c("temporal_split") == s.upper()).select(*(c(k).alias(f"{k}_{s}") for k in keys), *(c(n).alias(f"{n}_{s}") for n in ("n", "rate", "mean"))) for s in ("train", "test"))
    same = functools.reduce(lambda x, y: x & y, (c(f"{k}_train").eqNullSafe(c(f"{k}_test")) for k in keys))
    enough = (c("n_train") >= min_train) & (c("n_test") >= min_test)
    good = enough & (c("rate_train") >= 0.55) & (c("rate_test") >= 0.55) & (c("mean_train") > 0) & (c("mean_test") > 0)
    poor = enough & (c("rate_train") < 0.45) & (c("rate_test") < 0.45) & (c("mean_train") < 0) & (c("mean_test") < 0)
    j = t.join(u, same, "full")
    return rounded(j.select(*(F.coalesce(f"{k}_train", f"{k}_test").alias(k) for k in keys), "n_train", "n_test", "rate_train", "rate_test", c("mean_train").alias("return_train"), c("mean_test").alias("return_test"), F.when(good, "STABLE_POSITIVE").when(poor, "STABLE_NEGATIVE").otherwise("NOT_STABLE").alias("status")))


def _independent(spark, d) -> DataFrame:
    """For each horizon, the events whose outcome windows don't overlap: of each side, and of each side and previous color (scope)."""
    rows = _by_horizon(_break_events(spark, d)).withColumn("scope", F.explode(F.array(F.lit("SIDE"), F.lit("KEYS"))))
    rows = rows.withColumns({"_key": F.when(c("scope") == "KEYS", c("previous_color")), "_at": F.unix_seconds(c("time").cast("timestamp")), "_gap": c("horizon") * 900})
    return sequential.thin(rows, "_gap", ("symbol", "horizon", "scope", "break_side", "_key", "_gap"), "_at").drop("_key", "_at", "_gap")


_THIN = f"""{_DNA}, th0 AS (SELECT *, scope, CASE WHEN scope = 'KEYS' THEN previous_color ELSE '' END AS kc FROM sp, (VALUES ('SIDE'), ('KEYS')) v(scope)),
th1 AS MATERIALIZED (SELECT *, dense_rank() OVER (ORDER BY symbol, horizon, scope, break_side, kc) AS g, epoch(time)::BIGINT AS tsec FROM th0),
th2 AS MATERIALIZED (SELECT *, min(tsec) OVER (PARTITION BY g ORDER BY tsec RANGE BETWEEN (horizon * 900) FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM th1),
th3 AS (SELECT g, min(tsec) AS tsec FROM th2 GROUP BY g UNION ALL SELECT th2.g, th2.nxt FROM th3 JOIN th2 ON th2.g = th3.g AND th2.tsec = th3.tsec WHERE th2.nxt IS NOT NULL),
ind AS (SELECT th2.* FROM th2 JOIN th3 USING (g, tsec))"""


@query(f"{_THIN} SELECT symbol, time, horizon, scope, break_side, previous_color, success FROM ind")
def independent_events(spark, d):
    return _independent(spark, d).select("symbol", "time", "horizon", "scope", "break_side", "previous_color", "success")


@query(f"""{_THIN}, bs AS (SELECT symbol, horizon, break_side, avg(success::INT) AS b_rate, avg(return) AS b_ret FROM ind WHERE scope = 'SIDE' GROUP BY ALL),
nk AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY tsec) AS k, count(*) OVER (PARTITION BY g) AS m FROM ind WHERE scope = 'KEYS'),
bl AS (SELECT *, greatest(0, ceil((k - 1) * 5.0 / (m - 1)) - 1)::INT AS block, k <= least(greatest(floor(m * 0.7::DOUBLE), 1), m - 1) AS early FROM nk WHERE m >= 2),
bk AS (SELECT g, count(*) AS valid_blocks, count(*) FILTER (r > 0) AS positive_blocks, count(*) FILTER (r < 0) AS negative_blocks FROM (SELECT g, block, avg(return) AS r FROM bl WHERE m >= 5 GROUP BY ALL HAVING count(*) >= 20) GROUP BY g),
st AS (SELECT g, symbol, horizon, break_side, previous_color, count(*) AS n, count(*) FILTER (early) AS n_train, count(*) FILTER (NOT early) AS n_test, avg(success::INT) FILTER (early) AS s1, avg(success::INT) FILTER (NOT early) AS s2, avg(return) FILTER (early) AS r1, avg(return) FILTER (NOT early) AS r2 FROM bl GROUP BY ALL),
jn AS (SELECT st.*, coalesce(valid_blocks, 0) AS vb, coalesce(positive_blocks, 0) AS pb, coalesce(negative_blocks, 0) AS nb, s1 - b_rate AS sl1, s2 - b_rate AS sl2, r1 - b_ret AS rl1, r2 - b_ret AS rl2 FROM st LEFT JOIN bk USING (g) JOIN bs USING (symbol, horizon, break_side))
SELECT symbol, horizon, break_side, previous_color, n, n_train, n_test, vb AS valid_blocks, pb AS positive_blocks, nb AS negative_blocks, round(sl1, 6) AS success_lift_train, round(sl2, 6) AS success_lift_test, round(rl1, 6) AS return_lift_train, round(rl2, 6) AS return_lift_test,
CASE WHEN n_train >= 100 AND n_test >= 40 AND vb >= 4 AND r1 > 0 AND r2 > 0 AND sl1 >= 0.03 AND sl2 >= 0.03 AND rl1 >= 0.05 AND rl2 >= 0.05 AND pb >= 4 THEN 'ROBUST_POSITIVE' WHEN n_train >= 100 AND n_test >= 40 AND vb >= 4 AND r1 < 0 AND r2 < 0 AND sl1 <= -0.03 AND sl2 <= -0.03 AND rl1 <= -0.05 AND rl2 <= -0.05 AND nb >= 4 THEN 'ROBUST_NEGATIVE' ELSE 'NOT_ROBUST' END AS robust_status FROM jn""")
def robust_candidates(spark, d):
    """Lifts of independent events over their side's, in training and test time, and their signs over five blocks of time."""
    keys, side = ["symbol", "horizon", "break_side", "previous_color"], ["symbol", "horizon", "break_side"]
    ind = _independent(spark, d).withColumn("s", c("success").cast("int"))
    usual = ind.where("scope = 'SIDE'").groupBy(*side).agg(F.avg("s").alias("b_rate"), F.avg("return").alias("b_ret"))
    of = Window.partitionBy(*keys)
    rows = ind.where("scope = 'KEYS'").withColumns({"k": F.row_number().over(of.orderBy("time")), "m": F.count("*").over(of)}).where("m >= 2")
    rows = rows.withColumns({"block": e.equal_blocks(c("k"), c("m"), 5), "tr": c("k") <= F.least(F.greatest(F.floor(c("m") * 0.7), F.lit(1)), c("m") - 1)})
    blocks = rows.where("m >= 5").groupBy(*keys, "block").agg(F.avg("return").alias("r"), F.count("*").alias("size")).where("size >= 20")
    signs = blocks.groupBy(*keys).agg(F.count("*").alias("valid_blocks"), F.count_if(c("r") > 0).alias("positive_blocks"), F.count_if(c("r") < 0).alias("negative_blocks"))
    train, test = (lambda x: F.when(c("tr"), x)), (lambda x: F.when(~c("tr"), x))
    stats = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if("tr").alias("n_train"), F.count_if(~c("tr")).alias("n_test"), *(F.avg(pick(c(x))).alias(n) for n, x, pick in (("s1", "s", train), ("s2", "s", test), ("r1", "return", train), ("r2", "return", test))))
    j = stats.join(signs, keys, "left").join(usual, side).na.fill(0, ["valid_blocks", "positive_blocks", "negative_blocks"])
    lifts = {"success_lift_train": c("s1") - c("b_rate"), "success_lift_test": c("s2") - c("b_rate"), "return_lift_train": c("r1") - c("b_ret"), "return_lift_test": c("r2") - c("b_ret")}
    j = j.withColumns(lifts)
    enough = (c("n_train") >= 100) & (c("n_test") >= 40) & (c("valid_blocks") >= 4)

    def all_of(sign: int, signed: str) -> Column:
        least = {n: 0.03 if n.startswith("success") else 0.05 for n in lifts}
        tests = [sign * c(n) >= x for n, x in least.items()] + [sign * c("r1") > 0, sign * c("r2") > 0, c(signed) >= 4]
        return functools.reduce(lambda a, b: a & b, tests, enough)

    status = F.when(all_of(1, "positive_blocks"), "ROBUST_POSITIVE").when(all_of(-1, "negative_blocks"), "ROBUST_NEGATIVE").otherwise("NOT_ROBUST")
    return rounded(j.select(*keys, "n", "n_train", "n_test", "valid_blocks", "positive_blocks", "negative_blocks", *lifts, status.alias("robust_status")))


_EDGE = f"WITH RECURSIVE {q.bars()}, {q.base()}, u AS ({q.touch('atr', '0.5 * atr', 12, '1')}), y AS (SELECT b.*, CASE u.label WHEN 'TP_FIRST' THEN 1 WHEN 'SL_FIRST' THEN -1 ELSE 0 END AS edge FROM b LEFT JOIN u ON u.symbol = b.symbol AND u.time = b.time WHERE atr > 0)"


def _edges(spark, d):
    z = touch.both_sides(base(spark, d)).where("atr > 0")
    return z.withColumn("edge", F.when(c("buy_label") == "TP_FIRST", 1).when(c("buy_label") == "SL_FIRST", -1).otherwise(0))


@query(f"{_EDGE} SELECT symbol, count(*) AS n, round(avg(edge), 6) AS edge, round(avg(edge) - 1.96 * stddev_samp(edge) / sqrt(count(*)), 6) AS ci_low, round(avg(edge) + 1.96 * stddev_samp(edge) / sqrt(count(*)), 6) AS ci_high, CASE WHEN count(*) >= 120 AND avg(edge) > 0.1 THEN 'VALIDATED' WHEN count(*) >= 80 AND avg(edge) > 0.05 THEN 'PROVISIONAL' ELSE 'REJECTED' END AS status FROM y GROUP BY 1")
def law_stats(spark, d):
    g = _edges(spark, d).groupBy("symbol").agg(F.count("*").alias("n"), F.avg("edge").alias("edge"), (1.96 * F.stddev_samp("edge") / F.sqrt(F.count("*"))).alias("half"))
    status = F.when((c("n") >= 120) & (c("edge") > 0.1), "VALIDATED").when((c("n") >= 80) & (c("edge") > 0.05), "PROVISIONAL").otherwise("REJECTED")
    return rounded(g.select("symbol", "n", "edge", (c("edge") - c("half")).alias("ci_low"), (c("edge") + c("half")).alias("ci_high"), status.alias("status")))


@query(f"{_EDGE}, w AS (SELECT *, ntile(10) OVER (PARTITION BY symbol ORDER BY time) AS block FROM y), g AS (SELECT symbol, block, avg(edge) AS edge FROM w GROUP BY 1, 2 HAVING count(*) >= 15) SELECT symbol, count(*) AS windows_tested, round(avg((edge > 0)::INT), 6) AS positive_window_ratio, round(min(edge), 6) AS worst_edge FROM g GROUP BY 1")
def law_stability(spark, d):
    w = _edges(spark, d).withColumn("block", F.ntile(10).over(e.series()))
    g = w.groupBy("symbol", "block").agg(F.avg("edge").alias("edge"), F.count("*").alias("n")).where("n >= 15")
    return rounded(g.groupBy("symbol").agg(F.count("*").alias("windows_tested"), F.avg((c("edge") > 0).cast("int")).alias("positive_window_ratio"), F.min("edge").alias("worst_edge")))


@query(f"{_EDGE}, r AS (SELECT *, row_number() OVER {q.W} AS k, count(*) OVER (PARTITION BY symbol) AS n FROM y), z AS (SELECT symbol, greatest(0, ceil((k - 1) * 5.0 / (n - 1)) - 1)::INT AS block, edge FROM r), g AS (SELECT symbol, block, count(*) AS n, sum((edge = 1)::INT)::BIGINT AS hits FROM z GROUP BY 1, 2) SELECT symbol, block, n, hits, round((hits / n + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) - 1.96 * sqrt(hits / n * (1 - hits / n) / n + 1.96 * 1.96 / (4 * n * n)) / (1 + 1.96 * 1.96 / n), 6) AS wilson_low FROM g")
def block_wilson(spark, d):
    r = _edges(spark, d).withColumns({"k": F.row_number().over(e.series()), "n": F.count("*").over(Window.partitionBy("symbol"))})
    g = r.groupBy("symbol", e.equal_blocks(c("k"), c("n"), 5).alias("block")).agg(F.count("*").alias("n"), F.sum((c("edge") == 1).cast("long")).alias("hits"))
    return rounded(g.select("symbol", "block", "n", "hits", e.wilson(c("hits"), c("n"))[0].alias("wilson_low")))


@query(f"""{_DNA}, m AS (SELECT *, tr / atr AS v FROM sp WHERE horizon = 15), qs AS (SELECT symbol, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS q2, quantile_cont(v, 0.75) AS q3 FROM m WHERE temporal_split = 'TRAIN' GROUP BY 1),
bk AS (SELECT m.*, CASE WHEN v <= q1 THEN 'Q1' WHEN v <= q2 THEN 'Q2' WHEN v <= q3 THEN 'Q3' ELSE 'Q4' END AS bucket FROM m JOIN qs ON m.symbol = qs.symbol), bs AS (SELECT temporal_split, avg(success::INT) AS base_rate FROM m GROUP BY 1)
SELECT bucket, bk.temporal_split, count(*) AS n, round(avg(success::INT) - any_value(base_rate), 6) AS lift FROM bk JOIN bs ON bk.temporal_split = bs.temporal_split GROUP BY 1, 2""")
def miner_lift(spark, d):
    ev = _break_events(spark, d).withColumns({"x": c("tr") / c("atr"), "s": c("success_15").cast("int")})
    edges = ev.where("temporal_split = 'TRAIN'").groupBy("symbol").agg(F.percentile("x", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("qs"))
    rates = ev.groupBy("temporal_split").agg(F.avg("s").alias("base_rate"))
    j = ev.join(edges, "symbol").join(F.broadcast(rates), "temporal_split")  # two rows
    bucket = F.when(c("x") <= c("qs")[0], "Q1").when(c("x") <= c("qs")[1], "Q2").when(c("x") <= c("qs")[2], "Q3").otherwise("Q4")
    return rounded(j.groupBy(bucket.alias("bucket"), "temporal_split").agg(F.count("*").alias("n"), (F.avg("s") - F.max("base_rate")).alias("lift")))


@query(f"""{_ST}, laws AS (SELECT * FROM (VALUES ('LAW_A', 'UP', 'BREAKOUT', 0.0, 1.0), ('LAW_B', 'DOWN', 'BREAKOUT', 0.0, 1.0), ('LAW_C', 'UP', 'FALSE_BREAK', 0.5, 3.0), ('LAW_D', 'DOWN', 'FALSE_BREAK', 0.5, 3.0)) l(law_id, direction, event_name, low_ratio, high_ratio))
SELECT law_id, symbol, count(*) AS matches, min(time) AS first_match FROM s JOIN laws ON s.direction = laws.direction AND s.event_name = laws.event_name AND (high - low) / (atr + 1e-9) BETWEEN low_ratio AND high_ratio GROUP BY 1, 2""")
def law_match(spark, d):
    laws = spark.createDataFrame([("LAW_A", "UP", "BREAKOUT", 0.0, 1.0), ("LAW_B", "DOWN", "BREAKOUT", 0.0, 1.0), ("LAW_C", "UP", "FALSE_BREAK", 0.5, 3.0), ("LAW_D", "DOWN", "FALSE_BREAK", 0.5, 3.0)], "law_id string, law_dir string, law_event string, low_ratio double, high_ratio double")
    s = _states(spark, d).withColumn("ratio", e.guarded(c("high") - c("low"), c("atr")))
    met = s.join(F.broadcast(laws), (c("direction") == c("law_dir")) & (c("event_name") == c("law_event")) & c("ratio").between(c("low_ratio"), c("high_ratio")))  # a fixed table of rules
    return met.groupBy("law_id", "symbol").agg(F.count("*").alias("matches"), F.min("time").alias("first_match"))
