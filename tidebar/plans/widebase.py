"""Queries over the wide base: bars of 15 minutes with those of one hour, four hours and a day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.operators import features, levels, touch, wide
from tidebar.plans import sqlparts as q
from tidebar.plans.bars_and_features import _IND, rounded
from tidebar.plans.blocks import _Z
from tidebar.plans.research import _PR
from tidebar.sources import bars as src

c = F.col
QUERIES, SQL = {}, {}
LARGER = {"h1": "1 hour", "h4": "4 hours", "d1": "1 day"}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def wide_base(spark, d) -> DataFrame:
    larger = {n: (src.event_bars(spark, d, w), w) for n, w in LARGER.items()}
    return wide.core(wide.with_larger(wide.anchor(src.event_bars(spark, d, "15 minutes")), larger), list(LARGER))


def _bins(x: str, edges, names, missing="UNKNOWN") -> str:
    return f"CASE WHEN {x} IS NULL THEN '{missing}' " + " ".join(f"WHEN {x} <= {e} THEN '{n}'" for e, n in zip(edges, names, strict=False)) + f" ELSE '{names[-1]}' END"


_IND_M = _IND.replace("FROM b)", "FROM m)", 1)
_DIR = "CASE WHEN {0}close > {0}open THEN 'UP' WHEN {0}close < {0}open THEN 'DOWN' ELSE 'FLAT' END"
_BRT = "((time AT TIME ZONE 'UTC') AT TIME ZONE 'America/Sao_Paulo')"
_SHARE = "CASE WHEN count({0}) OVER (PARTITION BY symbol) < 50 THEN 0.5 WHEN {0} IS NULL THEN 0.5 ELSE " + _PR + " END"
_E = {"e1": ("vol_ratio", 5, 0.30), "e2": ("range_atr", 5, 0.30), "e3": ("body_atr", 3, 0.20), "e4": ("h1_adx_14", 80, 0.15)}


def _wide_sql() -> str:
    parts = [q.bars("15 minutes"), q.base(), q.smoothed(), _IND_M, _Z]
    for n, w in LARGER.items():
        parts += [q.bars(w, f"{n}_bars"), q.base(f"{n}_bars", f"{n}_b"), q.smoothed(f"{n}_b", f"{n}_m")]
    distances = ", ".join(f"(close - {x}) / (nullif(atr, 0) + 1e-9) AS dist_{n}_atr" for n, x in levels.DISTANCES.items())
    parts.append(f"""a0 AS (SELECT * EXCLUDE (dist_sma200_atr), {distances}, {q.FLAGS}, {_DIR.format('')} AS direction, high - low AS range_usd, close - open AS net_usd, (high - low) / (atr + 1e-9) AS range_atr, abs(close - open) / (atr + 1e-9) AS body_atr, (close - low) / (nullif(high - low, 0) + 1e-9) AS close_pos, hour({_BRT})::INT AS hour_brt, strftime({_BRT}, '%H:%M') AS time_slot,
(close - ph) / (atr + 1e-9) AS dist_prev_high_atr, (close - pl) / (atr + 1e-9) AS dist_prev_low_atr, {q.flag('high > ph AND close < ph', 'sweep_high')}, {q.flag('low < pl AND close > pl', 'sweep_low')}, {q.flag('atr_z < -1 AND bb_width_z < -1', 'compression_flag')}, {q.flag('atr_z > 1 OR bb_width_z > 1', 'expansion_flag')} FROM y)""")
    parts.append(f"a1 AS (SELECT *, {', '.join(f'{_bins(x, *y)} AS {n}' for n, (x, *y) in wide.CHOSEN.items())}, CASE WHEN breakout_up + breakout_down > 0 THEN 'ACCEPTED_BREAKOUT' WHEN false_breakout_up + false_breakout_down + sweep_high + sweep_low > 0 THEN 'SWEEP_OR_FALSE_BREAK' WHEN compression_flag = 1 THEN 'COMPRESSION' WHEN expansion_flag = 1 THEN 'EXPANSION' WHEN range_atr < 0.5 THEN 'LOW_RANGE' ELSE 'NORMAL_FLOW' END AS market_state FROM a0)")
    joins = " ".join(f"ASOF LEFT JOIN (SELECT symbol AS s_{n}, time + INTERVAL '{w}' AS t_{n}, open AS {n}_open, high AS {n}_high, low AS {n}_low, close AS {n}_close, atr AS {n}_atr, adx_14 AS {n}_adx_14, {_DIR.format('')} AS {n}_direction FROM {n}_m) {n} ON a1.symbol = s_{n} AND a1.time >= t_{n}" for n, w in LARGER.items())
    votes = " + ".join(f"coalesce(CASE {x} WHEN 'UP' THEN 1 WHEN 'DOWN' THEN -1 ELSE 0 END, 0)" for x in ("direction", *(f"{n}_direction" for n in LARGER)))
    parts.append(f"a2 AS (SELECT * FROM a1 {joins})")
    parts.append(f"a3 AS (SELECT *, ({votes})::INT AS mtf_alignment_score, {', '.join(f'CASE WHEN {x} IS NOT NULL THEN least(greatest({x}, 0), {top}) END AS {n}' for n, (x, top, _) in _E.items())} FROM a2)")
    energy = " + ".join(f"{w} * ({_SHARE.format(n)})" for n, (_, _, w) in _E.items())
    near = {"nearest_resistance_atr": "high", "nearest_support_atr": "low"}
    parts.append(f"a4 AS (SELECT *, CASE WHEN mtf_alignment_score > 0 THEN 'UP' WHEN mtf_alignment_score < 0 THEN 'DOWN' ELSE 'MIXED' END AS mtf_bias, {_bins('abs(mtf_alignment_score)', (0, 1, 2, 3), ('NONE', 'WEAK', 'MIXED', 'STRONG', 'FULL'))} AS mtf_alignment_bucket, least(100, greatest(0, 100 * ({energy} + 0.1 * expansion_flag + 0.05 * compression_flag))) AS energy_score, {', '.join(f'least(abs(dist_prev_{s}_atr), abs(dist_donchian_{s}20_atr), abs(dist_bb_{s}_atr)) AS {n}' for n, s in near.items())} FROM a3)")
    bucket = ((0.15, 0.35, 0.75, 1.5), ("TOUCHING", "VERY_NEAR", "NEAR", "FAR", "VERY_FAR"))
    parts.append(f"a5 AS (SELECT *, {_bins('energy_score', *wide.ENERGY)} AS energy_bucket, {_bins('nearest_resistance_atr', *bucket)} AS resistance_bucket, {_bins('nearest_support_atr', *bucket)} AS support_bucket FROM a4)")
    parts.append("""wb AS MATERIALIZED (SELECT *, CASE WHEN resistance_bucket IN ('TOUCHING', 'VERY_NEAR') THEN 'AT_RESISTANCE' WHEN support_bucket IN ('TOUCHING', 'VERY_NEAR') THEN 'AT_SUPPORT' WHEN resistance_bucket = 'NEAR' THEN 'NEAR_RESISTANCE' WHEN support_bucket = 'NEAR' THEN 'NEAR_SUPPORT' ELSE 'NO_LEVEL_PRESSURE' END AS level_zone,
CASE WHEN breakout_up + breakout_down > 0 THEN 'BREAKOUT' WHEN false_breakout_up + false_breakout_down > 0 THEN 'FALSE_BREAK' WHEN sweep_high + sweep_low > 0 THEN 'SWEEP' WHEN compression_flag = 1 THEN 'COMPRESSION' WHEN expansion_flag = 1 THEN 'EXPANSION' ELSE 'NONE' END AS event_name, direction || '|R:' || range_bucket || '|B:' || body_bucket || '|V:' || vol_bucket || '|C:' || close_position_bucket || '|S:' || market_state AS candle_dna FROM a5)""")
    return "WITH RECURSIVE " + ",\n".join(parts)


_WIDE = _wide_sql()
_TEXT = ["direction", "time_slot", "market_state", "vol_bucket", "range_bucket", "body_bucket", "close_position_bucket", "mtf_alignment_score", "mtf_alignment_bucket", "mtf_bias", "energy_bucket", "resistance_bucket", "support_bucket", "level_zone", "event_name", "candle_dna", "h1_direction", "h4_direction", "d1_direction", "hour_brt"]
_NUMBERS = ["range_usd", "net_usd", "range_atr", "body_atr", "vol_ratio", "energy_score", "nearest_resistance_atr", "nearest_support_atr", "h1_high", "h4_low", "d1_close", "h1_atr", "h1_adx_14", "h4_adx_14"]


@query(f"{_WIDE} SELECT symbol, time, {', '.join(_TEXT)}, {', '.join(f'round({n}, 5) AS {n}' for n in _NUMBERS)} FROM wb")
def mtf_base(spark, d):
    return rounded(wide_base(spark, d).select("symbol", "time", *_TEXT, *_NUMBERS), 5)


_SETUP = f"""{_WIDE}, s0 AS (SELECT *, CASE WHEN mtf_bias = 'UP' AND direction = 'UP' THEN 'BUY_ALIGNED' WHEN mtf_bias = 'DOWN' AND direction = 'DOWN' THEN 'SELL_ALIGNED' WHEN mtf_bias = 'UP' THEN 'BUY_MTF_ONLY' WHEN mtf_bias = 'DOWN' THEN 'SELL_MTF_ONLY' ELSE 'MIXED' END AS setup_side_context, CASE WHEN level_zone LIKE '%RESISTANCE' THEN 'RESISTANCE_ZONE' WHEN level_zone LIKE '%SUPPORT' THEN 'SUPPORT_ZONE' ELSE 'MID_RANGE' END AS setup_location_context FROM wb),
s1 AS (SELECT *, CASE WHEN event_name IN ('BREAKOUT', 'FALSE_BREAK') THEN CASE WHEN setup_location_context = 'MID_RANGE' THEN 'NO_EVENT' ELSE replace(setup_location_context, '_ZONE', '_') || event_name END WHEN event_name = 'NONE' THEN 'NO_EVENT' ELSE event_name END AS setup_event_context FROM s0),
su AS (SELECT *, 'state=' || market_state || '|setup=' || setup_event_context || '|side=' || setup_side_context || '|loc=' || setup_location_context || '|energy=' || energy_bucket || '|align=' || mtf_alignment_bucket || '/' || mtf_bias AS setup_genome_macro FROM s1)"""


@query(f"{_SETUP} SELECT symbol, time, setup_side_context, setup_location_context, setup_event_context, setup_genome_macro, 'hour=' || hour_brt || '|' || setup_genome_macro || '|vol=' || vol_bucket AS setup_genome_time FROM su")
def setup_genome(spark, d):
    s = wide.setup(wide_base(spark, d))
    return s.select("symbol", "time", "setup_side_context", "setup_location_context", "setup_event_context", "setup_genome_macro", F.concat(F.lit("hour="), c("hour_brt").cast("string"), F.lit("|"), "setup_genome_macro", F.lit("|vol="), "vol_bucket").alias("setup_genome_time"))


def _location_sql() -> str:
    edges = (-0.05, 0.20, 0.45, 0.55, 0.80, 1.05)
    first = ", ".join(f"({n}_high - close) / nullif(atr, 0) AS dist_{n}_high_atr, (close - {n}_low) / nullif(atr, 0) AS dist_{n}_low_atr, CASE WHEN {n}_high <> {n}_low THEN least(3, greatest(-2, (close - {n}_low) / ({n}_high - {n}_low))) END AS pos_in_{n}_range" for n in LARGER)
    places = ", ".join(f"{_bins(f'pos_in_{n}_range', edges, [f'BELOW_{n.upper()}_LOW', f'LOWER_{n.upper()}_RANGE', f'LOW_MID_{n.upper()}', f'MID_{n.upper()}', f'HIGH_MID_{n.upper()}', f'UPPER_{n.upper()}_RANGE', f'ABOVE_{n.upper()}_HIGH'], f'UNKNOWN_{n.upper()}')} AS {n}_range_location" for n in LARGER)
    up = " + ".join(f"regexp_matches({n}_range_location, 'ABOVE|UPPER|HIGH_MID')::INT + coalesce(({n}_direction = 'UP')::INT, 0)" for n in LARGER)
    down = " + ".join(f"regexp_matches({n}_range_location, 'BELOW|LOWER|LOW_MID')::INT + coalesce(({n}_direction = 'DOWN')::INT, 0)" for n in LARGER)
    return f"{_SETUP}, l0 AS (SELECT *, {first} FROM su), l1 AS (SELECT *, {places} FROM l0), l2 AS (SELECT *, ({up})::INT AS up_p, ({down})::INT AS dn_p FROM l1), lo AS (SELECT *, up_p - dn_p AS bs FROM l2)"


_LOC = _location_sql()
_PLACES = [f"{n}_range_location" for n in LARGER]


@query(f"{_LOC} SELECT symbol, time, {', '.join(_PLACES)}, {', '.join(f'round(dist_{n}_{s}_atr, 5) AS dist_{n}_{s}_atr, coalesce(dist_{n}_{s}_atr BETWEEN -0.05 AND 0.35, false) AS {n}_near_{s}' for n in LARGER for s in ('high', 'low'))}, up_p AS htf_location_up_pressure, dn_p AS htf_location_down_pressure, bs AS htf_location_bias_score, CASE WHEN bs >= 3 THEN 'STRONG_UP_LOCATION' WHEN bs <= -3 THEN 'STRONG_DOWN_LOCATION' WHEN bs > 0 THEN 'UP_LOCATION' WHEN bs < 0 THEN 'DOWN_LOCATION' ELSE 'MIXED_LOCATION' END AS htf_location_bias, CASE WHEN breakout_up = 1 AND bs > 0 THEN 'BREAKOUT_WITH_HTF_UP' WHEN breakout_down = 1 AND bs < 0 THEN 'BREAKOUT_WITH_HTF_DOWN' WHEN breakout_up = 1 AND bs < 0 THEN 'BREAKOUT_AGAINST_HTF_DOWN' WHEN breakout_down = 1 AND bs > 0 THEN 'BREAKOUT_AGAINST_HTF_UP' WHEN breakout_up + breakout_down > 0 THEN 'BREAKOUT_MIXED_HTF' ELSE 'NO_BREAKOUT' END AS breakout_location_alignment FROM lo")
def htf_location(spark, d):
    b = wide.location(wide.setup(wide_base(spark, d)), list(LARGER))
    near = [x for n in LARGER for s in ("high", "low") for x in (f"dist_{n}_{s}_atr", f"{n}_near_{s}")]
    return rounded(b.select("symbol", "time", *_PLACES, *near, "htf_location_up_pressure", "htf_location_down_pressure", "htf_location_bias_score", "htf_location_bias", "breakout_location_alignment"), 5)


_CNT = {"compression_count": "compression_flag", "expansion_count": "expansion_flag", "breakout_count": "bo", "false_break_count": "fb", "sweep_count": "sw"}
_SEQ = f"""{_WIDE}, q0 AS (SELECT *, greatest(breakout_up, breakout_down) AS bo, greatest(false_breakout_up, false_breakout_down) AS fb, greatest(sweep_high, sweep_low) AS sw, CASE direction WHEN 'UP' THEN 'U' WHEN 'DOWN' THEN 'D' ELSE 'N' END AS ds, lag(direction) OVER {q.W} AS ld FROM wb),
q1 AS (SELECT *, sum((ld IS DISTINCT FROM direction)::INT) OVER (PARTITION BY symbol ORDER BY time ROWS UNBOUNDED PRECEDING) AS island, {', '.join(f"CASE WHEN row_idx >= {n} THEN array_to_string(list(ds) OVER {q.past(n)}, '-') ELSE 'NA' END AS dir_seq_{n}" for n in (3, 5, 8))}, {', '.join(f"CASE WHEN row_idx >= {n} THEN sum({x}) OVER {q.past(n)} END::BIGINT AS {m}_{n}" for m, x in _CNT.items() for n in (5, 8))}, (sum(bo) OVER {q.past(12)})::BIGINT AS tries FROM q0),
q2 AS (SELECT *, (CASE direction WHEN 'UP' THEN 1 WHEN 'DOWN' THEN -1 ELSE 0 END * row_number() OVER (PARTITION BY symbol, island ORDER BY time))::INT AS dir_streak FROM q1),
sq AS (SELECT *, CASE WHEN compression_count_5 >= 3 AND bo = 1 THEN 'BREAKOUT_AFTER_COMPRESSION' WHEN compression_count_8 >= 5 AND bo = 1 THEN 'BREAKOUT_AFTER_LONG_COMPRESSION' WHEN expansion_count_5 >= 3 AND bo = 1 THEN 'BREAKOUT_AFTER_EXPANSION_CHAIN' WHEN sweep_count_5 >= 1 AND bo = 1 THEN 'BREAKOUT_AFTER_SWEEP' WHEN false_break_count_5 >= 1 AND bo = 1 THEN 'BREAKOUT_AFTER_FALSE_BREAK' WHEN dir_streak >= 4 THEN 'UP_STREAK_EXTENDED' WHEN dir_streak <= -4 THEN 'DOWN_STREAK_EXTENDED' WHEN compression_count_5 >= 3 THEN 'COMPRESSION_BUILDUP' WHEN expansion_count_5 >= 3 THEN 'EXPANSION_CHAIN' ELSE 'NORMAL_SEQUENCE' END AS sequence_regime FROM q2)"""


@query(f"{_SEQ} SELECT symbol, time, dir_seq_3, dir_seq_5, dir_seq_8, compression_count_5, expansion_count_5, breakout_count_8, false_break_count_5, sweep_count_5, dir_streak, sequence_regime, tries AS breakout_attempt_lookback_12, {_bins('tries', (0, 1, 2, 4), ('NO_RECENT_BO', 'FIRST_BO', 'SECOND_BO', 'MULTI_BO', 'BO_CLUSTER'))} AS breakout_attempt_bucket FROM sq")
def sequence_regimes(spark, d):
    return wide.sequences(wide_base(spark, d)).select("symbol", "time", "dir_seq_3", "dir_seq_5", "dir_seq_8", "compression_count_5", "expansion_count_5", "breakout_count_8", "false_break_count_5", "sweep_count_5", "dir_streak", "sequence_regime", "breakout_attempt_lookback_12", "breakout_attempt_bucket")


_RATES = {"avg_energy": "energy_score", "avg_range_atr": "range_atr", "continuation_h3": "h3_continues", "continuation_h6": "h6_continues", "continuation_h12": "h12_continues", "pullback_0p50_h6": "h6_pullback_0p50", "reach_1atr_h12": "h12_reaches_1p00"}
_LAYERS = ("hour_brt", "market_state", "energy_bucket", "vol_bucket", "align", "event_name", "zone")


@query(f"""{_WIDE}, {q.outcomes((3, 6, 12), 'wb')}, t AS ({q.touch('atr', '0.5 * atr', 12, 'sign(close - open)')}), x AS (SELECT o.*, mtf_alignment_bucket || '/' || mtf_bias AS align, resistance_bucket || '/' || support_bucket AS zone, CASE WHEN atr > 0 AND close <> open THEN coalesce(t.label, 'NO_TOUCH') ELSE 'INVALID' END AS rr FROM o LEFT JOIN t ON t.symbol = o.symbol AND t.time = o.time),
g AS (SELECT {', '.join(_LAYERS)}, 7 - ({' + '.join(f'grouping({n})' for n in _LAYERS)})::INT AS layer, count(*) AS bars, {', '.join(f'avg({x}) AS {n}' for n, x in _RATES.items())}, avg((rr = 'TP_FIRST')::INT) AS rr_tp, avg((rr = 'SL_FIRST')::INT) AS rr_sl FROM x GROUP BY ROLLUP ({', '.join(_LAYERS)}) HAVING count(*) >= 20)
SELECT {', '.join(_LAYERS)}, layer, bars, {', '.join(f'round({n}, 5) AS {n}' for n in _RATES)}, round(rr_tp, 5) AS rr_tp, round(rr_sl, 5) AS rr_sl, round(0.35 * (rr_tp - rr_sl) + 0.25 * reach_1atr_h12 + 0.2 * continuation_h6 - 0.2 * pullback_0p50_h6, 5) AS fusion_edge_score FROM g WHERE layer > 0""")
def context_layers(spark, d):
    """Seven keys, each layer one more of them, as one rollup."""
    b = touch.reward_risk(features.forward_outcomes(wide_base(spark, d), (3, 6, 12)), ((1.0, 0.5, 12),)).withColumnRenamed("rr_1.0_0.5_12", "rr")
    b = b.withColumns({"align": F.concat_ws("/", "mtf_alignment_bucket", "mtf_bias"), "zone": F.concat_ws("/", "resistance_bucket", "support_bucket")})
    level = F.lit(7)
    for n in _LAYERS:
        level = level - F.grouping(n)
    g = b.rollup(*_LAYERS).agg(level.cast("int").alias("layer"), F.count("*").alias("bars"), *(F.avg(x).alias(n) for n, x in _RATES.items()), F.avg((c("rr") == "TP_FIRST").cast("int")).alias("rr_tp"), F.avg((c("rr") == "SL_FIRST").cast("int")).alias("rr_sl"))
    score = 0.35 * (c("rr_tp") - c("rr_sl")) + 0.25 * c("reach_1atr_h12") + 0.2 * c("continuation_h6") - 0.2 * c("pullback_0p50_h6")
    return rounded(g.where("bars >= 20 AND layer > 0").withColumn("fusion_edge_score", score), 5)
