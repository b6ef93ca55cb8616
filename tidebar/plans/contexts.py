"""Contexts of bars of four widths as nested documents, their levels and zones, and the vote of the widths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebar.functions.exprs import past
from tidebar.operators import context as ctx
from tidebar.operators import features, levels
from tidebar.plans import bars_and_features as bf
from tidebar.plans import blocks
from tidebar.plans import sqlparts as q
from tidebar.plans.bars_and_features import rounded
from tidebar.plans.shared import written
from tidebar.sources import bars as src

c = F.col
QUERIES, SQL = {}, {}
WIDTHS = {"H4": "4 hours", "H1": "1 hour", "M15": "15 minutes", "M5": "5 minutes"}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _bars(spark, d) -> DataFrame:
    """All feature columns of the bars of all widths, in one pass: a series is a symbol and width."""
    bars = None
    for name, width in WIDTHS.items():
        part = src.event_bars(spark, d, width).withColumn("symbol", F.concat_ws("|", "symbol", F.lit(name)))
        bars = part if bars is None else bars.unionByName(part)
    b = features.smoothed(features.base(bars))
    b = features.candle_patterns(features.bar_flags(features.sessions(levels.ema_trend(features.regimes(features.rolling_indicators(b))))))
    b = levels.order_blocks(levels.gap_zones(levels.fibonacci(levels.zigzag(features.structure(b)))))
    size = F.when(c("high") != c("low"), c("high") - c("low"))
    b = b.withColumns({"close_pos": (c("close") - c("low")) / (size + 1e-9), "live": F.lit("NOT_LIVE"), "recent_high": F.max("high").over(past(20)), "recent_low": F.min("low").over(past(20))})
    b = ctx.levels_of(ctx.classified(b)).withColumns({"timeframe": F.substring_index("symbol", "|", -1), "symbol": F.substring_index("symbol", "|", 1)})
    keep = ("symbol", "timeframe", "time", "row_idx", "open", "high", "low", "close", "atr", "structure", "momentum", "volume_state", "volatility", "location", "live", "session_name", "events", "setup", "quality", "reason", "levels", "rsi_14", "adx_14", "plus_di_14", "minus_di_14", "range_atr", "bull_ratio", "bear_ratio", "recent_high", "recent_low")
    return b.select(*keep)


_ALL = " UNION ALL ".join(f"SELECT event_type || '|{n}' AS symbol, time_bucket(INTERVAL '{w}', ts) AS time, arg_min(value, event_id) AS open, max(value) AS high, min(value) AS low, arg_max(value, event_id) AS close, count(*) AS volume FROM events GROUP BY 1, 2" for n, w in WIDTHS.items())
_RATIO = {"bull_ratio": ">", "bear_ratio": "<"}
_GAPS = ", ".join(f"CASE WHEN ({lo}) IS NOT NULL AND ({hi}) IS NOT NULL AND greatest(({hi}) - ({lo}), 0) / (nullif(atr, 0) + 1e-9) >= 0.1 THEN {x} END AS fvg_{s}_{n}" for s, (lo, hi) in blocks._GAP.items() for n, x in (("low", f"({lo})"), ("high", f"({hi})")))
_LIST = ", ".join(f"CASE WHEN {n} = 1 THEN '{label}' END" for n, label in ctx.EVENTS.items())


def _entry(kind: int) -> str:
    """kind: 0 setup, 1 quality, 2 reason."""
    parts = []
    for name, order, far in (("BEARISH", "SELL", "'NEAR_BAR_LOW', 'LOWER_THIRD'"), ("BULLISH", "BUY", "'NEAR_BAR_HIGH', 'UPPER_THIRD'")):
        words = ctx.WORDS[name]
        agrees = f"starts_with(structure, '{name}') AND starts_with(momentum, '{name}')"
        volume = "volume_state IN ('NEAR_EXPECTED', 'ABOVE_EXPECTED', 'VERY_HIGH')"
        late, active, else_ = ((f"'{order}'",) * 3, ("'LOW'", "'HIGH'", "'MEDIUM'"), (f"'{words[0]}'", f"'{words[2]}'", f"'{words[3]}'"))[kind]
        parts.append(f"WHEN {agrees} THEN CASE WHEN location IN ({far}) THEN {late} WHEN {volume} THEN {active} ELSE {else_} END")
    return f"CASE {' '.join(parts)} ELSE '{('WAIT', 'LOW', ctx.WORDS['none'])[kind]}' END"


_CTX = f"""WITH RECURSIVE bars AS ({_ALL}), {q.base()}, {q.smoothed()}, {blocks._IND_M}, {blocks._Z}, {blocks._SWINGS.replace('FROM b)', 'FROM y)', 1)}, {blocks._ZIG.partition('z0 AS')[1]}{blocks._ZIG.partition('z0 AS')[2]}, {blocks._FIB.partition('f0 AS')[1]}{blocks._FIB.partition('f0 AS')[2]}, {blocks._OB.partition('o0 AS')[1]}{blocks._OB.partition('o0 AS')[2].replace('FROM w2)', 'FROM f)', 1)},
c0 AS (SELECT *, {q.flag('close > rh AND pc <= rh', 'bos_up')}, {q.flag('close < rl AND pc >= rl', 'bos_dn')}, {bf._BRT}::INT AS hbrt, {bf._AT.format('America/Sao_Paulo')}::DATE AS dbrt, {bf._LON}::INT AS hlon, {bf._NY}::INT AS hny, avg(volume) OVER {q.past(10)} AS v10, {_GAPS}, ln(ema_20 / lag(ema_20, 5) OVER {q.W}) AS slope20,
  {', '.join(f'CASE WHEN row_idx >= 5 THEN avg((close {x} open)::INT) OVER {q.past(5)} END AS {n}' for n, x in _RATIO.items())}, max(high) OVER {q.past(20)} AS recent_high, min(low) OVER {q.past(20)} AS recent_low FROM o),
c1 AS (SELECT *, coalesce(last_value(CASE WHEN bos_up = 1 THEN 1 WHEN bos_dn = 1 THEN -1 END IGNORE NULLS) OVER {bf._RUN}, 0)::INT AS structure_state, max(high) OVER (PARTITION BY symbol, dbrt ORDER BY time ROWS UNBOUNDED PRECEDING) AS session_high, min(low) OVER (PARTITION BY symbol, dbrt ORDER BY time ROWS UNBOUNDED PRECEDING) AS session_low FROM c0),
c2 AS (SELECT *, coalesce(lag(structure_state) OVER {q.W}, 0) AS prev FROM c1),
c3 AS (SELECT *, {q.FLAGS}, {q.flag('bos_up = 1 AND prev = -1', 'choch_up')}, {q.flag('bos_dn = 1 AND prev = 1', 'choch_dn')}, {q.flag('high > ph AND close < ph', 'sweep_high')}, {q.flag('low < pl AND close > pl', 'sweep_low')}, {q.flag('high > rh AND close < rh', 'swing_sweep_high')}, {q.flag('low < rl AND close > rl', 'swing_sweep_low')}, (fvg_up_low IS NOT NULL)::INT AS fvg_up, (fvg_dn_low IS NOT NULL)::INT AS fvg_dn,
  {q.flag('row_idx >= 10 AND volume > 2 * v10', 'volume_spike')}, {q.flag('atr_z < -1 AND bb_width_z < -1', 'compression_flag')}, {q.flag('atr_z > 1 OR bb_width_z > 1', 'expansion_flag')}, (high - low) / (atr + 1e-9) AS range_atr, (close - low) / (nullif(high - low, 0) + 1e-9) AS close_pos, coalesce(nullif(rsi_14, 0), 50) AS rs, coalesce(macd_hist, 0) AS mh, coalesce(adx_14, 0) AS ax, coalesce(plus_di_14, 0) AS pd, coalesce(minus_di_14, 0) AS md,
  CASE WHEN hny BETWEEN 8 AND 16 THEN 'NEW_YORK' WHEN hlon BETWEEN 8 AND 11 THEN 'LONDON' WHEN hlon < 8 THEN 'ASIA' ELSE 'OFF_SESSION' END AS session_name,
  CASE WHEN structure_state > 0 THEN 'BULLISH' WHEN structure_state < 0 THEN 'BEARISH' WHEN ema_20 > ema_50 AND coalesce(slope20, 0) > 0 THEN 'BULLISH_WEAK' WHEN ema_20 < ema_50 AND coalesce(slope20, 0) < 0 THEN 'BEARISH_WEAK' ELSE 'NEUTRAL' END AS structure FROM c2),
c4 AS (SELECT *, CASE WHEN mh > 0 AND pd > md THEN 'BULLISH' WHEN mh < 0 AND md > pd THEN 'BEARISH' WHEN rs >= 55 THEN 'BULLISH' WHEN rs <= 45 THEN 'BEARISH' ELSE 'NEUTRAL' END AS way, '_' || CASE WHEN ax >= 25 THEN 'STRONG' WHEN ax >= 18 THEN 'MODERATE' ELSE 'WEAK' END || CASE WHEN rs >= 70 THEN '_OVERBOUGHT' WHEN rs <= 30 THEN '_OVERSOLD' ELSE '' END AS tail, left(structure, 7) AS sd FROM c3),
c5 AS (SELECT *, CASE WHEN sd IN ('BEARISH', 'BULLISH') AND sd <> way THEN sd || '_STRUCTURE_MOMENTUM_MIXED' || tail ELSE way || tail END AS momentum, CASE WHEN vol_ratio IS NULL THEN 'UNKNOWN' WHEN vol_ratio >= 1.5 THEN 'VERY_HIGH' WHEN vol_ratio >= 1.1 THEN 'ABOVE_EXPECTED' WHEN vol_ratio >= 0.85 THEN 'NEAR_EXPECTED' WHEN vol_ratio >= 0.6 THEN 'BELOW_EXPECTED' ELSE 'VERY_LOW' END AS volume_state,
  CASE WHEN compression_flag = 1 THEN 'COMPRESSION' WHEN expansion_flag = 1 OR coalesce(atr_z, 0) >= 1 OR coalesce(range_atr, 0) >= 1.5 THEN 'EXPANSION' WHEN coalesce(atr_z, 0) <= -1 THEN 'LOW_VOLATILITY' ELSE 'NORMAL' END AS volatility,
  CASE WHEN close_pos IS NULL THEN 'UNKNOWN' WHEN close_pos <= 0.15 THEN 'NEAR_BAR_LOW' WHEN close_pos <= 0.35 THEN 'LOWER_THIRD' WHEN close_pos < 0.65 THEN 'MID_RANGE' WHEN close_pos < 0.85 THEN 'UPPER_THIRD' ELSE 'NEAR_BAR_HIGH' END AS location, list_filter([{_LIST}], lambda x: x IS NOT NULL) AS events FROM c4),
cx AS MATERIALIZED (SELECT * EXCLUDE (symbol), split_part(symbol, '|', 1) AS symbol, split_part(symbol, '|', 2) AS timeframe, {_entry(0)} AS setup, {_entry(1)} AS quality, {_entry(2)} AS reason FROM c5)"""


@query(f"{_CTX} SELECT symbol, timeframe, time, structure, momentum, volume_state, volatility, location, array_to_string(events, ',') AS events, setup, quality, reason FROM cx")
def bar_contexts(spark, d):
    """The classes, events and entry of every bar of four widths."""
    return _bars(spark, d).select("symbol", "timeframe", "time", "structure", "momentum", "volume_state", "volatility", "location", F.array_join("events", ",").alias("events"), "setup", "quality", "reason")


_UN = f"lv AS MATERIALIZED (SELECT symbol, timeframe, time, close, atr, level, price::DOUBLE AS price FROM (SELECT symbol, timeframe, time, close, atr, unnest([{', '.join(repr(x) for x in ctx.LEVELS.values())}]) AS level, unnest([{', '.join(f'{n}::DOUBLE' for n in ctx.LEVELS)}]) AS price FROM cx) WHERE price > 0)"


@query(f"{_CTX}, {_UN} SELECT symbol, timeframe, level, count(*) AS bars, round(avg(price), 5) AS avg_price, count(*) FILTER (price > close) AS above, round(avg(abs(price - close) / atr), 5) AS avg_distance_atr FROM lv GROUP BY ALL")
def context_levels(spark, d):
    """The 24 levels of every bar, unpivoted: how often each is there, on which side and how far away."""
    rows = _bars(spark, d).select("symbol", "timeframe", "close", "atr", F.explode_outer("levels").alias("x")).where("x IS NOT NULL").select("symbol", "timeframe", "close", "atr", "x.*")
    g = rows.groupBy("symbol", "timeframe", c("reason").alias("level")).agg(F.count("*").alias("bars"), F.avg("price").alias("avg_price"), F.count_if(c("side") == "RESISTANCE").alias("above"), F.avg(c("distance") / c("atr")).alias("avg_distance_atr"))
    return rounded(g, 5)


_REACHED = "CASE timeframe WHEN 'M1' THEN 4.0 WHEN 'M5' THEN 4.0 WHEN 'M15' THEN 5.0 WHEN 'H1' THEN 6.0 ELSE 5.0 END"
_ZN = f"""{_UN}, zi AS MATERIALIZED (SELECT *, abs(price - close) AS distance, price > close AS up, row_number() OVER (PARTITION BY symbol, timeframe, time, price > close ORDER BY price, level) AS i FROM lv WHERE atr IS NULL OR abs(price - close) <= atr * {_REACHED}),
zr AS (SELECT symbol, timeframe, time, up, i, 1 AS zone, price AS total, 1 AS m FROM zi WHERE i = 1 UNION ALL
  SELECT n.symbol, n.timeframe, n.time, n.up, n.i, CASE WHEN far THEN zone + 1 ELSE zone END, CASE WHEN far THEN n.price ELSE total + n.price END, CASE WHEN far THEN 1 ELSE m + 1 END FROM (SELECT zr.*, zi.price, zi.i AS ni, abs(zi.price - total / m) > greatest(coalesce(atr, 0) * 0.15, 0.01) AS far FROM zr JOIN zi ON zi.symbol = zr.symbol AND zi.timeframe = zr.timeframe AND zi.time = zr.time AND zi.up = zr.up AND zi.i = zr.i + 1) AS n0, LATERAL (SELECT n0.symbol, n0.timeframe, n0.time, n0.up, n0.ni AS i, n0.price) n),
zs AS (SELECT symbol, timeframe, time, up, zone, min(distance) AS distance, avg(price) AS center, min(price) AS low, max(price) AS high, count(DISTINCT level) AS reasons, min(distance) / any_value(atr) AS distance_atr FROM zr JOIN zi USING (symbol, timeframe, time, up, i) GROUP BY ALL),
zz AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol, timeframe, time, up ORDER BY distance, center) AS place FROM zs QUALIFY place <= 4)"""


def _last(b: DataFrame) -> DataFrame:
    """The newest bar of each symbol and width, with its zones and its context as JSON text."""
    newest = b.withColumn("_n", F.row_number().over(Window.partitionBy("symbol", "timeframe").orderBy(c("time").desc()))).where("_n = 1").drop("_n")
    newest = newest.withColumns({"supports": ctx.zones("SUPPORT", c("timeframe")), "resistances": ctx.zones("RESISTANCE", c("timeframe"))})
    return ctx.contexts(newest)


@query(f"""{_CTX}, {_ZN} SELECT symbol, timeframe, time, CASE WHEN up THEN 'RESISTANCE' ELSE 'SUPPORT' END AS side, place::INT AS place, round(center, 8) AS center, round(low, 8) AS low, round(high, 8) AS high, CASE WHEN reasons >= 3 THEN 'HIGH' WHEN reasons = 2 THEN 'MEDIUM' ELSE 'LOW' END AS strength, round(distance_atr, 8) AS distance_atr FROM zz WHERE timeframe IN ('H1', 'H4')""")
def level_zones(spark, d):
    """The nearest four zones on each side of every bar of an hour and of four hours."""
    b = written(_bars(spark, d).where(c("timeframe").isin("H1", "H4")).select("symbol", "timeframe", "time", "close", "atr", "levels"), "levels")
    sides = F.array(*(F.struct(F.lit(s).alias("side"), ctx.zones(s, c("timeframe")).alias("zones")) for s in ("SUPPORT", "RESISTANCE")))
    rows = b.select("symbol", "timeframe", "time", F.explode(sides).alias("s")).select("symbol", "timeframe", "time", "s.side", F.posexplode("s.zones").alias("k", "z"))
    return rounded(rows.select("symbol", "timeframe", "time", "side", (c("k") + 1).alias("place"), "z.center", "z.low", "z.high", "z.strength", "z.distance_atr"), 8)


_NEW = "nw AS (SELECT * FROM cx QUALIFY row_number() OVER (PARTITION BY symbol, timeframe ORDER BY time DESC) = 1)"


@query(f"""{_CTX}, {_ZN}, {_NEW}, zc AS (SELECT symbol, timeframe, time, count(*) FILTER (NOT up) AS supports, count(*) FILTER (up) AS resistances, max(center) FILTER (NOT up AND place = 1) AS first_support FROM zz GROUP BY ALL)
SELECT symbol, timeframe, strftime(nw.time, '%Y-%m-%d %H:%M:%S') AS bar_time, structure, momentum, volume_state, reason, round(rsi_14, 2) AS rsi, round(atr, 5) AS atr, round(nw.close, 5) AS close, coalesce(array_to_string(events, ','), '') AS events, coalesce(supports, 0)::INT AS supports, coalesce(resistances, 0)::INT AS resistances, round(first_support, 3) AS first_support, false AS has_nulls FROM nw LEFT JOIN zc USING (symbol, timeframe, time)""")
def context_documents(spark, d):
    """One JSON document a symbol and width, read back by path; nothing in it is null or empty."""
    docs = written(_last(_bars(spark, d)).select("symbol", "context"), "contexts").withColumn("v", F.parse_json("context"))
    at = lambda path, kind="string": F.variant_get("v", path, kind)
    size = lambda path: F.coalesce(F.size(F.try_variant_get("v", path, "array<variant>")), F.lit(0))
    empty = c("context").rlike(r":null|:\{\}|:\[\]")
    return docs.select("symbol", at("$.timeframe").alias("timeframe"), at("$.bar_time").alias("bar_time"), at("$.state.structure").alias("structure"), at("$.state.momentum").alias("momentum"), at("$.state.volume").alias("volume_state"), at("$.entry_assessment.reason").alias("reason"), at("$.metrics.rsi", "double").alias("rsi"), at("$.metrics.atr", "double").alias("atr"), at("$.ohlc.close", "double").alias("close"), F.coalesce(F.array_join(at("$.events", "array<string>"), ","), F.lit("")).alias("events"), F.greatest(size("$.levels.supports"), F.lit(0)).alias("supports"), F.greatest(size("$.levels.resistances"), F.lit(0)).alias("resistances"), F.round(at("$.levels.supports[0].center", "double"), 3).alias("first_support"), empty.alias("has_nulls"))


@query(f"""{_CTX}, {_NEW}, vt AS (SELECT symbol, sum(CASE WHEN starts_with(structure, 'BULLISH') THEN w WHEN starts_with(structure, 'BEARISH') THEN -w ELSE 0 END)::BIGINT AS weighted_structure_score, sum(w) AS total, count(*) FILTER (act) AS confirmations, count(*) FILTER (act AND starts_with(structure, 'BULLISH')) AS ups, count(*) FILTER (act AND starts_with(structure, 'BEARISH')) AS downs, max(structure) FILTER (timeframe = 'H1') AS h1, max(structure) FILTER (timeframe = 'M5') AS m5,
  string_agg(timeframe || ':' || structure || '/NOT_LIVE/' || volume_state, ' ' ORDER BY w DESC) AS trace FROM (SELECT *, CASE timeframe WHEN 'H4' THEN 5 WHEN 'H1' THEN 4 WHEN 'M15' THEN 3 WHEN 'M5' THEN 2 ELSE 1 END AS w, volume_state IN ('NEAR_EXPECTED', 'ABOVE_EXPECTED', 'VERY_HIGH') AS act FROM nw) GROUP BY symbol),
vu AS (SELECT *, CASE WHEN weighted_structure_score >= total * 0.45 THEN 'BULLISH' WHEN weighted_structure_score <= -total * 0.45 THEN 'BEARISH' ELSE 'MIXED' END AS directional_state, CASE WHEN confirmations >= 3 THEN 'STRONG' WHEN confirmations >= 2 THEN 'MODERATE' ELSE 'WEAK' END AS participation_strength FROM vt)
SELECT symbol, weighted_structure_score, confirmations, directional_state, participation_strength, CASE WHEN ups + downs = 0 THEN 'WEAK_OR_UNKNOWN' WHEN downs = 0 THEN 'BULLISH' WHEN ups = 0 THEN 'BEARISH' ELSE 'MIXED' END AS directional_volume_confirmation, CASE WHEN starts_with(h1, 'BEARISH') AND starts_with(m5, 'BULLISH') THEN '{ctx.WORDS['conflict'][0]}' WHEN starts_with(h1, 'BULLISH') AND starts_with(m5, 'BEARISH') THEN '{ctx.WORDS['conflict'][1]}' END AS conflict, trace,
CASE WHEN directional_state = 'MIXED' OR participation_strength = 'WEAK' THEN 'WAIT' WHEN directional_state = 'BEARISH' THEN 'SELL_ON_CONFIRMATION' ELSE 'BUY_ON_CONFIRMATION' END AS immediate_action, CASE directional_state WHEN 'BEARISH' THEN 'SELL_PULLBACK_OR_CONFIRMED_BREAKDOWN' WHEN 'BULLISH' THEN 'BUY_PULLBACK_OR_CONFIRMED_BREAKOUT' ELSE 'AGUARDAR_MELHOR_CONFLUENCIA' END AS preferred_setup FROM vu""")
def market_votes(spark, d):
    """What the widths say together about each symbol."""
    b = _bars(spark, d).select("symbol", "timeframe", "time", "structure", "volume_state", "live")
    newest = b.withColumn("_n", F.row_number().over(Window.partitionBy("symbol", "timeframe").orderBy(c("time").desc()))).where("_n = 1")
    return ctx.vote(newest)
