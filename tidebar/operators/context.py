"""What a bar says in words: classes of its state, events, levels clustered into zones, an entry's quality, and the vote of several widths.

Classes are columns. Levels are unpivoted into an array (LEVELS has their columns and names), split by side of the close, kept
within reach, sorted by price and folded into zones: a level joins the last zone if it is near its mean. All arrays are bounded by
the number of levels. A context is one nested column; `document` leaves out what is missing or empty at every depth.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col
# Fixed values of the rules: labels, columns of levels, reach by width, weights of the vote, and the words of the assessment.
EVENTS = {
    "bos_up": "BOS_UP", "bos_dn": "BOS_DOWN", "choch_up": "CHOCH_UP", "choch_dn": "CHOCH_DOWN", "breakout_up": "BREAKOUT_UP", "breakout_down": "BREAKOUT_DOWN", "false_breakout_up": "FALSE_BREAKOUT_UP", "false_breakout_down": "FALSE_BREAKOUT_DOWN",
    "sweep_high": "SWEEP_HIGH", "sweep_low": "SWEEP_LOW", "swing_sweep_high": "SWING_SWEEP_HIGH", "swing_sweep_low": "SWING_SWEEP_LOW", "fvg_up": "FVG_UP", "fvg_dn": "FVG_DOWN", "volume_spike": "VOLUME_SPIKE", "compression_flag": "COMPRESSION", "expansion_flag": "EXPANSION",
}
LEVELS = {
    "last_swing_high": "SWING_HIGH", "last_swing_low": "SWING_LOW", "last_zigzag_high": "ZIGZAG_HIGH", "last_zigzag_low": "ZIGZAG_LOW", "session_high": "SESSION_HIGH", "session_low": "SESSION_LOW", "bollinger_high": "BB_HIGH", "bollinger_low": "BB_LOW",
    "ema_20": "EMA20", "ema_50": "EMA50", "sma_200": "SMA200", "fib_382_retr": "FIB_382", "fib_500_retr": "FIB_500", "fib_618_retr": "FIB_618", "fib_1272_ext": "FIB_1272", "fib_1618_ext": "FIB_1618",
    "fvg_up_low": "FVG_UP_LOW", "fvg_up_high": "FVG_UP_HIGH", "fvg_dn_low": "FVG_DOWN_LOW", "fvg_dn_high": "FVG_DOWN_HIGH", "bull_ob_candidate_low": "BULL_OB_LOW", "bull_ob_candidate_high": "BULL_OB_HIGH", "bear_ob_candidate_low": "BEAR_OB_LOW", "bear_ob_candidate_high": "BEAR_OB_HIGH",
}
REACH, USUAL_REACH, NEAR_ATR, NEAR_LEAST, EACH_SIDE = {"M1": 4.0, "M5": 4.0, "M15": 5.0, "H1": 6.0}, 5.0, 0.15, 0.01, 4
WEIGHTS = {"H4": 5, "H1": 4, "M15": 3, "M5": 2, "M1": 1}
ACTIVE = ("NEAR_EXPECTED", "ABOVE_EXPECTED", "VERY_HIGH")
WORDS = {
    "none": "SEM_CONFLUENCIA_SUFFICIENTE",
    "BEARISH": ("DIRECAO_BAIXISTA_MAS_ENTRADA_ESTICADA", "ROMPIMENTO_BAIXISTA_REJEITADO", "CONFLUENCIA_BAIXISTA_COM_VOLUME", "CONFLUENCIA_BAIXISTA_SEM_CONFIRMACAO_DE_VOLUME"),
    "BULLISH": ("DIRECAO_ALTISTA_MAS_ENTRADA_ESTICADA", "ROMPIMENTO_ALTISTA_REJEITADO", "CONFLUENCIA_ALTISTA_COM_VOLUME", "CONFLUENCIA_ALTISTA_SEM_CONFIRMACAO_DE_VOLUME"),
    "conflict": ("M5_REACAO_ALTISTA_CONTRA_H1_BAIXISTA", "M5_REACAO_BAIXISTA_CONTRA_H1_ALTISTA"),
}


def _or_zero(name: str) -> Column:
    return F.coalesce(c(name), F.lit(0.0))


def classified(b: DataFrame) -> DataFrame:
    """b with structure, momentum, volume_state, volatility, location, events, and the entry's setup, quality and reason.

    `live` (text) names the state of a bar in progress; bars that are over have NOT_LIVE.
    """
    state, slope = _or_zero("structure_state"), _or_zero("ema20_slope_5")
    weak = F.when((c("ema_20") > c("ema_50")) & (slope > 0), "BULLISH_WEAK").when((c("ema_20") < c("ema_50")) & (slope < 0), "BEARISH_WEAK").otherwise("NEUTRAL")
    b = b.withColumn("structure", F.when(state > 0, "BULLISH").when(state < 0, "BEARISH").otherwise(weak))
    rsi = F.coalesce(F.when(c("rsi_14") != 0, c("rsi_14")), F.lit(50.0))
    hist, adx, plus, minus = (_or_zero(n) for n in ("macd_hist", "adx_14", "plus_di_14", "minus_di_14"))
    way = F.when((hist > 0) & (plus > minus), "BULLISH").when((hist < 0) & (minus > plus), "BEARISH").when(rsi >= 55, "BULLISH").when(rsi <= 45, "BEARISH").otherwise("NEUTRAL")
    tail = F.concat(F.lit("_"), F.when(adx >= 25, "STRONG").when(adx >= 18, "MODERATE").otherwise("WEAK"), F.when(rsi >= 70, "_OVERBOUGHT").when(rsi <= 30, "_OVERSOLD").otherwise(""))
    side = F.when(c("structure").startswith("BEARISH"), "BEARISH").when(c("structure").startswith("BULLISH"), "BULLISH")
    mixed = side.isNotNull() & (side != way)
    b = b.withColumn("momentum", F.when(mixed, F.concat(side, F.lit("_STRUCTURE_MOMENTUM_MIXED"), tail)).otherwise(F.concat(way, tail)))
    ratio, pos = c("vol_ratio"), c("close_pos")
    b = b.withColumns(
        {
            "volume_state": F.when(ratio.isNull(), "UNKNOWN").when(ratio >= 1.5, "VERY_HIGH").when(ratio >= 1.1, "ABOVE_EXPECTED").when(ratio >= 0.85, "NEAR_EXPECTED").when(ratio >= 0.6, "BELOW_EXPECTED").otherwise("VERY_LOW"),
            "volatility": F.when(c("compression_flag") == 1, "COMPRESSION").when((c("expansion_flag") == 1) | (_or_zero("atr_z") >= 1) | (_or_zero("range_atr") >= 1.5), "EXPANSION").when(_or_zero("atr_z") <= -1, "LOW_VOLATILITY").otherwise("NORMAL"),
            "location": F.when(pos.isNull(), "UNKNOWN").when(pos <= 0.15, "NEAR_BAR_LOW").when(pos <= 0.35, "LOWER_THIRD").when(pos < 0.65, "MID_RANGE").when(pos < 0.85, "UPPER_THIRD").otherwise("NEAR_BAR_HIGH"),
            "events": F.array_compact(F.array(*(F.when(c(n) == 1, label) for n, label in EVENTS.items()))),
        }
    )
    setup, quality, reason = F.when(F.lit(False), ""), F.when(F.lit(False), ""), F.when(F.lit(False), "")
    for name, order, far, rejected in (("BEARISH", "SELL", ("NEAR_BAR_LOW", "LOWER_THIRD"), "FALSE_BREAKOUT_DOWN"), ("BULLISH", "BUY", ("NEAR_BAR_HIGH", "UPPER_THIRD"), "FALSE_BREAKOUT_UP")):
        agrees = c("structure").startswith(name) & c("momentum").startswith(name)
        late, back, volume = c("location").isin(*far), c("live").contains(rejected), c("volume_state").isin(*ACTIVE)
        words = WORDS[name]
        setup = setup.when(agrees, order)
        quality = quality.when(agrees & (late | back), "LOW").when(agrees & volume, "HIGH").when(agrees, "MEDIUM")
        reason = reason.when(agrees & late, words[0]).when(agrees & back, words[1]).when(agrees & volume, words[2]).when(agrees, words[3])
    return b.withColumns({"setup": setup.otherwise("WAIT"), "quality": quality.otherwise("LOW"), "reason": reason.otherwise(WORDS["none"])})


def levels_of(b: DataFrame) -> DataFrame:
    """b with an array column levels: (price, reason, side, distance) of the levels that are there and above 0."""
    rows = F.array(*(F.when(c(n) > 0, F.struct(c(n).cast("double").alias("price"), F.lit(label).alias("reason"), F.when(c(n) > c("close"), "RESISTANCE").otherwise("SUPPORT").alias("side"), F.abs(c(n) - c("close")).alias("distance"))) for n, label in LEVELS.items()))
    return b.withColumn("levels", F.array_compact(rows))


def zones(side: str, timeframe: Column) -> Column:
    """The zones of a side from levels, the nearest EACH_SIDE: (center, low, high, strength, reasons, distance_atr)."""
    reach = F.lit(USUAL_REACH)
    for name, far in REACH.items():
        reach = F.when(timeframe == name, far).otherwise(reach)
    near = F.greatest(F.coalesce(c("atr"), F.lit(0.0)) * NEAR_ATR, F.lit(NEAR_LEAST))
    fits = F.array_sort(F.filter("levels", lambda x: (x["side"] == side) & (c("atr").isNull() | (x["distance"] <= c("atr") * reach))))
    none = F.array().cast("array<struct<total:double,items:array<struct<price:double,reason:string,side:string,distance:double>>>>")

    def join(found: Column, item: Column) -> Column:
        last = F.try_element_at(found, F.lit(-1))
        grown = F.struct((last["total"] + item["price"]).alias("total"), F.concat(last["items"], F.array(item)).alias("items"))
        own = F.struct(item["price"].alias("total"), F.array(item).alias("items"))
        apart = last.isNull() | (F.abs(item["price"] - last["total"] / F.size(last["items"])) > near)
        return F.when(apart, F.concat(found, F.array(own))).otherwise(F.concat(F.slice(found, 1, F.greatest(F.size(found) - 1, F.lit(0))), F.array(grown)))

    def summary(zone: Column) -> Column:
        prices, reasons = F.transform(zone["items"], lambda x: x["price"]), F.array_sort(F.array_distinct(F.transform(zone["items"], lambda x: x["reason"])))
        distance, n = F.array_min(F.transform(zone["items"], lambda x: x["distance"])), F.size(reasons)
        strength = F.when(n >= 3, "HIGH").when(n == 2, "MEDIUM").otherwise("LOW")
        return F.struct(distance.alias("distance"), (zone["total"] / F.size(zone["items"])).alias("center"), F.array_min(prices).alias("low"), F.array_max(prices).alias("high"), strength.alias("strength"), reasons.alias("reasons"), (distance / c("atr")).alias("distance_atr"))

    nearest = F.slice(F.array_sort(F.transform(F.aggregate(fits, none, join), summary)), 1, EACH_SIDE)
    return F.transform(nearest, lambda z: z.dropFields("distance"))


def filled(array: Column) -> Column:
    """An array, null where it is empty."""
    return F.when(F.size(array) > 0, array)


def document(fields: Mapping[str, Column]) -> Column:
    """A struct, null where all of its fields are; to_json leaves nulls out, so that what is empty is absent at every depth."""
    there = F.lit(False)
    for x in fields.values():
        there = there | x.isNotNull()
    return F.when(there, F.struct(*(x.alias(n) for n, x in fields.items())))


def _shown(zone: Column) -> Column:
    """A zone as the document shows it."""
    return F.struct(*(F.round(zone[n], 5).alias(n) for n in ("center", "low", "high")), zone["strength"].alias("strength"), zone["reasons"].alias("reasons"), F.round(zone["distance_atr"], 3).alias("distance_atr"))


def contexts(b: DataFrame) -> DataFrame:
    """b (classified, with levels) and its context as JSON text."""
    r = lambda n, k: F.round(n, k)
    numbers = {"rsi": ("rsi_14", 2), "adx": ("adx_14", 2), "adx_positive": ("plus_di_14", 2), "adx_negative": ("minus_di_14", 2), "atr": ("atr", 5), "range_atr": ("range_atr", 3), "bull_ratio_5": ("bull_ratio", 3), "bear_ratio_5": ("bear_ratio", 3)}
    whole = {
        "timeframe": c("timeframe"),
        "bar_time": F.date_format("time", "yyyy-MM-dd HH:mm:ss"),
        "bar_status": F.lit("CLOSED"),
        "ohlc": document({n: r(n, 5) for n in ("open", "high", "low", "close")}),
        "state": document({n: c(n) for n in ("structure", "momentum", "volatility", "location")} | {"volume": c("volume_state"), "live_bar": c("live"), "session": c("session_name")}),
        "metrics": document({n: r(x, k) for n, (x, k) in numbers.items()}),
        "events": filled(c("events")),
        "recent_closed_range_20": document({"high": r("recent_high", 5), "low": r("recent_low", 5)}),
        "levels": document({n: filled(F.transform(n, _shown)) for n in ("supports", "resistances")}),
        "entry_assessment": document({"directional_setup": c("setup"), "quality": c("quality"), "reason": c("reason")}),
    }
    return b.withColumn("context", F.to_json(document(whole)))


def vote(rows: DataFrame, by: str = "symbol") -> DataFrame:
    """The market's direction from the contexts of several widths (timeframe, structure, volume_state, live, momentum): a few rows a series."""
    weight = F.lit(1)
    for name, w in WEIGHTS.items():
        weight = F.when(c("timeframe") == name, w).otherwise(weight)
    bull, bear = c("structure").startswith("BULLISH"), c("structure").startswith("BEARISH")
    active = c("volume_state").isin(*ACTIVE)
    up, down = active & (c("live").contains("BREAKOUT_UP") | bull), active & (c("live").contains("BREAKOUT_DOWN") | bear)
    of = lambda tf: F.max(F.when(c("timeframe") == tf, c("structure")))
    trace = F.struct((-weight).alias("k"), F.concat(c("timeframe"), F.lit(":"), c("structure"), F.lit("/"), c("live"), F.lit("/"), c("volume_state")).alias("text"))
    g = rows.groupBy(by).agg(F.sum(F.when(bull, weight).when(bear, -weight).otherwise(0)).alias("score"), F.sum(weight).alias("total"), F.count_if(active).alias("confirmations"), F.count_if(up).alias("ups"), F.count_if(down).alias("downs"), of("H1").alias("h1"), of("M5").alias("m5"), F.sort_array(F.collect_list(trace)).alias("traces"))
    score, total = c("score"), c("total")
    direction = F.when(score >= total * 0.45, "BULLISH").when(score <= -total * 0.45, "BEARISH").otherwise("MIXED")
    strength = F.when(c("confirmations") >= 3, "STRONG").when(c("confirmations") >= 2, "MODERATE").otherwise("WEAK")
    volume = F.when(c("ups") + c("downs") == 0, "WEAK_OR_UNKNOWN").when(c("downs") == 0, "BULLISH").when(c("ups") == 0, "BEARISH").otherwise("MIXED")
    conflict = F.when(c("h1").startswith("BEARISH") & c("m5").startswith("BULLISH"), WORDS["conflict"][0]).when(c("h1").startswith("BULLISH") & c("m5").startswith("BEARISH"), WORDS["conflict"][1])
    g = g.withColumns({"directional_state": direction, "participation_strength": strength, "directional_volume_confirmation": volume, "conflict": conflict, "trace": F.array_join(F.transform("traces", lambda x: x["text"]), " ")})
    act = F.when(c("participation_strength") == "WEAK", "WAIT")
    action = F.when(c("directional_state") == "BEARISH", act.otherwise("SELL_ON_CONFIRMATION")).when(c("directional_state") == "BULLISH", act.otherwise("BUY_ON_CONFIRMATION")).otherwise("WAIT")
    wanted = F.when(c("directional_state") == "BEARISH", "SELL_PULLBACK_OR_CONFIRMED_BREAKDOWN").when(c("directional_state") == "BULLISH", "BUY_PULLBACK_OR_CONFIRMED_BREAKOUT").otherwise("AGUARDAR_MELHOR_CONFLUENCIA")
    return g.withColumns({"immediate_action": action, "preferred_setup": wanted}).withColumnRenamed("score", "weighted_structure_score").drop("total", "ups", "downs", "h1", "m5", "traces")
