"""The wide base: anchor bars with the last closed bar of larger widths, and the contexts that are read from it.

The buckets of volume, range, body and close place and the market state have cuts of our own choice; all other cuts are
fixed values of the rules.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebar.functions.exprs import bins, flag, full, guarded, over, past, percent_rank, series
from tidebar.operators import asof, features, levels

c = F.col
ENERGY = ((20, 40, 60, 80), ("VERY_LOW", "LOW", "MEDIUM", "HIGH", "EXTREME"))
CHOSEN = {
    "vol_bucket": ("vol_ratio", (0.8, 1.2, 2.0), ("LOW", "NORMAL", "HIGH", "SPIKE")),
    "range_bucket": ("range_atr", (0.75, 1.25), ("SMALL", "NORMAL", "LARGE")),
    "body_bucket": ("body_atr", (0.3, 0.7), ("SMALL", "MEDIUM", "LARGE")),
    "close_position_bucket": ("close_pos", (0.2, 0.8), ("CLOSE_LOW", "CLOSE_MID", "CLOSE_HIGH")),
}


def direction(o: str = "open", cl: str = "close") -> Column:
    return F.when(c(cl) > c(o), "UP").when(c(cl) < c(o), "DOWN").otherwise("FLAT")


def anchor(bars: DataFrame) -> DataFrame:
    """All anchor columns of bars."""
    b = features.regimes(levels.distances(features.rolling_indicators(features.smoothed(features.base(bars)))))
    b = features.sessions(features.bar_flags(b))
    size = F.when(c("high") != c("low"), c("high") - c("low"))
    b = b.withColumns(
        {
            "direction": direction(),
            "range_usd": c("high") - c("low"),
            "net_usd": c("close") - c("open"),
            "close_pos": guarded(c("close") - c("low"), size),
            "time_slot": F.date_format(F.from_utc_timestamp(c("time"), "America/Sao_Paulo"), "HH:mm"),
            "sweep_high": flag((c("high") > c("ph")) & (c("close") < c("ph"))),
            "sweep_low": flag((c("low") < c("pl")) & (c("close") > c("pl"))),
        }
    )
    b = b.withColumns({n: bins(c(x), edges, names) for n, (x, edges, names) in CHOSEN.items()})
    failed = (c("false_breakout_up") == 1) | (c("false_breakout_down") == 1) | (c("sweep_high") == 1) | (c("sweep_low") == 1)
    broke = (c("breakout_up") == 1) | (c("breakout_down") == 1)
    state = F.when(broke, "ACCEPTED_BREAKOUT").when(failed, "SWEEP_OR_FALSE_BREAK").when(c("compression_flag") == 1, "COMPRESSION").when(c("expansion_flag") == 1, "EXPANSION").when(c("range_atr") < 0.5, "LOW_RANGE")
    return b.withColumn("market_state", state.otherwise("NORMAL_FLOW"))


def with_larger(b: DataFrame, larger: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """b with open, high, low, close, atr, adx and direction of the last closed bar of each larger width (bars and their width)."""
    for name, (bars, width) in larger.items():
        h = features.smoothed(features.base(bars)).withColumn("direction", direction())
        b = asof.asof_backward(b, h, "symbol", "time", "time", ["open", "high", "low", "close", "atr", "adx_14", "direction"], f"{name}_", width)
    return b


def _share(x: Column) -> Column:
    """The percent rank, one half where it is missing or fewer than 50 values are there."""
    return F.when(F.count(x).over(Window.partitionBy("symbol")) < 50, 0.5).otherwise(F.coalesce(percent_rank(x), F.lit(0.5)))


def clipped(x: Column, top: float) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(0.0)), F.lit(float(top))))


def core(b: DataFrame, larger: list[str]) -> DataFrame:
    """Alignment over the anchor and the larger bars, energy, levels and the event of the bar."""
    votes = [F.when(c(n) == "UP", 1).when(c(n) == "DOWN", -1).otherwise(0) for n in ("direction", *(f"{x}_direction" for x in larger))]
    total = votes[0]
    for v in votes[1:]:
        total = total + v
    b = b.withColumn("mtf_alignment_score", total)
    score = c("mtf_alignment_score")
    b = b.withColumns({"mtf_bias": F.when(score > 0, "UP").when(score < 0, "DOWN").otherwise("MIXED"), "mtf_alignment_bucket": bins(F.abs(score), (0, 1, 2, 3), ("NONE", "WEAK", "MIXED", "STRONG", "FULL"))})
    parts = {"_e1": (c("vol_ratio"), 5, 0.30), "_e2": (c("range_atr"), 5, 0.30), "_e3": (c("body_atr"), 3, 0.20), "_e4": (c(f"{larger[0]}_adx_14"), 80, 0.15)}
    b = b.withColumns({n: clipped(x, top) for n, (x, top, _) in parts.items()})
    energy = sum((w * _share(c(n)) for n, (_, _, w) in parts.items()), F.lit(0.0)) + 0.10 * c("expansion_flag") + 0.05 * c("compression_flag")
    b = b.withColumn("energy_score", F.least(F.lit(100.0), F.greatest(F.lit(0.0), 100 * energy))).drop(*parts)
    b = levels.resistance_support(b.withColumn("energy_bucket", bins(c("energy_score"), *ENERGY)))
    up_or_down = (c("breakout_up") == 1) | (c("breakout_down") == 1)
    failed, swept = (c("false_breakout_up") == 1) | (c("false_breakout_down") == 1), (c("sweep_high") == 1) | (c("sweep_low") == 1)
    event = F.when(up_or_down, "BREAKOUT").when(failed, "FALSE_BREAK").when(swept, "SWEEP").when(c("compression_flag") == 1, "COMPRESSION").when(c("expansion_flag") == 1, "EXPANSION")
    dna = F.concat_ws("|", "direction", F.concat(F.lit("R:"), "range_bucket"), F.concat(F.lit("B:"), "body_bucket"), F.concat(F.lit("V:"), "vol_bucket"), F.concat(F.lit("C:"), "close_position_bucket"), F.concat(F.lit("S:"), "market_state"))
    return b.withColumns({"event_name": event.otherwise("NONE"), "candle_dna": dna})


def setup(b: DataFrame) -> DataFrame:
    """Side, place and event of a setup, and the key they make. Needs core."""
    bias, way, zone, event = c("mtf_bias"), c("direction"), c("level_zone"), c("event_name")
    b = b.withColumns(
        {
            "setup_side_context": F.when((bias == "UP") & (way == "UP"), "BUY_ALIGNED").when((bias == "DOWN") & (way == "DOWN"), "SELL_ALIGNED").when(bias == "UP", "BUY_MTF_ONLY").when(bias == "DOWN", "SELL_MTF_ONLY").otherwise("MIXED"),
            "setup_location_context": F.when(zone.isin("AT_RESISTANCE", "NEAR_RESISTANCE"), "RESISTANCE_ZONE").when(zone.isin("AT_SUPPORT", "NEAR_SUPPORT"), "SUPPORT_ZONE").otherwise("MID_RANGE"),
        }
    )
    place = c("setup_location_context")
    kind = F.when(F.lit(False), "")
    for name, suffix in (("BREAKOUT", "BREAKOUT"), ("FALSE_BREAK", "FALSE_BREAK")):
        for side in ("RESISTANCE", "SUPPORT"):
            kind = kind.when((event == name) & (place == f"{side}_ZONE"), f"{side}_{suffix}")
    for name in ("SWEEP", "COMPRESSION", "EXPANSION"):
        kind = kind.when(event == name, name)
    b = b.withColumn("setup_event_context", kind.otherwise("NO_EVENT"))
    key = F.concat(F.lit("state="), "market_state", F.lit("|setup="), "setup_event_context", F.lit("|side="), "setup_side_context", F.lit("|loc="), "setup_location_context", F.lit("|energy="), "energy_bucket", F.lit("|align="), "mtf_alignment_bucket", F.lit("/"), "mtf_bias")
    return b.withColumn("setup_genome_macro", key)


def location(b: DataFrame, larger: list[str]) -> DataFrame:
    """Where the close stands in each larger bar, the pressure of all and how a break-out goes with it. Needs setup."""
    edges = (-0.05, 0.20, 0.45, 0.55, 0.80, 1.05)
    for t in larger:
        name, high, low = t.upper(), c(f"{t}_high"), c(f"{t}_low")
        names = (f"BELOW_{name}_LOW", f"LOWER_{name}_RANGE", f"LOW_MID_{name}", f"MID_{name}", f"HIGH_MID_{name}", f"UPPER_{name}_RANGE", f"ABOVE_{name}_HIGH")
        place = over(c("close") - low, F.when(high != low, high - low))
        b = b.withColumns({f"dist_{t}_high_atr": over(high - c("close"), c("atr")), f"dist_{t}_low_atr": over(c("close") - low, c("atr")), f"pos_in_{t}_range": F.when(place.isNotNull(), F.least(F.lit(3.0), F.greatest(F.lit(-2.0), place)))})
        b = b.withColumns({f"{t}_range_location": bins(c(f"pos_in_{t}_range"), edges, names, f"UNKNOWN_{name}")} | {f"{t}_near_{s}": F.coalesce(c(f"dist_{t}_{s}_atr").between(-0.05, 0.35), F.lit(False)) for s in ("high", "low")} | {f"{t}_{n}_{s}": F.coalesce(c(f"dist_{t}_{s}_atr") < -0.05, F.lit(False)) for n, s in (("above", "high"), ("below", "low"))})
    up = sum((c(f"{t}_range_location").rlike("ABOVE|UPPER|HIGH_MID").cast("int") + F.coalesce((c(f"{t}_direction") == "UP").cast("int"), F.lit(0)) for t in larger), F.lit(0))
    down = sum((c(f"{t}_range_location").rlike("BELOW|LOWER|LOW_MID").cast("int") + F.coalesce((c(f"{t}_direction") == "DOWN").cast("int"), F.lit(0)) for t in larger), F.lit(0))
    b = b.withColumns({"htf_location_up_pressure": up, "htf_location_down_pressure": down})
    b = b.withColumn("htf_location_bias_score", c("htf_location_up_pressure") - c("htf_location_down_pressure"))
    s = c("htf_location_bias_score")
    b = b.withColumn("htf_location_bias", F.when(s >= 3, "STRONG_UP_LOCATION").when(s <= -3, "STRONG_DOWN_LOCATION").when(s > 0, "UP_LOCATION").when(s < 0, "DOWN_LOCATION").otherwise("MIXED_LOCATION"))
    with_up, with_down = s > 0, s < 0
    rise, fall = c("breakout_up") == 1, c("breakout_down") == 1
    way = F.when(rise & with_up, "BREAKOUT_WITH_HTF_UP").when(fall & with_down, "BREAKOUT_WITH_HTF_DOWN").when(rise & with_down, "BREAKOUT_AGAINST_HTF_DOWN").when(fall & with_up, "BREAKOUT_AGAINST_HTF_UP").when(rise | fall, "BREAKOUT_MIXED_HTF")
    return b.withColumn("breakout_location_alignment", way.otherwise("NO_BREAKOUT"))


def sequences(b: DataFrame) -> DataFrame:
    """Recent directions and events as text and counts, the streak, and the regime of the sequence. Needs core."""
    w = series()
    symbol = F.when(c("direction") == "UP", "U").when(c("direction") == "DOWN", "D").otherwise("N")
    b = b.withColumns({"_d": symbol, "_out": F.greatest("breakout_up", "breakout_down"), "_false": F.greatest("false_breakout_up", "false_breakout_down"), "_sweep": F.greatest("sweep_high", "sweep_low")})
    counted = {"compression_count": "compression_flag", "expansion_count": "expansion_flag", "breakout_count": "_out", "false_break_count": "_false", "sweep_count": "_sweep"}
    b = b.withColumns({f"dir_seq_{n}": F.when(c("row_idx") >= n, F.array_join(F.collect_list("_d").over(past(n)), "-")).otherwise("NA") for n in (3, 5, 8)} | {f"{name}_{n}": full(F.sum(x).over(past(n)), n, c("row_idx")) for name, x in counted.items() for n in (5, 8)})
    changed = F.coalesce(c("direction") != F.lag("direction").over(w), F.lit(True)).cast("int")
    b = b.withColumn("_new", changed).withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    length = F.row_number().over(Window.partitionBy("symbol", "_island").orderBy("time"))
    b = b.withColumn("dir_streak", F.when(c("direction") == "UP", length).when(c("direction") == "DOWN", -length).otherwise(0))
    out, streak = c("_out") == 1, c("dir_streak")
    ladder = (
        ((c("compression_count_5") >= 3) & out, "BREAKOUT_AFTER_COMPRESSION"),
        ((c("compression_count_8") >= 5) & out, "BREAKOUT_AFTER_LONG_COMPRESSION"),
        ((c("expansion_count_5") >= 3) & out, "BREAKOUT_AFTER_EXPANSION_CHAIN"),
        ((c("sweep_count_5") >= 1) & out, "BREAKOUT_AFTER_SWEEP"),
        ((c("false_break_count_5") >= 1) & out, "BREAKOUT_AFTER_FALSE_BREAK"),
        (streak >= 4, "UP_STREAK_EXTENDED"),
        (streak <= -4, "DOWN_STREAK_EXTENDED"),
        (c("compression_count_5") >= 3, "COMPRESSION_BUILDUP"),
        (c("expansion_count_5") >= 3, "EXPANSION_CHAIN"),
    )
    kind = F.when(F.lit(False), "")
    for test, name in ladder:
        kind = kind.when(test, name)
    tries = F.sum("_out").over(past(12))
    b = b.withColumns({"sequence_regime": kind.otherwise("NORMAL_SEQUENCE"), "breakout_attempt_lookback_12": tries})
    return b.withColumn("breakout_attempt_bucket", bins(c("breakout_attempt_lookback_12"), (0, 1, 2, 4), ("NO_RECENT_BO", "FIRST_BO", "SECOND_BO", "MULTI_BO", "BO_CLUSTER"))).drop("_d", "_out", "_false", "_sweep", "_new", "_island")
