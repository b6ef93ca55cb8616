"""The geometry of the last bars: slopes, compression, impulse and consolidation, local pivots, and shapes scored by their conditions.

Each bar carries its last LOOKBACK bars as one bounded array, from which everything is computed in place: least-squares slopes over
places in the array, means of halves, and pivots, which are bars no lower (or higher) than the RADIUS bars on either side. A shape's
score is the share of its conditions that hold. Bars with fewer than LEAST bars behind them, or without a size to measure by, have
no geometry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebar.functions.exprs import past

c = F.col
# Fixed values of the rules.
LOOKBACK, LEAST, WINDOW, RADIUS = 30, 8, 12, 2
TOLERANCE_ATR, APART = 0.45, 3


def values(bars: Column, field: str) -> Column:
    return F.transform(bars, lambda b: b[field])


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def mean(xs: Column) -> Column:
    return F.try_divide(total(xs), F.size(xs))


def slope(xs: Column) -> Column:
    """The least-squares slope of values over their places."""
    n = F.size(xs)
    mid = (n - 1) / F.lit(2.0)
    along = total(F.transform(xs, lambda x, i: (i - mid) * x))
    return F.try_divide(along, n * (n * n - 1) / F.lit(12.0))


def pivots(bars: Column, field: str) -> Column:
    """(at, price) of each local extreme: highs no lower, lows no higher than their neighbours."""
    n = F.size(bars)
    near = lambda i: values(F.slice(bars, i - RADIUS + 1, 2 * RADIUS + 1), field)
    inside = F.filter(F.transform(bars, lambda b, i: F.struct(i.alias("at"), b[field].alias("price"))), lambda p: (p["at"] >= RADIUS) & (p["at"] < n - RADIUS))
    return F.filter(inside, lambda p: p["price"] >= F.array_max(near(p["at"])) if field == "high" else p["price"] <= F.array_min(near(p["at"])))


def share(*conditions: Column) -> Column:
    """The share of conditions that hold; a missing one doesn't."""
    return F.round(sum((F.coalesce(x, F.lit(False)).cast("int") for x in conditions), F.lit(0)) / len(conditions), 3)


def geometry(b: DataFrame) -> DataFrame:
    """b (with atr and row_idx) and the geometry's columns; candidates is an array of (name, score)."""
    n = F.least(c("row_idx"), F.lit(LOOKBACK)).cast("int")
    few = F.when(c("row_idx") >= LEAST, F.collect_list(F.struct("open", "high", "low", "close", c("volume").cast("double").alias("volume"))).over(past(LOOKBACK)))
    g = b.withColumns({"_b": few, "_n": n})
    usual = mean(F.transform(F.slice("_b", F.greatest(c("_n") - 13, F.lit(1)), 14), lambda x: x["high"] - x["low"]))
    g = g.withColumn("atr_reference", F.coalesce(F.when(c("atr") > 0, c("atr")), F.when(usual > 0, usual)))
    g = g.withColumn("_b", F.when(c("atr_reference").isNotNull(), c("_b")))
    recent = F.slice("_b", F.greatest(c("_n") - (WINDOW - 1), F.lit(1)), WINDOW)
    calm = F.least(F.lit(6), F.greatest(F.lit(4), F.floor(c("_n") / 4).cast("int")))
    push = F.least(F.lit(5), F.greatest(F.lit(3), F.floor(c("_n") / 5).cast("int")))
    g = g.withColumns({"_g": recent, "_c": calm, "_i": push})
    g = g.withColumns({"_calm": F.slice("_b", c("_n") - c("_c") + 1, c("_c")), "_push": F.slice("_b", c("_n") - c("_c") - c("_i") + 1, c("_i"))})
    atr = c("atr_reference")
    widths = F.transform("_g", lambda x: x["high"] - x["low"])
    half = F.greatest(F.lit(2), F.floor(F.size("_g") / 2).cast("int"))
    move = F.element_at("_push", -1)["close"] - F.element_at("_push", 1)["open"]
    g = g.withColumns({f"{f}_slope_atr": slope(values(c("_g"), f)) / atr for f in ("high", "low", "close")} | {"compression_ratio": F.try_divide(mean(F.slice(widths, half + 1, WINDOW)), mean(F.slice(widths, F.lit(1), half))), "_move": move, "impulse_move_atr": move / atr, "_ch": F.array_max(values(c("_calm"), "high")), "_cl": F.array_min(values(c("_calm"), "low")), "_ic": F.element_at("_push", -1)["close"]})
    m = c("impulse_move_atr")
    back = F.when(c("_move") > 0, c("_ic") - c("_cl")).otherwise(c("_ch") - c("_ic"))
    g = g.withColumns(
        {
            "impulse_direction": F.when(m > 0, "UP").when(m < 0, "DOWN").when(m.isNotNull(), "FLAT"),
            "pullback_depth_pct": F.abs(F.try_divide(back, F.when(c("_move") != 0, c("_move")))) * 100,
            "consolidation_high_slope_atr": slope(values(c("_calm"), "high")) / atr,
            "consolidation_low_slope_atr": slope(values(c("_calm"), "low")) / atr,
            "consolidation_width_atr": (c("_ch") - c("_cl")) / atr,
            "volume_ratio": F.try_divide(mean(values(c("_calm"), "volume")), mean(values(c("_push"), "volume"))),
            "high_pivots": pivots(c("_b"), "high"),
            "low_pivots": pivots(c("_b"), "low"),
        }
    )
    return g.withColumn("candidates", _candidates()).drop("_b", "_n", "_g", "_c", "_i", "_calm", "_push", "_move", "_ch", "_cl", "_ic")


def _candidates() -> Column:
    m, back, vol = c("impulse_move_atr"), c("pullback_depth_pct").between(10, 70), c("volume_ratio") <= 1.05
    ch, cl, hs, ls, comp = c("consolidation_high_slope_atr"), c("consolidation_low_slope_atr"), c("high_slope_atr"), c("low_slope_atr"), c("compression_ratio")
    along = (hs + ls) / 2
    parallel, leans = F.abs(hs - ls) <= 0.05, F.abs(along) >= 0.02
    shapes = [
        (F.lit("BULL_FLAG"), share(m > 0, F.abs(m) >= 1.2, back, ch <= 0.08, cl <= 0.08, vol), 0.5),
        (F.lit("BEAR_FLAG"), share(m < 0, F.abs(m) >= 1.2, back, ch >= -0.08, cl >= -0.08, vol), 0.5),
        (F.lit("SYMMETRICAL_TRIANGLE"), share(hs < -0.02, ls > 0.02, comp < 0.9), 0.667),
        (F.lit("ASCENDING_TRIANGLE"), share(F.abs(hs) <= 0.04, ls > 0.02, comp < 0.95), 0.667),
        (F.lit("DESCENDING_TRIANGLE"), share(hs < -0.02, F.abs(ls) <= 0.04, comp < 0.95), 0.667),
    ]
    out = [F.when(score >= least, F.struct(name.alias("name"), score.alias("score"))) for name, score, least in shapes]
    channel = F.when(along > 0, "ASCENDING_CHANNEL").otherwise("DESCENDING_CHANNEL")
    out.append(F.when(parallel & leans, F.struct(channel.alias("name"), share(parallel, leans, comp.isNull() | (comp >= 0.65)).alias("score"))))
    for name, field in (("DOUBLE_TOP", "high_pivots"), ("DOUBLE_BOTTOM", "low_pivots")):
        a, z = F.try_element_at(field, F.lit(-2)), F.try_element_at(field, F.lit(-1))
        twice = (z["at"] - a["at"] >= APART) & (F.abs(z["price"] - a["price"]) / c("atr_reference") <= TOLERANCE_ATR)
        out.append(F.when(twice, F.struct(F.lit(name).alias("name"), F.lit(1.0).alias("score"))))
    return F.when(c("high_slope_atr").isNotNull(), F.array_compact(F.array(*out)))
