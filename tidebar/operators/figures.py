"""Chart figures from regression lines over the highs and lows of the last bars, their break-outs, retests and zones."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebar.functions.exprs import ahead, past, series
from tidebar.operators import sequential

c = F.col
#: Fixed values of the detector; distances in atr.
WINDOWS, HORIZONS = (12, 20, 30), (3, 6, 12)
SLOPE, MIN_R2, COMPRESSION, BOX_WIDTH = 0.025, 0.15, 0.25, 2.5
TOUCH, MIN_TOUCHES, BUFFER, FALSE_BARS, RETEST_BARS = 0.18, 2, 0.08, 3, 6
WEIGHTS = {"PREVIOUS": 1, "RANGE": 2, "SWING": 3}
MERGE, ALIGNED, OBSTACLE = 0.10, 0.20, 1.0


def _line(y: str, w: int) -> tuple[Column, Column, Column]:
    """Slope, value at the window's first bar and R2 of a column over the last w bars; a flat column has R2 1."""
    x, of = c("row_idx").cast("double"), past(w)
    slope = F.regr_slope(c(y), x).over(of)
    start = F.regr_intercept(c(y), x).over(of) + slope * (c("row_idx") - w + 1)
    return slope, start, F.coalesce(F.regr_r2(c(y), x).over(of), F.lit(1.0))


def figures(b: DataFrame, w: int, far: int = max(HORIZONS)) -> DataFrame:
    """Rows at which a figure of w bars stands, with the next bar's close and on which side it leaves the lines (side, null: stays). Needs base."""
    n = F.count("*").over(Window.partitionBy("symbol"))
    b = b.withColumns(dict(zip(("us", "u0", "ur"), _line("high", w), strict=True)) | dict(zip(("ds", "d0", "dr"), _line("low", w), strict=True)))
    b = b.withColumns({"ar": F.percentile(F.when(c("atr") > 0, c("atr")), F.lit(0.5)).over(past(w)), "bars": F.collect_list(F.struct("high", "low")).over(past(w)), "n": n, "w0": c("u0") - c("d0"), "w1": c("u0") + c("us") * (w - 1) - c("d0") - c("ds") * (w - 1)})
    ahead1 = {f"next_{x}": F.lead(x).over(series()) for x in ("close", "atr", "time", "row_idx", "vol_ratio")}
    b = b.withColumns(ahead1).where((c("row_idx") >= w) & (c("row_idx") <= c("n") - far - 1) & (c("ar") > 0) & (c("w0") > 0) & (c("w1") > 0))
    us, ds, comp = c("us") / c("ar"), c("ds") / c("ar"), 1 - c("w1") / c("w0")
    flat_up, flat_down, falls, rises, tight = F.abs(us) <= SLOPE, F.abs(ds) <= SLOPE, us <= -SLOPE, ds >= SLOPE, comp >= COMPRESSION
    kind = F.when(tight & falls & rises, "TRIANGLE_SYMMETRIC").when(tight & flat_up & rises, "TRIANGLE_ASCENDING").when(tight & falls & flat_down, "TRIANGLE_DESCENDING").when(flat_up & flat_down & (c("w1") / c("ar") <= BOX_WIDTH), "RANGE_BOX")
    b = b.withColumns({"compression_ratio": comp, "width_end_atr": c("w1") / c("ar"), "upper_slope_atr": us, "lower_slope_atr": ds, "pattern_type": F.when(F.least("ur", "dr") >= MIN_R2, kind)}).where("pattern_type IS NOT NULL")

    def touches(side: str, start: str, slope: str) -> Column:
        near = F.transform("bars", lambda x, k: F.abs(x[side] - (c(slope) * k + c(start))) <= TOUCH * c("ar"))
        return F.size(F.filter(near, lambda x: x))

    b = b.withColumns({"upper_touches": touches("high", "u0", "us"), "lower_touches": touches("low", "d0", "ds")}).where(F.least("upper_touches", "lower_touches") >= MIN_TOUCHES)
    quality = 25 * F.greatest(c("compression_ratio"), F.lit(0.0)) + 20 * c("ur") + 20 * c("dr") + 10 * F.least(c("upper_touches") / 4, F.lit(1.0)) + 10 * F.least(c("lower_touches") / 4, F.lit(1.0))
    b = b.withColumns({"window_bars": F.lit(w), "na": F.when(c("next_atr") > 0, c("next_atr")).otherwise(c("ar")), "upper": c("us") * w + c("u0"), "lower": c("ds") * w + c("d0"), "quality_score": F.least(F.lit(100.0), F.greatest(F.lit(0.0), quality))})
    side = F.when(c("next_close") > c("upper") + BUFFER * c("na"), "UP").when(c("next_close") < c("lower") - BUFFER * c("na"), "DOWN")
    return b.withColumn("breakout_side", side).drop("bars")


def _all(b: DataFrame, windows: Iterable[int]) -> DataFrame:
    out = None
    for w in windows:
        rows = figures(b, w)
        out = rows if out is None else out.unionByName(rows)
    return out


_SHAPE = ["compression_ratio", "width_end_atr", "upper_slope_atr", "lower_slope_atr", "ur", "dr", "upper_touches", "lower_touches", "quality_score"]


def episodes(b: DataFrame, windows: tuple[int, ...] = WINDOWS) -> DataFrame:
    """Standing figures without a break-out, the best of each run of bars of a window and type."""
    rows = _all(b, windows).where("breakout_side IS NULL").select("symbol", "time", "row_idx", "pattern_type", "window_bars", *_SHAPE)
    of = Window.partitionBy("symbol", "window_bars", "pattern_type").orderBy("row_idx")
    rows = rows.withColumn("_new", (F.coalesce(c("row_idx") - F.lag("row_idx").over(of), F.lit(999)) > 1).cast("int"))
    rows = rows.withColumn("episode_id", F.sum("_new").over(of.rowsBetween(Window.unboundedPreceding, 0)))
    best = F.max_by(F.struct("time", "row_idx", *_SHAPE), F.struct("quality_score", "row_idx"))
    return rows.groupBy("symbol", "window_bars", "pattern_type", "episode_id").agg(best.alias("x")).select("symbol", "window_bars", "pattern_type", "episode_id", "x.*")


def breakouts(b: DataFrame, windows: tuple[int, ...] = WINDOWS, shared: bool = True) -> DataFrame:
    """Break-outs of figures after their cooldown, one a bar and side (the best), with what followed. Needs base and vol_ratio."""
    w = series()
    later = {f"hi_{h}": F.max("high").over(ahead(h)) for h in HORIZONS} | {f"lo_{h}": F.min("low").over(ahead(h)) for h in HORIZONS} | {f"cl_{h}": F.lead("close", h).over(w) for h in HORIZONS}
    coming = F.collect_list(F.struct(c("row_idx").alias("k"), "high", "low", "close", "time")).over(ahead(RETEST_BARS))
    after = b.withColumns(later | {"next_bars": coming}).select(c("symbol").alias("_symbol"), c("row_idx").alias("_row"), *later, "next_bars")
    broke = _all(b, windows).where("breakout_side IS NOT NULL").select("symbol", "pattern_type", "window_bars", c("next_row_idx").cast("int").alias("bar_index"), c("next_time").alias("breakout_time"), c("time").alias("formation_end_time"), "breakout_side", c("next_close").alias("breakout_price"), "upper", "lower", c("na").alias("atr"), c("next_vol_ratio").alias("breakout_volume_ratio"), *_SHAPE)
    kept = sequential.cooled(broke, ("symbol",), "window_bars", "bar_index", shared)
    up = c("breakout_side") == "UP"
    kept = kept.withColumn("breakout_boundary", F.when(up, c("upper")).otherwise(c("lower"))).withColumn("breakout_distance_atr", F.abs(c("breakout_price") - c("breakout_boundary")) / c("atr"))
    first = Window.partitionBy("symbol", "breakout_time", "breakout_side").orderBy(c("quality_score").desc(), "window_bars")
    kept = kept.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    met = kept.join(after, (c("symbol") == c("_symbol")) & (c("bar_index") == c("_row"))).drop("_symbol", "_row")
    edge, tol = c("breakout_boundary"), TOUCH * c("atr")
    back = F.exists(F.slice("next_bars", 1, FALSE_BARS), lambda x: F.when(up, x["close"] < edge).otherwise(x["close"] > edge))
    met = met.withColumns({"false_breakout": back, "retest": F.exists("next_bars", lambda x: F.abs(F.when(up, x["low"]).otherwise(x["high"]) - edge) <= tol)})
    return outcomes(met)


def outcomes(met: DataFrame, prefix: str = "", entry: str = "breakout_price") -> DataFrame:
    """For each horizon mfe, mae, return and success of entries on breakout_side, from hi_, lo_ and cl_ columns."""
    up, e = c("breakout_side") == "UP", c(entry)
    for h in HORIZONS:
        rise, fall = (c(f"{prefix}hi_{h}") - e) / c("atr"), (e - c(f"{prefix}lo_{h}")) / c("atr")
        met = met.withColumns({f"{prefix}mfe_{h}_atr": F.when(up, rise).otherwise(fall), f"{prefix}mae_{h}_atr": F.when(up, fall).otherwise(rise), f"{prefix}return_{h}_atr": F.when(up, 1.0).otherwise(-1.0) * (c(f"{prefix}cl_{h}") - e) / c("atr")})
        met = met.withColumn(f"{prefix}success_{h}", F.coalesce((c(f"{prefix}mfe_{h}_atr") >= 0.5) & (c(f"{prefix}mfe_{h}_atr") > c(f"{prefix}mae_{h}_atr")), F.lit(False)))
    return met


def retests(events: DataFrame) -> DataFrame:
    """The first of the next bars that comes back to the boundary and closes beyond it, unless one closes through it before."""
    up, edge, tol = c("breakout_side") == "UP", c("breakout_boundary"), TOUCH * c("atr")

    def failed(x: Column) -> Column:
        return F.when(up, x["close"] < edge - tol).otherwise(x["close"] > edge + tol)

    def confirmed(x: Column) -> Column:
        return F.when(up, (x["low"] <= edge + tol) & (x["close"] > edge)).otherwise((x["high"] >= edge - tol) & (x["close"] < edge))

    hit = F.try_element_at(F.filter("next_bars", lambda x: failed(x) | confirmed(x)), F.lit(1))
    events = events.withColumn("_hit", hit)
    lost = F.coalesce(failed(c("_hit")), F.lit(False))
    held = c("_hit").isNotNull() & ~lost
    return events.withColumns({"retest_confirmed": held, "failed_before_retest": lost, "bars_to_retest": F.when(held, c("_hit.k") - c("bar_index")), "retest_time": F.when(held, c("_hit.time")), "retest_entry_price": F.when(held, c("_hit.close"))}).drop("_hit")


def swings(b: DataFrame, left: int = 2, right: int = 2) -> DataFrame:
    """Swing levels at the bar that confirms them: high (or low) of `right` bars before, carried on."""
    w = series()
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    high, low = F.lag("high", right).over(w), F.lag("low", right).over(w)
    older, newer = w.rowsBetween(-(left + right), -(right + 1)), w.rowsBetween(-(right - 1), 0)
    whole = F.row_number().over(w) > left + right
    top = F.when(whole & (high >= F.max("high").over(older)) & (high > F.max("high").over(newer)), high)
    bottom = F.when(whole & (low <= F.min("low").over(older)) & (low < F.min("low").over(newer)), low)
    b = b.withColumns({"_top": top, "_bottom": bottom})
    return b.withColumns({"swing_up": F.last("_top", True).over(run), "swing_down": F.last("_bottom", True).over(run)}).drop("_top", "_bottom")


def clustered(candidates: Column, atr: Column) -> Column:
    """Zones of levels (structs of level, kind, tf) that stand near the weighted mean of the zone below them: price, kinds, tfs, strength."""

    def weight(kind: Column) -> Column:
        out = F.when(F.lit(False), 0.0)
        for name, w in WEIGHTS.items():
            out = out.when(kind == name, float(w))
        return out

    zone = "struct<price:double,total:double,weight:double,kinds:array<string>,tfs:array<string>>"

    def fresh(x: Column) -> Column:
        return F.struct(x["level"].alias("price"), (x["level"] * weight(x["kind"])).alias("total"), weight(x["kind"]).alias("weight"), F.array(x["kind"]).alias("kinds"), F.array(x["tf"]).alias("tfs"))

    def add(zones: Column, x: Column) -> Column:
        last = F.try_element_at(zones, F.lit(-1))
        total, w = last["total"] + x["level"] * weight(x["kind"]), last["weight"] + weight(x["kind"])
        joined = F.struct((total / w).alias("price"), total.alias("total"), w.alias("weight"), F.array_union(last["kinds"], F.array(x["kind"])).alias("kinds"), F.array_union(last["tfs"], F.array(x["tf"])).alias("tfs"))
        apart = last.isNull() | (F.abs(x["level"] - last["price"]) / atr > MERGE)
        return F.when(apart, F.concat(zones, F.array(fresh(x)))).otherwise(F.concat(F.slice(zones, F.lit(1), F.size(zones) - 1), F.array(joined)))

    made = F.aggregate(F.array_sort(F.filter(candidates, lambda x: x["level"].isNotNull())), F.array().cast(f"array<{zone}>"), add)
    strength = lambda z: F.aggregate(z["kinds"], F.lit(0.0), lambda a, k: a + weight(k))
    return F.transform(made, lambda z: F.struct(z["price"].alias("price"), F.array_sort(z["kinds"]).alias("kinds"), z["tfs"].alias("tfs"), strength(z).alias("strength")))


def zone_context(events: DataFrame, candidates: Column) -> DataFrame:
    """The zone that a break-out's boundary stands at, the next one ahead, and the context that they make."""
    up, edge, atr = c("breakout_side") == "UP", c("breakout_boundary"), c("atr")
    events = events.withColumn("zones", clustered(candidates, atr))
    events = events.withColumn("zones", F.transform("zones", lambda z: F.struct((F.abs(z["price"] - edge) / atr).alias("distance_atr"), (-z["strength"]).alias("weakness"), z["price"].alias("price"), z["kinds"].alias("kinds"), z["tfs"].alias("tfs"), F.when(up, z["price"] > edge).otherwise(z["price"] < edge).alias("ahead"))))
    at = F.array_min(F.filter("zones", lambda z: z["distance_atr"] <= ALIGNED))
    ahead_of = F.array_min(F.filter("zones", lambda z: z["ahead"] & (z["distance_atr"] > ALIGNED) & (z["distance_atr"] <= OBSTACLE)))
    events = events.withColumns({"_at": at, "_next": ahead_of})

    def has(z: str, kind: str) -> Column:
        return F.array_contains(f"{z}.kinds", kind)

    obstacle = F.when(has("_next", "SWING"), "STRUCTURAL_OBSTACLE_AHEAD").when(has("_next", "RANGE"), "RANGE_BOUNDARY_AHEAD").otherwise("INSIDE_HTF_CANDLE_RANGE")
    alignment = F.when(has("_at", "SWING"), "STRUCTURAL_ALIGNMENT").when(has("_at", "RANGE"), "RANGE_ALIGNMENT").otherwise("CANDLE_EXTREME_ALIGNMENT")
    there, near = c("_at").isNotNull(), c("_next").isNotNull()
    ref = F.coalesce(c("_at"), c("_next"))
    kinds, strength = ref["kinds"], -ref["weakness"]
    return events.withColumns(
        {
            "htf_zone_count": F.size("zones"),
            "higher_tf_context": F.when(there & near, "ALIGNED_WITH_NEAR_OBSTACLE").when(there, "HTF_ZONE_ALIGNMENT_CLEAR_SPACE").when(near, obstacle).otherwise("NO_NEAR_HTF_ZONE"),
            "breakout_zone_price": c("_at.price"),
            "breakout_zone_relation": F.when(there, alignment).otherwise("NO_ALIGNMENT"),
            "breakout_zone_sources": F.array_join("_at.kinds", "+"),
            "next_obstacle_price": c("_next.price"),
            "next_obstacle_relation": F.when(near, obstacle).otherwise("NO_NEAR_OBSTACLE"),
            "available_space_atr": c("_next.distance_atr"),
            "zone_strength_bucket": F.when(ref.isNull(), "NO_ZONE").when(strength <= 1, "WEAK_ZONE").when(strength <= 3, "MEDIUM_ZONE").otherwise("STRONG_ZONE"),
            "zone_origin_bucket": F.when(ref.isNull(), "NO_ZONE").when(F.array_contains(kinds, "SWING") & F.array_contains(kinds, "RANGE"), "HAS_RANGE_AND_SWING").when(F.array_contains(kinds, "SWING"), "HAS_SWING").when(F.array_contains(kinds, "RANGE"), "HAS_RANGE").otherwise("PREVIOUS_ONLY"),
        }
    ).drop("zones", "_at", "_next")
