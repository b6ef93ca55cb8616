"""First match in a window of coming bars: one generic operator with its variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebar.functions.exprs import ahead, series

c = F.col


def coming(horizon: int, first: int = 1) -> Column:
    """The next bars in order, as an array of (k, high, low, close); bounded by the horizon."""
    return F.collect_list(F.struct(c("row_idx").alias("k"), "high", "low", "close")).over(ahead(horizon, first))


def first_touch(bars: Column, entry: Column, target: Column, stop: Column, side: Column, tie: str = "AMBIGUOUS") -> tuple[Column, Column]:
    """Label and place of the first bar that touches target or stop; a bar with both gets the tie's label."""
    tp, sl = entry + side * target, entry - side * stop

    def won(b: Column) -> Column:
        return F.when(side > 0, b["high"] >= tp).otherwise(b["low"] <= tp)

    def lost(b: Column) -> Column:
        return F.when(side > 0, b["low"] <= sl).otherwise(b["high"] >= sl)

    hit = F.try_element_at(F.filter(bars, lambda b: won(b) | lost(b)), F.lit(1))
    label = F.when(hit.isNull(), "NO_TOUCH").when(won(hit) & lost(hit), tie).when(won(hit), "TP_FIRST").otherwise("SL_FIRST")
    return label, hit["k"]


def reward_risk(b: DataFrame, combos: tuple[tuple[float, float, int], ...] = ((0.5, 0.25, 6), (1.0, 0.5, 12), (1.5, 0.75, 24), (2.0, 1.0, 24))) -> DataFrame:
    """In the candle's direction: a column for each (target, stop, bars), INVALID without atr or direction."""
    side = F.signum(c("close") - c("open"))
    for target, stop, bars in combos:
        label, _ = first_touch(c("_next"), c("close"), target * c("atr"), stop * c("atr"), side)
        b = b.withColumn("_next", coming(bars)).withColumn(f"rr_{target}_{stop}_{bars}", F.when(c("atr").isNull() | (side == 0) | (c("atr") <= 0), "INVALID").otherwise(label))
    return b.drop("_next")


def both_sides(b: DataFrame, target: float = 1.0, stop: float = 0.5, bars: int = 12) -> DataFrame:
    """buy and sell labels, with bars to the result."""
    b = b.withColumn("_next", coming(bars))
    for name, side in (("buy", 1), ("sell", -1)):
        label, place = first_touch(c("_next"), c("close"), target * c("atr"), stop * c("atr"), F.lit(side))
        b = b.withColumns({f"{name}_label": F.when(c("atr").isNull() | (c("atr") <= 0), "INVALID").otherwise(label), f"{name}_bars": F.when(c("atr") > 0, place - c("row_idx"))})
    return b.drop("_next")


def with_extremes(b: DataFrame, way: str, target: float, stop: float) -> DataFrame:
    """First touch of one direction ("up" or "down") over the bars in _next, with bars to it and the extremes up to it, that bar included."""
    side = F.lit(1 if way == "up" else -1)
    label, place = first_touch(c("_next"), c("close"), target * c("atr"), stop * c("atr"), side)
    ready = F.coalesce(c("atr") > 0, F.lit(False))
    name = f"{way}_{stop:g}"
    b = b.withColumns({"_label": label, "_place": F.when(ready, place)})
    seen = F.filter("_next", lambda x: x["k"] <= c("_place"))

    def most(value) -> Column:
        return F.when(c("_place").isNotNull(), F.round(F.greatest(F.lit(0.0), F.array_max(F.transform(seen, value)) / c("atr")), 5))

    high, low = most(lambda x: x["high"] - c("close")), most(lambda x: c("close") - x["low"])
    adverse, favorable = (low, high) if way == "up" else (high, low)
    return b.withColumns({f"first_touch_{name}": F.when(ready, c("_label")).otherwise("INVALID"), f"bars_to_result_{name}": c("_place") - c("row_idx").cast("long"), f"adverse_before_target_{name}": adverse, f"favorable_before_stop_{name}": favorable}).drop("_label", "_place")


def pullback_entry(b: DataFrame, back: float = 0.25, target: float = 1.0, stop: float = 0.5, bars: int = 12) -> DataFrame:
    """A limit `back` atr behind the close; target and stop are tested from the bar that fills it on."""
    side = F.signum(c("close") - c("open"))
    entry = c("close") - side * back * c("atr")
    b = b.withColumn("_next", coming(bars)).withColumn("_entry", entry)
    fill = F.try_element_at(F.filter("_next", lambda x: F.when(side > 0, x["low"] <= c("_entry")).otherwise(x["high"] >= c("_entry"))), F.lit(1))["k"]
    b = b.withColumn("fill_bars", fill - c("row_idx"))
    label, _ = first_touch(F.filter("_next", lambda x: x["k"] >= c("row_idx") + c("fill_bars")), c("_entry"), target * c("atr"), stop * c("atr"), side)
    ready = (c("atr") > 0) & (side != 0)
    done = F.when(c("fill_bars").isNull(), "NOT_FILLED").when(label == "NO_TOUCH", "FILLED_NO_EXIT").otherwise(label)
    return b.withColumn("pullback_label", F.when(F.coalesce(ready, F.lit(False)), done).otherwise("INVALID")).withColumn("fill_bars", F.when(ready, c("fill_bars"))).drop("_next", "_entry")


def triple_barrier(b: DataFrame, target: float = 1.5, stop: float = 1.0, timeout: int = 12) -> DataFrame:
    """Entry at the next close; the entry bar itself is scanned; both in one bar is a stop; what runs out leaves at the last close of its time."""
    side = F.signum(c("close") - c("open"))
    b = b.withColumns({"_entry": F.lead("close").over(series()), "_next": coming(timeout + 1)}).withColumn("_exit", F.try_element_at("_next", F.lit(-1))["close"])
    label, place = first_touch(c("_next"), c("_entry"), target * c("atr"), stop * c("atr"), side, "SL_FIRST")
    ready = F.coalesce((c("atr") > 0) & (side != 0) & c("_entry").isNotNull(), F.lit(False))
    kind = F.when(~ready, "NO_TRADE").when(label == "TP_FIRST", "TP").when(label == "SL_FIRST", "SL").otherwise("TIMEOUT")
    r = F.when(c("tb_exit_type") == "TP", target).when(c("tb_exit_type") == "SL", -stop).when(c("tb_exit_type") == "TIMEOUT", F.try_divide(side * (c("_exit") - c("_entry")), c("atr")))
    b = b.withColumns({"tb_exit_type": kind, "tb_exit_idx": F.when(ready, place)})
    return b.withColumns({"tb_r_atr": r, "tb_y": F.when(c("tb_exit_type") == "TP", 1).when(c("tb_exit_type") == "SL", -1).otherwise(0)}).drop("_entry", "_next", "_exit")
