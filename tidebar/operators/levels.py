"""Blocks over structure and smoothed columns: distances, zigzag, gaps, order blocks, Fibonacci levels, readiness, live bar, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebar.functions.exprs import bins, flag, guarded, over, past, series
from tidebar.operators import touch

c = F.col

RETRACEMENTS = (382, 500, 618, 786)
EXTENSIONS = (1272, 1618)
#: Columns that are carried forward where they are missing.
CARRIED = ("sma_", "ema_", "bollinger_", "ichimoku_", "last_", "fib_", "bull_ob_candidate_", "bear_ob_candidate_")
CLASSES = ("FALSE_BREAKOUT_UP", "FALSE_BREAKOUT_DOWN", "OUTSIDE_RANGE", "BREAKOUT_UP_LIVE", "BREAKOUT_DOWN_LIVE", "INSIDE_RANGE_LOW_PARTICIPATION", "INSIDE_RANGE", "LIVE_RANGE_DEVELOPING")


def _running():
    return series().rowsBetween(Window.unboundedPreceding, 0)


def _known(x: Column) -> Column:
    """Zero as null, for divisors."""
    return F.when(x != 0, x)


def spread(b: DataFrame, z: int = 200) -> DataFrame:
    """The spread as a share of the close, and its z-score over whole windows of z rows."""
    b = b.withColumn("spread_pct", guarded(c("spread"), _known(c("close"))))
    w = past(z)
    return b.withColumn("spread_z", F.when(F.count("spread_pct").over(w) >= z, guarded(c("spread_pct") - F.avg("spread_pct").over(w), F.stddev_pop("spread_pct").over(w))))


def ema_trend(b: DataFrame) -> DataFrame:
    w = series()
    fast, slow = c("ema_20"), c("ema_50")
    fast1, slow1 = F.lag("ema_20").over(w), F.lag("ema_50").over(w)
    return b.withColumns(
        {
            "ema20_slope_5": F.ln(over(fast, F.lag("ema_20", 5).over(w))),
            "ema50_slope_5": F.ln(over(slow, F.lag("ema_50", 5).over(w))),
            "ema20_above_ema50": flag(fast > slow),
            "ema_cross_up": flag((fast > slow) & (fast1 <= slow1)),
            "ema_cross_dn": flag((fast < slow) & (fast1 >= slow1)),
        }
    )


DISTANCES = {"sma10": "sma_10", "sma50": "sma_50", "sma200": "sma_200", "ema20": "ema_20", "ema50": "ema_50", "bb_high": "bollinger_high", "bb_low": "bollinger_low", "donchian_high20": "donchian_high20", "donchian_low20": "donchian_low20"}


def distances(b: DataFrame) -> DataFrame:
    """How far the close is from each average and band, in atr. Needs rolling and smoothed columns."""
    return b.withColumns({f"dist_{n}_atr": guarded(c("close") - c(x), _known(c("atr"))) for n, x in DISTANCES.items()})


def zigzag(b: DataFrame, deviation_pct: float = 0.5, wing: int = 3) -> DataFrame:
    """Confirmed swings that are far enough from the last opposite swing. Places of their bars count from 0. Needs structure."""
    w = series()
    low1, high1 = F.lag("last_swing_low").over(w), F.lag("last_swing_high").over(w)
    far = {"high": guarded(F.abs(c("swing_high") - low1), F.abs(low1)), "low": guarded(F.abs(high1 - c("swing_low")), F.abs(c("swing_low")))}
    b = b.withColumns({f"zigzag_{s}_confirmed": flag(x >= deviation_pct / 100) for s, x in far.items()})
    place = (c("row_idx") - 1 - wing).cast("int")
    b = b.withColumns({f"zigzag_{s}": F.when(c(f"zigzag_{s}_confirmed") == 1, c(f"swing_{s}")) for s in far} | {f"zigzag_{s}_source_idx": F.when(c(f"zigzag_{s}_confirmed") == 1, place).otherwise(-1) for s in far})
    return b.withColumns({f"last_zigzag_{s}": F.last(f"zigzag_{s}", True).over(_running()) for s in far} | {f"last_zigzag_{s}_idx": F.last(F.when(c(f"zigzag_{s}_confirmed") == 1, place), True).over(_running()) for s in far})


def gap_zones(b: DataFrame, least: float = 0.1) -> DataFrame:
    """Gaps between a bar and the one before the previous: flags, bounds and sizes."""
    w = series()
    bounds = {"up": (F.lag("high", 2).over(w), c("low")), "dn": (c("high"), F.lag("low", 2).over(w))}
    for side, (low, high) in bounds.items():
        size = F.when(high.isNotNull() & low.isNotNull(), F.greatest(high - low, F.lit(0.0)))
        b = b.withColumns({"_low": low, "_high": high, "_size": size})
        b = b.withColumn("_atr", guarded(c("_size"), _known(c("atr"))))
        hit = F.coalesce(c("_atr") >= least, F.lit(False))
        b = b.withColumns({f"fvg_{side}": hit.cast("int"), f"fvg_{side}_low": F.when(hit, c("_low")), f"fvg_{side}_high": F.when(hit, c("_high")), f"fvg_{side}_size": F.when(hit, c("_size")).otherwise(0.0), f"fvg_{side}_size_atr": F.when(hit, c("_atr")).otherwise(0.0)})
    return b.drop("_low", "_high", "_size", "_atr")


def order_blocks(b: DataFrame, strong: float = 0.8) -> DataFrame:
    """The bar before a strong break of structure, carried on as a zone; in it, and closed through it. Needs structure."""
    force = guarded(F.abs(c("close") - c("open")), _known(c("atr"))) >= strong
    for side, bos, way in (("bull", "bos_up", c("close") > c("open")), ("bear", "bos_dn", c("close") < c("open"))):
        name = f"{side}_ob_candidate"
        b = b.withColumn(f"{name}_event", flag((c(bos) == 1) & way & force))
        new = c(f"{name}_event") == 1
        b = b.withColumns({f"{name}_low": F.last(F.when(new, c("pl")), True).over(_running()), f"{name}_high": F.last(F.when(new, c("ph")), True).over(_running())})
        b = b.withColumn(f"in_{name}", flag((c("low") <= c(f"{name}_high")) & (c("high") >= c(f"{name}_low"))))
        through = c("close") < c(f"{name}_low") if side == "bull" else c("close") > c(f"{name}_high")
        b = b.withColumn(f"mitigated_{name}", flag((c(f"in_{name}") == 1) & through))
    return b


def fibonacci(b: DataFrame) -> DataFrame:
    """Levels between the last zigzag points, in the direction of the newer one. Needs zigzag."""
    high, low = c("last_zigzag_high"), c("last_zigzag_low")
    way = F.when(c("last_zigzag_low_idx") < c("last_zigzag_high_idx"), 1).when(c("last_zigzag_high_idx") < c("last_zigzag_low_idx"), -1).otherwise(0)
    b = b.withColumns({"fib_direction": way, "_range": _known(F.abs(high - low))})
    d = c("fib_direction")
    levels = {f"fib_{k}_retr": -k / 1000 for k in RETRACEMENTS} | {f"fib_{k}_ext": k / 1000 - 1 for k in EXTENSIONS}
    b = b.withColumns({n: F.when(d == 1, high + F.lit(x) * c("_range")).when(d == -1, low - F.lit(x) * c("_range")) for n, x in levels.items()})
    return b.withColumns({f"dist_fib{k}_atr": guarded(c("close") - c(f"fib_{k}_retr"), _known(c("atr"))) for k in RETRACEMENTS}).drop("_range")


def readiness(b: DataFrame, warmup: int = 250) -> DataFrame:
    """Place from 0, whether the series warms up, and whether all that training or live use needs is there."""

    def there(*names: str) -> Column:
        out = F.lit(True)
        for n in names:
            out &= c(n).isNotNull()
        return out

    return b.withColumns(
        {
            "bar_idx": c("row_idx") - 1,
            "is_warmup": flag(c("row_idx") <= warmup),
            "ready_for_train": flag((c("row_idx") > warmup) & there("atr_z", "bb_width_z", "dist_sma200_atr", "vol_ratio")),
            "ready_for_realtime": flag(there("atr", "ema_20", "ema_50", "vol_ratio")),
        }
    )


def mark_live(bars: DataFrame, now: Column, seconds: int) -> DataFrame:
    """is_live_bar: the last bar of its symbol, if it is not over at `now`."""
    end = F.unix_micros(c("time").cast("timestamp")) + seconds * 1_000_000
    return bars.withColumn("is_live_bar", flag(F.lead("time").over(series()).isNull() & (F.unix_micros(now.cast("timestamp")) < end)))


def live_context(b: DataFrame, now: Column, seconds: int) -> DataFrame:
    """Pace, projected volume, place and class of the live bar; all others are NOT_LIVE. Needs base, bar_flags and is_live_bar."""
    live = c("is_live_bar") == 1
    passed = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(c("time").cast("timestamp"))) / 1e6
    ratio = F.least(F.lit(1.0), F.greatest(F.lit(0.01), F.least(F.lit(float(seconds)), F.greatest(F.lit(0.0), passed)) / seconds))
    usual = F.avg("volume").over(series().rowsBetween(-20, -1))
    size = c("high") - c("low")
    b = b.withColumns({"elapsed_bar_ratio": F.when(live, ratio), "_usual": usual})
    b = b.withColumns(
        {
            "expected_volume_at_elapsed": c("_usual") * c("elapsed_bar_ratio"),
            "projected_final_volume": c("volume") / c("elapsed_bar_ratio"),
            "live_price_position": F.when(live & (size > 0), (c("close") - c("low")) / size),
            "live_range_atr": F.when(live & (c("atr") > 0), size / c("atr")),
            "live_body_atr": F.when(live & (c("atr") > 0), F.abs(c("close") - c("open")) / c("atr")),
        }
    )
    b = b.withColumns({"volume_pace_ratio": F.when(c("expected_volume_at_elapsed") > 0, c("volume") / c("expected_volume_at_elapsed")), "projected_volume_ratio_20": F.when(c("_usual") > 0, c("projected_final_volume") / c("_usual"))})
    up, down, inside = c("high_above_prev_high") == 1, c("low_below_prev_low") == 1, c("inside_previous_range") == 1
    tests = (c("false_breakout_up") == 1, c("false_breakout_down") == 1, up & down, up, down, inside & (c("projected_volume_ratio_20") < 0.8), inside)
    kind = F.when(~live, "NOT_LIVE")
    for test, name in zip(tests, CLASSES, strict=False):
        kind = kind.when(test, name)
    return b.withColumn("live_bar_classification", kind.otherwise(CLASSES[-1])).drop("_usual")


def undoubled(df: DataFrame) -> DataFrame:
    """The first of the columns of each name."""
    names, own = df.columns, [f"c{k}" for k in range(len(df.columns))]
    first = {n: own[k] for k, n in reversed(list(enumerate(names)))}
    return df if len(first) == len(names) else df.toDF(*own).select(*(c(first[n]).alias(n) for n in dict.fromkeys(names)))


def assembled(df: DataFrame, flags: tuple[str, ...] = ()) -> DataFrame:
    """The last steps over all blocks: doubled columns once, infinities and not-a-number null, continuous columns carried forward, missing flags 0."""
    df = undoubled(df)
    fixed = {n: F.when(~F.isnan(c(n)) & (F.abs(c(n)) != float("inf")), c(n)) for n, t in df.dtypes if t == "double"}
    df = df.withColumns(fixed)
    carried = [n for n in df.columns if n.startswith(CARRIED) and not n.endswith("_event") and not n.startswith("fib_direction")]
    df = df.withColumns({n: F.last(n, True).over(_running()) for n in carried})
    return df.withColumns({n: F.coalesce(c(n), F.lit(0)) for n in flags})


def direction_signal(b: DataFrame) -> DataFrame:
    """+1 or -1 by structure, else by the averages; 0 where the row is not ready or live."""
    way = F.when(c("structure_state") != 0, F.signum("structure_state")).otherwise(F.when(c("ema20_above_ema50") == 1, 1.0).otherwise(-1.0))
    return b.withColumn("dir_signal", F.when((c("ready_for_train") == 1) & (c("is_live_bar") == 0), way).otherwise(0.0).cast("int"))


#: Target, stop (both in atr) and timeout in bars, by regime. Those besides the first are our own choice.
BARRIERS = {"default": (0.9, 0.7, 8), "compression": (0.8, 0.6, 6), "expansion_killzone": (1.2, 0.8, 10), "new_york_expansion": (1.5, 1.0, 12)}


def labels(b: DataFrame, barriers: dict[str, tuple[float, float, int]] = BARRIERS) -> DataFrame:
    """Triple barrier in the direction of dir_signal, with barriers by regime, and the meta label (did it pay).

    Entry at the next close; the entry bar is scanned too; both barriers in one bar are a stop; a live bar ends the scan; what
    runs out leaves at the close of the last bar of its time.
    """
    squeeze, wide = c("compression_flag") == 1, c("expansion_flag") == 1
    zone = (c("london_killzone") == 1) | (c("ny_killzone") == 1)

    def chosen(k: int) -> Column:
        value = {n: F.lit(x[k]) for n, x in barriers.items()}
        return F.when(wide & (c("ny_killzone") == 1), value["new_york_expansion"]).when(wide & zone, value["expansion_killzone"]).when(squeeze, value["compression"]).otherwise(value["default"])

    longest = max(x[2] for x in barriers.values())
    w = series()
    bars = F.collect_list(F.struct(c("row_idx").alias("k"), "high", "low", "close", c("is_live_bar").alias("live"))).over(w.rowsBetween(1, longest + 1))
    b = b.withColumns({"_tp": chosen(0), "_sl": chosen(1), "_t": chosen(2), "_entry": F.lead("close").over(w), "_all": bars})
    b = b.withColumn("_all", F.filter("_all", lambda x: x["k"] <= c("row_idx") + 1 + c("_t")))
    seen = F.filter("_all", lambda x: x["live"] == 0)
    side = c("dir_signal").cast("double")
    label, place = touch.first_touch(seen, c("_entry"), c("_tp") * c("atr"), c("_sl") * c("atr"), side, "SL_FIRST")
    ready = F.coalesce((c("dir_signal") != 0) & (c("atr") > 0) & c("_entry").isNotNull(), F.lit(False))
    kind = F.when(~ready, "NO_TRADE").when(label == "TP_FIRST", "TP").when(label == "SL_FIRST", "SL").otherwise("TIMEOUT")
    b = b.withColumns({"tb_exit_type": kind, "_place": place, "_out": F.try_element_at("_all", F.lit(-1))})
    t = c("tb_exit_type")
    b = b.withColumns(
        {
            "tb_y": F.when(t == "TP", 1).when(t == "SL", -1).otherwise(0),
            "tb_exit_idx": F.when(t == "NO_TRADE", -1).when(t == "TIMEOUT", c("_out.k") - 1).otherwise(c("_place") - 1).cast("int"),
            "tb_r_atr": F.when(t == "TP", c("_tp")).when(t == "SL", -c("_sl")).when(t == "TIMEOUT", side * (c("_out.close") - c("_entry")) / c("atr")),
        }
    )
    return b.withColumn("meta_label", F.when(t != "NO_TRADE", (c("tb_r_atr") > 0).cast("int"))).drop("_tp", "_sl", "_t", "_entry", "_all", "_place", "_out")


def resistance_support(b: DataFrame) -> DataFrame:
    """The nearest of previous bar, channel and band on both sides, in atr, with buckets and the zone they make."""
    high = F.least(F.abs("dist_prev_high_atr"), F.abs("dist_donchian_high20_atr"), F.abs("dist_bb_high_atr"))
    low = F.least(F.abs("dist_prev_low_atr"), F.abs("dist_donchian_low20_atr"), F.abs("dist_bb_low_atr"))
    edges, names = (0.15, 0.35, 0.75, 1.5), ("TOUCHING", "VERY_NEAR", "NEAR", "FAR", "VERY_FAR")
    b = b.withColumns({"nearest_resistance_atr": high, "nearest_support_atr": low})
    b = b.withColumns({"resistance_bucket": bins(c("nearest_resistance_atr"), edges, names), "support_bucket": bins(c("nearest_support_atr"), edges, names)})
    close = ("TOUCHING", "VERY_NEAR")
    zone = F.when(c("resistance_bucket").isin(*close), "AT_RESISTANCE").when(c("support_bucket").isin(*close), "AT_SUPPORT").when(c("resistance_bucket") == "NEAR", "NEAR_RESISTANCE").when(c("support_bucket") == "NEAR", "NEAR_SUPPORT")
    return b.withColumn("level_zone", zone.otherwise("NO_LEVEL_PRESSURE"))


