"""Feature blocks: each takes bars (symbol, time, open, high, low, close, volume) and adds columns, by window functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebar.functions import blocks
from tidebar.functions.exprs import ahead, flag, full, guarded, over, past, series
from tidebar.functions.recursive import ewm, linear, wilder, wilder_sum

c = F.col


def base(bars: DataFrame, atr: int = 14) -> DataFrame:
    """Previous values, place, true range and Wilder's mean of it as atr."""
    return with_atr(previous(bars.withColumn("row_idx", F.row_number().over(series()))), atr)


def previous(b: DataFrame) -> DataFrame:
    """Previous values and true range."""
    w = series()
    out = b.withColumns({"po": F.lag("open").over(w), "ph": F.lag("high").over(w), "pl": F.lag("low").over(w), "pc": F.lag("close").over(w)})
    return out.withColumn("tr", F.greatest(c("high") - c("low"), F.abs(c("high") - c("pc")), F.abs(c("low") - c("pc"))))


def with_atr(b: DataFrame, atr: int = 14) -> DataFrame:
    return linear(b, {"atr": wilder(c("tr"), atr)}).withColumn("atr", full(c("atr"), atr, c("row_idx")))


#: Rows that the bounded features look back: 200 for z-scores of a band of 20, and some.
LOOK_BACK = 256


def in_blocks(bars: DataFrame, size: int = blocks.SIZE) -> DataFrame:
    """All feature columns of bars whose frames are bounded, and the smoothed ones, without a task a series for the bounded ones."""
    from tidebar.operators import levels

    def bounded(b: DataFrame) -> DataFrame:
        b = regimes(levels.distances(rolling_indicators(b, totals=False)))
        return levels.gap_zones(candle_patterns(bar_flags(price_blocks(b))))

    b = blocks.in_blocks(blocks.numbered(bars), previous, 1, 0, size)
    return blocks.in_blocks(smoothed(with_atr(b)), bounded, LOOK_BACK, 0, size)


def smoothed(b: DataFrame, width: int = 14) -> DataFrame:
    """EMA, MACD with signal and histogram, RSI, ADX with both directional indices. Needs base."""
    n, cl, pc = c("row_idx"), c("close"), c("pc")
    up, down = c("high") - c("ph"), c("pl") - c("low")
    plus, minus = F.when((up > down) & (up > 0), up).otherwise(0.0), F.when((down > up) & (down > 0), down).otherwise(0.0)
    b = linear(
        b,
        {
            **{f"_e{k}": ewm(cl, 2 / (k + 1)) for k in (12, 20, 26, 50)},
            "_gain": ewm(F.when(cl > pc, cl - pc).otherwise(0.0), 1 / width),
            "_loss": ewm(F.when(cl < pc, pc - cl).otherwise(0.0), 1 / width),
            "_tr": wilder_sum(c("tr"), width, 2),
            "_plus": wilder_sum(plus, width, 2),
            "_minus": wilder_sum(minus, width, 2),
        },
    )
    b = b.withColumns(
        {
            **{f"ema_{k}": full(c(f"_e{k}"), k, n) for k in (20, 50)},
            "macd": full(c("_e12") - c("_e26"), 26, n),
            "rsi_14": full(F.when(c("_loss") == 0, 100.0).otherwise(100 - 100 / (1 + over(c("_gain"), c("_loss")))), width, n),
            "plus_di_14": full(100 * over(c("_plus"), c("_tr")), width + 1, n),
            "minus_di_14": full(100 * over(c("_minus"), c("_tr")), width + 1, n),
        }
    )
    b = b.withColumn("_dx", F.coalesce(100 * over(F.abs(c("plus_di_14") - c("minus_di_14")), c("plus_di_14") + c("minus_di_14")), F.lit(0.0)))
    b = linear(b, {"macd_signal": ewm(c("macd"), 2 / 10, 26), "adx_14": wilder(c("_dx"), width, width + 1)})
    b = b.withColumns({"macd_signal": full(c("macd_signal"), 34, n), "adx_14": full(c("adx_14"), 2 * width, n)})
    return b.withColumn("macd_hist", c("macd") - c("macd_signal")).drop("_e12", "_e20", "_e26", "_e50", "_gain", "_loss", "_tr", "_plus", "_minus", "_dx")


def price_blocks(b: DataFrame) -> DataFrame:
    w = series()
    rng, body = c("high") - c("low"), c("close") - c("open")
    solid = F.when(rng != 0, rng)
    return b.withColumns(
        {
            **{f"ret_{k}": F.when(F.lag("close", k).over(w) > 0, F.ln(over(c("close"), F.lag("close", k).over(w)))) for k in (1, 3, 5)},
            "range_pct": guarded(solid, c("close")),
            "body_pct": guarded(F.abs(body), solid),
            "body_signed_pct": guarded(body, solid),
            "close_pos": guarded(c("close") - c("low"), solid),
            "upper_wick_pct": guarded(c("high") - F.greatest("open", "close"), solid),
            "lower_wick_pct": guarded(F.least("open", "close") - c("low"), solid),
            "body_direction": F.signum(body).cast("int"),
        }
    )


def bar_flags(b: DataFrame) -> DataFrame:
    h, lo, cl, ph, pl, pc = (c(n) for n in ("high", "low", "close", "ph", "pl", "pc"))
    return b.withColumns(
        {
            "close_above_prev_close": flag(cl > pc),
            "close_below_prev_close": flag(cl < pc),
            "high_above_prev_high": flag(h > ph),
            "low_below_prev_low": flag(lo < pl),
            "inside_previous_range": flag((h <= ph) & (lo >= pl)),
            "outside_previous_range": flag((h > ph) & (lo < pl)),
            "breakout_up": flag(cl > ph),
            "breakout_down": flag(cl < pl),
            "false_breakout_up": flag((h > ph) & (cl <= ph)),
            "false_breakout_down": flag((lo < pl) & (cl >= pl)),
            "range_expansion_vs_prev": flag((h - lo) > (ph - pl)),
            "range_expansion_ratio": guarded(h - lo, ph - pl),
            "dist_prev_high_atr": guarded(cl - ph, c("atr")),
            "dist_prev_low_atr": guarded(cl - pl, c("atr")),
            "breakout_up_distance_atr": F.when(cl > ph, guarded(cl - ph, c("atr"))).otherwise(0.0),
            "breakout_down_distance_atr": F.when(cl < pl, guarded(pl - cl, c("atr"))).otherwise(0.0),
        }
    )


def candle_patterns(b: DataFrame) -> DataFrame:
    w = series()
    o, h, lo, cl, po, ph, pl, pc = (c(n) for n in ("open", "high", "low", "close", "po", "ph", "pl", "pc"))
    o2, c2 = F.lag("open", 2).over(w), F.lag("close", 2).over(w)
    rng, body, top, bottom = h - lo, F.abs(cl - o), F.greatest(o, cl), F.least(o, cl)
    upper, lower = h - top, bottom - lo
    near = F.when(F.count("*").over(past(20)) >= 5, 0.05 * F.percentile(rng, F.lit(0.5)).over(past(20)))
    return b.withColumns(
        {
            "hammer": flag((lower > 2 * body) & (upper < body)),
            "inverted_hammer": flag((upper > 2 * body) & (lower < body)),
            "bullish_engulfing": flag((pc < po) & (cl > o) & (o <= pc) & (cl >= po)),
            "bearish_engulfing": flag((pc > po) & (cl < o) & (o >= pc) & (cl <= po)),
            "doji": flag(over(body, rng) < 0.1),
            "bullish_marubozu": flag((cl > o) & (guarded(upper, rng) < 0.05) & (guarded(lower, rng) < 0.05)),
            "bearish_marubozu": flag((cl < o) & (guarded(upper, rng) < 0.05) & (guarded(lower, rng) < 0.05)),
            "morning_star": flag((c2 < o2) & (F.abs(pc - po) < 0.35 * F.abs(c2 - o2)) & (cl > o) & (cl > (o2 + c2) / 2)),
            "evening_star": flag((c2 > o2) & (F.abs(pc - po) < 0.35 * F.abs(c2 - o2)) & (cl < o) & (cl < (o2 + c2) / 2)),
            "three_white_soldiers": flag((c2 > o2) & (pc > po) & (cl > o) & (pc > c2) & (cl > pc)),
            "three_black_crows": flag((c2 < o2) & (pc < po) & (cl < o) & (pc < c2) & (cl < pc)),
            "piercing_line": flag((pc < po) & (cl > o) & (o < pc) & (cl > (po + pc) / 2) & (cl < po)),
            "dark_cloud_cover": flag((pc > po) & (cl < o) & (o > pc) & (cl < (po + pc) / 2) & (cl > po)),
            "tweezer_tops": flag(F.abs(h - ph) <= near),
            "tweezer_bottoms": flag(F.abs(lo - pl) <= near),
            "gap_up": flag(o > ph),
            "gap_down": flag(o < pl),
            "volume_spike": flag((c("row_idx") >= 10) & (c("volume") > 2 * F.avg("volume").over(past(10)))),
        }
    )


def rolling_indicators(b: DataFrame, totals: bool = True) -> DataFrame:
    """Averages, bands and oscillators; totals: the volume on balance too, which adds up a whole series."""
    w, n = series(), c("row_idx")
    h, lo, cl, v = c("high"), c("low"), c("close"), c("volume").cast("double")
    typical = (h + lo + cl) / 3
    rising = F.lag(typical).over(w)
    b = b.withColumns({"_tp": typical, "_up": F.when(typical > rising, typical * v).otherwise(0.0), "_dn": F.when(typical < rising, typical * v).otherwise(0.0)})
    b = b.withColumns({"_vp": F.abs(h - c("pl")), "_vm": F.abs(lo - c("ph")), "_ob": F.when(cl > c("pc"), c("volume")).when(cl < c("pc"), -c("volume")).otherwise(F.lit(0))})

    def mid(k: int) -> Column:
        return full((F.max("high").over(past(k)) + F.min("low").over(past(k))) / 2, k, n)

    def mean(name: str, k: int) -> Column:
        return full(F.avg(name).over(past(k)), k, n)

    low14, high14 = F.min("low").over(past(14)), F.max("high").over(past(14))
    sd = full(F.stddev_pop("close").over(past(20)), 20, n)
    out = b.withColumns(
        {
            **{f"sma_{k}": mean("close", k) for k in (10, 50, 200)},
            "volume_ma_10": mean("volume", 10),
            "volume_ma_20": mean("volume", 20),
            "bollinger_mid": mean("close", 20),
            "bollinger_high": mean("close", 20) + 2 * sd,
            "bollinger_low": mean("close", 20) - 2 * sd,
            "stoch_k": full(100 * over(cl - low14, high14 - low14), 14, n),
            "williams_r": full(-100 * over(high14 - cl, high14 - low14), 14, n),
            "roc_12": 100 * (over(cl, F.lag("close", 12).over(w)) - 1),
            "mfi_14": full(100 - over(F.lit(100.0), 1 + over(F.sum("_up").over(past(14)), F.sum("_dn").over(past(14)))), 15, n),
            "vortex_plus": full(over(F.sum("_vp").over(past(14)), F.sum("tr").over(past(14))), 15, n),
            "vortex_minus": full(over(F.sum("_vm").over(past(14)), F.sum("tr").over(past(14))), 15, n),
            "ichimoku_conversion": mid(9),
            "ichimoku_base": mid(26),
            "ichimoku_b": mid(52),
            **({"obv": F.sum("_ob").over(w.rowsBetween(Window.unboundedPreceding, 0))} if totals else {}),
            "donchian_high20": full(F.max("high").over(past(20)), 20, n),
            "donchian_low20": full(F.min("low").over(past(20)), 20, n),
        }
    )
    out = out.withColumns({"stoch_d": full(F.avg("stoch_k").over(past(3)), 16, n), "ichimoku_a": (c("ichimoku_conversion") + c("ichimoku_base")) / 2})
    return out.drop("_tp", "_up", "_dn", "_vp", "_vm", "_ob")


def regimes(b: DataFrame, sentiment: int = 5, z: int = 200) -> DataFrame:
    """Sentiment, volume ratios, z-scores of the band width and the true range, compression and expansion. Needs rolling_indicators."""
    n = c("row_idx")
    b = b.withColumns({"bb_width": guarded(c("bollinger_high") - c("bollinger_low"), c("close")), "vol_ratio": guarded(c("volume"), c("volume_ma_20"))})

    def score(name: str) -> Column:
        return F.when(F.count(name).over(past(z)) >= z, guarded(c(name) - F.avg(name).over(past(z)), F.stddev_pop(name).over(past(z))))

    b = b.withColumns({"atr_z": score("atr"), "bb_width_z": score("bb_width")})
    return b.withColumns(
        {
            "bull_ratio": full(F.avg((c("close") > c("open")).cast("int")).over(past(sentiment)), sentiment, n),
            "bear_ratio": full(F.avg((c("close") < c("open")).cast("int")).over(past(sentiment)), sentiment, n),
            "vol_spike_1p5": flag(c("vol_ratio") >= 1.5),
            "vol_spike_2p0": flag(c("vol_ratio") >= 2.0),
            "compression_flag": flag((c("atr_z") < -1) & (c("bb_width_z") < -1)),
            "expansion_flag": flag((c("atr_z") > 1) | (c("bb_width_z") > 1)),
            "range_atr": guarded(c("high") - c("low"), c("atr")),
            "body_atr": guarded(F.abs(c("close") - c("open")), c("atr")),
        }
    )


def structure(b: DataFrame, wing: int = 3) -> DataFrame:
    """Confirmed swings, breaks and changes of structure, sweeps. A swing shows `wing` bars after it."""
    w, n = series(), c("row_idx")
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    hs, ls = F.lag("high", wing).over(w), F.lag("low", wing).over(w)
    both = past(2 * wing + 1)
    b = b.withColumns({"swing_high": F.when((n > 2 * wing) & (hs >= F.max("high").over(both)), hs), "swing_low": F.when((n > 2 * wing) & (ls <= F.min("low").over(both)), ls)})
    b = b.withColumns({"last_swing_high": F.last("swing_high", True).over(running), "last_swing_low": F.last("swing_low", True).over(running)})
    b = b.withColumns({"_h": F.lag("last_swing_high").over(w), "_l": F.lag("last_swing_low").over(w)})
    cl, pc = c("close"), c("pc")
    b = b.withColumns({"bos_up": flag((cl > c("_h")) & (pc <= c("_h"))), "bos_dn": flag((cl < c("_l")) & (pc >= c("_l")))})
    b = b.withColumn("structure_state", F.coalesce(F.last(F.when(c("bos_up") == 1, 1).when(c("bos_dn") == 1, -1), True).over(running), F.lit(0)))
    before = F.coalesce(F.lag("structure_state").over(w), F.lit(0))
    return b.withColumns(
        {
            "choch_up": flag((c("bos_up") == 1) & (before == -1)),
            "choch_dn": flag((c("bos_dn") == 1) & (before == 1)),
            "sweep_high": flag((c("high") > c("ph")) & (cl < c("ph"))),
            "sweep_low": flag((c("low") < c("pl")) & (cl > c("pl"))),
            "swing_sweep_high": flag((c("high") > c("_h")) & (cl < c("_h"))),
            "swing_sweep_low": flag((c("low") < c("_l")) & (cl > c("_l"))),
        }
    ).drop("_h", "_l")


def sessions(b: DataFrame) -> DataFrame:
    """Wall clocks of UTC bar times, session flags, and the session day's running extremes (by date in São Paulo)."""

    def at(zone: str) -> Column:
        return F.from_utc_timestamp(c("time"), zone)

    b = b.withColumns({"hour_utc": F.hour("time"), "minute_utc": F.minute("time"), "hour_brt": F.hour(at("America/Sao_Paulo")), "hour_london": F.hour(at("Europe/London")), "hour_ny": F.hour(at("America/New_York")), "day_of_week": F.weekday("time"), "date_brt": F.to_date(at("America/Sao_Paulo"))})
    b = b.withColumns({"in_asia_session": flag(c("hour_london") < 8), "in_london_session": flag(c("hour_london").between(8, 11)), "in_ny_session": flag(c("hour_ny").between(8, 16)), "london_killzone": flag(c("hour_london").between(7, 9)), "ny_killzone": flag(c("hour_ny").between(8, 10))})
    name = F.when(c("in_ny_session") == 1, "NEW_YORK").when(c("in_london_session") == 1, "LONDON").when(c("in_asia_session") == 1, "ASIA").otherwise("OFF_SESSION")
    b = b.withColumns({"is_london_open_bar": flag((c("hour_london") == 8) & (F.minute(at("Europe/London")) == 0)), "is_ny_open_bar": flag((c("hour_ny") == 8) & (F.minute(at("America/New_York")) == 0))})
    day = Window.partitionBy("symbol", "date_brt").orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    return b.withColumns({"session_name": name, "session_high": F.max("high").over(day), "session_low": F.min("low").over(day)})


#: Distances in atr that adverse and favourable moves are held against.
PULLBACKS, REACHES = {"0p25": 0.25, "0p50": 0.5}, {"0p50": 0.5, "1p00": 1.0, "1p50": 1.5}


def forward_outcomes(b: DataFrame, horizons: tuple[int, ...] = (1, 2, 3, 6, 12, 24)) -> DataFrame:
    """For each horizon in bars: what followed, in the candle's own direction; flat candles have no direction.

    The extremes are those of the bars that are there; a return needs the last bar of its horizon.
    """
    w = series()
    b = b.withColumn("side", F.signum(c("close") - c("open")).cast("int"))
    up, down = c("side") > 0, c("side") < 0
    adds = {}
    for k in horizons:
        rise, fall = F.max("high").over(ahead(k)) - c("close"), c("close") - F.min("low").over(ahead(k))
        fav, adv = over(F.when(up, rise).when(down, fall), c("atr")), over(F.when(up, fall).when(down, rise), c("atr"))
        ret = F.lead("close", k).over(w) - c("close")
        adds |= {
            f"h{k}_fav_atr": fav,
            f"h{k}_adv_atr": adv,
            f"h{k}_continues": flag((up & (ret > 0)) | (down & (ret < 0))),
            f"h{k}_reverses": flag((up & (ret < 0)) | (down & (ret > 0))),
            **{f"h{k}_pullback_{n}": flag(adv >= x) for n, x in PULLBACKS.items()},
            **{f"h{k}_reaches_{n}": flag(fav >= x) for n, x in REACHES.items()},
        }
    return b.withColumns(adds)
