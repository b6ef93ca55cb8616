"""Verdicts over groups of events: whether to wait for a retest, and which side of a setup has paid.

A break-out is entered at its close. Its retest is the first of the coming bars that comes back to the broken level and closes
beyond it; a close on the wrong side of the level before that fails it. A retest is entered at its close. Both are held against
the bars after their own entry, so that the same events can be compared in pairs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col
# Fixed values of the rules: near the level (in atr), bars in which a retest counts, what a success is, and the words of guidance.
NEAR_ATR, WAIT_BARS, SUCCESS_ATR = 0.18, 6, 0.5
GUIDANCE = (": memória favorável; buscar confirmação/reteste", ": há deslocamento, mas a memória indica devolução; não perseguir", "memória desfavorável; evitar usar como gatilho", "memória inconclusiva; usar apenas como filtro contextual")
MEASURES = ("success", "mfe", "mae", "return")


def after(bars: Column, at: Column, entry: Column, side: Column, atr: Column, horizon: int) -> dict[str, Column]:
    """What the `horizon` bars after place `at` did to an entry: null where there is none; a return needs the last bar."""
    seen = F.filter(bars, lambda b: (b["at"] > at) & (b["at"] <= at + horizon))
    up, down = F.array_max(F.transform(seen, lambda b: b["high"])) - entry, entry - F.array_min(F.transform(seen, lambda b: b["low"]))
    mfe, mae = F.when(side > 0, up).otherwise(down) / atr, F.when(side > 0, down).otherwise(up) / atr
    last = F.try_element_at(F.filter(bars, lambda b: b["at"] == at + horizon), F.lit(1))["close"]
    return {"mfe": mfe, "mae": mae, "return": side * (last - entry) / atr, "success": ((mfe >= SUCCESS_ATR) & (mfe > mae)).cast("double")}


def retested(b: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """Break-outs of the bar before (from bars with flags, atr and row_idx), their retests, and the outcomes of both entries."""
    far = WAIT_BARS + max(horizons)
    coming = F.collect_list(F.struct(c("row_idx").cast("long").alias("at"), "high", "low", "close")).over(Window.partitionBy("symbol").orderBy("time").rowsBetween(1, far))
    side = F.when(c("breakout_up") == 1, 1).when(c("breakout_down") == 1, -1)
    e = b.withColumns({"_next": coming, "side": side, "edge": F.when(side > 0, c("ph")).otherwise(c("pl"))}).where((c("breakout_up") != c("breakout_down")) & (c("atr") > 0))
    s, edge, near, at = c("side"), c("edge"), NEAR_ATR * c("atr"), c("row_idx").cast("long")
    failed = lambda x: F.when(s > 0, x["close"] < edge - near).otherwise(x["close"] > edge + near)
    held = lambda x: F.when(s > 0, (x["low"] <= edge + near) & (x["close"] > edge)).otherwise((x["high"] >= edge - near) & (x["close"] < edge))
    e = e.withColumn("_first", F.try_element_at(F.filter("_next", lambda x: (x["at"] <= at + WAIT_BARS) & (failed(x) | held(x))), F.lit(1)))
    e = e.withColumns({"failed_before_retest": F.coalesce(failed(c("_first")), F.lit(False)), "retest_confirmed": F.coalesce(~failed(c("_first")), F.lit(False))})
    e = e.withColumns({"_at": F.when(c("retest_confirmed"), c("_first.at")), "_entry": F.when(c("retest_confirmed"), c("_first.close"))}).withColumn("bars_to_retest", c("_at") - at)
    for h in horizons:
        e = e.withColumns({f"breakout_{n}_{h}": x for n, x in after(c("_next"), at, c("close"), s, c("atr"), h).items()} | {f"retest_{n}_{h}": x for n, x in after(c("_next"), c("_at"), c("_entry"), s, c("atr"), h).items()})
    return e.drop("_next", "_first", "_at", "_entry")


def compared(events: DataFrame, keys: Sequence[str], horizons: Sequence[int], least: int, least_retests: int) -> DataFrame:
    """Groups of break-outs: all of them, those that were retested (both entries, in pairs), the others, and a recommendation."""
    yes = c("retest_confirmed")
    columns = [F.count("*").alias("sample_size"), F.count_if(yes).alias("retest_confirmed_count"), F.count_if(~yes).alias("no_retest_count"), F.avg(yes.cast("int")).alias("retest_confirmation_rate"), F.avg(c("failed_before_retest").cast("int")).alias("failed_before_retest_rate"), F.avg(F.when(yes, c("bars_to_retest"))).alias("avg_bars_to_retest")]
    for h in horizons:
        for n in MEASURES:
            x = c(f"breakout_{n}_{h}")
            columns += [F.avg(x).alias(f"breakout_all_{n}_{h}"), F.avg(F.when(yes, x)).alias(f"paired_breakout_{n}_{h}"), F.avg(F.when(yes, c(f"retest_{n}_{h}"))).alias(f"retest_{n}_{h}")]
    g = events.groupBy(*keys).agg(*columns)
    for h in horizons:
        g = g.withColumns({f"paired_success_lift_{h}": c(f"retest_success_{h}") - c(f"paired_breakout_success_{h}"), f"paired_mae_reduction_{h}": c(f"paired_breakout_mae_{h}") - c(f"retest_mae_{h}"), f"paired_return_lift_{h}": c(f"retest_return_{h}") - c(f"paired_breakout_return_{h}")})
    h = max(horizons)
    lift, safer, gain, own, all_ = (c(f"{n}_{h}") for n in ("paired_success_lift", "paired_mae_reduction", "paired_return_lift", "retest_return", "breakout_all_return"))
    few = (c("sample_size") < least) | (c("retest_confirmed_count") < least_retests)
    verdict = F.when(few, "INSUFFICIENT_SAMPLE").when((lift >= 0.10) & (safer > 0) & (gain > 0) & (own > 0), "WAIT_FOR_RETEST").when((lift <= -0.10) & (gain < 0) & (all_ > 0), "BREAKOUT_ENTRY_PREFERRED").when((own < 0) & (all_ < 0), "AVOID_PATTERN")
    return g.withColumn("recommendation", verdict.otherwise("RETEST_OPTIONAL"))


def playbook(states: DataFrame, keys: Sequence[str], least: int, most: int = 500) -> DataFrame:
    """Setups with an edge on one side: groups of states with buy_label, sell_label and outcomes, scored, with guidance, the best first."""
    tp = lambda s: F.avg((c(f"{s}_label") == "TP_FIRST").cast("int"))
    sl = lambda s: F.avg((c(f"{s}_label") == "SL_FIRST").cast("int"))
    means = {"avg_energy": "energy_score", "avg_range_atr": "range_atr", "continuation_h6": "h6_continues", "pullback_0p50_h6": "h6_pullback_0p50", "reach_1atr_h12": "h12_reaches_1p00"}
    g = states.groupBy(*keys).agg(F.count("*").alias("bars"), *(F.avg(x).alias(n) for n, x in means.items()), *(x for s in ("buy", "sell") for x in (tp(s).alias(f"{s}_tp"), sl(s).alias(f"{s}_sl")))).where(c("bars") >= least)
    g = g.withColumns({f"{s}_edge": c(f"{s}_tp") - c(f"{s}_sl") for s in ("buy", "sell")})
    g = g.withColumns({"best_side": F.when(c("buy_edge") >= c("sell_edge"), "BUY").otherwise("SELL"), "best_edge": F.greatest("buy_edge", "sell_edge"), "edge_gap": F.abs(c("buy_edge") - c("sell_edge"))})
    edge, gap, back = c("best_edge"), c("edge_gap"), c("pullback_0p50_h6")
    score = 0.40 * F.greatest(edge, F.lit(0.0)) + 0.20 * gap + 0.20 * c("reach_1atr_h12") + 0.10 * c("continuation_h6") - 0.15 * back + 0.05 * F.least(c("bars") / 500.0, F.lit(1.0))
    words = F.when((edge >= 0.18) & (gap >= 0.30) & (back < 0.65), F.concat("best_side", F.lit(GUIDANCE[0]))).when((edge >= 0.10) & (back >= 0.65), F.concat("best_side", F.lit(GUIDANCE[1]))).when(edge < 0, GUIDANCE[2]).otherwise(GUIDANCE[3])
    g = g.withColumns({"score": score, "guidance": words}).where((edge > 0) & (gap >= 0.08))
    return g.orderBy(c("score").desc(), edge.desc(), c("bars").desc(), *keys).limit(most)  # a report's length
