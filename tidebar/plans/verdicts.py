"""Break-outs and their retests compared in pairs, and the playbook of setups."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebar.operators import features, touch, verdicts, wide
from tidebar.plans import sqlparts as q
from tidebar.plans import widebase as w
from tidebar.plans.bars_and_features import base, rounded

c = F.col
QUERIES, SQL = {}, {}
HORIZONS = (3, 6)
#: Least break-outs and retests of a verdict, and least bars of a setup: our own choice for the small test tables.
LEAST, LEAST_RETESTS, LEAST_BARS = 30, 10, 15


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_FAR = verdicts.WAIT_BARS + max(HORIZONS)


def _after(at: str, entry: str, prefix: str) -> str:
    parts = []
    for h in HORIZONS:
        seen = f"FILTER (n.row_idx > {at} AND n.row_idx <= {at} + {h})"
        up, down = f"max(n.high) {seen} - any_value({entry})", f"any_value({entry}) - min(n.low) {seen}"
        mfe, mae = (f"(CASE WHEN any_value(side) > 0 THEN {a} ELSE {b} END) / any_value(r.atr)" for a, b in ((up, down), (down, up)))
        last = f"max(n.close) FILTER (n.row_idx = {at} + {h})"
        parts.append(f"{mfe} AS {prefix}_mfe_{h}, {mae} AS {prefix}_mae_{h}, any_value(side) * ({last} - any_value({entry})) / any_value(r.atr) AS {prefix}_return_{h}")
    return ", ".join(parts)


_EVENTS = f"""WITH RECURSIVE {q.bars()}, {q.base()}, e0 AS (SELECT *, {q.FLAGS}, CASE WHEN close > ph THEN 1 ELSE -1 END AS side, CASE WHEN close > ph THEN ph ELSE pl END AS edge FROM b),
e AS MATERIALIZED (SELECT * FROM e0 WHERE breakout_up <> breakout_down AND atr > 0),
k0 AS (SELECT e.symbol, e.row_idx, n.row_idx AS k, n.close, CASE WHEN side > 0 THEN n.close < edge - 0.18 * e.atr ELSE n.close > edge + 0.18 * e.atr END AS failed, CASE WHEN side > 0 THEN n.low <= edge + 0.18 * e.atr AND n.close > edge ELSE n.high >= edge - 0.18 * e.atr AND n.close < edge END AS held FROM e JOIN b n ON n.symbol = e.symbol AND n.row_idx BETWEEN e.row_idx + 1 AND e.row_idx + {verdicts.WAIT_BARS}),
k1 AS (SELECT * FROM k0 WHERE failed OR held QUALIFY row_number() OVER (PARTITION BY symbol, row_idx ORDER BY k) = 1),
r AS MATERIALIZED (SELECT e.*, coalesce(failed, false) AS failed_before_retest, coalesce(NOT failed, false) AS retest_confirmed, CASE WHEN NOT failed THEN k END AS at_row, CASE WHEN NOT failed THEN k1.close END AS entry FROM e LEFT JOIN k1 USING (symbol, row_idx)),
o AS (SELECT r.symbol, r.row_idx, any_value(side) AS side, any_value(failed_before_retest) AS failed_before_retest, any_value(retest_confirmed) AS retest_confirmed, any_value(at_row) - r.row_idx AS bars_to_retest, {_after('r.row_idx', 'r.close', 'breakout')}, {_after('r.at_row', 'r.entry', 'retest')} FROM r LEFT JOIN b n ON n.symbol = r.symbol AND n.row_idx > r.row_idx AND n.row_idx <= r.row_idx + {_FAR} GROUP BY r.symbol, r.row_idx, r.at_row),
ev AS MATERIALIZED (SELECT *, {', '.join(f'CASE WHEN {p}_mfe_{h} IS NOT NULL THEN ({p}_mfe_{h} >= 0.5 AND {p}_mfe_{h} > {p}_mae_{h})::INT::DOUBLE END AS {p}_success_{h}' for p in ('breakout', 'retest') for h in HORIZONS)} FROM o)"""
_GROUPED = ", ".join(f"avg(breakout_{n}_{h}) AS breakout_all_{n}_{h}, avg(breakout_{n}_{h}) FILTER (retest_confirmed) AS paired_breakout_{n}_{h}, avg(retest_{n}_{h}) FILTER (retest_confirmed) AS retest_{n}_{h}" for h in HORIZONS for n in verdicts.MEASURES)
_LIFTS = ", ".join(f"retest_success_{h} - paired_breakout_success_{h} AS paired_success_lift_{h}, paired_breakout_mae_{h} - retest_mae_{h} AS paired_mae_reduction_{h}, retest_return_{h} - paired_breakout_return_{h} AS paired_return_lift_{h}" for h in HORIZONS)
_NUMBERS = ["retest_confirmation_rate", "failed_before_retest_rate", "avg_bars_to_retest", *(f"{p}_{n}_{h}" for h in HORIZONS for n in verdicts.MEASURES for p in ("breakout_all", "paired_breakout", "retest")), *(f"{n}_{h}" for h in HORIZONS for n in ("paired_success_lift", "paired_mae_reduction", "paired_return_lift"))]
_H = max(HORIZONS)


@query(f"""{_EVENTS}, g AS (SELECT symbol, side, count(*) AS sample_size, count(*) FILTER (retest_confirmed) AS retest_confirmed_count, count(*) FILTER (NOT retest_confirmed) AS no_retest_count, avg(retest_confirmed::INT) AS retest_confirmation_rate, avg(failed_before_retest::INT) AS failed_before_retest_rate, avg(bars_to_retest) FILTER (retest_confirmed) AS avg_bars_to_retest, {_GROUPED} FROM ev GROUP BY ALL), v AS (SELECT *, {_LIFTS} FROM g)
SELECT symbol, side, sample_size, retest_confirmed_count, no_retest_count, {', '.join(f'round({n}, 6) AS {n}' for n in _NUMBERS)}, CASE WHEN sample_size < {LEAST} OR retest_confirmed_count < {LEAST_RETESTS} THEN 'INSUFFICIENT_SAMPLE' WHEN paired_success_lift_{_H} >= 0.1 AND paired_mae_reduction_{_H} > 0 AND paired_return_lift_{_H} > 0 AND retest_return_{_H} > 0 THEN 'WAIT_FOR_RETEST'
WHEN paired_success_lift_{_H} <= -0.1 AND paired_return_lift_{_H} < 0 AND breakout_all_return_{_H} > 0 THEN 'BREAKOUT_ENTRY_PREFERRED' WHEN retest_return_{_H} < 0 AND breakout_all_return_{_H} < 0 THEN 'AVOID_PATTERN' ELSE 'RETEST_OPTIONAL' END AS recommendation FROM v""")
def retest_verdicts(spark, d):
    """Whether the break-outs of a symbol and side are better entered at once or at their retest."""
    ev = verdicts.retested(features.bar_flags(base(spark, d)), HORIZONS)
    g = verdicts.compared(ev, ("symbol", "side"), HORIZONS, LEAST, LEAST_RETESTS)
    return rounded(g.select("symbol", "side", "sample_size", "retest_confirmed_count", "no_retest_count", *_NUMBERS, "recommendation"))


_PLAY = ["avg_energy", "avg_range_atr", "continuation_h6", "pullback_0p50_h6", "reach_1atr_h12", "buy_tp", "buy_sl", "buy_edge", "sell_tp", "sell_sl", "sell_edge", "best_edge", "edge_gap", "score"]


@query(f"""{w._SETUP}, {q.outcomes((6, 12), 'su')}, tb AS ({q.touch('atr', '0.5 * atr', 12, '1')}), ts AS ({q.touch('atr', '0.5 * atr', 12, '-1')}),
x AS (SELECT o.*, CASE WHEN o.atr > 0 THEN coalesce(tb.label, 'NO_TOUCH') ELSE 'INVALID' END AS bl, CASE WHEN o.atr > 0 THEN coalesce(ts.label, 'NO_TOUCH') ELSE 'INVALID' END AS sl FROM o LEFT JOIN tb ON tb.symbol = o.symbol AND tb.time = o.time LEFT JOIN ts ON ts.symbol = o.symbol AND ts.time = o.time),
g AS (SELECT setup_event_context, setup_side_context, energy_bucket, market_state, count(*) AS bars, avg(energy_score) AS avg_energy, avg(range_atr) AS avg_range_atr, avg(h6_continues) AS continuation_h6, avg(h6_pullback_0p50) AS pullback_0p50_h6, avg(h12_reaches_1p00) AS reach_1atr_h12, avg((bl = 'TP_FIRST')::INT) AS buy_tp, avg((bl = 'SL_FIRST')::INT) AS buy_sl, avg((sl = 'TP_FIRST')::INT) AS sell_tp, avg((sl = 'SL_FIRST')::INT) AS sell_sl FROM x GROUP BY ALL HAVING count(*) >= {LEAST_BARS}),
h AS (SELECT *, buy_tp - buy_sl AS buy_edge, sell_tp - sell_sl AS sell_edge, greatest(buy_tp - buy_sl, sell_tp - sell_sl) AS best_edge, abs((buy_tp - buy_sl) - (sell_tp - sell_sl)) AS edge_gap, CASE WHEN buy_tp - buy_sl >= sell_tp - sell_sl THEN 'BUY' ELSE 'SELL' END AS best_side FROM g),
p AS (SELECT *, 0.4 * greatest(best_edge, 0) + 0.2 * edge_gap + 0.2 * reach_1atr_h12 + 0.1 * continuation_h6 - 0.15 * pullback_0p50_h6 + 0.05 * least(bars / 500.0::DOUBLE, 1) AS score FROM h WHERE best_edge > 0 AND edge_gap >= 0.08)
SELECT setup_event_context, setup_side_context, energy_bucket, market_state, bars, {', '.join(f'round({n}, 6) AS {n}' for n in _PLAY)}, best_side, CASE WHEN best_edge >= 0.18 AND edge_gap >= 0.3 AND pullback_0p50_h6 < 0.65 THEN best_side || '{verdicts.GUIDANCE[0]}' WHEN best_edge >= 0.1 AND pullback_0p50_h6 >= 0.65 THEN best_side || '{verdicts.GUIDANCE[1]}' WHEN best_edge < 0 THEN '{verdicts.GUIDANCE[2]}' ELSE '{verdicts.GUIDANCE[3]}' END AS guidance FROM p ORDER BY score DESC, best_edge DESC, bars DESC, setup_event_context, setup_side_context, energy_bucket, market_state LIMIT 500""")
def setup_playbook(spark, d):
    """Setups whose one side has an edge, with guidance; the 500 best."""
    b = touch.both_sides(features.forward_outcomes(wide.setup(w.wide_base(spark, d)), (6, 12)))
    keys = ("setup_event_context", "setup_side_context", "energy_bucket", "market_state")
    return rounded(verdicts.playbook(b, keys, LEAST_BARS).select(*keys, "bars", *_PLAY, "best_side", "guidance"))
