"""Laws over the wide base: validation by splits, years and windows, segmentation, publishing, matching and its audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebar.operators import features, laws, touch, wide
from tidebar.plans import sqlparts as q
from tidebar.plans import widebase as w
from tidebar.plans.bars_and_features import rounded
from tidebar.plans.shared import written

c = F.col
QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: The registry of these queries, as its JSON says it; every kind of condition occurs.
DECLARED = [
    {"law_id": "LAW_0001A", "side": "SELL", "best_tier": "A", "conditions": {"level_zone": "AT_RESISTANCE", "mtf_bias": "DOWN", "mtf_alignment_bucket_in": ["MIXED", "STRONG", "FULL"]}},
    {"law_id": "LAW_0001B", "side": "BUY", "best_tier": "A", "conditions": {"level_zone": "AT_SUPPORT", "mtf_bias": "UP", "mtf_alignment_bucket_in": ["MIXED", "STRONG", "FULL"]}},
    {"law_id": "LAW_0002A", "side": "SELL", "best_tier": "A", "conditions": {"level_zone_in": ["AT_RESISTANCE", "NEAR_RESISTANCE"], "breakout_up": True, "range_atr_between": [0.5, 2.5]}},
    {"law_id": "LAW_0002B", "side": "BUY", "best_tier": "A", "conditions": {"level_zone_in": ["AT_SUPPORT", "NEAR_SUPPORT"], "breakout_down": True, "range_atr_between": [0.5, 2.5]}},
    {"law_id": "LAW_0003A", "side": "SELL", "best_tier": "B", "conditions": {"breakout_up": False, "event_name_in": ["FALSE_BREAK", "SWEEP"], "energy_score_between": [40, 100]}},
    {"law_id": "LAW_0003B", "side": "BUY", "best_tier": "C", "conditions": {"direction": "DOWN", "close_position_bucket": "CLOSE_LOW"}},
    {"law_id": "LAW_0004A", "side": "SELL", "best_tier": "C", "conditions": {"no_such_field": "ANYTHING", "direction": "UP"}},
]
#: The same in SQL, written by hand.
_MASKS = {
    "LAW_0001A": "level_zone = 'AT_RESISTANCE' AND mtf_bias = 'DOWN' AND mtf_alignment_bucket IN ('MIXED', 'STRONG', 'FULL')",
    "LAW_0001B": "level_zone = 'AT_SUPPORT' AND mtf_bias = 'UP' AND mtf_alignment_bucket IN ('MIXED', 'STRONG', 'FULL')",
    "LAW_0002A": "level_zone IN ('AT_RESISTANCE', 'NEAR_RESISTANCE') AND breakout_up = 1 AND range_atr BETWEEN 0.5 AND 2.5",
    "LAW_0002B": "level_zone IN ('AT_SUPPORT', 'NEAR_SUPPORT') AND breakout_down = 1 AND range_atr BETWEEN 0.5 AND 2.5",
    "LAW_0003A": "breakout_up = 0 AND event_name IN ('FALSE_BREAK', 'SWEEP') AND energy_score BETWEEN 40 AND 100",
    "LAW_0003B": "direction = 'DOWN' AND close_position_bucket = 'CLOSE_LOW'",
    "LAW_0004A": "false",
}
#: What a runtime registry says of the same laws: status, tier, edge and modulators, two of which rest on the same evidence.
_OPERATIVE = {
    "LAW_0001A": ("VALIDATED", "A", 0.42, "BUY_BREAKOUT", [("ENERGY", "LOW", "STRONGER", 4.5, 120, 0.5, 31, 0.4), ("WEEKDAY", "MONDAY", "WEAKER", -7.25, 90, 0.1, 25, 0.05), ("LEVEL_PROXIMITY", "NEAR_RESISTANCE", "STRONGER", 3.0, 120, 0.5, 31, 0.4)]),
    "LAW_0001B": ("VALIDATED", "A", 0.37, "SELL_BREAKOUT", [("SESSION_BRT", "LONDON", "STRONGER", 6.0, 100, 0.48, 22, 0.3), ("HTF_LOCATION", "UP_LOCATION", "WEAKER", -6.0, 100, 0.48, 22, 0.3)]),
    "LAW_0002A": ("PROVISIONAL", "C", 0.12, None, []),
    "LAW_0002B": ("VALIDATED", "B", 0.93, None, [("HOUR_BRT", "9", "STRONGER", 18.0, 81, 0.9, 20, 0.8)]),
    "LAW_0003A": ("PROVISIONAL", "C", -0.9, None, [("BREAKOUT_ALIGNMENT", "NO_BREAKOUT", "WEAKER", -18.0, 200, -0.5, 60, -0.4)]),
    "LAW_0003B": ("PROVISIONAL", "B", 0.31, None, []),
    "LAW_0004A": ("REJECTED", "C", 0.9, None, []),
}
_MOD = ("dimension", "segment", "status", "score_adjustment", "full_valid", "full_edge", "oos_valid", "oos_edge")


def declared(spark):
    return laws.registry_table(spark, DECLARED)


def operative(spark):
    rows = []
    for law in DECLARED:
        status, tier, edge, blocks, mods = _OPERATIVE[law["law_id"]]
        rows.append(law | {"validation_status": status, "tier": tier, "full_edge": edge, "block_action": blocks, "modulators": [dict(zip(_MOD, m, strict=True)) for m in mods]})
    return laws.registry_table(spark, rows)


def states(spark, d):
    """The wide base with locations, the seven dimensions, outcomes and the first touch of both sides, written once: each query reads it several times."""
    b = wide.location(wide.setup(w.wide_base(spark, d)), list(w.LARGER))
    return written(laws.dimensions(touch.both_sides(features.forward_outcomes(b, (6, 12)))).select(*_STATE), "law-states")


_STATE = ("symbol", "time", "row_idx", "dims", "buy_label", "sell_label", "h12_reaches_1p00", "h6_pullback_0p50", *sorted({laws.field_of(k) for x in DECLARED for k in x["conditions"]} - {"no_such_field"}))


_BIAS = "CASE WHEN bs >= 3 THEN 'STRONG_UP_LOCATION' WHEN bs <= -3 THEN 'STRONG_DOWN_LOCATION' WHEN bs > 0 THEN 'UP_LOCATION' WHEN bs < 0 THEN 'DOWN_LOCATION' ELSE 'MIXED_LOCATION' END"
_WAY = "CASE WHEN breakout_up = 1 AND bs > 0 THEN 'BREAKOUT_WITH_HTF_UP' WHEN breakout_down = 1 AND bs < 0 THEN 'BREAKOUT_WITH_HTF_DOWN' WHEN breakout_up = 1 AND bs < 0 THEN 'BREAKOUT_AGAINST_HTF_DOWN' WHEN breakout_down = 1 AND bs > 0 THEN 'BREAKOUT_AGAINST_HTF_UP' WHEN breakout_up + breakout_down > 0 THEN 'BREAKOUT_MIXED_HTF' ELSE 'NO_BREAKOUT' END"
_SESSION = "CASE " + " ".join(f"WHEN hour_brt IN ({', '.join(map(str, hours))}) THEN '{n}'" for n, hours in laws.SESSIONS) + " ELSE 'UNKNOWN' END"
_NEAR = "CASE WHEN resistance_bucket IN ('TOUCHING', 'VERY_NEAR') THEN 'NEAR_RESISTANCE' WHEN support_bucket IN ('TOUCHING', 'VERY_NEAR') THEN 'NEAR_SUPPORT' ELSE 'OTHER_LOCATION' END"
_DIMS = {"HOUR_BRT": "hour_brt::VARCHAR", "SESSION_BRT": _SESSION, "WEEKDAY": "upper(dayname(time))", "ENERGY": "energy_bucket", "HTF_LOCATION": _BIAS, "BREAKOUT_ALIGNMENT": _WAY, "LEVEL_PROXIMITY": _NEAR}
_LAWS = "VALUES " + ", ".join(f"('{x['law_id']}', '{x['side']}', '{x['best_tier']}')" for x in DECLARED)
_STATES = f"""{w._LOC}, {q.outcomes((6, 12), 'lo')},
tb AS ({q.touch('atr', '0.5 * atr', 12, '1')}), ts AS ({q.touch('atr', '0.5 * atr', 12, '-1')}),
st0 AS (SELECT o.*, CASE WHEN o.atr > 0 THEN coalesce(tb.label, 'NO_TOUCH') ELSE 'INVALID' END AS buy_label, CASE WHEN o.atr > 0 THEN coalesce(ts.label, 'NO_TOUCH') ELSE 'INVALID' END AS sell_label
  FROM o LEFT JOIN tb ON tb.symbol = o.symbol AND tb.time = o.time LEFT JOIN ts ON ts.symbol = o.symbol AND ts.time = o.time),
st AS MATERIALIZED (SELECT *, MAP {{{', '.join(f"'{n}': {x}" for n, x in _DIMS.items())}}} AS dims, row_idx - 1 AS k, max(row_idx) OVER (PARTITION BY symbol) AS n, ntile(10) OVER (PARTITION BY symbol ORDER BY time) AS win FROM st0),
law(law_id, side, best_tier) AS ({_LAWS}),
held AS MATERIALIZED ({' UNION ALL '.join(f"SELECT st.*, '{x['law_id']}' AS law_id, {x['side'].lower()}_label AS label FROM st WHERE {_MASKS[x['law_id']]}" for x in DECLARED)})"""


def _stats_sql(prefix: str = "", on: str = "true") -> str:
    valid = f"({on}) AND label IN ('TP_FIRST', 'SL_FIRST', 'NO_TOUCH', 'AMBIGUOUS')"
    x = "(CASE label WHEN 'TP_FIRST' THEN 1.0 WHEN 'SL_FIRST' THEN -1.0 ELSE 0.0 END)::DOUBLE"
    f = f"FILTER ({valid})"
    half = f"1.96 * stddev_samp({x}) {f} / sqrt(count(*) {f})"
    share = {"tp_rate": "TP_FIRST", "sl_rate": "SL_FIRST", "no_touch_rate": "NO_TOUCH", "ambiguous_rate": "AMBIGUOUS"}
    parts = {"bars": f"count(*) FILTER ({on})", "valid": f"count(*) {f}", "edge": f"avg({x}) {f}", "edge_ci_low": f"avg({x}) {f} - {half}", "edge_ci_high": f"avg({x}) {f} + {half}"}
    parts |= {n: f"avg((label = '{v}')::INT) {f}" for n, v in share.items()}
    parts |= {n: f"CASE WHEN count(*) {f} > 0 THEN avg({v}) FILTER ({on}) END" for n, v in {"reach_1atr": "h12_reaches_1p00", "pullback_0p50": "h6_pullback_0p50"}.items()}
    return ", ".join(f"{parts[n]} AS {prefix}{n}" for n in laws.STATS)


_OUT = "k >= floor(n * 0.7::DOUBLE)"
_SEGMENTS = f"""{_STATES},
deal AS (SELECT symbol, law_id, label, h12_reaches_1p00, h6_pullback_0p50, unnest([{{'kind': 'SPLIT', 'segment': 'FULL'}}, {{'kind': 'SPLIT', 'segment': CASE WHEN {_OUT} THEN 'OUT_OF_SAMPLE_30' ELSE 'IN_SAMPLE_70' END}},
  {{'kind': 'SPLIT', 'segment': CASE WHEN k >= floor(n * 0.75::DOUBLE) THEN 'RECENT_25' END}}, {{'kind': 'YEAR', 'segment': year(time)::VARCHAR}}, {{'kind': 'WINDOW', 'segment': win::VARCHAR}}]) AS p FROM held),
seg AS MATERIALIZED (SELECT symbol, law_id, p.kind AS kind, p.segment AS segment, {_stats_sql()} FROM deal WHERE p.segment IS NOT NULL GROUP BY ALL),
grid AS (SELECT symbol, law_id, side, best_tier FROM (SELECT DISTINCT symbol FROM st), law)"""
_RATES = [n for n in laws.STATS if n not in ("bars", "valid")]
_ROUND = ", ".join(f"round({n}, 6) AS {n}" for n in _RATES)


@query(f"""{_SEGMENTS}, sp(split) AS (VALUES {', '.join(f"('{n}')" for n in laws.SPLITS)})
SELECT grid.symbol, grid.law_id, side, split, coalesce(bars, 0) AS bars, coalesce(valid, 0) AS valid, {_ROUND} FROM grid CROSS JOIN sp LEFT JOIN seg ON seg.symbol = grid.symbol AND seg.law_id = grid.law_id AND seg.kind = 'SPLIT' AND seg.segment = split""")
def law_splits(spark, d):
    """Each law in sample, out of sample, recently and in full; splits without a state are given with no bars."""
    b = states(spark, d)
    seg = laws.by_segment(b, declared(spark)).where("kind = 'SPLIT'").withColumnRenamed("segment", "split").drop("kind")
    each = laws.grid(b, declared(spark)).withColumn("split", F.explode(F.array(*map(F.lit, laws.SPLITS)))).drop("best_tier")
    return rounded(each.join(seg, ["symbol", "law_id", "split"], "left").fillna(0, ["bars", "valid"]))


@query(f"{_SEGMENTS} SELECT symbol, law_id, segment::INT AS year, bars, valid, {_ROUND} FROM seg WHERE kind = 'YEAR'")
def law_years(spark, d):
    return rounded(laws.by_segment(states(spark, d), declared(spark)).where("kind = 'YEAR'").withColumn("year", c("segment").cast("int")).drop("kind", "segment"))


@query(f"""{_SEGMENTS}, win AS (SELECT symbol, win, min(time) AS start_time, max(time) AS end_time FROM st GROUP BY ALL)
SELECT grid.symbol, grid.law_id, side, win::INT AS "window", start_time, end_time, coalesce(bars, 0) AS bars, coalesce(valid, 0) AS valid, {_ROUND} FROM grid JOIN win ON win.symbol = grid.symbol LEFT JOIN seg ON seg.symbol = grid.symbol AND seg.law_id = grid.law_id AND seg.kind = 'WINDOW' AND seg.segment = win::VARCHAR""")
def law_windows(spark, d):
    """Each law in ten windows of equally many bars, with the times they span."""
    b = states(spark, d)
    seg = laws.by_segment(b, declared(spark)).where("kind = 'WINDOW'").withColumn("window", c("segment").cast("int")).drop("kind", "segment")
    spans = laws.placed(b).groupBy("symbol", "window").agg(F.min("time").alias("start_time"), F.max("time").alias("end_time"))
    each = laws.grid(b, declared(spark)).join(spans, "symbol").drop("best_tier")
    return rounded(each.join(seg, ["symbol", "law_id", "window"], "left").fillna(0, ["bars", "valid"]))


def _at(split: str, name: str) -> str:
    return f"max({name}) FILTER (kind = 'SPLIT' AND segment = '{split}')"


_KEPT = {f"full_{n}": _at("FULL", n) for n in ("bars", "valid", "edge", "edge_ci_low", "edge_ci_high", "tp_rate", "sl_rate", "pullback_0p50", "reach_1atr")}
_KEPT |= {"is_edge": _at("IN_SAMPLE_70", "edge"), "oos_valid": _at("OUT_OF_SAMPLE_30", "valid"), "oos_edge": _at("OUT_OF_SAMPLE_30", "edge"), "oos_edge_ci_low": _at("OUT_OF_SAMPLE_30", "edge_ci_low"), "recent_edge": _at("RECENT_25", "edge")}
for _name, _kind, _least in (("year", "YEAR", 20), ("window", "WINDOW", 15)):
    _KEPT |= {f"{_name}s_tested": f"count(*) FILTER (kind = '{_kind}' AND valid >= {_least})", f"positive_{_name}_ratio": f"avg((edge > 0)::INT) FILTER (kind = '{_kind}' AND valid >= {_least})"}
_COUNTS = ("full_bars", "full_valid", "oos_valid", "years_tested", "windows_tested")
_VALIDATED = f"""{_SEGMENTS}, sm0 AS (SELECT symbol, law_id, {', '.join(f'{x} AS {n}' for n, x in _KEPT.items())} FROM seg GROUP BY ALL),
sm1 AS (SELECT grid.*, {', '.join(f'coalesce({n}, 0) AS {n}' if n in _COUNTS else n for n in _KEPT)} FROM grid LEFT JOIN sm0 ON sm0.symbol = grid.symbol AND sm0.law_id = grid.law_id),
sm AS MATERIALIZED (SELECT *, CASE WHEN is_edge > 0 THEN oos_edge / is_edge END AS oos_degradation_ratio,
  CASE WHEN full_valid >= 120 AND oos_valid >= 40 AND full_edge > 0.10 AND oos_edge > 0.05 AND positive_year_ratio >= 0.6 AND positive_window_ratio >= 0.6 THEN CASE WHEN full_edge_ci_low > 0 AND oos_edge_ci_low > 0 THEN 'VALIDATED' ELSE 'PROVISIONAL' END
  WHEN full_valid >= 80 AND full_edge > 0.05 THEN 'PROVISIONAL' ELSE 'REJECTED' END AS status FROM sm1)"""
_SUMMARY = ["symbol", "law_id", "side", "best_tier", "status", *_COUNTS, *(n for n in _KEPT if n not in _COUNTS), "oos_degradation_ratio"]


def _validated(b, registry):
    return laws.summary(laws.by_segment(b, registry), laws.grid(b, registry))


@query(f"{_VALIDATED} SELECT {', '.join(n if n in _SUMMARY[:5] or n in _COUNTS else f'round({n}, 6) AS {n}' for n in _SUMMARY)} FROM sm")
def law_validation(spark, d):
    """The status of each law from its splits, years and windows."""
    return rounded(_validated(states(spark, d), declared(spark)).select(*_SUMMARY))


_SEG_STATS = [f"{p}_{n}" for p in ("full", "oos") for n in laws.STATS]
_SEGMENTED = f"""{_VALIDATED}, dd AS (SELECT symbol, law_id, label, h12_reaches_1p00, h6_pullback_0p50, k, n, unnest(map_entries(dims)) AS e FROM held),
sg0 AS (SELECT symbol, law_id, e.key AS dimension, e.value AS segment, {_stats_sql('full_')}, {_stats_sql('oos_', _OUT)} FROM dd GROUP BY ALL),
sg1 AS (SELECT sg0.*, sm.full_edge AS base_edge, sg0.full_edge - sm.full_edge AS segment_edge_delta FROM sg0 JOIN sm ON sm.symbol = sg0.symbol AND sm.law_id = sg0.law_id),
sg AS MATERIALIZED (SELECT *, CASE WHEN full_valid < 40 OR oos_valid < 13 OR full_edge IS NULL OR oos_edge IS NULL THEN 'INSUFFICIENT' WHEN full_edge_ci_low > 0 AND oos_edge > 0 AND segment_edge_delta >= 0.08 THEN 'STRONGER'
  WHEN full_edge > 0 AND oos_edge > 0 AND coalesce(segment_edge_delta >= -0.08, true) THEN 'STABLE' WHEN full_edge <= 0 OR oos_edge <= 0 OR segment_edge_delta <= -0.15 THEN 'WEAKER' ELSE 'MIXED' END AS segment_status FROM sg1)"""
_SEG_COLUMNS = ["symbol", "law_id", "dimension", "segment", "segment_status", "base_edge", "segment_edge_delta", *_SEG_STATS]


def _segmented(b, registry):
    return laws.segmented(b, registry, _validated(b, registry))


@query(f"{_SEGMENTED} SELECT {', '.join(n if n in _SEG_COLUMNS[:5] or n.endswith(('_bars', '_valid')) else f'round({n}, 6) AS {n}' for n in _SEG_COLUMNS)} FROM sg")
def law_segments(spark, d):
    """Each law in the segments of seven dimensions, one at a time."""
    return rounded(_segmented(states(spark, d), declared(spark)).select(*_SEG_COLUMNS))


_EXTREME = {"segment": "segment", "segment_status": "status", "full_valid": "valid", "full_edge": "edge", "oos_edge": "oos_edge"}
_BEST = {"strongest": "DESC", "weakest": "ASC"}


@query(f"""{_SEGMENTED}, {', '.join(f"x{p} AS (SELECT symbol, law_id, dimension, {', '.join(f'{n} AS {p}_{m}' for n, m in _EXTREME.items())} FROM sg WHERE segment_status IN ('STRONGER', 'STABLE', 'WEAKER') QUALIFY row_number() OVER (PARTITION BY symbol, law_id, dimension ORDER BY full_edge {o}, full_valid DESC, segment) = 1)" for p, o in _BEST.items())}
SELECT symbol, law_id, dimension, {', '.join(f'round({p}_{m}, 6) AS {p}_{m}' if m.endswith('edge') else f'{p}_{m}' for p in _BEST for m in _EXTREME.values())}, round(strongest_edge - weakest_edge, 6) AS edge_spread FROM xstrongest JOIN xweakest USING (symbol, law_id, dimension)""")
def law_segment_extremes(spark, d):
    """The strongest and the weakest segment of each law and dimension."""
    return rounded(laws.extremes(_segmented(states(spark, d), declared(spark))))


@query(f"""{_SEGMENTED}, md AS (SELECT symbol, law_id, count(*) AS modulators, sum(round(least(18, greatest(-18, coalesce(segment_edge_delta, 0) * 35)), 3)) AS adjustment, min(dimension || '=' || segment) AS first_modulator FROM sg WHERE segment_status IN ('STRONGER', 'WEAKER') AND full_valid >= 80 AND oos_valid >= 20 GROUP BY ALL),
rg AS (SELECT sm.*, CASE status WHEN 'VALIDATED' THEN best_tier ELSE 'C' END AS tier FROM sm)
SELECT rg.symbol, rg.law_id, side, tier, status AS validation_status, CASE tier WHEN 'A' THEN 'GUARD' WHEN 'B' THEN 'CONFIRMATION' ELSE 'ADVISORY' END AS runtime_role, CASE WHEN tier = 'A' THEN CASE side WHEN 'BUY' THEN 'SELL_BREAKOUT' ELSE 'BUY_BREAKOUT' END END AS block_action, round(full_edge, 6) AS full_edge,
  coalesce(modulators, 0) AS modulators, round(coalesce(adjustment, 0), 3) AS adjustment, first_modulator FROM rg LEFT JOIN md ON md.symbol = rg.symbol AND md.law_id = rg.law_id""")
def law_registry(spark, d):
    """What validation and segmentation publish of each law."""
    b, registry = states(spark, d), declared(spark)
    validated = _validated(b, registry)
    out = laws.publishable(validated, laws.segmented(b, registry, validated))
    total = F.aggregate("modulators", F.lit(0.0), lambda s, m: s + m["score_adjustment"])
    first = F.array_min(F.transform("modulators", lambda m: F.concat_ws("=", m["dimension"], m["segment"])))
    return out.select("symbol", "law_id", "side", "tier", "validation_status", "runtime_role", "block_action", F.round("full_edge", 6).alias("full_edge"), F.size("modulators").cast("long").alias("modulators"), F.round(total, 3).alias("adjustment"), first.alias("first_modulator"))


def _literal(x) -> str:
    return "NULL" if x is None else f"'{x}'" if isinstance(x, str) else f"{x}::DOUBLE" if isinstance(x, float) else str(x)


_OPS = ", ".join("(" + ", ".join(map(_literal, (n, *x[:4]))) + ")" for n, x in _OPERATIVE.items())
_MODS = ", ".join("(" + ", ".join(map(_literal, (n, k, *m))) + ")" for n, x in _OPERATIVE.items() for k, m in enumerate(x[4]))
_MATCHED = f"""{_STATES}, op(law_id, vs, tier, edge, blocks) AS (VALUES {_OPS}), mo(law_id, place, {', '.join(_MOD)}) AS (VALUES {_MODS}),
hit AS (SELECT held.symbol, held.time, held.law_id, law.side, tier, blocks, dims, least(100, greatest(0, 45 + 55 * edge)) AS base FROM held JOIN law ON law.law_id = held.law_id JOIN op ON op.law_id = held.law_id WHERE vs IN ('VALIDATED', 'PROVISIONAL')),
ap AS (SELECT hit.symbol, hit.time, hit.law_id, score_adjustment, row_number() OVER (PARTITION BY hit.symbol, hit.time, hit.law_id, status, full_valid, round(full_edge, 9), oos_valid, round(oos_edge, 9) ORDER BY abs(score_adjustment) DESC, place) AS r FROM hit JOIN mo ON mo.law_id = hit.law_id AND dims[mo.dimension] = mo.segment),
mv AS (SELECT symbol, time, law_id, sum(score_adjustment) FILTER (r = 1) AS moved, count(*) FILTER (r = 1) AS applied, count(*) FILTER (r > 1) AS suppressed FROM ap GROUP BY ALL),
sc AS MATERIALIZED (SELECT hit.*, coalesce(applied, 0) AS applied, coalesce(suppressed, 0) AS suppressed, least(100, greatest(0, base + CASE tier WHEN 'A' THEN 5 WHEN 'C' THEN -12 ELSE 0 END + coalesce(moved, 0))) AS score FROM hit LEFT JOIN mv ON mv.symbol = hit.symbol AND mv.time = hit.time AND mv.law_id = hit.law_id)"""


@query(f"""{_MATCHED}, g AS (SELECT symbol, time, count(*) AS matched_count, string_agg(law_id, ',' ORDER BY score DESC, tier = 'A' DESC, law_id) AS matched_laws, coalesce(sum(score) FILTER (side = 'BUY'), 0) AS buy, coalesce(sum(score) FILTER (side = 'SELL'), 0) AS sell, max(score) FILTER (side = 'BUY') AS top_buy, max(score) FILTER (side = 'SELL') AS top_sell, sum(applied)::BIGINT AS applied, sum(suppressed)::BIGINT AS suppressed, list_sort(list_distinct(list(blocks) FILTER (tier = 'A' AND blocks IS NOT NULL))) AS bl FROM sc GROUP BY ALL),
h AS (SELECT *, CASE WHEN buy > 0 AND sell > 0 AND abs(buy - sell) < 15 THEN 'MIXED' WHEN buy > sell THEN 'BUY' ELSE 'SELL' END AS sup FROM g)
SELECT st.symbol, st.time, coalesce(matched_count, 0) AS matched_count, coalesce(matched_laws, '') AS matched_laws, coalesce(sup, 'NONE') AS supporting_side, round(coalesce(buy, 0), 3) AS buy_score, round(coalesce(sell, 0), 3) AS sell_score, coalesce(array_to_string(bl, ','), '') AS blocked_actions, coalesce(applied, 0) AS applied, coalesce(suppressed, 0) AS suppressed,
  CASE WHEN sup IS NULL THEN 'NO_MATCH' WHEN sup = 'MIXED' THEN 'WAIT_CONFLICT' ELSE 'WAIT_FOR_' || sup || '_CONFIRMATION' END AS action,
  CASE WHEN sup IS NULL THEN 'NONE' WHEN buy > 0 AND sell > 0 THEN 'MEDIUM' WHEN (CASE sup WHEN 'BUY' THEN top_buy ELSE top_sell END) >= 75 THEN 'HIGH' WHEN (CASE sup WHEN 'BUY' THEN top_buy ELSE top_sell END) >= 55 THEN 'MEDIUM' ELSE 'LOW' END AS confidence
FROM st LEFT JOIN h ON h.symbol = st.symbol AND h.time = st.time""")
def law_decisions(spark, d):
    """Every bar against the registry: which laws hold, their scores, what they block and what to wait for."""
    m = laws.matched(states(spark, d), operative(spark))
    count = lambda n: F.aggregate("matches", F.lit(0).cast("long"), lambda s, x: s + x[n])
    return m.select("symbol", "time", F.size("matches").cast("long").alias("matched_count"), F.array_join("matches.law_id", ",").alias("matched_laws"), "supporting_side", F.round("buy_score", 3).alias("buy_score"), F.round("sell_score", 3).alias("sell_score"), F.array_join("blocked_actions", ",").alias("blocked_actions"), count("applied").alias("applied"), count("suppressed").alias("suppressed"), "action", "confidence")


_FAILS = {
    "LAW_0001A": {"level_zone": "level_zone = 'AT_RESISTANCE'", "mtf_alignment_bucket_in": "mtf_alignment_bucket IN ('MIXED', 'STRONG', 'FULL')", "mtf_bias": "mtf_bias = 'DOWN'"},
    "LAW_0002A": {"breakout_up": "breakout_up = 1", "level_zone_in": "level_zone IN ('AT_RESISTANCE', 'NEAR_RESISTANCE')", "range_atr_between": "coalesce(range_atr BETWEEN 0.5 AND 2.5, false)"},
    "LAW_0003A": {"breakout_up": "breakout_up = 0", "energy_score_between": "coalesce(energy_score BETWEEN 40 AND 100, false)", "event_name_in": "event_name IN ('FALSE_BREAK', 'SWEEP')"},
    "LAW_0004A": {"direction": "direction = 'UP'", "no_such_field": "false"},
}


@query(f"""{_STATES}, fl AS ({' UNION ALL '.join(f"SELECT symbol, '{n}' AS law_id, list_filter([{', '.join(f'''CASE WHEN NOT ({x}) THEN '{k}' END''' for k, x in tests.items())}], lambda v: v IS NOT NULL) AS failed FROM st" for n, tests in _FAILS.items())})
SELECT symbol, law_id, condition, count(*) AS failed, count(*) FILTER (alone) AS failed_alone FROM (SELECT symbol, law_id, unnest(failed) AS condition, len(failed) = 1 AS alone FROM fl) GROUP BY ALL""")
def law_audit(spark, d):
    """Which conditions of four laws fail, and how often each is the only one."""
    registry = declared(spark).where(c("law_id").isin(*_FAILS))
    return laws.audit(states(spark, d), registry)
