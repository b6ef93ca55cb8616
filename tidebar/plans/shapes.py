"""The geometry of the last bars of each bar, and how often each shape comes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebar.operators import geometry as geo
from tidebar.plans import sqlparts as q
from tidebar.plans.bars_and_features import base, rounded

c = F.col
QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _slope(list_: str, field: str) -> str:
    n = f"len({list_})"
    return f"list_sum(list_transform({list_}, lambda x, i: (i - 1 - ({n} - 1) / 2.0::DOUBLE) * x.{field})) / nullif({n} * ({n} * {n} - 1) / 12.0::DOUBLE, 0)"


def _mean(list_: str, value: str) -> str:
    return f"list_avg(list_transform({list_}, lambda x: {value}))"


def _pivots(field: str, best: str, sign: str) -> str:
    return f"list_filter(list_transform(range(1, len(w) + 1), lambda i: {{'at': i - 1, 'price': w[i].{field}}}), lambda p: p.at >= 2 AND p.at < len(w) - 2 AND p.price {sign} list_{best}(list_transform(w[p.at - 1:p.at + 3], lambda x: x.{field})))"


def _share(*tests: str) -> str:
    return f"round(({' + '.join(f'coalesce({t}, false)::INT' for t in tests)}) / {len(tests)}.0::DOUBLE, 3)"


_HS, _LS, _CH, _CL, _M = "high_slope_atr", "low_slope_atr", "consolidation_high_slope_atr", "consolidation_low_slope_atr", "impulse_move_atr"
_BACK, _VOL = "pullback_depth_pct BETWEEN 10 AND 70", "volume_ratio <= 1.05"
_PAR, _LEAN = f"abs({_HS} - {_LS}) <= 0.05", f"abs(({_HS} + {_LS}) / 2) >= 0.02"
_SHAPES = {
    "BULL_FLAG": (_share(f"{_M} > 0", f"abs({_M}) >= 1.2", _BACK, f"{_CH} <= 0.08", f"{_CL} <= 0.08", _VOL), 0.5),
    "BEAR_FLAG": (_share(f"{_M} < 0", f"abs({_M}) >= 1.2", _BACK, f"{_CH} >= -0.08", f"{_CL} >= -0.08", _VOL), 0.5),
    "SYMMETRICAL_TRIANGLE": (_share(f"{_HS} < -0.02", f"{_LS} > 0.02", "compression_ratio < 0.9"), 0.667),
    "ASCENDING_TRIANGLE": (_share(f"abs({_HS}) <= 0.04", f"{_LS} > 0.02", "compression_ratio < 0.95"), 0.667),
    "DESCENDING_TRIANGLE": (_share(f"{_HS} < -0.02", f"abs({_LS}) <= 0.04", "compression_ratio < 0.95"), 0.667),
}
_CAND = [f"CASE WHEN {s} >= {least} THEN {{'name': '{n}', 'score': {s}}} END" for n, (s, least) in _SHAPES.items()]
_CAND.append(f"CASE WHEN {_PAR} AND {_LEAN} THEN {{'name': CASE WHEN {_HS} + {_LS} > 0 THEN 'ASCENDING_CHANNEL' ELSE 'DESCENDING_CHANNEL' END, 'score': {_share(_PAR, _LEAN, 'compression_ratio IS NULL OR compression_ratio >= 0.65')}}} END")
_CAND += [f"CASE WHEN len({x}) >= 2 AND {x}[-1].at - {x}[-2].at >= 3 AND abs({x}[-1].price - {x}[-2].price) / atr_reference <= 0.45 THEN {{'name': '{n}', 'score': 1.0::DOUBLE}} END" for n, x in (("DOUBLE_TOP", "high_pivots"), ("DOUBLE_BOTTOM", "low_pivots"))]
_GEO = f"""WITH RECURSIVE {q.bars()}, {q.base()}, ge0 AS (SELECT *, list({{'open': open, 'high': high, 'low': low, 'close': close, 'volume': volume::DOUBLE}}) OVER {q.past(30)} AS w0 FROM b),
ge1 AS (SELECT *, coalesce(CASE WHEN atr > 0 THEN atr END, nullif({_mean('w0[greatest(len(w0) - 13, 1):]', 'x.high - x.low')}, 0)) AS ref FROM ge0),
ge2 AS (SELECT *, CASE WHEN row_idx >= 8 AND ref IS NOT NULL THEN w0 END AS w, least(6, greatest(4, len(w0) // 4)) AS nc, least(5, greatest(3, len(w0) // 5)) AS ni FROM ge1),
ge3 AS (SELECT *, ref AS atr_reference, w[greatest(len(w) - 11, 1):] AS g, w[len(w) - nc + 1:] AS cw, w[len(w) - nc - ni + 1:len(w) - nc] AS iw FROM ge2),
ge4 AS (SELECT *, {', '.join(f'{_slope("g", f)} / ref AS {f}_slope_atr' for f in ('high', 'low', 'close'))}, {_mean('g[greatest(2, len(g) // 2) + 1:]', 'x.high - x.low')} / nullif({_mean('g[:greatest(2, len(g) // 2)]', 'x.high - x.low')}, 0) AS compression_ratio, iw[-1].close - iw[1].open AS move, list_max(list_transform(cw, lambda x: x.high)) AS chigh, list_min(list_transform(cw, lambda x: x.low)) AS clow, iw[-1].close AS ic FROM ge3),
ge5 AS (SELECT *, move / ref AS impulse_move_atr, CASE WHEN move / ref > 0 THEN 'UP' WHEN move / ref < 0 THEN 'DOWN' WHEN move IS NOT NULL THEN 'FLAT' END AS impulse_direction, abs(CASE WHEN move > 0 THEN ic - clow ELSE chigh - ic END / nullif(move, 0)) * 100 AS pullback_depth_pct, {_slope('cw', 'high')} / ref AS consolidation_high_slope_atr, {_slope('cw', 'low')} / ref AS consolidation_low_slope_atr, (chigh - clow) / ref AS consolidation_width_atr, {_mean('cw', 'x.volume')} / nullif({_mean('iw', 'x.volume')}, 0) AS volume_ratio, {_pivots('high', 'max', '>=')} AS high_pivots, {_pivots('low', 'min', '<=')} AS low_pivots FROM ge4),
ge AS MATERIALIZED (SELECT *, CASE WHEN w IS NOT NULL THEN list_filter([{', '.join(_CAND)}], lambda s: s IS NOT NULL) END AS candidates FROM ge5)"""
_NUMBERS = ("high_slope_atr", "low_slope_atr", "close_slope_atr", "compression_ratio", "impulse_move_atr", "pullback_depth_pct", "consolidation_high_slope_atr", "consolidation_low_slope_atr", "consolidation_width_atr", "volume_ratio")


@query(f"""{_GEO} SELECT symbol, time, {', '.join(f'round(CASE WHEN w IS NOT NULL THEN {n} END, 5) AS {n}' for n in _NUMBERS)}, CASE WHEN w IS NOT NULL THEN impulse_direction END AS impulse_direction, coalesce(array_to_string(list_transform(high_pivots, lambda p: p.at::VARCHAR), ','), '') AS high_pivots, coalesce(array_to_string(list_transform(low_pivots, lambda p: p.at::VARCHAR), ','), '') AS low_pivots,
coalesce(array_to_string(list_transform(candidates, lambda s: s.name || '=' || (round(s.score * 1000)::INT)::VARCHAR), ','), '') AS candidates FROM ge""")
def bar_geometry(spark, d):
    """Slopes, compression, impulse and consolidation, pivots and shapes of every bar."""
    g = geo.geometry(base(spark, d))
    text = lambda n: F.coalesce(F.array_join(F.transform(n, lambda p: p["at"].cast("string")), ","), F.lit(""))
    shapes = F.coalesce(F.array_join(F.transform("candidates", lambda s: F.concat_ws("=", s["name"], F.round(s["score"] * 1000).cast("int").cast("string"))), ","), F.lit(""))
    return rounded(g.select("symbol", "time", *_NUMBERS, "impulse_direction", text("high_pivots").alias("high_pivots"), text("low_pivots").alias("low_pivots"), shapes.alias("candidates")), 5)


@query(f"{_GEO} SELECT symbol, s.name AS name, count(*) AS bars, round(avg(s.score), 5) AS avg_score, min(time) AS first_time, max(time) AS last_time FROM (SELECT symbol, time, unnest(candidates) AS s FROM ge) GROUP BY ALL")
def shape_counts(spark, d):
    # explode_outer: for explode() the optimizer would add a filter that computes the whole geometry once more.
    g = geo.geometry(base(spark, d)).select("symbol", "time", F.explode_outer("candidates").alias("s"))
    return rounded(g.where("s IS NOT NULL").groupBy("symbol", c("s.name").alias("name")).agg(F.count("*").alias("bars"), F.avg("s.score").alias("avg_score"), F.min("time").alias("first_time"), F.max("time").alias("last_time")), 5)
