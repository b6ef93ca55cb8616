"""The ranked miner: single features of break events, their ranking, and pairs of the ranked ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.operators import features, levels, miner
from tidebar.plans import bars_and_features as bf
from tidebar.plans import blocks, research
from tidebar.plans import sqlparts as q
from tidebar.plans.bars_and_features import base, rounded
from tidebar.plans.shared import written

c = F.col
QUERIES, SQL = {}, {}
# The features that are mined (the spread's score is absent, as ticks have no spread).
TEXTS = ("body_direction", "structure_state", "session_name", "in_asia_session", "in_london_session", "in_ny_session", "london_killzone", "ny_killzone", "compression_flag", "expansion_flag", "bos_up", "bos_dn", "choch_up", "choch_dn", "sweep_high", "sweep_low", "fvg_up", "fvg_dn", "ema20_above_ema50", "vol_spike_1p5", "vol_spike_2p0")
NUMBERS = ("vol_ratio", "atr_z", "bb_width_z", "adx_14", "rsi_14", "range_atr", "body_atr", "ema20_slope_5", "ema50_slope_5", "dist_ema20_atr", "dist_ema50_atr", "dist_donchian_high20_atr", "dist_donchian_low20_atr", "fvg_up_size_atr", "fvg_dn_size_atr")
#: Least training and test rows of single features and of pairs: a sixth of the published ones, as the test tables are small.
SINGLE, PAIR = (20, 8), (14, 5)
_SIDE = ("symbol", "horizon", "side")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _events(spark, d) -> tuple[DataFrame, DataFrame]:
    """Independent events of each side and horizon with all features as text, and the side's baselines."""
    b = features.smoothed(base(spark, d, research._WIDTH))
    b = levels.gap_zones(features.structure(features.sessions(features.price_blocks(levels.ema_trend(levels.distances(features.regimes(features.rolling_indicators(b))))))))
    ev = research._break_events(spark, d).select("symbol", "time").join(b.select("symbol", "time", *TEXTS, *NUMBERS), ["symbol", "time"])
    named = miner.with_features(ev, TEXTS, NUMBERS).select("symbol", "time", "features")
    ind = research._independent(spark, d).where("scope = 'SIDE'").select("symbol", "time", "horizon", c("break_side").alias("side"), c("success").cast("double").alias("success"), "return", "mfe", "mae")
    rows = written(ind.join(named, ["symbol", "time"]), "mining")
    return rows, written(miner.baselines(rows), "mining-base")


def _singles(rows: DataFrame, base_: DataFrame) -> DataFrame:
    each = rows.withColumn("_f", F.explode("features")).select(*(n for n in rows.columns if n != "features"), "_f.*")
    return miner.judged(miner.measured(each, ("feature", "value")), base_, SINGLE)


_METRICS = tuple(f"{p}_{m}" for p in ("train", "test") for m in ("success", "return", "median_return", "mfe", "mae", "success_lift", "return_lift"))
_S = f"""{research._THIN}, {q.smoothed()}, {blocks._IND_M}, {blocks._Z},
k0 AS (SELECT *, CASE WHEN row_idx > 6 AND lag(high, 3) OVER {q.W} >= max(high) OVER {q.past(7)} THEN lag(high, 3) OVER {q.W} END AS swing_high, CASE WHEN row_idx > 6 AND lag(low, 3) OVER {q.W} <= min(low) OVER {q.past(7)} THEN lag(low, 3) OVER {q.W} END AS swing_low, hour({bf._AT.format('Europe/London')})::INT AS hlon, hour({bf._AT.format('America/New_York')})::INT AS hny,
  {', '.join(f'greatest(({hi}) - ({lo}), 0) / (nullif(atr, 0) + 1e-9) AS gap_{s}, ({lo}) IS NOT NULL AND ({hi}) IS NOT NULL AS has_{s}' for s, (lo, hi) in blocks._GAP.items())} FROM y),
k1 AS (SELECT *, last_value(swing_high IGNORE NULLS) OVER {bf._RUN} AS lsh, last_value(swing_low IGNORE NULLS) OVER {bf._RUN} AS lsl FROM k0), k2 AS (SELECT *, lag(lsh) OVER {q.W} AS rh, lag(lsl) OVER {q.W} AS rl FROM k1),
k3 AS (SELECT *, {q.flag('close > rh AND pc <= rh', 'bos_up')}, {q.flag('close < rl AND pc >= rl', 'bos_dn')} FROM k2), k4 AS (SELECT *, coalesce(last_value(CASE WHEN bos_up = 1 THEN 1 WHEN bos_dn = 1 THEN -1 END IGNORE NULLS) OVER {bf._RUN}, 0)::INT AS structure_state FROM k3),
k5 AS (SELECT *, coalesce(lag(structure_state) OVER {q.W}, 0) AS prev FROM k4),
k6 AS MATERIALIZED (SELECT symbol, time, sign(close - open)::INT AS body_direction, structure_state, CASE WHEN hny BETWEEN 8 AND 16 THEN 'NEW_YORK' WHEN hlon BETWEEN 8 AND 11 THEN 'LONDON' WHEN hlon < 8 THEN 'ASIA' ELSE 'OFF_SESSION' END AS session_name, (hlon < 8)::INT AS in_asia_session, (hlon BETWEEN 8 AND 11)::INT AS in_london_session, (hny BETWEEN 8 AND 16)::INT AS in_ny_session, (hlon BETWEEN 7 AND 9)::INT AS london_killzone, (hny BETWEEN 8 AND 10)::INT AS ny_killzone,
  {q.flag('atr_z < -1 AND bb_width_z < -1', 'compression_flag')}, {q.flag('atr_z > 1 OR bb_width_z > 1', 'expansion_flag')}, bos_up, bos_dn, {q.flag('bos_up = 1 AND prev = -1', 'choch_up')}, {q.flag('bos_dn = 1 AND prev = 1', 'choch_dn')}, {q.flag('high > ph AND close < ph', 'sweep_high')}, {q.flag('low < pl AND close > pl', 'sweep_low')},
  {', '.join(f"coalesce(has_{s} AND gap_{s} >= 0.1, false)::INT AS fvg_{s}, CASE WHEN has_{s} AND gap_{s} >= 0.1 THEN gap_{s} ELSE 0 END AS fvg_{s}_size_atr" for s in ('up', 'dn'))}, {q.flag('ema_20 > ema_50', 'ema20_above_ema50')}, {q.flag('vol_ratio >= 1.5', 'vol_spike_1p5')}, {q.flag('vol_ratio >= 2', 'vol_spike_2p0')}, vol_ratio, atr_z, bb_width_z, adx_14, rsi_14, (high - low) / (atr + 1e-9) AS range_atr, abs(close - open) / (atr + 1e-9) AS body_atr,
  ln(ema_20 / lag(ema_20, 5) OVER {q.W}) AS ema20_slope_5, ln(ema_50 / lag(ema_50, 5) OVER {q.W}) AS ema50_slope_5, {', '.join(f"(close - {x}) / (nullif(atr, 0) + 1e-9) AS dist_{n}_atr" for n, x in (('ema20', 'ema_20'), ('ema50', 'ema_50'), ('donchian_high20', 'donchian_high20'), ('donchian_low20', 'donchian_low20')))} FROM k5),
en0 AS (SELECT k6.*, row_number() OVER (PARTITION BY symbol ORDER BY time) - 1 AS en, count(*) OVER (PARTITION BY symbol) AS em FROM k6 SEMI JOIN ev USING (symbol, time)),
nm AS (UNPIVOT (SELECT symbol, time, en, em, {', '.join(f'coalesce({n}, 1e300)::DOUBLE AS {n}' for n in NUMBERS)} FROM en0) ON {', '.join(NUMBERS)} INTO NAME feature VALUE v),
eg AS (SELECT * FROM (SELECT symbol, feature, quantile_cont(v, [0.25, 0.5, 0.75]) AS qs, count(DISTINCT v) AS m FROM nm WHERE v < 1e300 AND en < floor(em * 0.7::DOUBLE) GROUP BY ALL) WHERE m >= 4 AND qs[1] < qs[2] AND qs[2] < qs[3]),
ft AS MATERIALIZED (SELECT symbol, time, feature, value FROM (UNPIVOT (SELECT symbol, time, {', '.join(f"coalesce({n}::VARCHAR, 'UNKNOWN') AS {n}" for n in TEXTS)} FROM en0) ON {', '.join(TEXTS)} INTO NAME feature VALUE value)
  UNION ALL SELECT symbol, time, feature, CASE WHEN qs IS NULL OR v >= 1e300 THEN 'UNKNOWN' WHEN v <= qs[1] THEN 'Q1_LOW' WHEN v <= qs[2] THEN 'Q2' WHEN v <= qs[3] THEN 'Q3' ELSE 'Q4_HIGH' END FROM nm LEFT JOIN eg USING (symbol, feature)),
iv AS MATERIALIZED (SELECT symbol, time, horizon, break_side AS side, success::INT::DOUBLE AS success, return, mfe, mae, row_number() OVER w AS k, count(*) OVER (PARTITION BY symbol, horizon, break_side) AS m FROM ind WHERE scope = 'SIDE' WINDOW w AS (PARTITION BY symbol, horizon, break_side ORDER BY time)),
bl AS MATERIALIZED (SELECT symbol, horizon, side, {', '.join(f"avg({m}) FILTER ({'' if p == 'train' else 'NOT '}(k <= least(greatest(floor(m * 0.7::DOUBLE), 1), m - 1))) AS {p}_{m}_base" for p in ('train', 'test') for m in ('success', 'return'))} FROM iv WHERE m >= 2 GROUP BY ALL)"""


def _lifts_sql(rows: str, keys: str, least: tuple[int, int], name: str) -> str:
    by = f"symbol, horizon, side, {keys}"
    train = "(k2 <= least(greatest(floor(m2 * 0.7::DOUBLE), 1), m2 - 1))"
    parts = {"train": train, "test": f"NOT {train}"}
    agg = ", ".join(f"count(*) FILTER ({on}) AS {p}_n, {', '.join(f'avg({m}) FILTER ({on}) AS {p}_{m}' for m in miner.MEASURES)}, median(return) FILTER ({on}) AS {p}_median_return" for p, on in parts.items())
    lifts = ", ".join(f"{p}_{m} - {p}_{m}_base AS {p}_{m}_lift" for p in parts for m in ("success", "return"))

    def lasts(sign: str) -> str:
        return " AND ".join(f"{sign}{p}_success_lift >= 0.03 AND {sign}{p}_return_lift >= 0.05 AND {sign}{p}_return > 0" for p in parts)

    return f"""{name}0 AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY time) AS k2, count(*) OVER (PARTITION BY {by}) AS m2 FROM {rows}), {name}1 AS (SELECT {by}, {agg} FROM {name}0 GROUP BY ALL),
{name}2 AS (SELECT {name}1.*, {lifts} FROM {name}1 JOIN bl USING (symbol, horizon, side)),
{name} AS MATERIALIZED (SELECT *, CASE WHEN train_n >= {least[0]} AND test_n >= {least[1]} THEN CASE WHEN {lasts('')} THEN 'ROBUST_POSITIVE' WHEN {lasts('-')} THEN 'ROBUST_NEGATIVE' ELSE 'NOT_ROBUST' END ELSE 'NOT_ROBUST' END AS candidate_status FROM {name}2)"""


_SG = f"{_S}, sgr AS (SELECT iv.*, feature, value FROM iv JOIN ft USING (symbol, time)), {_lifts_sql('sgr', 'feature, value', SINGLE, 'sg')}"
_RK = f"""{_SG}, rk0 AS (SELECT symbol, feature, count(*) AS robust_count, avg(abs(test_success_lift)) AS mean_success_lift, avg(abs(test_return_lift)) AS mean_return_lift FROM sg WHERE candidate_status <> 'NOT_ROBUST' GROUP BY ALL),
rk AS MATERIALIZED (SELECT *, robust_count + mean_success_lift + mean_return_lift AS score, row_number() OVER (PARTITION BY symbol ORDER BY robust_count + mean_success_lift + mean_return_lift DESC, feature) AS place FROM rk0 QUALIFY place <= {miner.MOST_FEATURES})"""
_ROUND = ", ".join(f"round({n}, 6) AS {n}" for n in _METRICS)


@query(f"{_SG} SELECT symbol, horizon, side, feature, value, train_n, test_n, {_ROUND}, candidate_status FROM sg")
def mined_features(spark, d):
    """Every value of 36 features at four horizons, in training and test time, against its side."""
    return rounded(_singles(*_events(spark, d)).select(*_SIDE, "feature", "value", "train_n", "test_n", *_METRICS, "candidate_status"))


@query(f"{_RK} SELECT symbol, feature, place::INT AS place, robust_count, round(mean_success_lift, 6) AS mean_success_lift, round(mean_return_lift, 6) AS mean_return_lift, round(score, 6) AS score FROM rk")
def ranked_features(spark, d):
    return rounded(miner.ranked(_singles(*_events(spark, d))).select("symbol", "feature", "place", "robust_count", "mean_success_lift", "mean_return_lift", "score"))


@query(f"""{_RK}, prr AS (SELECT iv.*, a.feature AS feature_1, b.feature AS feature_2, f1.value AS value_1, f2.value AS value_2 FROM iv JOIN rk a ON a.symbol = iv.symbol JOIN rk b ON b.symbol = iv.symbol AND b.place > a.place JOIN ft f1 ON f1.symbol = iv.symbol AND f1.time = iv.time AND f1.feature = a.feature JOIN ft f2 ON f2.symbol = iv.symbol AND f2.time = iv.time AND f2.feature = b.feature),
{_lifts_sql('prr', 'feature_1, feature_2, value_1, value_2', PAIR, 'pr')} SELECT symbol, horizon, side, feature_1, feature_2, value_1, value_2, train_n, test_n, {_ROUND}, candidate_status FROM pr""")
def mined_pairs(spark, d):
    """Pairs of the features that ranked best: which columns the second pass reads depends on what the first one found."""
    rows, base_ = _events(spark, d)
    ranks = written(miner.ranked(_singles(rows, base_)), "mining-ranks")
    keys = ("feature_1", "feature_2", "value_1", "value_2")
    groups = miner.paired(rows, ranks).drop("features")
    return rounded(miner.judged(miner.measured(groups, keys), base_, PAIR).select(*_SIDE, *keys, "train_n", "test_n", *_METRICS, "candidate_status"))
