"""Entries of each bar, their cascade over smaller widths, decisions by horizon, and profiles chosen and judged on separate periods."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebar.functions import exprs as e
from tidebar.operators import executions as ex
from tidebar.operators import features
from tidebar.plans import profile
from tidebar.plans import sqlparts as q
from tidebar.plans.bars_and_features import base, rounded
from tidebar.plans.shared import written
from tidebar.sources import bars as src

c = F.col
QUERIES, SQL = {}, {}
#: Target in atr, horizons of bars of 15 minutes and of an hour, and shares of the periods.
TARGET, HORIZONS, HOURLY = 0.5, {"fast": 2, "base": 4, "extended": 8}, 3
TRAIN, TEST = 0.60, 0.80
CHAIN = (("15 minutes", "M15"), ("5 minutes", "M5"), ("1 minute", "M1"))


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_CASES = ", ".join(f"('{way}', '{n}', {side}, {back}::DOUBLE, {stop}::DOUBLE, {mode != 'MARKET'}, '{mode}', {k})" for way, side in (("UP", 1), ("DOWN", -1)) for k, (n, mode, back, stop) in enumerate(ex.ENTRIES))


def _entries_sql(source: str, target: float, name: str = "en") -> str:
    """A row for each bar and case, with its prices."""
    return f"""kinds(direction, variant, side, back, stop, waits, mode, place) AS (VALUES {_CASES}),
{name} AS MATERIALIZED (SELECT *, entry + side * {target} * atr AS tp, entry - side * stop * atr AS sl FROM (SELECT symbol, time, row_idx, atr, kinds.*, close - side * back * atr AS entry FROM {source}, kinds))"""


def _scan_sql(cases: str, bars: str, on: str, at: str, name: str) -> str:
    """(symbol, time, direction, variant, filled, label) of cases over bars that `on` pairs with them, in the order of `at`."""
    won, lost = (f"CASE WHEN side > 0 THEN {a} ELSE {b} END" for a, b in (("n.high >= tp", "n.low <= tp"), ("n.low <= sl", "n.high >= sl")))
    return f"""{name}0 AS (SELECT c.symbol, c.time, direction, variant, {at} AS p, NOT waits OR CASE WHEN side > 0 THEN n.low <= entry ELSE n.high >= entry END AS reached, {won} AS won, {lost} AS lost FROM {cases} c JOIN {bars} n ON n.symbol = c.symbol AND {on}),
{name}1 AS (SELECT *, min(p) FILTER (reached) OVER (PARTITION BY symbol, time, direction, variant) AS fill FROM {name}0),
{name} AS MATERIALIZED (SELECT symbol, time, direction, variant, any_value(fill) AS fill, arg_min(CASE WHEN won AND lost THEN 'AMBIGUOUS' WHEN won THEN 'TP_FIRST' ELSE 'SL_FIRST' END, p) FILTER (p >= fill AND (won OR lost)) AS label FROM {name}1 GROUP BY ALL)"""


def _labelled_sql(source: str, horizon: int, target: float = TARGET, name: str = "lb", entries: str = "en") -> str:
    scan = _scan_sql(f"(SELECT * FROM {entries} WHERE atr > 0)", source, f"n.row_idx BETWEEN c.row_idx + 1 AND c.row_idx + {horizon}", "n.row_idx", f"{name}s")
    return f"""{scan}, {name} AS MATERIALIZED (SELECT e.*, coalesce(atr > 0 AND (NOT waits OR fill IS NOT NULL), false) AS filled, CASE WHEN NOT coalesce(atr > 0, false) THEN 'INVALID' ELSE coalesce(label, CASE WHEN NOT waits THEN 'NO_TOUCH' WHEN fill IS NULL THEN 'NOT_FILLED' ELSE 'FILLED_NO_EXIT' END) END AS label
FROM {entries} e LEFT JOIN {name}s s ON s.symbol = e.symbol AND s.time = e.time AND s.direction = e.direction AND s.variant = e.variant)"""


# --- The cascade ----------------------------------------------------------------------------------------------------------


def _cascade_sql() -> str:
    parts = [f"WITH RECURSIVE {q.bars()}", q.base(), *(q.bars(w, f"low{k}") for k, (w, _) in enumerate(CHAIN)), _entries_sql("b", TARGET), _labelled_sql("b", HOURLY)]
    parts.append("op0 AS MATERIALIZED (SELECT * FROM lb WHERE label = 'AMBIGUOUS')")
    for k in range(len(CHAIN)):
        parts.append(_scan_sql(f"op{k}", f"low{k}", f"n.time >= c.time + INTERVAL '1 hour' AND n.time < c.time + INTERVAL '1 hour' * {HOURLY + 1}", "n.time", f"r{k}"))
        parts.append(f"ok{k} AS (SELECT * FROM r{k} WHERE label <> 'AMBIGUOUS'), op{k + 1} AS MATERIALIZED (SELECT o.* FROM op{k} o ANTI JOIN ok{k} USING (symbol, time, direction, variant))")
    done = " UNION ALL ".join(f"SELECT symbol, time, direction, variant, label, '{n}' AS settled_by FROM ok{k}" for k, (_, n) in enumerate(CHAIN))
    return ", ".join(parts) + f", cc AS MATERIALIZED ({done} UNION ALL SELECT symbol, time, direction, variant, 'AMBIGUOUS', NULL FROM op{len(CHAIN)})"


_CASCADE = _cascade_sql()


def _settled(spark, d) -> DataFrame:
    before = ex.with_cases(base(spark, d), TARGET, HOURLY).select("symbol", "time", "cases")
    before = written(before, "entries")
    chain = [(n, src.event_bars(spark, d, w)) for w, n in CHAIN]
    return ex.ambiguous(before, ex.cascade(before, chain, "1 hour", HOURLY, written))


@query(f"{_CASCADE} SELECT * FROM cc")
def cascade_cases(spark, d):
    """Every entry of an hourly bar that was unclear, with the width that settled it."""
    return _settled(spark, d)


_WIDTHS = [n for _, n in CHAIN]


@query(f"""{_CASCADE}, ev AS (SELECT symbol, time, bool_and(settled_by IS NOT NULL) AS whole FROM cc GROUP BY ALL), e AS (SELECT symbol, count(*) AS events_before, count(*) FILTER (whole) AS events_settled FROM ev GROUP BY symbol),
k AS (SELECT symbol, count(*) AS cases_before, count(settled_by) AS cases_settled, {', '.join(f"count(*) FILTER (settled_by IS NULL OR settled_by NOT IN ({', '.join(repr(m) for m in (*_WIDTHS[:i], ''))})) AS attempted_{n}, count(*) FILTER (settled_by = '{n}') AS settled_{n}" for i, n in enumerate(_WIDTHS))} FROM cc GROUP BY symbol)
SELECT e.*, k.* EXCLUDE (symbol), round(events_settled / events_before, 6) AS event_rate, round(cases_settled / cases_before, 6) AS case_rate FROM e JOIN k USING (symbol)""")
def cascade_summary(spark, d):
    """Cases and events before and after the cascade, and what each width was given and settled."""
    k = _settled(spark, d)
    k = written(k, "cascade-cases")
    of = c("settled_by")
    widths = [x for i, n in enumerate(_WIDTHS) for x in (F.count_if(of.isNull() | ~of.isin("", *_WIDTHS[:i])).alias(f"attempted_{n}"), F.count_if(of == n).alias(f"settled_{n}"))]
    cases = k.groupBy("symbol").agg(F.count("*").alias("cases_before"), F.count("settled_by").alias("cases_settled"), *widths)
    events = k.groupBy("symbol", "time").agg(F.bool_and(of.isNotNull()).alias("whole")).groupBy("symbol").agg(F.count("*").alias("events_before"), F.count_if("whole").alias("events_settled"))
    return rounded(events.join(cases, "symbol").withColumns({"event_rate": c("events_settled") / c("events_before"), "case_rate": c("cases_settled") / c("cases_before")}))


# --- Decisions ------------------------------------------------------------------------------------------------------------


def _attempts(b: DataFrame) -> DataFrame:
    """A row for each bar and direction that it attempts to break out in."""
    way = F.array_compact(F.array(*(F.when((c(f"breakout_{s}") == 1) | (c(f"false_breakout_{s}") == 1), n) for s, n in (("up", "UP"), ("down", "DOWN")))))
    return b.withColumn("direction", F.explode(way))


_ATT = "((direction = 'UP' AND breakout_up + false_breakout_up > 0) OR (direction = 'DOWN' AND breakout_down + false_breakout_down > 0))"


def _grade(n: str = "resolved") -> str:
    tests = " ".join(f"WHEN reliability >= {r} AND {n} >= {least} AND ambiguity <= {unclear} AND expectancy >= {worth} THEN '{g}'" for g, r, least, unclear, worth in ex.GRADES)
    return f"CASE WHEN NOT expectancy > 0 THEN 'D' {tests} WHEN reliability >= 0.35 AND {n} >= 25 THEN 'C' ELSE 'D' END"


def _executed_sql(source: str, by: str, name: str) -> str:
    """Needs direction, variant, mode, stop, place, label and filled in the source, attempts only."""
    return f"""{name}0 AS (SELECT {by}, direction, variant, any_value(mode) AS mode, any_value(stop) AS stop, any_value(place) AS place, count(*) AS total, {', '.join(f"count(*) FILTER (label = '{x}') AS {n}" for n, x in (('tp', 'TP_FIRST'), ('sl', 'SL_FIRST'), ('amb', 'AMBIGUOUS'), ('nt', 'NO_TOUCH')))}, count(*) FILTER (filled) AS filled FROM {source} GROUP BY {by}, direction, variant),
{name} AS MATERIALIZED (SELECT *, (tp * {TARGET}::DOUBLE - sl * stop) / total AS expectancy, CASE WHEN mode = 'MARKET' THEN 1.0 ELSE filled / total END::DOUBLE AS coverage, tp + sl AS resolved, coalesce(amb / nullif(CASE WHEN mode = 'MARKET' THEN tp + sl + amb + nt ELSE filled END, 0), 0)::DOUBLE AS ambiguity, total / (total + 100.0::DOUBLE) AS reliability FROM {name}0)"""


_SIDES = f"WITH RECURSIVE {q.bars('15 minutes')}, {q.base()}, {_entries_sql('b', TARGET)}, fl AS (SELECT symbol, time, {q.FLAGS} FROM b)"
_HZ = ", ".join(_labelled_sql("b", h, name=f"lb_{n}") for n, h in HORIZONS.items())
_SHOWN = ("total", "resolved", "coverage", "ambiguity", "expectancy", "confidence_grade", "recommended_entry_mode", "recommended_variant")


@query(f"""{_SIDES}, {_HZ}, al AS ({' UNION ALL '.join(f"SELECT '{n}' AS horizon, l.*, {_ATT} AS att FROM lb_{n} l JOIN fl USING (symbol, time)" for n in HORIZONS)}), tries AS (SELECT * FROM al WHERE att), {_executed_sql('tries', 'symbol, horizon', 'g')},
w AS (SELECT *, {_grade()} AS confidence_grade FROM g QUALIFY row_number() OVER (PARTITION BY symbol, horizon, direction ORDER BY expectancy DESC, place) = 1)
SELECT symbol, horizon, direction, total, resolved, round(coverage, 6) AS coverage, round(ambiguity, 6) AS ambiguity, round(expectancy, 6) AS expectancy, confidence_grade, CASE WHEN expectancy > 0 THEN mode ELSE 'NO_TRADE' END AS recommended_entry_mode, CASE WHEN expectancy > 0 THEN variant END AS recommended_variant FROM w""")
def horizon_decisions(spark, d):
    """For three horizons and both directions the entry of the best expectancy, at the close or by a limit."""
    b = _attempts(features.bar_flags(base(spark, d, "15 minutes")).select("symbol", "time", "row_idx", "high", "low", "close", "atr", *(f"{x}_{s}" for x in ("breakout", "false_breakout") for s in ("up", "down"))))
    b = written(b, "attempts")
    all_bars = base(spark, d, "15 minutes")
    parts = []
    for n, h in HORIZONS.items():
        with_h = ex.with_cases(all_bars, TARGET, h).select("symbol", "time", "cases")
        parts.append(b.select("symbol", "time", "direction").join(with_h, ["symbol", "time"]).withColumn("horizon", F.lit(n)))
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    out = ex.decided(ex.executed(rows, TARGET, ["symbol", "horizon"]), ["symbol", "horizon"])
    return rounded(out.select("symbol", "horizon", "direction", *_SHOWN))


# --- Profiles chosen on a first period and judged on later ones -----------------------------------------------------------

_KEYS = profile._KEYS
#: Level: its keys, least attempts and break-outs (before the share for training), least effect.
LEVELS = {
    "GENERAL": ((), 0, 0, 0.0),
    "HOUR": (("hour",), 60, 25, 0.02),
    "WEEKDAY": (("weekday",), 90, 35, 0.02),
    "MONTH": (("month",), 120, 45, 0.03),
    "HOUR_WEEKDAY": (("hour", "weekday"), 60, 25, 0.04),
    "STRUCTURE_VOLUME_VOLATILITY": (("structure", "vol_bucket", "atr_bucket"), 60, 25, 0.03),
}
LEAST_GROUP, LEAST_MONTHS, SHARE = 120, 6, 0.55
_RATES = ("confirmation_probability", "false_breakout_probability", "continuation_probability", "clean_continuation_probability")


def _thresholds() -> dict[str, tuple[int, int, float]]:
    return {n: (max(20, int(a * SHARE)), max(12, int(k * SHARE)), effect) for n, (_, a, k, effect) in LEVELS.items()}


def _grouped(b: DataFrame, horizon: int) -> DataFrame:
    """A row for each bar and group it belongs to (level and key as text), with the period that it falls in."""
    keys = F.array(*(F.struct(F.lit(n).alias("level"), F.concat_ws("|", *(c(k).cast("string") for k in ks)).alias("key")) for n, (ks, *_) in LEVELS.items()))
    rows = b.withColumn("_g", F.explode(keys)).select(*b.columns, "_g.*")
    # The place in a group by its own sort; in the general one by the row's number, as it holds all bars.
    group = Window.partitionBy("symbol", "level", "key")
    first = rows.groupBy("symbol", "level", "key").agg(F.count("*").alias("n_bars"), F.min("row_idx").alias("_first"))
    rows = rows.where("level <> 'GENERAL'").withColumn("k", F.row_number().over(group.orderBy("time")) - 1).unionByName(rows.where("level = 'GENERAL'").withColumn("k", c("row_idx")))
    rows = rows.join(first, ["symbol", "level", "key"]).withColumn("k", F.when(c("level") == "GENERAL", c("k") - c("_first")).otherwise(c("k"))).drop("_first")
    a, z = F.floor(c("n_bars") * TRAIN), F.floor(c("n_bars") * TEST)
    period = F.when(c("k") < a - horizon, "train").when((c("k") >= a) & (c("k") < F.greatest(a, z - horizon)), "validation").when(c("k") >= z, "test")
    return rows.withColumn("period", period)


def _chosen(rows: DataFrame) -> DataFrame:
    """Groups (symbol, direction, level, key) whose rates on the training period differ enough from the general ones, with that effect."""
    yes, no = c("confirmed"), c("false")
    ok = F.coalesce(c("mfe") >= TARGET, F.lit(False))
    n, k = F.count_if(yes | no), F.count_if(yes)
    g = rows.where("period = 'train'").groupBy("symbol", "direction", "level", "key").agg(n.alias("n"), k.alias("n_confirmed"), F.try_divide(k, n).alias(_RATES[0]), F.try_divide(F.count_if(no), n).alias(_RATES[1]), F.avg(F.when(yes, ok.cast("int"))).alias(_RATES[2]), F.avg(F.when(yes, (ok & F.coalesce(c("mae") < TARGET, F.lit(False))).cast("int"))).alias(_RATES[3]))
    whole = g.where("level = 'GENERAL'").select("symbol", "direction", *(c(x).alias(f"w_{x}") for x in _RATES))
    g = g.join(F.broadcast(whole), ["symbol", "direction"])  # two rows a symbol
    effect = F.coalesce(F.greatest(*(F.abs(c(x) - c(f"w_{x}")) for x in _RATES)), F.lit(0.0))
    fits = F.lit(False)
    for level, (attempts, confirmed, least) in _thresholds().items():
        fits = fits | ((c("level") == level) & ((c("n") >= attempts) & (c("n_confirmed") >= confirmed) & (c("effect") >= least) if level != "GENERAL" else F.lit(True)))
    months = rows.groupBy("symbol").agg(F.count_distinct(F.trunc("time", "MM")).alias("months"))
    g = g.withColumn("effect", effect).where(fits).join(F.broadcast(months), "symbol")  # a row a symbol
    return g.where((c("level") != "MONTH") | (c("months") >= LEAST_MONTHS)).select("symbol", "direction", "level", "key", "effect")


_PERIODS = ("train", "validation", "test")
_GROUP = ["symbol", "level", "key"]


def _bars(spark, d) -> DataFrame:
    """Bars of 15 minutes with buckets, attempts of both directions, and all entries over the base horizon."""
    h = HORIZONS["base"]
    b = features.structure(features.bar_flags(base(spark, d, "15 minutes")))
    usual = F.when(F.count("volume").over(e.past(20)) >= 5, F.avg("volume").over(e.past(20)))
    b = b.withColumns({"vol_ratio": e.over(c("volume"), usual), "range_atr": e.over(c("high") - c("low"), c("atr")), "hi": F.max("high").over(e.ahead(h)), "lo": F.min("low").over(e.ahead(h))})
    edges = {"vol_bucket": ("vol_ratio", (0.8, 1.0, 1.5), ("LOW", "NORMAL", "HIGH", "SPIKE")), "atr_bucket": ("range_atr", (0.6, 1.0, 1.5), ("LOW", "NORMAL", "HIGH", "EXTREME"))}
    b = ex.with_cases(b.withColumns({n: e.bins(c(x), *y) for n, (x, *y) in edges.items()}), TARGET, h)
    return b.where("atr IS NOT NULL").withColumns({"hour": F.hour("time"), "weekday": F.upper(F.date_format("time", "EEEE")), "month": F.month("time"), "structure": c("structure_state").cast("int")})


_RUN = "(PARTITION BY symbol ORDER BY time ROWS UNBOUNDED PRECEDING)"
_TH = ", ".join(f"('{n}', {a}, {k}, {x})" for n, (a, k, x) in _thresholds().items())
_KEY = {n: " || '|' || ".join(f"{k}::VARCHAR" for k in ks) or "''" for n, (ks, *_) in LEVELS.items()}
_VP = f"""WITH RECURSIVE {q.bars('15 minutes')}, {q.base()}, {_entries_sql('b', TARGET)}, {_labelled_sql('b', HORIZONS['base'])},
v0 AS (SELECT *, CASE WHEN row_idx > 6 AND lag(high, 3) OVER {q.W} >= max(high) OVER {q.past(7)} THEN lag(high, 3) OVER {q.W} END AS sh, CASE WHEN row_idx > 6 AND lag(low, 3) OVER {q.W} <= min(low) OVER {q.past(7)} THEN lag(low, 3) OVER {q.W} END AS sl0, volume / nullif(CASE WHEN count(volume) OVER {q.past(20)} >= 5 THEN avg(volume) OVER {q.past(20)} END, 0) AS vol_ratio, (high - low) / nullif(atr, 0) AS range_atr,
  max(high) OVER {q.ahead(HORIZONS['base'])} AS hi, min(low) OVER {q.ahead(HORIZONS['base'])} AS lo, {q.FLAGS} FROM b),
v1 AS (SELECT *, last_value(sh IGNORE NULLS) OVER {_RUN} AS lh, last_value(sl0 IGNORE NULLS) OVER {_RUN} AS ll FROM v0), v2 AS (SELECT *, lag(lh) OVER {q.W} AS rh, lag(ll) OVER {q.W} AS rl FROM v1),
v3 AS (SELECT *, coalesce(last_value(CASE WHEN close > rh AND pc <= rh THEN 1 WHEN close < rl AND pc >= rl THEN -1 END IGNORE NULLS) OVER {_RUN}, 0)::INT AS structure FROM v2),
pb AS MATERIALIZED (SELECT *, hour(time)::INT AS hour, upper(dayname(time)) AS weekday, month(time)::INT AS month, {profile._bins('vol_ratio', (0.8, 1.0, 1.5), ('LOW', 'NORMAL', 'HIGH', 'SPIKE'))} AS vol_bucket, {profile._bins('range_atr', (0.6, 1.0, 1.5), ('LOW', 'NORMAL', 'HIGH', 'EXTREME'))} AS atr_bucket FROM v3 WHERE atr IS NOT NULL),
gr0 AS ({' UNION ALL '.join(f"SELECT *, '{n}' AS level, {k} AS key FROM pb" for n, k in _KEY.items())}),
gr1 AS (SELECT *, row_number() OVER g - 1 AS k, count(*) OVER (PARTITION BY symbol, level, key) AS n_bars FROM gr0 WINDOW g AS (PARTITION BY symbol, level, key ORDER BY time)),
gr2 AS (SELECT *, floor(n_bars * {TRAIN}::DOUBLE) AS a, floor(n_bars * {TEST}::DOUBLE) AS z FROM gr1),
gr AS MATERIALIZED (SELECT *, CASE WHEN k < a - {HORIZONS['base']} THEN 'train' WHEN k >= a AND k < greatest(a, z - {HORIZONS['base']}) THEN 'validation' WHEN k >= z THEN 'test' END AS period FROM gr2),
dr AS (SELECT *, 'UP' AS direction, breakout_up = 1 AS yes, false_breakout_up = 1 AS no, (hi - close) / nullif(atr, 0) AS mfe, (close - lo) / nullif(atr, 0) AS mae FROM gr UNION ALL SELECT *, 'DOWN', breakout_down = 1, false_breakout_down = 1, (close - lo) / nullif(atr, 0), (hi - close) / nullif(atr, 0) FROM gr),
tr AS (SELECT symbol, direction, level, key, count(*) FILTER (yes OR no) AS n, count(*) FILTER (yes) AS m, count(*) FILTER (yes) / nullif(count(*) FILTER (yes OR no), 0) AS p0, count(*) FILTER (no) / nullif(count(*) FILTER (yes OR no), 0) AS p1, avg(coalesce(mfe >= {TARGET}, false)::INT) FILTER (yes) AS p2, avg((coalesce(mfe >= {TARGET}, false) AND coalesce(mae < {TARGET}, false))::INT) FILTER (yes) AS p3 FROM dr WHERE period = 'train' GROUP BY ALL),
th(level, least_n, least_m, least) AS (VALUES {_TH}), mo AS (SELECT symbol, count(DISTINCT date_trunc('month', time)) AS months FROM pb GROUP BY 1),
ch AS MATERIALIZED (SELECT t.symbol, t.direction, t.level, t.key, coalesce(greatest(abs(t.p0 - w.p0), abs(t.p1 - w.p1), abs(t.p2 - w.p2), abs(t.p3 - w.p3)), 0) AS effect FROM tr t JOIN tr w ON w.level = 'GENERAL' AND w.symbol = t.symbol AND w.direction = t.direction JOIN th ON th.level = t.level JOIN mo ON mo.symbol = t.symbol
  WHERE t.level = 'GENERAL' OR (t.n >= least_n AND m_ok(t.m, least_m) AND coalesce(greatest(abs(t.p0 - w.p0), abs(t.p1 - w.p1), abs(t.p2 - w.p2), abs(t.p3 - w.p3)), 0) >= least AND (t.level <> 'MONTH' OR months >= {LEAST_MONTHS})))""".replace("m_ok(t.m, least_m)", "t.m >= least_m")
_VX = f"""{_VP}, nb AS (SELECT symbol, level, key, any_value(n_bars) AS n_bars, {', '.join(f"count(*) FILTER (period = '{p}') AS {p}_bars" for p in _PERIODS)} FROM gr GROUP BY ALL),
tries AS (SELECT d.symbol, d.level, d.key, d.period, d.direction, l.variant, l.mode, l.stop, l.place, l.label, l.filled FROM dr d JOIN ch USING (symbol, direction, level, key) JOIN lb l ON l.symbol = d.symbol AND l.time = d.time AND l.direction = d.direction WHERE (d.yes OR d.no) AND d.period IS NOT NULL),
{_executed_sql('tries', 'symbol, level, key, period', 'g')},
bt AS MATERIALIZED (SELECT *, {_grade()} AS grade FROM g QUALIFY row_number() OVER (PARTITION BY symbol, level, key, period, direction ORDER BY expectancy DESC, place) = 1),
fz AS (SELECT symbol, level, key, direction, variant FROM bt WHERE period = 'train' AND expectancy > 0),
pv AS (SELECT ch.*, nb.n_bars, {', '.join(f'nb.{p}_bars' for p in _PERIODS)}, fz.variant AS frozen_variant, {', '.join(f"{p}g.expectancy AS {p}_expectancy, {p}b.expectancy AS {p}_best_expectancy, CASE WHEN {p}b.expectancy > 0 THEN {p}b.mode ELSE 'NO_TRADE' END AS {p}_best_mode, coalesce({p}b.grade, 'D') AS {p}_grade" for p in _PERIODS)} FROM ch JOIN nb USING (symbol, level, key) LEFT JOIN fz USING (symbol, level, key, direction)
{' '.join(f"LEFT JOIN g {p}g ON {p}g.symbol = ch.symbol AND {p}g.level = ch.level AND {p}g.key = ch.key AND {p}g.direction = ch.direction AND {p}g.period = '{p}' AND {p}g.variant = fz.variant LEFT JOIN bt {p}b ON {p}b.symbol = ch.symbol AND {p}b.level = ch.level AND {p}b.key = ch.key AND {p}b.direction = ch.direction AND {p}b.period = '{p}'" for p in _PERIODS)}),
vx AS (SELECT *, list_filter([{', '.join(f'{p}_expectancy' for p in _PERIODS)}], lambda v: v IS NOT NULL) AS vs FROM pv WHERE n_bars >= {LEAST_GROUP})"""
_NUM = [f"{p}_{x}" for p in _PERIODS for x in ("expectancy", "best_expectancy")]


@query(f"""{_VX} SELECT symbol, direction, level, key, round(effect, 6) AS effect, n_bars, {', '.join(f'{p}_bars' for p in _PERIODS)}, frozen_variant, {', '.join(f'round({n}, 6) AS {n}' for n in _NUM)}, {', '.join(f'{p}_best_mode, {p}_grade' for p in _PERIODS)},
round(len(list_filter(vs, lambda v: v > 0)) / nullif(len(vs), 0), 6) AS positive_period_ratio, round(CASE WHEN len(vs) >= 2 THEN 1 / (1 + list_stddev_pop(vs)) END, 6) AS expectancy_stability, round(test_expectancy / nullif(train_expectancy, 0), 6) AS degradation_ratio, coalesce(validation_expectancy > 0 AND test_expectancy > 0, false) AS oos_pass FROM vx""")
def profile_validation(spark, d):
    """Groups chosen on the first 60 % of their bars less one horizon; the entry that was best there is held against the next 20 and the last 20 %."""
    rows = written(_grouped(_bars(spark, d).select("symbol", "time", "row_idx", *_KEYS, "atr", "close", "hi", "lo", "cases", *(f"{x}_{s}" for x in ("breakout", "false_breakout") for s in ("up", "down"))), HORIZONS["base"]), "profile-groups")
    sides = []
    for name, s, good, bad in (("UP", "up", c("hi") - c("close"), c("close") - c("lo")), ("DOWN", "down", c("close") - c("lo"), c("hi") - c("close"))):
        sides.append(F.struct(F.lit(name).alias("direction"), (c(f"breakout_{s}") == 1).alias("confirmed"), (c(f"false_breakout_{s}") == 1).alias("false"), F.try_divide(good, c("atr")).alias("mfe"), F.try_divide(bad, c("atr")).alias("mae")))
    directed = rows.withColumn("_d", F.explode(F.array(*sides))).select("symbol", "time", "level", "key", "period", "cases", "_d.*")
    chosen = written(_chosen(directed), "profile-chosen")
    attempts = directed.where((c("confirmed") | c("false")) & c("period").isNotNull()).join(chosen.select("symbol", "direction", "level", "key"), ["symbol", "direction", "level", "key"])
    by = [*_GROUP, "period"]
    g = written(ex.executed(attempts, TARGET, by), "profile-executions")
    best = ex.decided(g, by)
    names = [*_GROUP, "direction"]
    frozen = best.where("period = 'train'").select(*names, c("recommended_variant").alias("frozen_variant"))
    held = g.join(frozen, names).where("variant = frozen_variant")
    in_period = lambda p, x: F.max(F.when(c("period") == p, c(x)))
    fixed = held.groupBy(*names).agg(*(in_period(p, "expectancy").alias(f"{p}_expectancy") for p in _PERIODS))
    own = best.groupBy(*names).agg(*(x for p in _PERIODS for x in (in_period(p, "expectancy").alias(f"{p}_best_expectancy"), in_period(p, "recommended_entry_mode").alias(f"{p}_best_mode"), in_period(p, "confidence_grade").alias(f"{p}_grade"))))
    sizes = rows.groupBy(*_GROUP).agg(F.max("n_bars").alias("n_bars"), *(F.count_if(c("period") == p).alias(f"{p}_bars") for p in _PERIODS)).where(c("n_bars") >= LEAST_GROUP)
    j = chosen.join(sizes, _GROUP).join(frozen, names, "left").join(fixed, names, "left").join(own, names, "left")
    j = j.fillna("NO_TRADE", [f"{p}_best_mode" for p in _PERIODS]).fillna("D", [f"{p}_grade" for p in _PERIODS])
    vs = F.array_compact(F.array(*(c(f"{p}_expectancy") for p in _PERIODS)))
    n, mean = F.size("_vs"), F.try_divide(F.aggregate("_vs", F.lit(0.0), lambda a, x: a + x), F.size("_vs"))
    spread = F.sqrt(F.aggregate("_vs", F.lit(0.0), lambda a, x: a + (x - c("_mean")) * (x - c("_mean"))) / n)
    j = j.withColumn("_vs", vs).withColumn("_mean", mean)
    out = j.withColumns({"positive_period_ratio": F.try_divide(F.size(F.filter("_vs", lambda v: v > 0)), n), "expectancy_stability": F.when(n >= 2, 1 / (1 + spread)), "degradation_ratio": F.try_divide(c("test_expectancy"), c("train_expectancy")), "oos_pass": F.coalesce((c("validation_expectancy") > 0) & (c("test_expectancy") > 0), F.lit(False))})
    return rounded(out.drop("_vs", "_mean"))


# --- Regimes --------------------------------------------------------------------------------------------------------------

_FLAGS = {"breakout_up": "breakout_up", "breakout_down": "breakout_down", "false_breakout_up": "false_breakout_up", "false_breakout_down": "false_breakout_down"}
#: Level: least bars and effect.
REGIMES = {"GENERAL": (0, 0.0), "HOUR": (150, 0.025), "WEEKDAY": (300, 0.02), "MONTH": (500, 0.025), "HOUR_WEEKDAY": (150, 0.04), "STRUCTURE_VOLUME_VOLATILITY": (150, 0.03)}
_RG = ", ".join(f"('{n}', {k}, {x})" for n, (k, x) in REGIMES.items())


@query(f"""{_VP}, rg0 AS (SELECT symbol, level, key, count(*) AS sample_size, {', '.join(f'avg({x}) AS {n}' for n, x in _FLAGS.items())}, avg((breakout_up + breakout_down + false_breakout_up + false_breakout_down = 0)::INT) AS no_event, median(vol_ratio) AS median_volume_ratio, median(range_atr) AS median_range_atr FROM gr GROUP BY ALL),
rt(level, least_n, least) AS (VALUES {_RG}), rg AS (SELECT r.*, greatest({', '.join(f'abs(r.{n} - w.{n})' for n in _FLAGS)}) AS effect, least_n, least, months FROM rg0 r JOIN rg0 w ON w.level = 'GENERAL' AND w.symbol = r.symbol JOIN rt ON rt.level = r.level JOIN mo ON mo.symbol = r.symbol)
SELECT symbol, level, key, sample_size, {', '.join(f'round({n}, 6) AS {n}' for n in (*_FLAGS, 'no_event', 'median_volume_ratio', 'median_range_atr', 'effect'))} FROM rg WHERE level = 'GENERAL' OR (sample_size >= least_n AND effect >= least AND (level <> 'MONTH' OR months >= {LEAST_MONTHS}))""")
def profile_regimes(spark, d):
    """How often each kind of bar comes in groups that differ enough from all bars."""
    b = _bars(spark, d)
    keys = F.array(*(F.struct(F.lit(n).alias("level"), F.concat_ws("|", *(c(k).cast("string") for k in ks)).alias("key")) for n, (ks, *_) in LEVELS.items()))
    rows = b.withColumn("_g", F.explode(keys)).select("symbol", "time", "_g.*", *_FLAGS, "vol_ratio", "range_atr")
    none = sum((c(n) for n in _FLAGS), F.lit(0)) == 0
    half = lambda x: F.percentile(x, F.lit(0.5)).alias
    g = rows.groupBy(*_GROUP).agg(F.count("*").alias("sample_size"), *(F.avg(n).alias(n) for n in _FLAGS), F.avg(none.cast("int")).alias("no_event"), half("vol_ratio")("median_volume_ratio"), half("range_atr")("median_range_atr"))
    whole = g.where("level = 'GENERAL'").select("symbol", *(c(n).alias(f"w_{n}") for n in _FLAGS))
    months = b.groupBy("symbol").agg(F.count_distinct(F.trunc("time", "MM")).alias("months"))
    j = g.join(F.broadcast(whole), "symbol").join(F.broadcast(months), "symbol").withColumn("effect", F.greatest(*(F.abs(c(n) - c(f"w_{n}")) for n in _FLAGS)))  # a row a symbol
    fits = F.lit(False)
    for level, (least_n, least) in REGIMES.items():
        fits = fits | ((c("level") == level) & (c("sample_size") >= least_n) & (c("effect") >= least))
    j = j.where(fits & ((c("level") != "MONTH") | (c("months") >= LEAST_MONTHS)))
    return rounded(j.select(*_GROUP, "sample_size", *_FLAGS, "no_event", "median_volume_ratio", "median_range_atr", "effect"))
