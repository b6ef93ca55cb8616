"""Historical profiles by grouping sets, execution by first touch, and the look-up of the present bar in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebar.functions import exprs as e
from tidebar.operators import features, touch
from tidebar.plans import sqlparts as q
from tidebar.plans.bars_and_features import base, rounded

c = F.col
QUERIES, SQL = {}, {}
#: Stops of the execution view in atr; target and horizon of the profile (the horizon is our own choice for hourly bars).
STOPS, TARGET, BARS, MIN_SAMPLE = (0.4, 0.5, 0.6, 0.75, 1.0), 0.5, 3, 30


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _bars(spark, d) -> DataFrame:
    b = features.structure(features.bar_flags(base(spark, d)))
    usual = F.when(F.count("volume").over(e.past(20)) >= 5, F.avg("volume").over(e.past(20)))
    b = b.withColumns({"vol_ratio": e.over(c("volume"), usual), "range_atr": e.over(c("high") - c("low"), c("atr")), "hi": F.max("high").over(e.ahead(BARS)), "lo": F.min("low").over(e.ahead(BARS))})
    edges = {"vol_bucket": ("vol_ratio", (0.8, 1.0, 1.5), ("LOW", "NORMAL", "HIGH", "SPIKE")), "atr_bucket": ("range_atr", (0.6, 1.0, 1.5), ("LOW", "NORMAL", "HIGH", "EXTREME"))}
    b = b.withColumns({n: e.bins(c(x), *y) for n, (x, *y) in edges.items()})
    return b.where("atr IS NOT NULL").withColumns({"hour": F.hour("time"), "weekday": F.upper(F.date_format("time", "EEEE")), "month": F.month("time"), "structure": c("structure_state").cast("int")})


def _directed(b: DataFrame) -> DataFrame:
    """A row per bar and direction, with its attempt and what followed."""
    sides = []
    for name, ok, fail, good, bad in (("UP", "breakout_up", "false_breakout_up", c("hi") - c("close"), c("close") - c("lo")), ("DOWN", "breakout_down", "false_breakout_down", c("close") - c("lo"), c("hi") - c("close"))):
        sides.append(F.struct(F.lit(name).alias("direction"), (c(ok) == 1).alias("confirmed"), (c(fail) == 1).alias("false"), e.over(good, c("atr")).alias("mfe"), e.over(bad, c("atr")).alias("mae")))
    keep = ["symbol", "time", "row_idx", "hour", "weekday", "month", "structure", "vol_bucket", "atr_bucket", "vol_ratio", "range_atr"]
    return b.select(*keep, F.explode(F.array(*sides)).alias("x")).select(*keep, "x.*")


_KEYS = ("hour", "weekday", "month", "structure", "vol_bucket", "atr_bucket")
_SETS = ((), ("hour",), ("weekday",), ("month",), ("hour", "weekday"), ("structure", "vol_bucket", "atr_bucket"))
_LEVEL = {0b111111: "GENERAL", 0b011111: "HOUR", 0b101111: "WEEKDAY", 0b110111: "MONTH", 0b001111: "HOUR_WEEKDAY", 0b111000: "STRUCTURE_VOLUME_VOLATILITY"}
_STATS = ("n", "confirmed", "false", "reliability", "confirmation_probability", "false_breakout_probability", "continuation_probability", "clean_continuation_probability", "median_mfe_atr", "median_mae_atr", "mae_p75", "mae_p90", "mae_gt_0p5", "distinct_months")


def _profile(spark, d) -> DataFrame:
    x = _directed(_bars(spark, d))
    yes = c("confirmed")
    ok = F.coalesce(c("mfe") >= TARGET, F.lit(False))
    clean = ok & (c("mae") < TARGET)
    bits = F.lit(0)
    for k in _KEYS:
        bits = bits * 2 + F.grouping(k)
    sets = [[c("symbol"), c("direction"), *(c(k) for k in s)] for s in _SETS]
    g = x.groupingSets(sets, "symbol", "direction", *_KEYS).agg(
        bits.alias("bits"), F.count_if(yes | c("false")).alias("n"), F.count_if(yes).alias("n_confirmed"), F.count_if("false").alias("n_false"),
        F.avg(F.when(yes, ok.cast("int"))).alias("continuation_probability"), F.avg(F.when(yes, clean.cast("int"))).alias("clean_continuation_probability"),
        F.percentile(F.when(yes, c("mfe")), F.lit(0.5)).alias("median_mfe_atr"), F.percentile(F.when(yes, c("mae")), F.array(F.lit(0.5), F.lit(0.75), F.lit(0.9))).alias("maes"),
        F.avg(F.when(yes & c("mae").isNotNull(), (c("mae") > 0.5).cast("int"))).alias("mae_gt_0p5"), F.count_distinct(F.trunc("time", "MM")).alias("distinct_months"),
    )
    level = F.when(F.lit(False), "")
    for k, name in _LEVEL.items():
        level = level.when(c("bits") == k, name)
    return g.where("n > 0").select(
        "symbol", "direction", level.alias("level"), *_KEYS, "n", c("n_confirmed").alias("confirmed"), c("n_false").alias("false"), (c("n") / (c("n") + 100)).alias("reliability"), (c("n_confirmed") / c("n")).alias("confirmation_probability"), (c("n_false") / c("n")).alias("false_breakout_probability"),
        "continuation_probability", "clean_continuation_probability", "median_mfe_atr", c("maes")[0].alias("median_mae_atr"), c("maes")[1].alias("mae_p75"), c("maes")[2].alias("mae_p90"), "mae_gt_0p5", "distinct_months",
    )


_RUN = "(PARTITION BY symbol ORDER BY time ROWS UNBOUNDED PRECEDING)"


def _bins(x: str, edges, names) -> str:
    return f"CASE WHEN {x} IS NULL THEN 'UNKNOWN' " + " ".join(f"WHEN {x} <= {k} THEN '{n}'" for k, n in zip(edges, names, strict=False)) + f" ELSE '{names[-1]}' END"


_PB = f"""WITH RECURSIVE {q.bars()}, {q.base()}, v0 AS (SELECT *, CASE WHEN row_idx > 6 AND lag(high, 3) OVER {q.W} >= max(high) OVER {q.past(7)} THEN lag(high, 3) OVER {q.W} END AS sh, CASE WHEN row_idx > 6 AND lag(low, 3) OVER {q.W} <= min(low) OVER {q.past(7)} THEN lag(low, 3) OVER {q.W} END AS sl, volume / nullif(CASE WHEN count(volume) OVER {q.past(20)} >= 5 THEN avg(volume) OVER {q.past(20)} END, 0) AS vol_ratio, (high - low) / nullif(atr, 0) AS range_atr, max(high) OVER {q.ahead(BARS)} AS hi, min(low) OVER {q.ahead(BARS)} AS lo, {q.FLAGS} FROM b),
v1 AS (SELECT *, last_value(sh IGNORE NULLS) OVER {_RUN} AS lh, last_value(sl IGNORE NULLS) OVER {_RUN} AS ll FROM v0), v2 AS (SELECT *, lag(lh) OVER {q.W} AS rh, lag(ll) OVER {q.W} AS rl FROM v1),
v3 AS (SELECT *, coalesce(last_value(CASE WHEN close > rh AND pc <= rh THEN 1 WHEN close < rl AND pc >= rl THEN -1 END IGNORE NULLS) OVER {_RUN}, 0)::INT AS structure FROM v2),
pb AS MATERIALIZED (SELECT *, hour(time)::INT AS hour, upper(dayname(time)) AS weekday, month(time)::INT AS month, {_bins('vol_ratio', (0.8, 1.0, 1.5), ('LOW', 'NORMAL', 'HIGH', 'SPIKE'))} AS vol_bucket, {_bins('range_atr', (0.6, 1.0, 1.5), ('LOW', 'NORMAL', 'HIGH', 'EXTREME'))} AS atr_bucket FROM v3 WHERE atr IS NOT NULL),
dr AS (SELECT *, 'UP' AS direction, breakout_up = 1 AS ok, false_breakout_up = 1 AS fail, (hi - close) / nullif(atr, 0) AS mfe, (close - lo) / nullif(atr, 0) AS mae FROM pb UNION ALL SELECT *, 'DOWN', breakout_down = 1, false_breakout_down = 1, (close - lo) / nullif(atr, 0), (hi - close) / nullif(atr, 0) FROM pb),
pr AS (SELECT symbol, direction, {', '.join(_KEYS)}, CASE grouping({', '.join(_KEYS)}) {' '.join(f"WHEN {k} THEN '{n}'" for k, n in _LEVEL.items())} END AS level, count(*) FILTER (ok OR fail) AS n, count(*) FILTER (ok) AS confirmed, count(*) FILTER (fail) AS "false", avg(coalesce(mfe >= 0.5, false)::INT) FILTER (ok) AS continuation_probability, avg((coalesce(mfe >= 0.5, false) AND mae < 0.5)::INT) FILTER (ok) AS clean_continuation_probability, median(mfe) FILTER (ok) AS median_mfe_atr, median(mae) FILTER (ok) AS median_mae_atr, quantile_cont(mae, 0.75) FILTER (ok) AS mae_p75, quantile_cont(mae, 0.9) FILTER (ok) AS mae_p90, avg((mae > 0.5)::INT) FILTER (ok AND mae IS NOT NULL) AS mae_gt_0p5, count(DISTINCT date_trunc('month', time)) AS distinct_months FROM dr GROUP BY GROUPING SETS ({', '.join(f"(symbol, direction{''.join(', ' + k for k in s)})" for s in _SETS)})),
pf AS MATERIALIZED (SELECT *, n / (n + 100.0::DOUBLE) AS reliability, confirmed / n AS confirmation_probability, "false" / n AS false_breakout_probability FROM pr WHERE n > 0)"""


@query(f"{_PB} SELECT symbol, direction, level, {', '.join(_KEYS)}, {', '.join('"false"' if n == 'false' else n if n in ('n', 'confirmed', 'distinct_months') else f'round({n}, 5) AS {n}' for n in _STATS)} FROM pf")
def profile(spark, d):
    return rounded(_profile(spark, d), 5)


_TOUCH = [(n, s) for n in ("up", "down") for s in STOPS]


@query(f"WITH RECURSIVE {q.bars()}, {q.base()}, " + ", ".join(f"""t_{n}{k} AS (SELECT symbol, time, arg_min(CASE WHEN won AND lost THEN 'AMBIGUOUS' WHEN won THEN 'TP_FIRST' ELSE 'SL_FIRST' END, k) AS label, min(k) AS place FROM (SELECT a.symbol, a.time, x.row_idx - a.row_idx AS k, {'x.high >= a.close + 0.5 * a.atr' if n == 'up' else 'x.low <= a.close - 0.5 * a.atr'} AS won, {f'x.low <= a.close - {s} * a.atr' if n == 'up' else f'x.high >= a.close + {s} * a.atr'} AS lost FROM b a JOIN b x ON x.symbol = a.symbol AND x.row_idx BETWEEN a.row_idx + 1 AND a.row_idx + 6) WHERE won OR lost GROUP BY ALL),
u_{n}{k} AS (SELECT a.symbol, a.time, greatest(0, max({'(a.close - x.low)' if n == 'up' else '(x.high - a.close)'} / a.atr)) AS adverse, greatest(0, max({'(x.high - a.close)' if n == 'up' else '(a.close - x.low)'} / a.atr)) AS favorable FROM b a JOIN t_{n}{k} t ON t.symbol = a.symbol AND t.time = a.time JOIN b x ON x.symbol = a.symbol AND x.row_idx BETWEEN a.row_idx + 1 AND a.row_idx + t.place GROUP BY ALL)""" for k, s in enumerate(STOPS) for n in ("up", "down")) + " SELECT b.symbol, b.time, " + ", ".join(f"CASE WHEN atr > 0 THEN coalesce(t_{n}{k}.label, 'NO_TOUCH') ELSE 'INVALID' END AS \"first_touch_{n}_{s:g}\", CASE WHEN atr > 0 THEN t_{n}{k}.place END AS \"bars_to_result_{n}_{s:g}\", CASE WHEN atr > 0 THEN round(u_{n}{k}.adverse, 5) END AS \"adverse_before_target_{n}_{s:g}\", CASE WHEN atr > 0 THEN round(u_{n}{k}.favorable, 5) END AS \"favorable_before_stop_{n}_{s:g}\"" for k, s in enumerate(STOPS) for n in ("up", "down")) + " FROM b " + " ".join(f"LEFT JOIN {p}_{n}{k} ON {p}_{n}{k}.symbol = b.symbol AND {p}_{n}{k}.time = b.time" for k in range(len(STOPS)) for n in ("up", "down") for p in ("t", "u")))
def profile_first_touch(spark, d):
    b = base(spark, d).withColumn("_next", touch.coming(6))
    for n, s in _TOUCH:
        b = touch.with_extremes(b, n, TARGET, s)
    return b.select("symbol", "time", *(c(f"`{x}_{n}_{s:g}`") for n, s in _TOUCH for x in ("first_touch", "bars_to_result", "adverse_before_target", "favorable_before_stop")))


_EX = " UNION ALL ".join(f"SELECT symbol, 'UP' AS direction, {s} AS stop, label, breakout_up + false_breakout_up > 0 AS attempt FROM e{k}" for k, s in enumerate(STOPS))


@query(f"WITH RECURSIVE {q.bars()}, {q.base()}, x AS (SELECT *, {q.FLAGS} FROM b), " + ", ".join(f"t{k} AS ({q.touch('0.5 * atr', f'{s} * atr', 6, '1')}), e{k} AS (SELECT x.*, CASE WHEN atr > 0 THEN coalesce(t{k}.label, 'NO_TOUCH') ELSE 'INVALID' END AS label FROM x LEFT JOIN t{k} ON t{k}.symbol = x.symbol AND t{k}.time = x.time)" for k, s in enumerate(STOPS)) + f""", a AS ({_EX}), g AS (SELECT symbol, stop, count(*) AS total, count(*) FILTER (label = 'TP_FIRST') AS tp, count(*) FILTER (label = 'SL_FIRST') AS sl, count(*) FILTER (label = 'AMBIGUOUS') AS amb, count(*) FILTER (label = 'NO_TOUCH') AS nt FROM a WHERE attempt GROUP BY ALL),
h AS (SELECT *, (tp * 0.5 - sl * stop) / total AS expectancy, tp + sl AS resolved, amb / nullif(tp + sl + amb + nt, 0) AS ambiguity, total / (total + 100.0::DOUBLE) AS reliability FROM g), w AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY expectancy DESC, stop) = 1)
SELECT symbol, stop::DOUBLE AS best_stop, total AS sample_size, resolved, round(expectancy, 6) AS expectancy, round(ambiguity, 6) AS ambiguity, CASE WHEN expectancy <= 0 THEN 'NO_TRADE' ELSE 'CLOSE_ENTRY' END AS recommended_entry_mode, CASE WHEN expectancy <= 0 THEN 'D' WHEN reliability >= 0.7 AND resolved >= 100 AND ambiguity <= 0.1 AND expectancy >= 0.08 THEN 'A' WHEN reliability >= 0.55 AND resolved >= 60 AND ambiguity <= 0.15 AND expectancy >= 0.04 THEN 'B' WHEN reliability >= 0.35 AND resolved >= 25 THEN 'C' ELSE 'D' END AS confidence_grade FROM w""")
def best_decision(spark, d):
    """Of the stops the one of the best expectancy over all attempts upwards, with its grade: the row of a maximum, not the maximum."""
    b = features.bar_flags(base(spark, d)).withColumn("_next", touch.coming(6))
    for s in STOPS:
        label, _ = touch.first_touch(c("_next"), c("close"), TARGET * c("atr"), s * c("atr"), F.lit(1))
        b = b.withColumn(f"l_{int(100 * s)}", F.when(c("atr") > 0, label).otherwise("INVALID"))
    a = b.where("breakout_up + false_breakout_up > 0").select("symbol", F.explode(F.array(*(F.struct(F.lit(s).alias("stop"), c(f"l_{int(100 * s)}").alias("label")) for s in STOPS))).alias("x")).select("symbol", "x.*")
    count = lambda name: F.count_if(c("label") == name)
    g = a.groupBy("symbol", "stop").agg(F.count("*").alias("total"), count("TP_FIRST").alias("tp"), count("SL_FIRST").alias("sl"), count("AMBIGUOUS").alias("amb"), count("NO_TOUCH").alias("nt"))
    g = g.withColumns({"expectancy": (c("tp") * TARGET - c("sl") * c("stop")) / c("total"), "resolved": c("tp") + c("sl"), "ambiguity": e.over(c("amb"), c("tp") + c("sl") + c("amb") + c("nt")), "reliability": c("total") / (c("total") + 100)})
    best = g.groupBy("symbol").agg(F.max_by(F.struct("stop", "total", "resolved", "expectancy", "ambiguity", "reliability"), F.struct("expectancy", -c("stop"))).alias("x")).select("symbol", "x.*")
    exp, rel, amb, n = c("expectancy"), c("reliability"), c("ambiguity"), c("resolved")
    grade = F.when(exp <= 0, "D").when((rel >= 0.7) & (n >= 100) & (amb <= 0.1) & (exp >= 0.08), "A").when((rel >= 0.55) & (n >= 60) & (amb <= 0.15) & (exp >= 0.04), "B").when((rel >= 0.35) & (n >= 25), "C").otherwise("D")
    return rounded(best.select("symbol", c("stop").alias("best_stop"), c("total").alias("sample_size"), "resolved", "expectancy", "ambiguity", F.when(exp <= 0, "NO_TRADE").otherwise("CLOSE_ENTRY").alias("recommended_entry_mode"), grade.alias("confidence_grade")))


#: From the most specific to the general.
_ORDER = ("HOUR_WEEKDAY", "STRUCTURE_VOLUME_VOLATILITY", "HOUR", "WEEKDAY", "MONTH", "GENERAL")


def score(vol: Column, atr: Column) -> Column:
    """0 to 100 from a profile's rates, drawn to 50 where few attempts stand behind them; rounded half to even."""
    zero = F.lit(0.0)
    mfe, mae = (F.coalesce(c(n), zero) for n in ("median_mfe_atr", "median_mae_atr"))
    value = 35 * F.coalesce("continuation_probability", zero) + 20 * F.coalesce("clean_continuation_probability", zero) + 15 * c("confirmation_probability") + 10 * F.greatest(zero, 1 - c("false_breakout_probability")) + 7.5 * F.least(F.greatest(mfe, zero), F.lit(2.0)) + 7.5 * F.greatest(zero, 1 - F.least(mae, F.lit(1.0)))
    value = value + F.when(vol == "SPIKE", 5).when(vol == "LOW", -5).otherwise(0) - F.when(atr == "EXTREME", 3).otherwise(0)
    return F.bround(F.greatest(zero, F.least(F.lit(100.0), 50 + (value - 50) * c("reliability"))), 0).cast("int")


_MATCH = {"HOUR_WEEKDAY": ("hour", "weekday"), "STRUCTURE_VOLUME_VOLATILITY": ("structure", "vol_bucket", "atr_bucket"), "HOUR": ("hour",), "WEEKDAY": ("weekday",), "MONTH": ("month",), "GENERAL": ()}


@query(f"""{_PB}, nw AS (SELECT symbol, time, hour, weekday, month, structure, CASE WHEN breakout_up + false_breakout_up > 0 THEN 'UP' WHEN breakout_down + false_breakout_down > 0 THEN 'DOWN' WHEN close > open THEN 'UP' WHEN close < open THEN 'DOWN' END AS direction, CASE WHEN vol_ratio IS NULL THEN 'UNKNOWN' WHEN vol_ratio < 0.8 THEN 'LOW' WHEN vol_ratio < 1 THEN 'NORMAL' WHEN vol_ratio < 1.5 THEN 'HIGH' ELSE 'SPIKE' END AS vol_bucket, CASE WHEN range_atr IS NULL THEN 'UNKNOWN' WHEN range_atr < 0.6 THEN 'LOW' WHEN range_atr < 1 THEN 'NORMAL' WHEN range_atr < 1.5 THEN 'HIGH' ELSE 'EXTREME' END AS atr_bucket FROM pb),
lk AS (SELECT nw.symbol, nw.time, nw.direction, nw.vol_bucket AS nv, nw.atr_bucket AS na, pf.* EXCLUDE (symbol, direction, {', '.join(_KEYS)}), list_position({list(_ORDER)!r}, level) AS o FROM nw JOIN pf ON nw.symbol = pf.symbol AND nw.direction = pf.direction AND n >= {MIN_SAMPLE} AND ({' OR '.join(f"(level = '{lv}'" + ''.join(f' AND nw.{k} = pf.{k}' for k in ks) + ')' for lv, ks in _MATCH.items())}) QUALIFY row_number() OVER (PARTITION BY nw.symbol, nw.time ORDER BY o) = 1),
sc AS (SELECT *, 35 * coalesce(continuation_probability, 0) + 20 * coalesce(clean_continuation_probability, 0) + 15 * confirmation_probability + 10 * greatest(0, 1 - false_breakout_probability) + 7.5 * least(greatest(coalesce(median_mfe_atr, 0), 0), 2) + 7.5 * greatest(0, 1 - least(coalesce(median_mae_atr, 0), 1)) + CASE nv WHEN 'SPIKE' THEN 5 WHEN 'LOW' THEN -5 ELSE 0 END - CASE na WHEN 'EXTREME' THEN 3 ELSE 0 END AS v FROM lk)
SELECT symbol, time, direction, level, n, round_even(greatest(0, least(100, 50 + (v - 50) * reliability)), 0)::INT AS score FROM sc""")
def profile_lookup(spark, d):
    """For each bar the most specific profile with enough attempts, and its score. Look-up buckets close on the left, the profile's on the right."""
    b = _bars(spark, d)
    way = F.when(F.greatest("breakout_up", "false_breakout_up") == 1, "UP").when(F.greatest("breakout_down", "false_breakout_down") == 1, "DOWN").when(c("close") > c("open"), "UP").when(c("close") < c("open"), "DOWN")
    edges = {"vol_bucket": ("vol_ratio", (0.8, 1.0, 1.5), ("LOW", "NORMAL", "HIGH", "SPIKE")), "atr_bucket": ("range_atr", (0.6, 1.0, 1.5), ("LOW", "NORMAL", "HIGH", "EXTREME"))}
    now = b.withColumns({"direction": way} | {n: e.bins(c(x), *y, right=False) for n, (x, *y) in edges.items()}).where("direction IS NOT NULL").select("symbol", "time", "direction", *_KEYS)
    # One key a level: the present bar looks up six of them by an equi-join.
    text = lambda k: c(k).cast("string")
    keys = {lv: F.concat_ws("|", F.lit(lv), "direction", *(text(k) for k in ks)) for lv, ks in _MATCH.items()}
    wanted = now.select("symbol", "time", "direction", c("vol_bucket").alias("now_vol"), c("atr_bucket").alias("now_atr"), F.posexplode(F.array(*(keys[lv] for lv in _ORDER))).alias("o", "key"))
    own = F.when(F.lit(False), "")
    for lv in _ORDER:
        own = own.when(c("level") == lv, keys[lv])
    known = _profile(spark, d).where(c("n") >= MIN_SAMPLE).withColumn("key", own).drop("direction", *_KEYS)
    met = wanted.join(known, ["symbol", "key"])
    first = Window.partitionBy("symbol", "time").orderBy("o")
    met = met.withColumn("_k", F.row_number().over(first)).where("_k = 1")
    return met.select("symbol", "time", "direction", "level", "n", score(c("now_vol"), c("now_atr")).alias("score"))
