"""Queries over laws and their registry, event summaries, tops and tails, sets, pairs, votes, identifiers and calendar fields."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebar.functions import conditions
from tidebar.functions import exprs as e
from tidebar.operators import features, levels
from tidebar.plans import research, widebase
from tidebar.plans import sqlparts as q
from tidebar.plans.bars_and_features import _IND, base, rounded
from tidebar.plans.blocks import _Z
from tidebar.sources import bars as src

c = F.col
QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Laws of the test: every form of condition. (The registry's own are read from its JSON.)
LAWS = {
    "LAW_A": {"mtf_alignment_bucket_in": ["MIXED", "STRONG", "FULL"], "mtf_bias": "UP", "breakout_up": True},
    "LAW_B": {"mtf_alignment_bucket_in": ["MIXED", "STRONG", "FULL"], "mtf_bias": "DOWN", "breakout_down": True},
    "LAW_C": {"event_name": "FALSE_BREAK", "range_atr_between": [0.5, 1.5], "level_zone_in": ["AT_RESISTANCE", "AT_SUPPORT"]},
    "LAW_D": {"breakout_up": False, "breakout_down": False, "energy_score_between": [60, 100]},
}
_LAW_SQL = {
    "LAW_A": "mtf_alignment_bucket IN ('MIXED', 'STRONG', 'FULL') AND mtf_bias = 'UP' AND breakout_up = 1",
    "LAW_B": "mtf_alignment_bucket IN ('MIXED', 'STRONG', 'FULL') AND mtf_bias = 'DOWN' AND breakout_down = 1",
    "LAW_C": "event_name = 'FALSE_BREAK' AND range_atr BETWEEN 0.5 AND 1.5 AND level_zone IN ('AT_RESISTANCE', 'AT_SUPPORT')",
    "LAW_D": "breakout_up = 0 AND breakout_down = 0 AND energy_score BETWEEN 60 AND 100",
}


@query(f"{widebase._WIDE} SELECT symbol, law_id, count(*) AS matches, min(time) AS first_match, max(time) AS last_match FROM (" + " UNION ALL ".join(f"SELECT symbol, '{n}' AS law_id, time FROM wb WHERE {x}" for n, x in _LAW_SQL.items()) + ") GROUP BY ALL")
def law_conditions(spark, d):
    """Each bar against all laws in one pass: the laws are columns, not a join."""
    b = widebase.wide_base(spark, d)
    met = F.filter(F.array(*(F.when(conditions.compiled(x), F.lit(n)) for n, x in LAWS.items())), lambda n: n.isNotNull())
    return b.select("symbol", "time", F.explode(met).alias("law_id")).groupBy("symbol", "law_id").agg(F.count("*").alias("matches"), F.min("time").alias("first_match"), F.max("time").alias("last_match"))


def _registry(spark, d, part: Column) -> DataFrame:
    """A table of laws (one a type of event) from some of the ticks."""
    t = src.table(spark, d, "events").where(part)
    g = t.groupBy(F.concat(F.lit("LAW_"), F.upper("event_type")).alias("law_id")).agg(F.count("*").alias("sample_size"), F.round(F.avg("value"), 4).alias("edge"), F.count_distinct("user_id").alias("users"))
    return g.withColumn("tier", F.when(c("sample_size") % 3 == 0, "A").when(c("sample_size") % 3 == 1, "B").otherwise("C"))


_OLD, _NEW = "event_type <> (SELECT max(event_type) FROM events) AND user_id % 2 = 0", "event_type <> (SELECT min(event_type) FROM events)"
_REG = "SELECT 'LAW_' || upper(event_type) AS law_id, count(*) AS sample_size, round(avg(value), 4) AS edge, count(DISTINCT user_id) AS users, CASE count(*) % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS tier FROM events WHERE "
_RG = f"WITH o AS ({_REG}{_OLD} GROUP BY event_type), n AS ({_REG}{_NEW} GROUP BY event_type)"
_FIELDS = ("edge", "sample_size", "tier", "users")


def _registries(spark, d) -> tuple[DataFrame, DataFrame]:
    edge = src.table(spark, d, "events").agg(F.min("event_type"), F.max("event_type")).first()  # one row
    return _registry(spark, d, (c("event_type") != edge[1]) & (c("user_id") % 2 == 0)), _registry(spark, d, c("event_type") != edge[0])


@query(f"{_RG} SELECT coalesce(o.law_id, n.law_id) AS law_id, CASE WHEN o.law_id IS NULL THEN 'ADDED' WHEN n.law_id IS NULL THEN 'REMOVED' WHEN {' AND '.join(f'o.{f} IS NOT DISTINCT FROM n.{f}' for f in _FIELDS)} THEN 'UNCHANGED' ELSE 'CHANGED' END AS change, CASE WHEN o.law_id IS NULL OR n.law_id IS NULL THEN '' ELSE array_to_string(list_filter([{', '.join(f'''CASE WHEN o.{f} IS DISTINCT FROM n.{f} THEN '{f}' END''' for f in _FIELDS)}], lambda x: x IS NOT NULL), ',') END AS changed_fields, o.tier AS old_tier, n.tier AS new_tier, o.sample_size AS old_sample_size, n.sample_size AS new_sample_size FROM o FULL JOIN n ON o.law_id = n.law_id")
def registry_diff(spark, d):
    """What is new, gone or changed between two registries, field by field."""
    old, new = (t.select("law_id", F.struct(*_FIELDS).alias(n)) for t, n in zip(_registries(spark, d), ("o", "n"), strict=True))
    j = old.join(new, "law_id", "full")
    both = c("o").isNotNull() & c("n").isNotNull()
    fields = F.array_compact(F.array(*(F.when(~c(f"o.{f}").eqNullSafe(c(f"n.{f}")), F.lit(f)) for f in _FIELDS)))
    change = F.when(c("o").isNull(), "ADDED").when(c("n").isNull(), "REMOVED").when(F.size(fields) == 0, "UNCHANGED").otherwise("CHANGED")
    return j.select("law_id", change.alias("change"), F.when(both, F.array_join(fields, ",")).otherwise("").alias("changed_fields"), c("o.tier").alias("old_tier"), c("n.tier").alias("new_tier"), c("o.sample_size").alias("old_sample_size"), c("n.sample_size").alias("new_sample_size"))


@query(f"{_RG} SELECT 'ADDED' AS part, law_id FROM (SELECT law_id FROM n EXCEPT SELECT law_id FROM o) UNION ALL SELECT 'REMOVED', law_id FROM (SELECT law_id FROM o EXCEPT SELECT law_id FROM n) UNION ALL SELECT 'COMMON', law_id FROM (SELECT law_id FROM o INTERSECT SELECT law_id FROM n)")
def registry_sets(spark, d):
    old, new = (t.select("law_id") for t in _registries(spark, d))
    parts = {"ADDED": new.subtract(old), "REMOVED": old.subtract(new), "COMMON": old.intersect(new)}
    out = [t.select(F.lit(n).alias("part"), "law_id") for n, t in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(f"{_RG} SELECT law_id, sha256('{{\"edge\":' || edge::DECIMAL(18,4) || ',\"law_id\":\"' || law_id || '\",\"sample_size\":' || sample_size || ',\"tier\":\"' || tier || '\"}}') AS canonical_sha256, left(sha256(law_id), 8) AS short_id FROM n")
def registry_ids(spark, d):
    """SHA-256 of each law's canonical JSON (keys in order, no blanks), and a short identifier."""
    new = _registries(spark, d)[1]
    text = F.to_json(F.struct(c("edge").cast("decimal(18,4)").alias("edge"), "law_id", "sample_size", "tier"))
    return new.select("law_id", F.sha2(text, 256).alias("canonical_sha256"), F.left(F.sha2("law_id", 256), F.lit(8)).alias("short_id"))


_PF = ("sample_size", "success_rate", "avg_return_atr", "median_return_atr", "avg_win_atr", "avg_loss_atr", "payoff_ratio", "profit_factor")


@query(f"{research._DNA} SELECT symbol, break_side, horizon, count(*) AS sample_size, round(avg(success::INT), 5) AS success_rate, round(avg(return), 5) AS avg_return_atr, round(median(return), 5) AS median_return_atr, round(avg(return) FILTER (return > 0), 5) AS avg_win_atr, round(avg(return) FILTER (return < 0), 5) AS avg_loss_atr, round(avg(return) FILTER (return > 0) / nullif(abs(avg(return) FILTER (return < 0)), 0), 5) AS payoff_ratio, round(coalesce(sum(return) FILTER (return > 0), 0) / nullif(abs(sum(return) FILTER (return < 0)), 0), 5) AS profit_factor FROM sp GROUP BY symbol, break_side, horizon")
def profit_factor(spark, d):
    r = c("return")
    win, loss = F.when(r > 0, r), F.when(r < 0, r)
    g = research._by_horizon(research._break_events(spark, d)).groupBy("symbol", "break_side", "horizon")
    g = g.agg(F.count("*").alias("sample_size"), F.avg(c("success").cast("int")).alias("success_rate"), F.avg(r).alias("avg_return_atr"), F.percentile(r, F.lit(0.5)).alias("median_return_atr"), F.avg(win).alias("avg_win_atr"), F.avg(loss).alias("avg_loss_atr"), F.coalesce(F.sum(win), F.lit(0.0)).alias("w"), F.abs(F.sum(loss)).alias("l"))
    g = g.withColumns({"payoff_ratio": e.over(c("avg_win_atr"), F.abs("avg_loss_atr")), "profit_factor": e.over(c("w"), c("l"))})
    return rounded(g.select("symbol", "break_side", "horizon", *_PF), 5)


_TOP = f"WITH RECURSIVE {q.bars()}, {q.base()}, m AS (SELECT symbol, time, round((high - low) / atr, 6) AS range_atr FROM b WHERE atr > 0)"


@query(f"{_TOP}, t AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY range_atr DESC, time) <= 3), l AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY time DESC) <= 5), g AS (SELECT * FROM m ORDER BY range_atr DESC, symbol, time LIMIT 10) SELECT 'TOP_3_A_SYMBOL' AS part, * FROM t UNION ALL SELECT 'LAST_5_A_SYMBOL', * FROM l UNION ALL SELECT 'TOP_10', * FROM g")
def tops_and_tails(spark, d):
    """The widest bars of each symbol, the last ones, and the widest of all: the limits are the feature."""
    m = base(spark, d).where("atr > 0").select("symbol", "time", F.round((c("high") - c("low")) / c("atr"), 6).alias("range_atr"))
    of = Window.partitionBy("symbol")
    ranked = m.withColumns({"_t": F.row_number().over(of.orderBy(c("range_atr").desc(), "time")), "_l": F.row_number().over(of.orderBy(c("time").desc()))})
    parts = {"TOP_3_A_SYMBOL": ranked.where("_t <= 3"), "LAST_5_A_SYMBOL": ranked.where("_l <= 5"), "TOP_10": m.orderBy(c("range_atr").desc(), "symbol", "time").limit(10)}
    out = [t.select(F.lit(n).alias("part"), "symbol", "time", "range_atr") for n, t in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


_BK = ("previous_body_bucket", "previous_range_bucket", "previous_volume_bucket", "previous_color")
_BK_SQL = f"{research._lc('previous_body_ratio', (0.35, 0.65), ('SMALL_BODY', 'MEDIUM_BODY', 'STRONG_BODY'))} AS previous_body_bucket, {research._lc('previous_range_atr', (0.75, 1.25), ('LOW_RANGE', 'NORMAL_RANGE', 'EXPANSION_RANGE'))} AS previous_range_bucket, {research._lc('previous_volume_ratio', (0.8, 1.5), ('LOW_VOLUME', 'NORMAL_VOLUME', 'HIGH_VOLUME'))} AS previous_volume_bucket"
_PAIRS = tuple(itertools.combinations(_BK, 2))


@query(f"{research._DNA}, k AS (SELECT previous_color, {_BK_SQL}, success FROM sp WHERE horizon = 15), r AS (SELECT avg(success::INT) AS base FROM k) " + " UNION ALL ".join(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, {a} AS value_a, {b} AS value_b, count(*) AS n, round(avg(success::INT) - any_value(base), 6) AS lift FROM k, r GROUP BY {a}, {b} HAVING count(*) >= 20" for a, b in _PAIRS))
def feature_pairs(spark, d):
    """Lift of every pair of features over the whole rate, in one pass over the pairs of each event."""
    ev = research._break_events(spark, d).withColumn("s", c("success_15").cast("int"))
    pairs = F.array(*(F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), c(a).alias("value_a"), c(b).alias("value_b")) for a, b in _PAIRS))
    g = ev.select("s", F.explode(pairs).alias("x")).select("s", "x.*").groupBy("feature_a", "feature_b", "value_a", "value_b").agg(F.count("*").alias("n"), F.avg("s").alias("rate")).where("n >= 20")
    j = g.join(F.broadcast(ev.agg(F.avg("s").alias("whole"))))  # one row
    return rounded(j.select("feature_a", "feature_b", "value_a", "value_b", "n", (c("rate") - c("whole")).alias("lift")))


_FAMILIES = {"displacement": ("body_atr", "range_atr"), "location": ("dist_sma10_atr", "dist_bb_high_atr", "dist_bb_low_atr"), "participation": ("vol_ratio",)}
_MAGNITUDES = {"body_atr", "range_atr", "vol_ratio"}
_NUMERIC = tuple(x for f in _FAMILIES.values() for x in f)


def _vote_sql(x: str) -> str:
    sign = "1" if x in _MAGNITUDES else "CASE side WHEN 'UP' THEN 1 ELSE -1 END"
    return f"CASE WHEN {x} <= q_{x}[1] THEN -1 WHEN {x} > q_{x}[3] THEN 1 ELSE 0 END * {sign}"


@query(f"""WITH RECURSIVE {q.bars()}, {q.base()}, {_IND}, {_Z}, v AS (SELECT symbol, time, row_idx, CASE WHEN close > ph THEN 'UP' ELSE 'DOWN' END AS side, abs(close - open) / (atr + 1e-9) AS body_atr, (high - low) / (atr + 1e-9) AS range_atr, vol_ratio, (vol_ratio >= 1.5)::INT AS spike, (close - sma_10) / (nullif(atr, 0) + 1e-9) AS dist_sma10_atr, (close - bollinger_high) / (nullif(atr, 0) + 1e-9) AS dist_bb_high_atr, (close - bollinger_low) / (nullif(atr, 0) + 1e-9) AS dist_bb_low_atr FROM y WHERE (close > ph OR close < pl) AND atr > 0 AND vol_ratio IS NOT NULL AND sma_10 IS NOT NULL),
k AS (SELECT *, row_number() OVER {q.W} AS i, count(*) OVER (PARTITION BY symbol) AS m FROM v), qs AS (SELECT symbol, {', '.join(f'quantile_cont({x}, [0.25, 0.5, 0.75]) AS q_{x}' for x in _NUMERIC)} FROM k WHERE i <= floor(m * 0.7) GROUP BY symbol),
f AS (SELECT k.symbol, time, side, {', '.join(f"sign({' + '.join(_vote_sql(x) for x in xs)}{' + spike' if n == 'participation' else ''})::INT AS score_{n}" for n, xs in _FAMILIES.items())} FROM k JOIN qs ON k.symbol = qs.symbol),
s AS (SELECT *, {' + '.join(f'score_{n}' for n in _FAMILIES)} AS breakout_quality_score FROM f)
SELECT *, CASE WHEN breakout_quality_score <= -3 THEN 'VERY_WEAK' WHEN breakout_quality_score <= -1 THEN 'WEAK' WHEN breakout_quality_score <= 1 THEN 'NEUTRAL' WHEN breakout_quality_score <= 3 THEN 'STRONG' ELSE 'VERY_STRONG' END AS breakout_quality_class, CASE WHEN breakout_quality_score >= 4 THEN 'PREMIUM' WHEN breakout_quality_score >= 2 THEN 'VALID' ELSE 'LOW' END AS operational_band FROM s""")
def breakout_quality(spark, d):
    """Votes of features by their quartiles in the first 70 % of break-outs; families vote by sign, the score is their sum."""
    b = features.regimes(features.rolling_indicators(base(spark, d)))
    b = levels.distances(b.withColumns({"ema_20": F.lit(None).cast("double"), "ema_50": F.lit(None).cast("double")}))
    v = b.where("(close > ph OR close < pl) AND atr > 0 AND vol_ratio IS NOT NULL AND sma_10 IS NOT NULL").withColumn("side", F.when(c("close") > c("ph"), "UP").otherwise("DOWN"))
    v = v.withColumns({"i": F.row_number().over(e.series()), "m": F.count("*").over(Window.partitionBy("symbol"))})
    quarters = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    qs = v.where(c("i") <= F.floor(c("m") * 0.7)).groupBy("symbol").agg(*(F.percentile(x, quarters).alias(f"q_{x}") for x in _NUMERIC))
    j = v.join(qs, "symbol")

    def vote(x: str) -> Column:
        size = F.when(c(x) <= c(f"q_{x}")[0], -1).when(c(x) > c(f"q_{x}")[2], 1).otherwise(0)
        return size if x in _MAGNITUDES else size * F.when(c("side") == "UP", 1).otherwise(-1)

    totals = {n: sum((vote(x) for x in xs), c("vol_spike_1p5") if n == "participation" else F.lit(0)) for n, xs in _FAMILIES.items()}
    j = j.withColumns({f"score_{n}": F.signum(x).cast("int") for n, x in totals.items()})
    total = sum((c(f"score_{n}") for n in _FAMILIES), F.lit(0))
    j = j.withColumn("breakout_quality_score", total)
    s = c("breakout_quality_score")
    return j.select("symbol", "time", "side", *(f"score_{n}" for n in _FAMILIES), "breakout_quality_score", e.bins(s, (-3, -1, 1, 3), ("VERY_WEAK", "WEAK", "NEUTRAL", "STRONG", "VERY_STRONG")).alias("breakout_quality_class"), F.when(s >= 4, "PREMIUM").when(s >= 2, "VALID").otherwise("LOW").alias("operational_band"))


@query("SELECT o_orderkey, month(o_orderdate)::INT AS month, year(o_orderdate)::INT AS year, strftime(o_orderdate, '%Y-%m') AS period, upper(dayname(o_orderdate)) AS weekday, strftime(o_orderdate, '%H:%M') AS time_slot, (isodow(o_orderdate) - 1)::INT AS day_of_week, o_orderdate::DATE AS date FROM orders WHERE upper(o_orderstatus) IN ('F', 'O') AND o_totalprice BETWEEN 1000 AND 200000 AND regexp_matches(o_orderpriority, 'URGENT|HIGH|LOW')")
def calendar_fields(spark, d):
    t = src.table(spark, d, "orders").where(F.upper("o_orderstatus").isin("F", "O") & c("o_totalprice").between(1000, 200000) & c("o_orderpriority").rlike("URGENT|HIGH|LOW"))
    at = c("o_orderdate")
    return t.select("o_orderkey", F.month(at).alias("month"), F.year(at).alias("year"), F.date_format(at, "yyyy-MM").alias("period"), F.upper(F.date_format(at, "EEEE")).alias("weekday"), F.date_format(at, "HH:mm").alias("time_slot"), F.weekday(at).alias("day_of_week"), F.to_date(at).alias("date"))


@query(f"WITH RECURSIVE {q.bars()}, {q.base()}, ev AS (SELECT event_id, event_type AS symbol, time_bucket(INTERVAL '1 hour', ts) AS time, value FROM events) SELECT event_id, ev.symbol, ev.time, value, round((high - low) / (atr + 1e-9), 6) AS range_atr, coalesce((close > ph)::INT, 0) AS breakout_up FROM ev LEFT JOIN b ON ev.symbol = b.symbol AND ev.time = b.time")
def events_with_features(spark, d):
    """Events and the features of the bar that they fall in: a left equi-join on symbol and time."""
    t = src.table(spark, d, "events").select("event_id", c("event_type").alias("symbol"), F.window("ts", "1 hour")["start"].alias("time"), "value")
    f = features.bar_flags(base(spark, d)).select("symbol", "time", e.guarded(c("high") - c("low"), c("atr")).alias("range_atr"), "breakout_up")
    return rounded(t.join(f, ["symbol", "time"], "left").select("event_id", "symbol", "time", "value", "range_atr", "breakout_up"))


@query(f"WITH {q.bars()}, k AS (SELECT *, lag(open) OVER w AS o1, lag(high) OVER w AS h1, lag(low) OVER w AS l1, lag(close) OVER w AS c1, row_number() OVER w AS i FROM (SELECT symbol, time, floor(open / 50) AS open, floor(high / 50) AS high, floor(low / 50) AS low, floor(close / 50) AS close FROM bars) WINDOW w AS (PARTITION BY symbol ORDER BY time)) SELECT symbol, time, open, high, low, close FROM k WHERE i = 1 OR open IS DISTINCT FROM o1 OR high IS DISTINCT FROM h1 OR low IS DISTINCT FROM l1 OR close IS DISTINCT FROM c1")
def changed_bars(spark, d):
    b = src.event_bars(spark, d).select("symbol", "time", *(F.floor(c(n) / 50).cast("double").alias(n) for n in ("open", "high", "low", "close")))
    return src.drop_unchanged(b)


@query("SELECT * FROM (SELECT event_id, user_id, event_type, ts, value FROM events WHERE value IS NOT NULL AND upper(event_type) = (SELECT upper(min(event_type)) FROM events) QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, ts, event_id) = 1)")
def keep_best(spark, d):
    """Of each user's events of one type (named in other letters) the largest, after rows without a value went."""
    t = src.table(spark, d, "events")
    name = t.agg(F.min("event_type")).first()[0] or ""  # one row
    rows = src.of_symbol(src.required(t, ["value"]).withColumn("symbol", c("event_type")), name.swapcase()).drop("symbol")
    return src.keep_best(rows, ["user_id", "event_type"], "value", [c("ts"), c("event_id")]).select("event_id", "user_id", "event_type", "ts", "value")


@query("WITH k AS (SELECT event_type, list_sort(list(DISTINCT user_id % 10)) AS g, sum(value * (1 + event_id % 3)) / sum(1 + event_id % 3) AS w FROM events GROUP BY 1) SELECT event_type, array_to_string(g, '+') AS sources, len(g)::INT AS source_count, round(w, 6) AS weighted_mean FROM k")
def sorted_sources(spark, d):
    """Distinct sources as a sorted list, and a weighted mean."""
    w = 1 + c("event_id") % 3
    g = src.table(spark, d, "events").groupBy("event_type").agg(F.array_sort(F.collect_set(c("user_id") % 10)).alias("g"), (F.sum(c("value") * w) / F.sum(w)).alias("weighted_mean"))
    return g.select("event_type", F.array_join(F.transform("g", lambda x: x.cast("string")), "+").alias("sources"), F.size("g").alias("source_count"), F.round("weighted_mean", 6).alias("weighted_mean"))


@query(f"WITH {q.bars('15 minutes')}, {q.bars('1 hour', 'h1')}, {q.bars('4 hours', 'h4')}, {q.bars('1 day', 'd1')} SELECT bars.symbol, bars.time, (coalesce(sign(a.close - a.open), 0) * 1 + coalesce(sign(b.close - b.open), 0) * 2 + coalesce(sign(c.close - c.open), 0) * 3)::INT AS vote, CASE WHEN vote > 0 THEN 'UP' WHEN vote < 0 THEN 'DOWN' ELSE 'MIXED' END AS decision FROM bars ASOF LEFT JOIN (SELECT *, time + INTERVAL '1 hour' AS t FROM h1) a ON a.symbol = bars.symbol AND bars.time >= a.t ASOF LEFT JOIN (SELECT *, time + INTERVAL '4 hours' AS t FROM h4) b ON b.symbol = bars.symbol AND bars.time >= b.t ASOF LEFT JOIN (SELECT *, time + INTERVAL '1 day' AS t FROM d1) c ON c.symbol = bars.symbol AND bars.time >= c.t")
def weighted_votes(spark, d):
    """Larger bars vote by their direction, with the weight of their width."""
    from tidebar.operators import asof

    b = src.event_bars(spark, d, "15 minutes").select("symbol", "time")
    weights = {"1 hour": 1, "4 hours": 2, "1 day": 3}
    for k, w in weights.items():
        b = asof.asof_backward(b, src.event_bars(spark, d, k), "symbol", "time", "time", ["open", "close"], f"w{w}_", k)
    vote = sum((w * F.coalesce(F.signum(c(f"w{w}_close") - c(f"w{w}_open")), F.lit(0.0)) for w in weights.values()), F.lit(0.0)).cast("int")
    b = b.withColumn("vote", vote)
    return b.select("symbol", "time", "vote", F.when(c("vote") > 0, "UP").when(c("vote") < 0, "DOWN").otherwise("MIXED").alias("decision"))


