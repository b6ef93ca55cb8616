"""Laws as data: condition rows read from JSON, matching with an audit trail, validation over overlapping segments, segmentation.

A registry is a table of laws, a row each, written by hand or by `publishable`: law_id, side (BUY or SELL), best_tier, conditions (a
JSON object) and, for matching, tier, validation_status, full_edge, block_action and modulators. It meets the states as one
literal row (refused beyond MOST_LAWS laws), so that no state moves: conditions are typed rows of an array, looked up in a map
of the state's fields and compared by their kind, which the key and the JSON type give:

* "x_in": the text of x is one of a list; "x_between": x lies between two bounds, both included;
* a JSON boolean: a flag (texts 1, true, yes and sim count as true, numbers other than 0 too); anything else: equal as text.

A missing text counts as UNKNOWN, a missing flag as false; a missing number never holds. A law without conditions always holds.

Statistics of a law count its states by first touch: +1 for the target, -1 for the stop, 0 for neither or both; other labels (no
atr) are no part of the edge. A state belongs to many segments at once and is dealt to all of them in one pass.
"""

from __future__ import annotations

import json
import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col
MOST_LAWS = 10_000
# Fixed values of the rules: labels, splits and their shares, least samples and edges.
LABELS = ("TP_FIRST", "SL_FIRST", "NO_TOUCH", "AMBIGUOUS")
IN_SAMPLE, RECENT, WINDOWS = 0.70, 0.75, 10
SPLITS = ("IN_SAMPLE_70", "OUT_OF_SAMPLE_30", "RECENT_25", "FULL")
STATS = ("bars", "valid", "tp_rate", "sl_rate", "edge", "edge_ci_low", "edge_ci_high", "no_touch_rate", "ambiguous_rate", "reach_1atr", "pullback_0p50")
SESSIONS = (("ASIA", (21, 22, 23, 0, 1, 2, 3)), ("PRE_LONDON", (4, 5)), ("LONDON", (6, 7, 8)), ("NY_OPEN", (9, 10, 11, 12)), ("NY_AFTERNOON", (13, 14, 15, 16)), ("LATE_BRT", (17, 18, 19, 20)))
MODULATORS = "array<struct<dimension:string,segment:string,status:string,score_adjustment:double,full_valid:bigint,full_edge:double,oos_valid:bigint,oos_edge:double>>"


def field_of(key: str) -> str:
    """The field that a condition's key names."""
    return re.sub("_(in|between)$", "", key)


def checks(conditions: Column) -> Column:
    """JSON text of conditions as an array of (key, field, kind, texts, low, high, flag), by key."""

    def row(entry: Column) -> Column:
        key, value = entry["key"], entry["value"]
        kind = F.when(key.endswith("_in"), "in").when(key.endswith("_between"), "between").when(F.schema_of_variant(value) == "BOOLEAN", "flag").otherwise("equals")
        field = F.regexp_replace(key, "_(in|between)$", "")
        bounds = F.when(kind == "between", F.try_variant_get(value, "$", "array<double>"))
        texts = F.when(kind == "in", F.try_variant_get(value, "$", "array<string>")).when(kind == "equals", F.array(F.try_variant_get(value, "$", "string")))
        return F.struct(key.alias("key"), field.alias("field"), kind.alias("kind"), texts.alias("texts"), F.get(bounds, F.lit(0)).alias("low"), F.get(bounds, F.lit(1)).alias("high"), F.when(kind == "flag", F.try_variant_get(value, "$", "boolean")).alias("flag"))

    return F.transform(F.map_entries(F.parse_json(F.coalesce(conditions, F.lit("{}"))).cast("map<string,variant>")), row)


def _one_row(registry: DataFrame) -> tuple[DataFrame, list[str]]:
    """All laws as one row with an array, and the fields that their conditions name."""
    if registry.count() > MOST_LAWS:
        raise ValueError(f"a registry of more than {MOST_LAWS} laws: match it in parts")
    laws = registry.withColumn("checks", checks(c("conditions"))).drop("conditions")
    fields = [r[0] for r in laws.select(F.explode("checks.field").alias("f")).distinct().orderBy("f").collect()]
    return laws.agg(F.sort_array(F.collect_list(F.struct("law_id", *(n for n in laws.columns if n != "law_id")))).alias("_laws")), fields


def _fields(states: DataFrame, fields: list[str]) -> tuple[Column, Column, Column]:
    """Maps of the fields' texts, numbers and flags."""
    kinds = dict(states.dtypes)
    text, number, flag = {}, {}, {}
    for f in fields:
        kind = kinds.get(f, "void")
        text[f] = F.coalesce(c(f).cast("string"), F.lit("UNKNOWN")) if f in kinds else F.lit("UNKNOWN")
        number[f] = F.lit(None).cast("double") if kind in ("void", "boolean") else c(f).try_cast("double")
        flag[f] = F.lit(False) if kind == "void" else F.lower(F.trim(c(f))).isin("1", "true", "yes", "sim") if kind == "string" else c(f).cast("boolean") if kind == "boolean" else c(f).try_cast("double") != 0
    of = lambda m, kind: F.create_map(*(x for f, v in m.items() for x in (F.lit(f), v))) if m else F.lit(None).cast(f"map<string,{kind}>")
    return of(text, "string"), of(number, "double"), of(flag, "boolean")


def _passes(check: Column) -> Column:
    number = F.try_element_at("_number", check["field"])
    flag = F.coalesce(F.try_element_at("_flag", check["field"]), F.lit(False)) == check["flag"]
    test = F.when(check["kind"] == "between", number.between(check["low"], check["high"])).when(check["kind"] == "flag", flag)
    return F.coalesce(test.otherwise(F.array_contains(check["texts"], F.try_element_at("_text", check["field"]))), F.lit(False))


def judged(states: DataFrame, registry: DataFrame) -> DataFrame:
    """states with an array column laws: every law with failed (the keys of the conditions that don't hold) and passed (their number)."""
    one, fields = _one_row(registry)
    text, number, flag = _fields(states, fields)
    b = states.withColumns({"_text": text, "_number": number, "_flag": flag}).join(F.broadcast(one), how="cross")  # one row
    failed = lambda law: F.transform(F.filter(law["checks"], lambda k: ~_passes(k)), lambda k: k["key"])
    laws = F.transform("_laws", lambda law: law.withField("failed", failed(law)))
    laws = F.transform(laws, lambda law: law.withField("passed", F.size(law["checks"]) - F.size(law["failed"])))
    return b.withColumn("laws", laws).drop("_text", "_number", "_flag", "_laws")


def held(states: DataFrame, registry: DataFrame) -> DataFrame:
    """A row for each state and law that holds: law_id and side beside the state's columns."""
    rows = judged(states, registry)
    met = F.filter("laws", lambda law: F.size(law["failed"]) == 0)
    # explode_outer: for explode() the optimizer would add a filter that evaluates all conditions once more.
    each = rows.withColumn("_law", F.explode_outer(F.transform(met, lambda law: F.struct(law["law_id"], law["side"])))).where("_law IS NOT NULL")
    return each.select(*(n for n in rows.columns if n != "laws"), "_law.law_id", c("_law.side").alias("law_side"))


def audit(states: DataFrame, registry: DataFrame, by: str = "symbol") -> DataFrame:
    """For each law and condition, how many states failed it, and how many failed it alone."""
    rows = judged(states, registry).select(by, F.explode("laws").alias("law")).select(by, "law.law_id", F.explode_outer("law.failed").alias("condition"), (F.size("law.failed") == 1).cast("long").alias("alone"))
    return rows.where("condition IS NOT NULL").groupBy(by, "law_id", "condition").agg(F.count("*").alias("failed"), F.sum("alone").alias("failed_alone"))


# --- Matching -------------------------------------------------------------------------------------------------------------


def dimensions(states: DataFrame) -> DataFrame:
    """states (with hour_brt, time and the wide base's locations) and `dims`, the map of the seven dimensions to their segments."""
    hour = c("hour_brt").cast("int")
    session = F.when(F.lit(False), "")
    for name, hours in SESSIONS:
        session = session.when(hour.isin(*hours), name)
    near = F.when(c("resistance_bucket").isin("TOUCHING", "VERY_NEAR"), "NEAR_RESISTANCE").when(c("support_bucket").isin("TOUCHING", "VERY_NEAR"), "NEAR_SUPPORT").otherwise("OTHER_LOCATION")
    known = {
        "HOUR_BRT": hour.cast("string"),
        "SESSION_BRT": session.otherwise("UNKNOWN"),
        "WEEKDAY": F.upper(F.date_format("time", "EEEE")),
        "ENERGY": c("energy_bucket"),
        "HTF_LOCATION": c("htf_location_bias"),
        "BREAKOUT_ALIGNMENT": c("breakout_location_alignment"),
        "LEVEL_PROXIMITY": near,
    }
    return states.withColumn("dims", F.create_map(*(x for n, v in known.items() for x in (F.lit(n), F.coalesce(v, F.lit("UNKNOWN"))))))


def _same_evidence(a: Column, b: Column) -> Column:
    """Modulators that rest on the same sample, so that it counts once."""
    near = lambda n: F.round(a[n], 9).eqNullSafe(F.round(b[n], 9))
    return a["status"].eqNullSafe(b["status"]) & a["full_valid"].eqNullSafe(b["full_valid"]) & near("full_edge") & a["oos_valid"].eqNullSafe(b["oos_valid"]) & near("oos_edge")


def kept_modulators(applied: Column) -> Column:
    """Of modulators with the same evidence the one with the largest adjustment, the first of equal ones."""
    numbered = F.transform(applied, lambda m, i: F.struct(m.alias("m"), i.alias("i")))
    size = lambda x: F.abs(x["m"]["score_adjustment"])
    beaten = lambda x: F.exists(numbered, lambda y: _same_evidence(x["m"], y["m"]) & ((size(y) > size(x)) | ((size(y) == size(x)) & (y["i"] < x["i"]))))
    return F.transform(F.filter(numbered, lambda x: ~beaten(x)), lambda x: x["m"])


def _clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def matched(states: DataFrame, registry: DataFrame) -> DataFrame:
    """states (with `dims`) and what the registry's validated and provisional laws make of them.

    matches: law_id, side, tier, score and its parts, applied and suppressed modulators, the highest score first; then scores of
    both sides, blocked actions, the side that is supported, the action and its confidence.
    """
    rows = judged(states, registry.where(c("validation_status").isin("VALIDATED", "PROVISIONAL")))

    def scored(law: Column) -> Column:
        mods = F.coalesce(law["modulators"], F.array().cast(MODULATORS))
        applied = F.filter(mods, lambda m: F.try_element_at("dims", m["dimension"]) == m["segment"])
        kept = kept_modulators(applied)
        base = _clip(45 + 55 * F.coalesce(law["full_edge"], F.lit(0.0)), 0.0, 100.0)
        tier = F.when(law["tier"] == "A", 5.0).when(law["tier"] == "C", -12.0).otherwise(0.0)
        moved = F.aggregate(kept, F.lit(0.0), lambda s, m: s + F.coalesce(m["score_adjustment"], F.lit(0.0)))
        return F.struct(
            _clip(base + tier + moved, 0.0, 100.0).alias("score"), (law["tier"] == "A").alias("first_tier"), law["law_id"].alias("law_id"), law["side"].alias("side"), law["tier"].alias("tier"),
            base.alias("base_score"), tier.alias("tier_adjustment"), moved.alias("modulator_adjustment"), F.size(kept).alias("applied"), (F.size(applied) - F.size(kept)).alias("suppressed"),
            F.when(law["tier"] == "A", law["block_action"]).alias("blocks"),
        )

    met = F.transform(F.filter("laws", lambda law: F.size(law["failed"]) == 0), scored)
    # The highest score first, tier A before others; equal ones by law_id, in which order they come.
    order = lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).when(a["first_tier"] & ~b["first_tier"], -1).when(b["first_tier"] & ~a["first_tier"], 1).when(a["law_id"] < b["law_id"], -1).when(a["law_id"] > b["law_id"], 1).otherwise(0)
    rows = rows.withColumn("matches", F.array_sort(met, order)).drop("laws")
    total = lambda side: F.aggregate(F.filter("matches", lambda m: m["side"] == side), F.lit(0.0), lambda s, m: s + m["score"])
    rows = rows.withColumns({"buy_score": total("BUY"), "sell_score": total("SELL"), "blocked_actions": F.array_sort(F.array_distinct(F.array_compact(F.transform("matches", lambda m: m["blocks"]))))})
    buy, sell, none = c("buy_score"), c("sell_score"), F.size("matches") == 0
    both, close = (buy > 0) & (sell > 0), F.abs(buy - sell) < 15
    side = F.when(none, "NONE").when(both & close, "MIXED").when(buy > sell, "BUY").otherwise("SELL")
    rows = rows.withColumn("supporting_side", side)
    top = F.array_max(F.transform(F.filter("matches", lambda m: m["side"] == c("supporting_side")), lambda m: m["score"]))
    sure = F.when(none, "NONE").when(both, "MEDIUM").when(top >= 75, "HIGH").when(top >= 55, "MEDIUM").otherwise("LOW")
    action = F.when(none, "NO_MATCH").when(both & close, "WAIT_CONFLICT").otherwise(F.concat(F.lit("WAIT_FOR_"), "supporting_side", F.lit("_CONFIRMATION")))
    return rows.withColumns({"action": action, "confidence": sure})


# --- Validation -----------------------------------------------------------------------------------------------------------


def stats(prefix: str = "", when: Column | None = None) -> list[Column]:
    """The aggregates of STATS over rows with label, h12_reaches_1p00 and h6_pullback_0p50, or over those where `when` holds."""
    on = F.lit(True) if when is None else when
    valid = on & c("label").isin(*LABELS)
    x = F.when(valid, F.when(c("label") == "TP_FIRST", 1.0).when(c("label") == "SL_FIRST", -1.0).otherwise(0.0))
    n, edge, half = F.count(x), F.avg(x), 1.96 * F.stddev_samp(x) / F.sqrt(F.count(x))
    some = n > 0
    share = lambda name: F.avg(F.when(valid, (c("label") == name).cast("int")))
    of = lambda name: F.when(some, F.avg(F.when(on, c(name).cast("int"))))
    values = (F.count(F.when(on, 1)), n, share("TP_FIRST"), share("SL_FIRST"), edge, edge - half, edge + half, share("NO_TOUCH"), share("AMBIGUOUS"), of("h12_reaches_1p00"), of("h6_pullback_0p50"))
    return [v.alias(prefix + name) for name, v in zip(STATS, values, strict=True)]


def placed(states: DataFrame, by: str = "symbol") -> DataFrame:
    """states (with row_idx from 1) and their splits, rolling window (from 1) and year."""
    sizes = states.groupBy(by).agg(F.max("row_idx").alias("_n"))  # a row a series
    k, n = c("row_idx") - 1, c("_n")
    out = k >= F.floor(n * IN_SAMPLE)
    splits = F.array_compact(F.array(F.lit("FULL"), F.when(out, "OUT_OF_SAMPLE_30").otherwise("IN_SAMPLE_70"), F.when(k >= F.floor(n * RECENT), "RECENT_25")))
    size, more = F.floor(n / WINDOWS), n % WINDOWS  # the first windows hold one more
    window = F.when(k < more * (size + 1), F.floor(k / (size + 1))).otherwise(more + F.floor((k - more * (size + 1)) / F.greatest(size, F.lit(1))))
    b = states.join(F.broadcast(sizes), by)
    return b.withColumns({"splits": splits, "window": (window + 1).cast("int"), "year": F.year("time"), "out_of_sample": out}).drop("_n")


def labelled(rows: DataFrame) -> DataFrame:
    """Rows of held() with the first touch of the law's side as label."""
    return rows.withColumn("label", F.when(c("law_side") == "BUY", c("buy_label")).otherwise(c("sell_label")))


def by_segment(states: DataFrame, registry: DataFrame, by: str = "symbol") -> DataFrame:
    """Statistics of each law in every split, year and window that it has states in: one pass, one shuffle."""
    part = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("segment"))
    rows = labelled(held(placed(states, by), registry))
    parts = F.concat(F.transform("splits", lambda s: part("SPLIT", s)), F.array(part("YEAR", c("year")), part("WINDOW", c("window"))))
    rows = rows.select(by, "law_id", "label", "h12_reaches_1p00", "h6_pullback_0p50", F.explode(parts).alias("p"))
    return rows.groupBy(by, "law_id", "p.kind", "p.segment").agg(*stats())


def grid(states: DataFrame, registry: DataFrame, by: str = "symbol") -> DataFrame:
    """Every law for every series."""
    one = _one_row(registry)[0].select(F.transform("_laws", lambda x: F.struct(x["law_id"], x["side"], x["best_tier"])).alias("_laws"))
    return states.select(by).distinct().join(F.broadcast(one), how="cross").select(by, F.explode("_laws").alias("x")).select(by, "x.*")  # one row


def summary(segments: DataFrame, laws: DataFrame, min_oos: int = 40, by: str = "symbol") -> DataFrame:
    """Status of each law from the statistics of its segments: VALIDATED, PROVISIONAL or REJECTED."""
    at = lambda split, name: F.max(F.when((c("kind") == "SPLIT") & (c("segment") == split), c(name)))
    tested = lambda kind, least: (c("kind") == kind) & (c("valid") >= least)
    kept = {"full": ("FULL", ("bars", "valid", "edge", "edge_ci_low", "edge_ci_high", "tp_rate", "sl_rate", "pullback_0p50", "reach_1atr")), "is": ("IN_SAMPLE_70", ("edge",)), "oos": ("OUT_OF_SAMPLE_30", ("valid", "edge", "edge_ci_low")), "recent": ("RECENT_25", ("edge",))}
    columns = [at(split, n).alias(f"{p}_{n}") for p, (split, names) in kept.items() for n in names]
    for name, kind, least in (("year", "YEAR", 20), ("window", "WINDOW", 15)):
        columns += [F.count(F.when(tested(kind, least), 1)).alias(f"{name}s_tested"), F.avg(F.when(tested(kind, least), (c("edge") > 0).cast("int"))).alias(f"positive_{name}_ratio")]
    rows = laws.join(segments.groupBy(by, "law_id").agg(*columns), [by, "law_id"], "left")
    rows = rows.fillna(0, ["full_bars", "full_valid", "oos_valid", "years_tested", "windows_tested"])
    robust = (c("full_valid") >= 120) & (c("oos_valid") >= min_oos) & (c("full_edge") > 0.10) & (c("oos_edge") > 0.05) & (c("positive_year_ratio") >= 0.60) & (c("positive_window_ratio") >= 0.60)
    sure = (c("full_edge_ci_low") > 0) & (c("oos_edge_ci_low") > 0)
    some = (c("full_valid") >= 80) & (c("full_edge") > 0.05)
    status = F.when(robust & sure, "VALIDATED").when(robust | some, "PROVISIONAL").otherwise("REJECTED")
    return rows.withColumns({"status": status, "oos_degradation_ratio": F.when(c("is_edge") > 0, c("oos_edge") / c("is_edge"))})


# --- Segmentation ---------------------------------------------------------------------------------------------------------


def segmented(states: DataFrame, registry: DataFrame, validated: DataFrame, min_segment: int = 40, by: str = "symbol") -> DataFrame:
    """Statistics of each law within each segment of seven dimensions (`dims`), one at a time, whole and out of sample, with a status."""
    rows = labelled(held(placed(states, by), registry)).select(by, "law_id", "label", "h12_reaches_1p00", "h6_pullback_0p50", "out_of_sample", F.explode("dims").alias("dimension", "segment"))
    g = rows.groupBy(by, "law_id", "dimension", "segment").agg(*stats("full_"), *stats("oos_", c("out_of_sample")))
    g = g.join(validated.select(by, "law_id", c("full_edge").alias("base_edge")), [by, "law_id"])
    delta, edge, later = c("segment_edge_delta"), c("full_edge"), c("oos_edge")
    few = (c("full_valid") < min_segment) | (c("oos_valid") < max(12, min_segment // 3)) | edge.isNull() | later.isNull()
    status = F.when(few, "INSUFFICIENT").when((c("full_edge_ci_low") > 0) & (later > 0) & (delta >= 0.08), "STRONGER")
    status = status.when((edge > 0) & (later > 0) & (delta.isNull() | (delta >= -0.08)), "STABLE").when((edge <= 0) | (later <= 0) | (delta <= -0.15), "WEAKER").otherwise("MIXED")
    return g.withColumn("segment_edge_delta", edge - c("base_edge")).withColumn("segment_status", status)


def extremes(segments: DataFrame, by: str = "symbol") -> DataFrame:
    """The strongest and the weakest segment of each law and dimension; ties: the larger sample, then the first name."""
    fit = segments.where(c("segment_status").isin("STRONGER", "STABLE", "WEAKER"))
    picked = ("segment", "segment_status", "full_valid", "full_edge", "oos_edge")
    row = lambda sign: F.struct((sign * c("full_edge")).alias("a"), (-c("full_valid")).alias("b"), *picked)
    g = fit.groupBy(by, "law_id", "dimension").agg(F.min(row(-1)).alias("s"), F.min(row(1)).alias("w"))
    names = dict(zip(picked, ("segment", "status", "valid", "edge", "oos_edge"), strict=True))
    return g.select(by, "law_id", "dimension", *(c(f"{p}.{n}").alias(f"{word}_{m}") for p, word in (("s", "strongest"), ("w", "weakest")) for n, m in names.items()), (c("s.full_edge") - c("w.full_edge")).alias("edge_spread"))


def publishable(validated: DataFrame, segments: DataFrame, by: str = "symbol") -> DataFrame:
    """The registry that validation and segmentation give: tier, block action, and segments that strengthen or weaken as modulators."""
    fit = segments.where(c("segment_status").isin("STRONGER", "WEAKER") & (c("full_valid") >= 80) & (c("oos_valid") >= 20))
    moved = F.round(_clip(F.coalesce("segment_edge_delta", F.lit(0.0)) * 35, -18.0, 18.0), 3)
    mod = F.struct("dimension", "segment", c("segment_status").alias("status"), moved.alias("score_adjustment"), "full_valid", "full_edge", "oos_valid", "oos_edge")
    mods = fit.groupBy(by, "law_id").agg(F.sort_array(F.collect_list(mod)).alias("modulators"))  # at most the segments of seven dimensions
    tier = F.when(c("status") == "VALIDATED", c("best_tier")).otherwise("C")
    rows = validated.join(mods, [by, "law_id"], "left").withColumn("tier", tier)
    against = F.when(c("side") == "BUY", "SELL_BREAKOUT").otherwise("BUY_BREAKOUT")
    role = F.when(c("tier") == "A", "GUARD").when(c("tier") == "B", "CONFIRMATION").otherwise("ADVISORY")
    return rows.select(by, "law_id", "side", "tier", c("status").alias("validation_status"), role.alias("runtime_role"), F.when(c("tier") == "A", against).alias("block_action"), "full_edge", F.coalesce("modulators", F.array().cast(MODULATORS)).alias("modulators"))


def registry_table(spark, rows: list[Mapping[str, object]]) -> DataFrame:
    """A registry from parsed JSON (a list of laws); conditions and modulators may be missing."""
    kinds = {"law_id": "string", "side": "string", "best_tier": "string", "tier": "string", "validation_status": "string", "full_edge": "double", "block_action": "string"}
    data = [(*(r.get(n) for n in kinds), json.dumps(r.get("conditions", {})), json.dumps(r.get("modulators", []))) for r in rows]
    table = spark.createDataFrame(data, ", ".join(f"{n} {t}" for n, t in kinds.items()) + ", conditions string, mods string")
    return table.withColumn("modulators", F.from_json("mods", MODULATORS)).drop("mods")

