"""Laws, entries, profiles, mining, geometry, governance, times, plug-ins and contexts on small hand-made inputs."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebar import plugins
from tidebar.functions import recursive
from tidebar.operators import context as ctx
from tidebar.operators import executions as ex
from tidebar.operators import features, laws, levels, miner, sequential, verdicts
from tidebar.operators import geometry as geo
from tidebar.sources import files, governance, times

T0 = dt.datetime(2024, 1, 1)


# --- Laws -----------------------------------------------------------------------------------------------------------------

LAWS = [
    {"law_id": "L1", "side": "BUY", "conditions": {"zone_in": ["A", "B"], "flag": True, "x_between": [0.5, 1]}},
    {"law_id": "L2", "side": "SELL", "conditions": {"n": 3, "no_such_field": "UNKNOWN"}},
    {"law_id": "L3", "side": "SELL", "conditions": {"flag": False, "word": "true"}},
    {"law_id": "L4", "side": "BUY"},
]
STATES = [("A", 1, 0.5, 3, "true", "yes"), ("C", 0, 1.5, 3, "no", "no"), (None, None, None, None, None, None), ("B", 1, 1.0, 4, "true", "1")]


def _states(spark):
    return spark.createDataFrame(STATES, "zone string, flag int, x double, n int, word string, said string").withColumn("symbol", F.lit("S"))


def _plain_holds(state, conditions):
    row = dict(zip(("zone", "flag", "x", "n", "word", "said"), state, strict=True))
    out = []
    for key, want in conditions.items():
        if key.endswith("_in"):
            ok = str(row.get(key[:-3]) if row.get(key[:-3]) is not None else "UNKNOWN") in map(str, want)
        elif key.endswith("_between"):
            value = row.get(key[:-8])
            ok = value is not None and want[0] <= value <= want[1]
        elif isinstance(want, bool):
            value = row.get(key)
            ok = (str(value).lower() in ("1", "true", "yes", "sim") if isinstance(value, str) else bool(value)) == want
        else:
            value = row.get(key)
            ok = ("UNKNOWN" if value is None else str(value)) == str(want)
        if not ok:
            out.append(key)
    return sorted(out)


def test_conditions_are_rows_of_json(spark):
    rows = laws.judged(_states(spark), laws.registry_table(spark, LAWS)).select("laws").collect()
    got = sorted(str([(x["law_id"], sorted(x["failed"])) for x in r["laws"]]) for r in rows)
    assert got == sorted(str([(x["law_id"], _plain_holds(s, x.get("conditions", {}))) for x in LAWS]) for s in STATES)


def test_a_law_in_the_table_changes_the_result(spark):
    new = {"law_id": "L5", "side": "BUY", "conditions": {"said": True}}
    count = lambda rows: laws.held(_states(spark), laws.registry_table(spark, rows)).where("law_id = 'L5'").count()
    assert count(LAWS) == 0 and count([*LAWS, new]) == 2
    assert laws.audit(_states(spark), laws.registry_table(spark, [new])).first()["failed_alone"] == 2


def _law(name, side, edge, tier="B", mods=(), blocks=None, status="VALIDATED"):
    keys = ("dimension", "segment", "status", "score_adjustment", "full_valid", "full_edge", "oos_valid", "oos_edge")
    return {"law_id": name, "side": side, "tier": tier, "validation_status": status, "full_edge": edge, "block_action": blocks, "modulators": [dict(zip(keys, m, strict=True)) for m in mods]}


def _match(spark, *registry):
    states = spark.createDataFrame([(1,)], "x int").withColumn("dims", F.create_map(F.lit("ENERGY"), F.lit("LOW"), F.lit("HOUR_BRT"), F.lit("9")))
    return laws.matched(states, laws.registry_table(spark, list(registry))).first()


def test_modulators_with_the_same_evidence_count_once(spark):
    mods = [("ENERGY", "LOW", "STRONGER", 3.0, 100, 0.5, 30, 0.2), ("HOUR_BRT", "9", "STRONGER", -4.0, 100, 0.5, 30, 0.2), ("ENERGY", "LOW", "WEAKER", 1.0, 100, 0.5, 30, 0.2), ("ENERGY", "HIGH", "WEAKER", 9.0, 100, 0.5, 30, 0.2)]
    m = _match(spark, _law("A", "BUY", 0.2, mods=mods))["matches"][0]
    assert (m["applied"], m["suppressed"], m["modulator_adjustment"], m["score"]) == (2, 1, -3.0, 53.0)


def test_sides_in_conflict(spark):
    r = _match(spark, _law("A", "BUY", 0.2), _law("B", "SELL", 0.3))
    assert (r["action"], r["supporting_side"], r["confidence"]) == ("WAIT_CONFLICT", "MIXED", "MEDIUM")
    r = _match(spark, _law("A", "BUY", 0.9, "A", blocks="SELL_BREAKOUT"), _law("B", "SELL", 0.1, "C", blocks="BUY_BREAKOUT"))
    assert (r["action"], r["confidence"], r["blocked_actions"]) == ("WAIT_FOR_BUY_CONFIRMATION", "MEDIUM", ["SELL_BREAKOUT"])
    assert [m["law_id"] for m in r["matches"]] == ["A", "B"]
    assert _match(spark, _law("A", "SELL", 0.6))["confidence"] == "HIGH" and _match(spark, _law("A", "SELL", 0.0))["confidence"] == "LOW"
    assert _match(spark, _law("A", "SELL", 0.6, status="REJECTED"))["action"] == "NO_MATCH"


def _series(spark, labels, dims=None):
    rows = [("S", T0 + dt.timedelta(hours=k), k + 1, x, 1, 0) for k, x in enumerate(labels)]
    b = spark.createDataFrame(rows, "symbol string, time timestamp_ntz, row_idx int, buy_label string, h12_reaches_1p00 int, h6_pullback_0p50 int").withColumn("sell_label", F.lit("INVALID"))
    return b.withColumn("dims", F.create_map(F.lit("ENERGY"), dims if dims is not None else F.lit("LOW")))


ANY = [{"law_id": "L", "side": "BUY", "best_tier": "A"}]


def _summary(spark, labels):
    b, registry = _series(spark, labels), laws.registry_table(spark, ANY)
    return laws.summary(laws.by_segment(b, registry), laws.grid(b, registry)).first()


def test_law_statuses(spark):
    good, poor, mixed = ["TP_FIRST"] * 3 + ["SL_FIRST"], ["SL_FIRST"] * 3 + ["TP_FIRST"], ["TP_FIRST", "SL_FIRST", "NO_TOUCH", "AMBIGUOUS"]
    got = _summary(spark, good * 50)
    assert got["status"] == "VALIDATED" and got["full_valid"] == 200 and got["full_edge"] == 0.5 and got["windows_tested"] == 10 and got["years_tested"] == 1
    assert _summary(spark, poor * 50)["status"] == "REJECTED" and _summary(spark, mixed * 50)["full_edge"] == 0
    assert _summary(spark, good * 35 + poor * 15)["status"] == "PROVISIONAL" and _summary(spark, good * 10)["status"] == "REJECTED"
    assert _summary(spark, ["INVALID"] * 50)["full_valid"] == 0


def test_splits_and_windows_of_uneven_numbers(spark):
    labels = ["TP_FIRST"] * 103
    seg = {(r["kind"], r["segment"]): r["bars"] for r in laws.by_segment(_series(spark, labels), laws.registry_table(spark, ANY)).collect()}
    assert [seg["SPLIT", n] for n in laws.SPLITS] == [72, 31, 26, 103]
    assert [seg["WINDOW", str(k)] for k in range(1, 11)] == [len(x) for x in np.array_split(np.arange(103), 10)]


def test_segment_statuses(spark):
    patterns = {"STRONG": ["TP_FIRST"] * 9 + ["SL_FIRST"], "STEADY": ["TP_FIRST"] * 7 + ["SL_FIRST"] * 3, "WEAK": ["SL_FIRST"] * 7 + ["TP_FIRST"] * 2 + ["NO_TOUCH"], "SLIGHT": ["TP_FIRST", "NO_TOUCH", "NO_TOUCH", "NO_TOUCH", "NO_TOUCH", "NO_TOUCH", "NO_TOUCH", "NO_TOUCH", "NO_TOUCH", "NO_TOUCH"], "FEW": ["TP_FIRST"]}
    names, labels = [], []
    for k in range(100):
        for name, xs in patterns.items():
            if name != "FEW" or k < 10:
                names.append(name)
                labels.append(xs[k % len(xs)])
    dims = F.element_at(F.lit(names), F.col("row_idx"))
    b, registry = _series(spark, labels, dims), laws.registry_table(spark, ANY)
    whole = laws.summary(laws.by_segment(b, registry), laws.grid(b, registry))
    seg = laws.segmented(b, registry, whole).cache()
    assert {r["segment"]: r["segment_status"] for r in seg.collect()} == {"STRONG": "STRONGER", "STEADY": "STRONGER", "WEAK": "WEAKER", "SLIGHT": "MIXED", "FEW": "INSUFFICIENT"}
    top = laws.extremes(seg).first()
    assert (top["strongest_segment"], top["weakest_segment"]) == ("STRONG", "WEAK")
    out = laws.publishable(whole, seg).first()
    assert [(m["segment"], m["status"]) for m in out["modulators"]] == [("STEADY", "STRONGER"), ("STRONG", "STRONGER"), ("WEAK", "WEAKER")]
    assert max(m["score_adjustment"] for m in out["modulators"]) <= 18


# --- Entries --------------------------------------------------------------------------------------------------------------


def _ohlc(spark, rows, step=60):
    data = [("A", T0 + dt.timedelta(minutes=step * k), *map(float, r), 1) for k, r in enumerate(rows)]
    return spark.createDataFrame(data, "symbol string, time timestamp_ntz, open double, high double, low double, close double, volume long")


def _plain_entry(bars, k, side, back, stop, waits, target, horizon, atr):
    entry = bars[k][3] - side * back * atr
    filled = not waits
    for _, high, low, _ in bars[k + 1 : k + 1 + horizon]:
        filled = filled or (low <= entry if side > 0 else high >= entry)
        if not filled:
            continue
        won = high >= entry + side * target * atr if side > 0 else low <= entry - target * atr
        lost = low <= entry - stop * atr if side > 0 else high >= entry + stop * atr
        if won or lost:
            return "AMBIGUOUS" if won and lost else "TP_FIRST" if won else "SL_FIRST"
    return "NO_TOUCH" if not waits else "FILLED_NO_EXIT" if filled else "NOT_FILLED"


def test_entries_equal_a_loop(spark):
    rng = np.random.default_rng(6)
    close = 100 + np.cumsum(rng.normal(0, 1, 60))
    bars = [(c, c + a, c - z, c) for c, a, z in zip(close, rng.random(60) * 2, rng.random(60) * 2, strict=True)]
    out = ex.with_cases(features.base(_ohlc(spark, bars)), 0.5, 3).orderBy("time").collect()
    for k, r in enumerate(out):
        for case in r["cases"]:
            _, _, back, stop = next(e for e in ex.ENTRIES if e[0] == case["variant"])
            want = "INVALID" if r["atr"] is None else _plain_entry(bars, k, case["side"], back, stop, case["waits"], 0.5, 3, r["atr"])
            assert case["label"] == want, (k, case)


def test_cascade_settles_what_a_smaller_width_shows(spark):
    """Three events: settled by the first width, by the second, and by none."""
    case = lambda label: {"direction": "UP", "variant": "v", "side": 1, "entry": 10.0, "tp": 11.0, "sl": 9.0, "waits": False, "label": label, "filled": True, "settled_by": None}
    kind = "array<struct<direction:string,variant:string,side:int,entry:double,tp:double,sl:double,waits:boolean,label:string,filled:boolean,settled_by:string>>"
    events = spark.createDataFrame([(s, T0, [case("AMBIGUOUS"), case("SL_FIRST")]) for s in "XYZ"], f"symbol string, time timestamp_ntz, cases {kind}")
    bars = lambda rows: spark.createDataFrame([(s, T0 + dt.timedelta(minutes=m), float(h), float(lo)) for s, m, h, lo in rows], "symbol string, time timestamp_ntz, high double, low double")
    first = bars([("X", 60, 11, 10), ("X", 75, 10, 8), ("Y", 60, 12, 8), ("Z", 60, 10, 10), ("Z", 300, 12, 10)])
    second = bars([("X", 60, 10, 8), ("Y", 60, 10, 9), ("Y", 65, 12, 8), ("Z", 65, 12, 8)])
    after = ex.cascade(events, [("M15", first), ("M5", second)], "1 hour", 3, lambda df, name: df)
    got = {(r["symbol"], r["variant"]): (r["label"], r["settled_by"]) for r in ex.ambiguous(events.withColumn("cases", F.slice("cases", 1, 1)), after.withColumn("cases", F.slice("cases", 1, 1))).collect()}
    assert got == {("X", "v"): ("TP_FIRST", "M15"), ("Y", "v"): ("SL_FIRST", "M5"), ("Z", "v"): ("AMBIGUOUS", None)}
    assert after.count() == 3 and after.select(F.explode("cases.label").alias("x")).where("x = 'SL_FIRST'").count() >= 3


def test_best_entry_and_grade(spark):
    rows = [("MARKET", "stop_0.4_atr", 0, 0.1, 150, 0.05, 0.8), ("MARKET", "stop_0.5_atr", 1, 0.1, 150, 0.05, 0.8), ("LIMIT_0.25", "retrace_0.25_atr", 5, -1.0, 9, 0.0, 0.8)]
    df = spark.createDataFrame([("g", "UP", m, v, p, e, n, a, r, 200, 1.0) for m, v, p, e, n, a, r in rows], "g string, direction string, mode string, variant string, place int, expectancy double, resolved int, ambiguity double, reliability double, total int, coverage double")
    best = ex.decided(df, ["g"]).first()
    assert (best["recommended_variant"], best["confidence_grade"]) == ("stop_0.4_atr", "A")
    worst = ex.decided(df.where("mode <> 'MARKET'"), ["g"]).first()
    assert (worst["recommended_entry_mode"], worst["recommended_variant"], worst["confidence_grade"]) == ("NO_TRADE", None, "D")


def test_retests_equal_a_loop(spark):
    rng = np.random.default_rng(12)
    close = 100 + np.cumsum(rng.normal(0, 1, 80))
    bars = [(c, c + a, c - z, c) for c, a, z in zip(close, rng.random(80), rng.random(80), strict=True)]
    b = features.bar_flags(features.base(_ohlc(spark, bars)))
    got = {r["row_idx"]: r for r in verdicts.retested(b, (3,)).collect()}
    assert len(got) > 20 and any(r["retest_confirmed"] for r in got.values()) and any(r["failed_before_retest"] for r in got.values())
    for k, r in got.items():
        i, side, atr = k - 1, r["side"], r["atr"]
        edge = bars[i - 1][1] if side > 0 else bars[i - 1][2]
        failed = confirmed = None
        for j in range(i + 1, min(80, i + 1 + verdicts.WAIT_BARS)):
            _, high, low, last = bars[j]
            near = 0.18 * atr
            if (last < edge - near) if side > 0 else (last > edge + near):
                failed = j
                break
            if (low <= edge + near and last > edge) if side > 0 else (high >= edge - near and last < edge):
                confirmed = j
                break
        assert (r["failed_before_retest"], r["retest_confirmed"]) == (failed is not None, confirmed is not None)
        assert r["bars_to_retest"] == (confirmed - i if confirmed is not None else None)
        for name, at in (("breakout", i), ("retest", confirmed)):
            seen = [] if at is None else bars[at + 1 : at + 4]
            if not seen:
                assert r[f"{name}_mfe_3"] is None
                continue
            entry = bars[at][3]
            mfe = (max(x[1] for x in seen) - entry if side > 0 else entry - min(x[2] for x in seen)) / atr
            assert r[f"{name}_mfe_3"] == pytest.approx(mfe)
            assert r[f"{name}_return_3"] == (pytest.approx(side * (seen[-1][3] - entry) / atr) if len(seen) == 3 else None)


def test_retest_recommendations(spark):
    def group(name, n, retests, one, two):
        """Break-outs with (success, mae, return) `one`, and `two` for the retests of the first of them."""
        return [(name, k < retests, False, 1, one[0], 1.0, one[1], one[2], *((two[0], 1.0, two[1], two[2]) if k < retests else (None,) * 4)) for k in range(n)]

    rows = group("wait", 20, 10, (0.2, 2.0, -0.5), (0.6, 1.0, 0.5)) + group("now", 20, 10, (0.8, 1.0, 0.5), (0.2, 1.0, -0.1)) + group("avoid", 20, 10, (0.2, 1.0, -0.5), (0.2, 1.0, -0.4)) + group("either", 20, 10, (0.5, 1.0, 0.5), (0.5, 1.0, 0.5)) + group("few", 5, 5, (0.2, 2.0, -0.5), (0.6, 1.0, 0.5))
    names = "g string, retest_confirmed boolean, failed_before_retest boolean, bars_to_retest int, " + ", ".join(f"{p}_{m}_3 double" for p in ("breakout", "retest") for m in ("success", "mfe", "mae", "return"))
    out = verdicts.compared(spark.createDataFrame(rows, names), ("g",), (3,), 10, 5)
    assert {r["g"]: r["recommendation"] for r in out.collect()} == {"wait": "WAIT_FOR_RETEST", "now": "BREAKOUT_ENTRY_PREFERRED", "avoid": "AVOID_PATTERN", "either": "RETEST_OPTIONAL", "few": "INSUFFICIENT_SAMPLE"}


# --- Mining ---------------------------------------------------------------------------------------------------------------


def test_quartiles_of_training_rows(spark):
    rows = [("S", T0 + dt.timedelta(hours=k), float(k % 8), 1.0, float(k % 2), None if k % 3 else "x") for k in range(100)]
    df = spark.createDataFrame(rows, "symbol string, time timestamp_ntz, wide double, flat double, two double, word string")
    out = miner.with_features(df, ["word"], ["wide", "flat", "two"]).orderBy("time").collect()
    q = np.quantile([r[2] for r in rows[:70]], [0.25, 0.5, 0.75])
    for r in out:
        got = {x["feature"]: x["value"] for x in r["features"]}
        assert got["wide"] == miner.BUCKETS[int(np.searchsorted(q, r["wide"]))] and got["flat"] == got["two"] == "UNKNOWN" and got["word"] == (r["word"] or "UNKNOWN")


def test_pairs_follow_the_ranking(spark):
    events = spark.createDataFrame([("S", [("a", "1"), ("b", "2"), ("c", "3")]), ("T", [("a", "1")])], "symbol string, features array<struct<feature:string,value:string>>")
    ranks = spark.createDataFrame([("S", 1, "c"), ("S", 2, "a"), ("S", 3, "b")], "symbol string, place int, feature string")
    got = [tuple(r)[2:] for r in miner.paired(events, ranks).collect()]
    assert sorted(got) == [("a", "b", "1", "2"), ("c", "a", "3", "1"), ("c", "b", "3", "2")]


# --- Geometry -------------------------------------------------------------------------------------------------------------


def test_geometry_equals_numpy(spark):
    rng = np.random.default_rng(7)
    close = 50 + np.cumsum(rng.normal(0, 1, 45))
    bars = [(c - 0.2, c + a, c - z, c) for c, a, z in zip(close, rng.random(45), rng.random(45), strict=True)]
    out = geo.geometry(features.base(_ohlc(spark, bars))).orderBy("time").collect()
    assert all(out[k]["high_slope_atr"] is None for k in range(7)) and out[7]["high_slope_atr"] is not None
    for k in range(7, 45):
        w = np.array(bars[max(0, k - 29) : k + 1])
        g = w[-12:]
        ref = out[k]["atr"] or (w[:, 1] - w[:, 2])[-14:].mean()
        assert out[k]["high_slope_atr"] == pytest.approx(np.polyfit(np.arange(len(g)), g[:, 1], 1)[0] / ref)
        half = max(2, len(g) // 2)
        width = g[:, 1] - g[:, 2]
        assert out[k]["compression_ratio"] == pytest.approx(width[half:].mean() / width[:half].mean())
        highs = [i for i in range(2, len(w) - 2) if w[i, 1] >= w[i - 2 : i + 3, 1].max()]
        assert [p["at"] for p in out[k]["high_pivots"]] == highs
        calm, push = min(6, max(4, len(w) // 4)), min(5, max(3, len(w) // 5))
        impulse = w[: len(w) - calm][-push:]
        assert out[k]["impulse_move_atr"] == pytest.approx((impulse[-1, 3] - impulse[0, 0]) / ref)
        twice = len(highs) >= 2 and highs[-1] - highs[-2] >= 3 and abs(w[highs[-1], 1] - w[highs[-2], 1]) / ref <= 0.45
        assert twice == any(x["name"] == "DOUBLE_TOP" for x in out[k]["candidates"])


# --- Recursions -----------------------------------------------------------------------------------------------------------


def test_recursions_are_exact_for_every_span(spark):
    x = 100 + np.random.default_rng(1).standard_normal(9000).cumsum()
    df = spark.createDataFrame([("A", k, k + 1, float(v)) for k, v in enumerate(x)], "symbol string, time int, row_idx int, x double")
    spans = (2, 50, 51, 200, 1000, 20_000)
    out = recursive.linear(df, {f"e{s}": recursive.ewm(F.col("x"), 2 / (s + 1)) for s in spans}).orderBy("time").toPandas()
    for s in spans:
        want = [x[0]]
        for v in x[1:]:
            want.append(want[-1] + 2 / (s + 1) * (v - want[-1]))
        assert np.abs(np.array(want) - out[f"e{s}"]).max() < 1e-9, s
    with pytest.raises(Exception, match="row_idx must count"):
        recursive.linear(df.where("row_idx <> 7"), {"e": recursive.ewm(F.col("x"), 0.1)}).select(F.sum("e")).collect()
    with pytest.raises(ValueError, match="between 0 and 1"):
        recursive.linear(df, {"e": (F.col("x"), 1.0)})


def test_bounded_features_in_blocks_are_the_same(spark):
    close = 100 + np.random.default_rng(3).standard_normal(1500).cumsum()
    bars = _ohlc(spark, [(v, v + 1, v - 1, v) for v in close])
    many = features.in_blocks(bars, 256).orderBy("time").toPandas()
    one = features.in_blocks(bars, 100_000).orderBy("time").toPandas()
    assert many["row_idx"].tolist() == list(range(1, 1501)) and sorted(many.columns) == sorted(one.columns)
    for n in one.columns:
        if one[n].dtype == float:
            assert np.allclose(many[n], one[n], atol=1e-9, equal_nan=True), n
        else:
            assert many[n].tolist() == one[n].tolist(), n
    with pytest.raises(ValueError, match="don't fit"):
        features.in_blocks(bars, 100)


def test_state_goes_from_batch_to_batch(spark):
    """Thinning and the parabolic stop with three rows a batch."""
    rng = np.random.default_rng(8)
    places = np.sort(rng.choice(500, 120, replace=False))
    df = spark.createDataFrame([("A" if k % 2 else None, int(p), float(rng.normal())) for k, p in enumerate(places)], "symbol string, row_idx int, x double")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = {(r["symbol"], r["row_idx"]) for r in sequential.thin(df, 7).collect()}
        sar = sequential.with_sar(_ohlc(spark, [(10, 10 + abs(np.sin(k)), 9 - abs(np.cos(k)), 10) for k in range(40)])).orderBy("time").toPandas()["psar"]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    want = set()
    for s in ("A", None):
        last = None
        for p in (int(p) for k, p in enumerate(places) if ("A" if k % 2 else None) == s):
            if last is None or p - last >= 7:
                want.add((s, p))
                last = p
    assert got == want
    k = np.arange(40)
    assert np.allclose(sar, sequential.parabolic_sar(10 + abs(np.sin(k)), 9 - abs(np.cos(k))))


def test_tables_take_the_place_of_others_when_whole(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    files.write_table(spark.range(3), path)
    files.write_table(spark.range(5).withColumn("k", F.col("id") % 2), path, ("k",))
    assert spark.read.parquet(path).count() == 5 and sorted(files.names(spark, f"file://{tmp_path}")) == ["t"]
    with pytest.raises(Exception, match="boom"):
        files.write_table(spark.range(1).select(F.raise_error(F.lit("boom")).cast("int").alias("x")), path)
    assert spark.read.parquet(path).count() == 5 and sorted(files.names(spark, f"file://{tmp_path}")) == ["t"]
    with pytest.raises(FileExistsError):
        files.create(spark, f"file://{tmp_path}/one", b"1")
        files.create(spark, f"file://{tmp_path}/one", b"2")


def test_doubled_columns_go(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int").toDF("a", "b", "a")
    assert levels.undoubled(df).collect() == [(1, 2)]


# --- Governance -----------------------------------------------------------------------------------------------------------


def _registry(*names, **more):
    law = {"symbol": "GOLD", "anchor_tf": "M5", "validation_status": "VALIDATED", "tier": "A", "side": "BUY", "conditions": {}, "effect": {}, "metrics": {}}
    return {"registry_schema_version": "1", "symbol": "gold", "anchor_tf": "M5", "laws": [{"law_id": n, "name": n, **law} for n in names], **more}


def test_of_two_publishers_the_second_is_refused(spark, tmp_path):
    book, other = (governance.Registry(spark, f"file://{tmp_path}/r", "GOLD", "M5") for _ in range(2))
    first = json.dumps(_registry("A", "B"), indent=1).encode() + b"\n\n"
    assert book.version() == 0 and book.publish(first, 0, "me", "first") == 1 and other.version() == 1
    assert book.publish(_registry("A", "B", "C"), 1, "me", "more") == 2
    with pytest.raises(governance.RegistryError, match="another has published"):
        other.publish(_registry("A", "B", "D"), 1, "you", "other")
    with pytest.raises(governance.RegistryError, match="removes 1 laws: C"):
        book.publish(_registry("A", "B"), 2, "me", "less")
    with pytest.raises(governance.RegistryError, match="equals"):
        book.publish(_registry("A", "B", "C"), 2, "me", "same")
    with pytest.raises(governance.RegistryError, match="is not abc"):
        book.publish(_registry("E"), 2, "me", "hash", expected_hash="abc", allow_removals=True)
    assert book.version() == 2 and book.rollback(1, "me", "back") == 3 and book.content() == first
    audit = [(r["version"], r["action"], r["base"], r["added"], r["removed"]) for r in book.audit().orderBy("version").collect()]
    assert audit == [(1, "PUBLISH_REGISTRY", 0, 2, 0), (2, "PUBLISH_REGISTRY", 1, 1, 0), (3, "ROLLBACK_REGISTRY", 2, 0, 1)]
    name = files.read_json(spark, f"file://{tmp_path}/r/versions/000000003.json")["content"]
    files.write_bytes(spark, f"file://{tmp_path}/r/contents/{name}.json", b"{}")
    with pytest.raises(governance.RegistryError, match="differ from their hash"):
        book.content()


def test_registries_that_are_not_valid(spark, tmp_path):
    found = governance.problems({"symbol": "SILVER", "laws": [{"law_id": "A"}, {"law_id": "A", "effect": [], "segment_modulators": {}}, 3, {}]}, "GOLD", "M5")
    for part in ("registry_schema_version", "symbol is 'SILVER'", "A.name is missing", "A stands twice", "A.effect is no object", "A.segment_modulators is no list", "laws[2] is no object", "laws[3] has no law_id"):
        assert any(part in x for x in found), part
    assert governance.problems({"laws": 3}, "GOLD")[-1] == "laws is no list" and governance.problems(_registry("A"), "GOLD", "m5") == []
    book = governance.Registry(spark, f"file://{tmp_path}/r", "GOLD", "M5")
    with pytest.raises(governance.RegistryError, match="not valid"):
        book.publish({"laws": []}, 0, "me", "x")
    with pytest.raises(governance.RegistryError, match="nothing is published"):
        book.content()
    assert book.audit().count() == 0
    diff = governance.difference(_registry("A", "B"), _registry("B", "C", laws=[{"law_id": "B", "tier": "C"}]))
    assert diff["removed"] == ["A"] and diff["added"] == [] and "tier" in diff["changed"]["B"]


# --- Times and plug-ins ---------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("scale", [1, 1_000, 1_000_000, 1_000_000_000])
def test_units_by_magnitude(spark, scale):
    seconds = 1_704_067_200
    rows = [(k, float((seconds + 60 * k) * scale)) for k in range(5)] + [(5, float("nan")), (6, None), (7, float((seconds + 240) * scale))]
    out = times.conformed(spark.createDataFrame(rows, "id int, open_time double"), [], [F.col("id")]).orderBy("event_time").collect()
    assert [r["id"] for r in out] == [0, 1, 2, 3, 7] and [int(r["event_time"].timestamp()) for r in out] == [seconds + 60 * k for k in range(5)]


def test_times_that_are_texts_or_missing(spark):
    df = spark.createDataFrame([(1, "2024-01-01 10:00:00"), (2, "never"), (3, None)], "id int, candle_time string")
    assert [r["id"] for r in times.conformed(df, [], [F.col("id")]).collect()] == [1]
    with pytest.raises(ValueError, match="found id"):
        times.conformed(spark.range(1), [], [F.col("id")])
    assert times.conformed(spark.createDataFrame([], "id int, time long"), [], [F.col("id")]).count() == 0


def test_plugins_are_checked_before_they_run(spark, tmp_path):
    good = "from pyspark.sql import functions as F\n\n\ndef one(df):\n    return df.withColumn('a', F.udf(lambda k: k + helper(), 'int')('symbol'))\n\n\ndef helper():\n    return 41\n\n\ndef two(df):\n    return df.drop('symbol')\n\n\nthree = 3\n"
    path = tmp_path / "engine_for_test.py"
    path.write_text(good)
    module = plugins.load(spark, str(path), ["one", "two"])
    df = spark.createDataFrame([(1, 2)], "symbol int, time int")
    assert plugins.run(module, df, ["one"]).first()["a"] == 42
    with pytest.raises(plugins.ContractError, match="two: lost symbol"):
        plugins.run(module, df, ["one", "two"])
    with pytest.raises(plugins.ContractError, match="missing: four, five"):
        plugins.load(spark, str(path), ["one", "four", "five"])
    with pytest.raises(plugins.ContractError, match="not functions: three"):
        plugins.load(spark, str(path), ["three"])
    with pytest.raises(FileNotFoundError):
        plugins.load(spark, str(tmp_path / "none.py"), [])


# --- Contexts -------------------------------------------------------------------------------------------------------------


def test_zones_equal_a_plain_fold(spark):
    rng = np.random.default_rng(9)
    rows = []
    for k in range(40):
        prices = [None if rng.random() < 0.2 else float(np.round(100 + rng.normal(0, 2), 2)) for _ in ctx.LEVELS]
        rows.append((k, 100.0, 1.0 if k % 5 else None, *prices))
    df = spark.createDataFrame(rows, "id int, close double, atr double, " + ", ".join(f"{n} double" for n in ctx.LEVELS))
    out = ctx.levels_of(df).withColumns({"timeframe": F.lit("M5"), "s": ctx.zones("SUPPORT", F.lit("M5"))}).orderBy("id").collect()
    for r in out:
        items = sorted((r[n], label) for n, label in ctx.LEVELS.items() if r[n] is not None and r[n] <= 100 and (r["atr"] is None or 100 - r[n] <= 4 * r["atr"]))
        folded = []
        for price, label in items:
            if folded and abs(price - np.mean([p for p, _ in folded[-1]])) <= max((r["atr"] or 0) * 0.15, 0.01):
                folded[-1].append((price, label))
            else:
                folded.append([(price, label)])
        folded = sorted(folded, key=lambda z: min(100 - p for p, _ in z))[:4]
        assert [z["center"] for z in r["s"]] == pytest.approx([np.mean([p for p, _ in z]) for z in folded])
        assert [z["reasons"] for z in r["s"]] == [sorted({x for _, x in z}) for z in folded]
        assert [z["strength"] for z in r["s"]] == [{1: "LOW", 2: "MEDIUM"}.get(len({x for _, x in z}), "HIGH") for z in folded]


def test_documents_leave_out_what_is_empty(spark):
    df = spark.createDataFrame([(1, None, [])], "a int, b int, c array<int>")
    doc = ctx.document({"a": F.col("a"), "b": F.col("b"), "c": ctx.filled(F.col("c")), "d": ctx.document({"b": F.col("b"), "e": ctx.document({"b": F.col("b")})}), "f": ctx.document({"a": F.col("a"), "b": F.col("b")})})
    assert json.loads(df.select(F.to_json(doc)).first()[0]) == {"a": 1, "f": {"a": 1}}


def test_votes_in_conflict(spark):
    rows = [("S", "H4", "BEARISH", "LOW", "NOT_LIVE"), ("S", "H1", "BEARISH_WEAK", "NEAR_EXPECTED", "NOT_LIVE"), ("S", "M5", "BULLISH", "VERY_HIGH", "BREAKOUT_UP_LIVE"), ("T", "H4", "NEUTRAL", "UNKNOWN", "NOT_LIVE")]
    out = {r["symbol"]: r for r in ctx.vote(spark.createDataFrame(rows, "symbol string, timeframe string, structure string, volume_state string, live string")).collect()}
    s, t = out["S"], out["T"]
    assert (s["weighted_structure_score"], s["directional_state"], s["participation_strength"], s["directional_volume_confirmation"]) == (-7, "BEARISH", "MODERATE", "MIXED")
    assert s["conflict"] == ctx.WORDS["conflict"][0] and s["immediate_action"] == "SELL_ON_CONFIRMATION" and s["trace"].startswith("H4:BEARISH/NOT_LIVE/LOW H1:")
    assert (t["directional_state"], t["immediate_action"], t["directional_volume_confirmation"]) == ("MIXED", "WAIT", "WEAK_OR_UNKNOWN")
