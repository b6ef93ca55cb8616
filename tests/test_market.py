import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from compare import same
from tidebar.functions import conditions
from tidebar.operators import asof, features, levels, memory, sequential, touch
from tidebar.operators import figures as fig
from tidebar.plans import catalog, paths, research
from tidebar.plans import figures as figure_plans
from tidebar.plans import micro as micro_plans
from tidebar.sources import bars as src
from tidebar.sources import feed, files
from tidebar.streaming import live

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    same(spark, catalog.queries()[name], catalog.oracle_sql()[name], SMALL)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    """Besides the tests that hold each of them against plain Python."""
    rows = catalog.queries()[name](spark, "/root/testdata/sf0.01" if name == "figure_zones" else SMALL)
    assert rows.count() > 0


def _bars(spark, rows):
    t0 = dt.datetime(2024, 1, 1)
    data = [(s, t0 + dt.timedelta(hours=i), float(o), float(h), float(lo), float(c), 1) for s, i, o, h, lo, c in rows]
    return spark.createDataFrame(data, "symbol string, time timestamp_ntz, open double, high double, low double, close double, volume long")


def test_both_targets_in_one_bar_are_ambiguous(spark):
    rows = [("A", i, 10, 11, 9, 10.5) for i in range(14)] + [("A", 14, 10, 20, 1, 10)]
    out = touch.both_sides(features.base(_bars(spark, rows))).orderBy("time").collect()
    assert out[13]["buy_label"] == out[13]["sell_label"] == "AMBIGUOUS"
    assert out[0]["buy_label"] == "INVALID" and out[14]["buy_label"] == "NO_TOUCH"


def test_symbols_do_not_mix(spark):
    rows = [("A", i, 1, 2, 0, 1) for i in range(3)] + [("B", i, 100, 200, 50, 100) for i in range(3)]
    firsts = features.base(_bars(spark, rows)).where("row_idx = 1").collect()
    assert len(firsts) == 2 and all(r["ph"] is None for r in firsts)


def test_flat_bars_have_no_ratios(spark):
    out = features.price_blocks(_bars(spark, [("A", i, 5, 5, 5, 5) for i in range(3)])).collect()
    assert all(r["body_pct"] is None and r["body_direction"] == 0 for r in out)


def test_asof_never_looks_ahead(spark):
    left, right = src.event_bars(spark, SMALL), src.event_bars(spark, SMALL, "4 hours")
    right = right.withColumn("at", F.col("time"))
    met = asof.asof_backward(left, right, "symbol", "time", "time", ["at"], "r_", "4 hours")
    assert met.count() == left.count()
    assert met.where("r_at + INTERVAL 4 HOURS > time").count() == 0


def test_parabolic_sar_by_hand():
    sar = sequential.parabolic_sar(np.array([1.0, 2, 3, 4, 5, 3, 2]), np.array([0.5, 1, 2, 3, 4, 1, 0.5]))
    assert (sar[:5] <= [1, 2, 3, 4, 5]).all() and sar[5] == 5.0


def test_recursions_equal_loops_over_blocks(spark):
    """2,500 bars: more than two blocks of the recursion."""
    rng = np.random.default_rng(2)
    close = 100 + np.cumsum(rng.normal(0, 1, 2500))
    high, low = close + rng.random(2500), close - rng.random(2500)
    out = features.smoothed(features.base(_bars(spark, [("A", i, close[i], high[i], low[i], close[i]) for i in range(2500)]))).orderBy("time").toPandas()
    tr = np.maximum(high - low, np.maximum(np.abs(high - np.roll(close, 1)), np.abs(low - np.roll(close, 1))))
    tr[0] = high[0] - low[0]
    atr, fast, slow, signal = tr[:14].mean(), close[0], close[0], None
    for i in range(2500):
        if i >= 14:
            atr = (13 * atr + tr[i]) / 14
        if i:
            fast, slow = fast + 2 / 13 * (close[i] - fast), slow + 2 / 27 * (close[i] - slow)
        if i >= 25:
            signal = fast - slow if signal is None else signal + 0.2 * (fast - slow - signal)
        if i in (13, 100, 1023, 1024, 1500, 2047, 2048, 2499):
            assert out["atr"][i] == pytest.approx(atr, rel=1e-12)
        if i in (40, 1023, 1024, 2048, 2499):
            assert out["macd"][i] == pytest.approx(fast - slow, abs=1e-9) and out["macd_signal"][i] == pytest.approx(signal, abs=1e-9)
    assert out["atr"][:13].isna().all() and out["macd_signal"][:33].isna().all() and out["adx_14"][:27].isna().all() and out["adx_14"][27:].between(0, 100).all()


def test_thinning_keeps_gaps(spark):
    events = spark.createDataFrame([("A", i) for i in (1, 3, 8, 9, 20)], "symbol string, row_idx int")
    assert sorted(r["row_idx"] for r in sequential.thin(events, 6).collect()) == [1, 8, 20]


def test_thinning_is_by_side_and_keeps_events_at_the_gap(spark):
    rows = [("A", s, k) for s, ks in (("UP", (1, 3, 7, 12, 13)), ("DOWN", (2, 7, 8, 14))) for k in ks]
    got = sequential.thin(spark.createDataFrame(rows, "symbol string, break_side string, row_idx int"), 6, ("symbol", "break_side")).collect()
    assert sorted((r["break_side"], r["row_idx"]) for r in got) == [("DOWN", 2), ("DOWN", 8), ("DOWN", 14), ("UP", 1), ("UP", 7), ("UP", 13)]


class _Bar:
    def __init__(self, high, low, close, touch=None, energy=50.0, width=1.0):
        self.high, self.low, self.close, self.atr, self.energy_score, self.range_atr = high, low, close, 1.0, energy, width
        self.breakout_up, self.breakout_down = touch == "UP", touch == "DOWN"
        self.false_breakout_up = self.false_breakout_down = self.sweep_high = self.sweep_low = False


def test_level_memory_by_script():
    """New level, contact, away, second attempt, acceptance, a new cycle, expiry; the state is saved between all bars."""
    bars = [_Bar(10, 9.5, 9.9, "UP"), _Bar(10.1, 9.6, 9.8, "UP"), _Bar(9.7, 9.5, 9.6), _Bar(10.2, 9.7, 10.0, "UP", 60.0, 1.2), _Bar(10.6, 10.1, 10.4), _Bar(10.7, 10.2, 10.5), _Bar(12, 11.5, 11.6, "UP")]
    bars += [_Bar(11, 10.9, 11.0)] * 97 + [_Bar(11, 10.9, 11.0)]
    saved, rows = None, []
    for bar in bars:
        kept = memory.LevelMemory(saved)
        rows.append(kept.step(bar))
        saved = kept.saved()
    first, second, third, fourth = rows[:4]
    assert (first.start, first.cycle, first.attempt, first.reason, first.quality) == (True, 1, 1, "NEW_CYCLE", "FIRST_ATTEMPT")
    assert (second.start, second.cluster, second.age) == (False, 2, 1)
    assert (third.side, third.cycle, third.attempt) == ("NONE", 1, 1)
    assert (fourth.start, fourth.attempt, fourth.quality, fourth.energy_delta) == (True, 2, "IMPROVING", 10.0)
    assert not rows[4].accepted and rows[5].accepted and rows[5].reason == "ACCEPTED_BREAKOUT"
    assert (rows[6].cycle, rows[6].reason) == (2, "NEW_CYCLE")
    assert rows[6 + 96].reason == "NONE" and rows[6 + 97].reason == "LEVEL_EXPIRED"
    both = memory.LevelMemory()
    up = both.step(_Bar(10, 9.0, 9.5, "UP"))
    down = both.step(_Bar(9.4, 8.0, 8.2, "DOWN"))
    assert (up.side, up.cycle, down.side, down.cycle) == ("UP", 1, "DOWN", 2)


def test_streamed_memory_equals_the_batch(spark):
    a, b = ({(r["symbol"], r["time"]): tuple(r) for r in f(spark, SMALL).collect()} for f in (paths.level_memory, paths.stream_level_memory))
    assert a == b and any(r[2] for r in a.values())


def test_failure_episodes_equal_plain_rule(spark):
    bars = {(r["symbol"], r["time"]): r for r in paths._with_memory(spark, SMALL).collect()}
    want, state = {}, {}
    for key in sorted(bars):
        r, st = bars[key], state.setdefault(key[0], {"n": 0, "of": {}, "last": {}, "before": None})
        up, down = r["false_breakout_up"] or r["sweep_high"], r["false_breakout_down"] or r["sweep_low"]
        side = "UP" if up else "DOWN" if down else r["level_attempt_side"]
        level = (side, r["level_cycle_id"]) if side in ("UP", "DOWN") and r["level_cycle_id"] > 0 else None
        fails, new = bool(up or down) and level is not None, False
        if fails and st["before"] != level:
            new, st["n"] = True, st["n"] + 1
            st["of"][level] = st["of"].get(level, 0) + 1
            st["last"][level] = r["row_idx"]
        since = r["row_idx"] - st["last"][level] if level in st["last"] else 9999
        want[key] = (new, side if fails else "NONE", st["n"] if fails else 0, st["of"].get(level, 0) if level else 0, since if level else 9999)
        st["before"] = level if fails else None
    assert {k: (r["failure_episode_start"], r["failure_episode_side"], r["failure_episode_id"], r["failures_on_current_level"], r["bars_since_level_failure"]) for k, r in bars.items()} == want


def test_attempts_equal_plain_rule(spark):
    d = "/root/testdata/sf0.01"
    events = micro_plans._events(spark, d).select("symbol", "side", "row_idx", "level", "atr", "break_mode").collect()
    low, high = {}, {}
    for r in micro_plans.base(spark, d, micro_plans.WIDTH).select("symbol", "row_idx", "low", "high").collect():
        low[r["symbol"], r["row_idx"]], high[r["symbol"], r["row_idx"]] = r["low"], r["high"]
    want, held = set(), {}
    for ev in sorted(events, key=lambda r: (r["symbol"], r["side"], r["row_idx"])):
        key, k = (ev["symbol"], ev["side"]), ev["row_idx"]
        h = held.get(key)
        if h is None or k - h["last"] > micro_plans.MAX_GAP or abs(ev["level"] - h["level"]) / ev["atr"] > micro_plans.EPISODE:
            h = held[key] = {"level": ev["level"], "n": 0, "failed": None}
        recoil = None
        if h["failed"] is not None:
            span = range(h["failed"] + 1, k + 1)
            recoil = (h["level"] - min(low[key[0], j] for j in span)) / ev["atr"] if ev["side"] == "BUY" else (max(high[key[0], j] for j in span) - h["level"]) / ev["atr"]
        h["n"] += 1
        want.add((*key, k, h["n"], None if recoil is None else round(recoil, 6)))
        h["last"] = h["failed"] = k
        if ev["break_mode"] == "CLOSE_BREAK":
            held[key] = None
    got = {(r["symbol"], r["side"], r["row_idx"], r["attempt_number"], r["recoil_before_attempt_atr"]) for r in micro_plans.micro_attempts(spark, d).collect()}
    assert got == want and any(x[3] > 1 for x in got)


def test_zones_equal_plain_fold(spark):
    rng = np.random.default_rng(7)
    rows = []
    for k in range(300):
        cand = [(float(np.round(100 + rng.normal(0, 0.6), 3)) if rng.random() > 0.15 else None, tf, kind) for tf in ("h1", "h4") for kind in fig.WEIGHTS]
        rows.append((k, "UP" if k % 2 else "DOWN", float(100 + rng.normal(0, 0.3)), 1.0 + k % 3, cand))
    df = spark.createDataFrame(rows, "k int, breakout_side string, breakout_boundary double, atr double, candidates array<struct<level:double,tf:string,kind:string>>")
    got = {r["k"]: r for r in fig.zone_context(df, F.col("candidates")).collect()}
    for k, side, edge, atr, cand in rows:
        zones = []
        for level, tf, kind in sorted(x for x in cand if x[0] is not None):
            if not zones or abs(level - zones[-1]["price"]) / atr > fig.MERGE:
                zones.append({"members": [], "price": level})
            z = zones[-1]
            z["members"].append((level, tf, kind))
            if len(z["members"]) > 1:
                z["price"] = sum(x * fig.WEIGHTS[n] for x, _, n in z["members"]) / sum(fig.WEIGHTS[n] for _, _, n in z["members"])
        aligned = [z for z in zones if abs(z["price"] - edge) / atr <= fig.ALIGNED]
        ahead = [z for z in zones if (z["price"] > edge) == (side == "UP") and fig.ALIGNED < abs(z["price"] - edge) / atr <= fig.OBSTACLE]
        assert got[k]["htf_zone_count"] == len(zones)
        assert (got[k]["breakout_zone_price"] is None) == (not aligned) and (got[k]["next_obstacle_price"] is None) == (not ahead)
        if ahead:
            assert got[k]["available_space_atr"] == pytest.approx(min(abs(z["price"] - edge) / atr for z in ahead))


def test_conditions_hold_or_name_what_fails(spark):
    df = spark.createDataFrame([("UP", 1, 0.5, True), (None, 3, None, False)], "side string, n int, x double, flag boolean")
    rule = {"side_in": ["UP", "DOWN"], "n": 1, "x_between": [0.5, 1], "flag": True}
    out = df.select(conditions.compiled(rule).alias("ok"), conditions.failed(rule).alias("why")).collect()
    assert [r["ok"] for r in out] == [True, False] and out[0]["why"] == [] and out[1]["why"] == list(rule)
    assert df.where(conditions.compiled({"side": "UNKNOWN"})).count() == 1


class Waves:
    """A feed of 3,000 bars that refuses more than 700 at once."""

    LENGTH, AT_ONCE = 3000, 700

    def bars(self, symbol, timeframe, start, count):
        return None if count > self.AT_ONCE else [(p,) for p in range(start, min(self.LENGTH, start + count))]


def test_feed_chunks_shrink_and_end():
    sizes = [(at, len(rows)) for at, rows in feed.chunks(Waves(), "A", "M1", 0, 10_000, 5000)]
    assert sizes[0] == (0, 625) and sum(n for _, n in sizes) == Waves.LENGTH and [at for at, _ in sizes] == [sum(n for _, n in sizes[:k]) for k in range(len(sizes))]

    class Empty:
        def bars(self, *args):
            return None

    assert list(feed.chunks(Empty(), "A", "M1", 0, 5)) == []


def test_feed_is_read_by_a_task_a_chunk(spark, tmp_path):
    feed.store(_bars(spark, [("A", i, 1, 2, 0, i) for i in range(50)]), f"file://{tmp_path}/f", "M5", 10)
    spark.dataSource.register(feed.Candles)
    read = spark.read.format("candles").option("feed", "tidebar.sources.feed:Stored").option("arguments", '{"folder": "%s/f", "at_once": 4}' % tmp_path).option("symbols", "A").option("timeframe", "M5")
    df = read.option("count", "35").option("chunk", "10").load()
    rows = sorted((r["position"], r["close"]) for r in df.collect())
    assert df.rdd.getNumPartitions() == 4 and rows == [(p, 49.0 - p) for p in range(1, 36)]
    assert read.option("count", "99").option("live", "true").load().count() == 50


def test_files_are_found_and_written(spark, tmp_path):
    folder = f"file://{tmp_path}"
    for name in ("Gold_M5_old.parquet", "x_gold_m5_new.parquet", "GOLD_H1.parquet"):
        spark.range(1).write.parquet(f"{folder}/{name}")
    assert files.discover(spark, folder, "GOLD", "H1").endswith("GOLD_H1.parquet")
    assert "m5" in files.discover(spark, folder, "GOLD", "M5").lower() and files.discover(spark, folder, "GOLD", "D1") is None
    assert files.existence(spark, folder, "GOLD", ["H1", "M5", "D1"]) == {"found": ["H1", "M5"], "missing": ["D1"]}
    files.write_json(spark, f"{folder}/a.json", {"b": 1, "a": [1, 2]})
    files.write_json(spark, f"{folder}/a.json", {"b": 2, "a": "é"}, pretty=False)
    assert files.read_json(spark, f"{folder}/a.json") == {"a": "é", "b": 2} and files.read_bytes(spark, f"{folder}/a.json").startswith(b'{"a":')
    files.write_bytes(spark, f"{folder}/bom.json", "\ufeff{}".encode())
    assert files.read_json(spark, f"{folder}/bom.json") == {}
    df = spark.createDataFrame([(1, "x|y"), (2, None)], "n int, t string")
    assert files.markdown({"T": df}, 1).splitlines() == ["## T", "", "| n | t |", "|-|-|", "| 1 | x\\|y |"]
    files.append_jsonl(df, f"{folder}/log")
    files.append_jsonl(df, f"{folder}/log")
    assert spark.read.json(f"{folder}/log").count() == 4


def test_folders_are_pruned_and_filters_pushed(spark, tmp_path):
    bars = src.conform(src.event_bars(spark, SMALL)).withColumn("timeframe", F.lit("H1"))
    src.write_bars(bars, str(tmp_path / "b"))
    plan = spark.read.parquet(str(tmp_path / "b")).where("symbol = 'click' AND volume >= 2")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(symbol" in plan and "GreaterThanOrEqual(volume,2)" in plan


def test_multi_line_json_and_other_volumes(spark, tmp_path):
    (tmp_path / "a.json").write_text('[\n {"time": "2024-01-01 00:00:00",\n "close": 1.5, "tick_volume": 7}\n]')
    row = src.read_bars(spark, str(tmp_path / "a.json"), "json", multi_line=True).first()
    assert (row["close"], row["volume"]) == (1.5, 7)


def test_live_bars_and_changes(spark):
    b = _bars(spark, [("A", i, 10, 11, 9, 10) for i in range(3)] + [("A", 3, 10, 12, 9, 10)])
    now = F.lit(dt.datetime(2024, 1, 1, 3, 15)).cast("timestamp_ntz")
    marked = levels.mark_live(b, now, 3600)
    assert [r["is_live_bar"] for r in marked.orderBy("time").collect()] == [0, 0, 0, 1] and src.drop_live(marked).count() == 3
    assert src.drop_unchanged(b).count() == 2
    out = levels.live_context(features.bar_flags(features.base(marked)), now, 3600).orderBy("time").collect()[-1]
    assert out["elapsed_bar_ratio"] == 0.25 and out["projected_final_volume"] == 4.0 and out["live_bar_classification"] == "FALSE_BREAKOUT_UP"
    assert spark.range(1).select(live.freshness(F.lit("2024-01-01 00:00:00").cast("timestamp"), F.lit("2024-01-01 01:00:00").cast("timestamp"))).first()[0] == "STALE"


def test_figure_zones_have_rows(spark):
    assert figure_plans.figure_zones(spark, "/root/testdata/sf0.01").count() == figure_plans.figure_breakouts(spark, "/root/testdata/sf0.01").count() > 0


def test_dna_success_rule(spark):
    ev = research._break_events(spark, SMALL).where("break_side = 'UP'").collect()
    assert ev and all(r["success_15"] == (r["mfe_15"] >= 0.5 and r["mfe_15"] > r["mae_15"]) for r in ev)


def test_empty_bars(spark):
    assert features.structure(features.base(_bars(spark, []))).count() == 0


def test_conform_finds_time_and_drops_nan(spark):
    df = spark.createDataFrame([("A", "2024-01-01 00:00:00", float("nan"))], "symbol string, event_time string, close double")
    row = src.conform(df).collect()[0]
    assert row["close"] is None and row["time"] == dt.datetime(2024, 1, 1)


def test_bars_round_trip(spark, tmp_path):
    bars = src.conform(src.event_bars(spark, SMALL)).withColumn("timeframe", F.lit("H1"))
    src.write_bars(bars, str(tmp_path / "b"))
    assert src.read_bars(spark, str(tmp_path / "b")).count() == bars.count()
