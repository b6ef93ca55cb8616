"""Memory of tested levels: a state machine over the bars of one symbol, for whole series and for streams.

Resistance and support are followed on their own. A bar touches resistance if it breaks out upwards, falsely or not, or
sweeps a high; support likewise. A touch far from the level that is held opens a cycle; touches in a row are one contact; a
return counts as a new attempt once price went away and enough bars passed; two closes in a row well beyond the level accept
the break and end the cycle; a level that nothing touched for `max_age` bars expires.
"""

from __future__ import annotations

import dataclasses
import json
import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebar.functions.exprs import bins, flag, past, series
from tidebar.operators.sequential import in_order

INPUT = ("symbol", "time", "high", "low", "close", "atr", "energy_score", "range_atr", "breakout_up", "breakout_down", "false_breakout_up", "false_breakout_down", "sweep_high", "sweep_low")
OUTPUT = "symbol string, time timestamp_ntz, level_attempt_start boolean, level_attempt_side string, level_cycle_id long, level_price double, level_attempt_number long, level_attempt_cluster_length long, level_reset_reason string, level_age_bars long, distance_from_level_atr double, accepted_breakout boolean, attempt_energy_delta double, attempt_range_delta double, attempt_quality string"

c = F.col

#: Distances in atr, ages in bars.
TOLERANCE, AWAY, ACCEPTANCE, REENTRY, MAX_AGE, ACCEPTING_BARS = 0.30, 0.35, 0.30, 2, 96, 2
#: Bars of a level's last touch and attempt before there was one.
NEVER = -10_000


@dataclasses.dataclass
class Level:
    """What is known of one side's level; `cycle` 0 means that none is held."""

    cycle: int = 0
    price: float = math.nan
    attempt: int = 0
    touched: int = NEVER
    attempted: int = NEVER
    born: int = -1
    contact: bool = False
    away: bool = False
    beyond: int = 0
    cluster: int = 0
    energy: float = math.nan
    range: float = math.nan


@dataclasses.dataclass
class Row:
    """What a bar shows; a later side's values stand over an earlier one's."""

    start: bool = False
    side: str = "NONE"
    cycle: int = 0
    price: float = math.nan
    attempt: int = 0
    cluster: int = 0
    reason: str = "NONE"
    age: int = 0
    distance: float = math.nan
    accepted: bool = False
    energy_delta: float = math.nan
    range_delta: float = math.nan
    quality: str = "NO_NEW_ATTEMPT"


def _quality(energy: float, width: float) -> str:
    if energy > 5 and width > 0.10:
        return "IMPROVING"
    return "WEAKENING" if energy < -5 and width < -0.10 else "STABLE"


class LevelMemory:
    """Bars go in one by one, in order; the state can be saved as text between them."""

    def __init__(self, saved: str | None = None):
        state = json.loads(saved) if saved else {"bar": 0, "cycles": 0, "UP": {}, "DOWN": {}}
        self.bar, self.cycles = state["bar"], state["cycles"]
        self.levels = {s: Level(**state[s]) for s in ("UP", "DOWN")}

    def saved(self) -> str:
        return json.dumps({"bar": self.bar, "cycles": self.cycles, **{s: dataclasses.asdict(x) for s, x in self.levels.items()}})

    def step(self, bar) -> Row:
        """bar: has the fields of INPUT."""
        row = Row()
        up = bool(bar.breakout_up or bar.false_breakout_up or bar.sweep_high)
        down = bool(bar.breakout_down or bar.false_breakout_down or bar.sweep_low)
        self._side(row, "UP", bar, up)
        opened, shown = row.start, dataclasses.replace(row)
        self._side(row, "DOWN", bar, down)
        if opened and not down:  # an attempt from below stands, whatever the other side tells of its level
            row = dataclasses.replace(shown, start=row.start, accepted=row.accepted)
        self.bar += 1
        return row

    def _side(self, row: Row, side: str, bar, touch: bool) -> None:
        atr, probe = _number(bar.atr), _number(bar.high if side == "UP" else bar.low)
        if not atr > 0 or math.isinf(atr) or not math.isfinite(probe):
            return
        sign, i = (1 if side == "UP" else -1), self.bar
        level = self.levels[side]
        if level.cycle and i - level.touched > MAX_AGE:
            level = self.levels[side] = Level()
            row.reason = "LEVEL_EXPIRED"
        if level.cycle:
            row.distance, row.age = (bar.close - level.price) / atr, max(0, i - level.born)
            far = bar.low if side == "UP" else bar.high
            level.away |= sign * (level.price - far) >= AWAY * atr
            level.beyond = level.beyond + 1 if sign * (bar.close - level.price) >= ACCEPTANCE * atr else 0
            if level.beyond >= ACCEPTING_BARS:
                row.accepted, row.reason = True, "ACCEPTED_BREAKOUT"
                self.levels[side] = Level()
                return
        if not touch:
            if level.cycle:
                level.contact, level.cluster = False, 0
                row.cycle, row.price, row.attempt = level.cycle, level.price, level.attempt
            return
        energy, width = _number(bar.energy_score), _number(bar.range_atr)
        if not level.cycle or not abs(probe - level.price) <= TOLERANCE * atr:
            self.cycles += 1
            row.start, row.reason = True, "NEW_LEVEL" if level.cycle else "NEW_CYCLE"
            level = self.levels[side] = Level(self.cycles, probe, 1, i, i, i, True, cluster=1, energy=energy, range=width)
        elif level.contact:
            level.touched, level.cluster = i, level.cluster + 1
        elif level.away and i - level.attempted >= REENTRY:
            row.start = True
            if math.isfinite(level.energy):
                row.energy_delta = energy - level.energy
            if math.isfinite(level.range):
                row.range_delta = width - level.range
            row.quality = _quality(row.energy_delta, row.range_delta)
            level.attempt, level.touched, level.attempted, level.contact, level.away, level.beyond, level.cluster = level.attempt + 1, i, i, True, False, 0, 1
            level.energy, level.range = energy, width
        else:  # back too soon: still the same contact
            level.contact, level.touched, level.cluster = True, i, max(1, level.cluster + 1)
        row.side, row.cycle, row.price, row.attempt, row.cluster = side, level.cycle, level.price, level.attempt, level.cluster
        row.age, row.distance = max(0, i - level.born), (bar.close - level.price) / atr
        if row.start and row.quality == "NO_NEW_ATTEMPT":
            row.quality = "FIRST_ATTEMPT" if level.attempt == 1 else "STABLE"


def _number(x) -> float:
    return math.nan if x is None else float(x)


def rows_of(memory: LevelMemory, bars: pd.DataFrame) -> pd.DataFrame:
    """The rows of bars in the order of time; moves the memory on."""
    bars = bars.sort_values("time")
    out = pd.DataFrame([dataclasses.astuple(memory.step(b)) for b in bars.itertuples(index=False)], columns=[f.partition(" ")[0] for f in OUTPUT.split(", ")][2:])
    out.insert(0, "time", bars["time"].to_numpy())
    out.insert(0, "symbol", bars["symbol"].to_numpy())
    return out.astype(object).where(out.notna(), None)


def level_memory(bars: DataFrame) -> DataFrame:
    """A row per bar, from bars with the columns of INPUT: batch by batch in the order of time, the memory carried on."""
    return without_nan(in_order(bars.select(*INPUT), ["symbol"], ["time"], LevelMemory, rows_of, OUTPUT))


def without_nan(df: DataFrame) -> DataFrame:
    return df.withColumns({n: F.when(~F.isnan(c(n)), c(n)) for n, t in df.dtypes if t == "double"})


def failures(b: DataFrame) -> DataFrame:
    """Episodes of failure (false breaks and sweeps) at the level of each row, from bars joined with level_memory.

    Failures in a row at the same level are one episode. Rows without a failure show the level of their own side.
    """
    w = series()
    up, down = F.greatest("false_breakout_up", "sweep_high") == 1, F.greatest("false_breakout_down", "sweep_low") == 1
    side = F.when(up, "UP").when(down, "DOWN").otherwise(c("level_attempt_side"))
    b = b.withColumns({"_fails": up | down, "_side": side})
    b = b.withColumn("_key", F.when(c("_side").isin("UP", "DOWN") & (c("level_cycle_id") > 0), F.concat_ws("|", "_side", c("level_cycle_id").cast("string"))))
    failing = F.when(c("_fails"), c("_key"))
    b = b.withColumn("_active", failing)
    new = F.coalesce(c("_active").isNotNull() & ~c("_active").eqNullSafe(F.lag("_active").over(w)), F.lit(False))
    b = b.withColumn("failure_episode_start", new)
    of_level = Window.partitionBy("symbol", "_key").orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    count = F.sum(c("failure_episode_start").cast("long"))
    last = F.max(F.when(c("failure_episode_start"), c("row_idx"))).over(of_level)
    known = c("_key").isNotNull()
    b = b.withColumns(
        {
            "failure_episode_side": F.when(c("_active").isNotNull(), c("_side")).otherwise("NONE"),
            "failure_episode_id": F.when(c("_active").isNotNull(), count.over(w.rowsBetween(Window.unboundedPreceding, 0))).otherwise(0),
            "failures_on_current_level": F.when(known, count.over(of_level)).otherwise(0),
            "bars_since_level_failure": F.when(known & last.isNotNull(), c("row_idx") - last).otherwise(9999).cast("long"),
        }
    )
    names = ("NO_RECENT_FAILURE", "ONE_RECENT_FAILURE", "TWO_RECENT_FAILURES", "THREE_PLUS_FAILURES")
    return b.withColumn("failure_memory_bucket", bins(c("failures_on_current_level"), (0, 1, 2), names)).drop("_fails", "_side", "_key", "_active")




def bars_since(event: Column, cap: int = 9999) -> Column:
    """Bars since the event was last true, 0 in its bar, the cap before the first."""
    run = series().rowsBetween(Window.unboundedPreceding, 0)
    return F.coalesce(F.least(c("row_idx") - F.max(F.when(event, c("row_idx"))).over(run), F.lit(cap)), F.lit(cap)).cast("long")


def since_bucket(x: Column, prefix: str) -> Column:
    return bins(x, (0, 3, 6, 12, 24, 48), [f"{prefix}_{n}" for n in ("NOW", "1_3", "4_6", "7_12", "13_24", "25_48", "OLD_NONE")])


def conditions(b: DataFrame) -> DataFrame:
    """Ages, counts and the condition of memory by priority, from bars joined with level_memory and failures."""
    w = series()
    run = w.rowsBetween(Window.unboundedPreceding, 0)

    def first(name: str) -> Column:
        return (c(name) == 1) & (F.coalesce(F.lag(name).over(w), F.lit(0)) == 0)

    b = b.withColumns({"_fbu": first("false_breakout_up"), "_fbd": first("false_breakout_down"), "_swh": first("sweep_high"), "_swl": first("sweep_low"), "_start": flag(c("level_attempt_start"))})
    b = b.withColumns({"false_break_episode_start": c("_fbu") | c("_fbd"), "sweep_episode_start": c("_swh") | c("_swl"), "_tries": F.sum("_start").over(run)})
    b = b.withColumns(
        {
            "bars_since_breakout": bars_since((c("breakout_up") == 1) | (c("breakout_down") == 1)),
            "bars_since_breakout_episode": bars_since(c("level_attempt_start")),
            "bars_since_false_break": bars_since(c("false_break_episode_start")),
            "bars_since_sweep": bars_since(c("sweep_episode_start")),
            **{f"breakout_episodes_{k}": F.sum("_start").over(past(k)) for k in (12, 24, 48)},
            "recent_failure_count_24": F.sum(c("failure_episode_start").cast("long")).over(past(24)),
            **{f"attempts_since_{n}": c("_tries") - F.coalesce(F.last(F.when(c(x), c("_tries")), True).over(run), F.lit(0)) for n, x in (("false_break", "false_break_episode_start"), ("sweep", "sweep_episode_start"), ("level_failure", "failure_episode_start"))},
        }
    )
    b = b.withColumns({"since_breakout_bucket": since_bucket(c("bars_since_breakout_episode"), "BO"), "since_false_break_bucket": since_bucket(c("bars_since_false_break"), "FB"), "since_sweep_bucket": since_bucket(c("bars_since_sweep"), "SW"), "since_level_failure_bucket": since_bucket(c("bars_since_level_failure"), "LF")})
    attempt = bins(c("level_attempt_number"), (0, 1, 2, 3), ("NO_ATTEMPT", "FIRST_ATTEMPT", "SECOND_ATTEMPT", "THIRD_ATTEMPT", "FOURTH_PLUS"))
    b = b.withColumn("attempt_bucket", attempt)
    touch = F.greatest("breakout_up", "false_breakout_up", "sweep_high", "breakout_down", "false_breakout_down", "sweep_low") == 1
    start = c("level_attempt_start")
    ladder = (
        (start & (c("attempt_bucket") == "FIRST_ATTEMPT") & (c("failure_memory_bucket") == "NO_RECENT_FAILURE"), "CLEAN_FIRST_ATTEMPT"),
        (start & (c("attempt_bucket") == "SECOND_ATTEMPT"), "SECOND_LEVEL_ATTEMPT"),
        (start & (c("attempt_bucket") == "THIRD_ATTEMPT"), "THIRD_LEVEL_ATTEMPT"),
        (start & (c("attempt_bucket") == "FOURTH_PLUS"), "FOURTH_PLUS_PRESSURE"),
        (start & (c("attempt_quality") == "IMPROVING"), "IMPROVING_LEVEL_ATTEMPT"),
        (start & (c("attempt_quality") == "WEAKENING"), "WEAKENING_LEVEL_ATTEMPT"),
        (c("accepted_breakout"), "ACCEPTED_LEVEL_BREAK"),
        (touch, "ACTIVE_LEVEL_CONTACT"),
        (c("bars_since_false_break") <= 6, "RECENT_FALSE_BREAK_MEMORY"),
        (c("bars_since_sweep") <= 6, "RECENT_SWEEP_MEMORY"),
    )
    kind = F.when(F.lit(False), "")
    for test, name in ladder:
        kind = kind.when(test, name)
    return b.withColumn("memory_condition", kind.otherwise("NEUTRAL_MEMORY")).drop("_fbu", "_fbd", "_swh", "_swl", "_start", "_tries")
