"""Operators whose state depends on the path and is not linear: rows of a key in their order, batch by batch, with the state carried on.

Cooldown and attempts take one pandas group a key, as they sort by other columns or look back at bars; break-outs are few.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType


def in_order(rows: DataFrame, keys: Sequence[str], order: Sequence[str], begin: Callable[[], object], step: Callable[[object, pd.DataFrame], pd.DataFrame | None], schema: str | StructType) -> DataFrame:
    """step(state, part) over the rows of each key in their order, batch by batch: a key's rows need not fit into memory.

    begin() makes a key's state; step changes it and returns rows. A partition is sorted by key and order, so a key's batches follow
    each other, and only its state goes from one to the next.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, now = None, None
        for batch in batches:
            own = batch[list(keys)].astype(object).where(batch[list(keys)].notna(), None)
            names = list(zip(*(own[k] for k in keys), strict=True))
            first = 0
            for at in [*(k for k in range(1, len(names)) if names[k] != names[k - 1]), len(names)]:
                if first < at:
                    if state is None or names[first] != now:
                        state, now = begin(), names[first]
                    out = step(state, batch.iloc[first:at])
                    if out is not None and len(out):
                        yield out
                first = at

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


class Sar:
    """The parabolic stop, moved on by bars in their order."""

    def __init__(self, step: float = 0.02, most: float = 0.2):
        self.step, self.most, self.past = step, most, []

    def values(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        out = np.full(len(high), np.nan)
        for i, (h, lo) in enumerate(zip(high.tolist(), low.tolist(), strict=True)):
            if not self.past:
                self.up, self.speed, self.extreme, self.sar = True, self.step, h, lo
            else:
                self.sar += self.speed * (self.extreme - self.sar)
                (h1, l1), (h2, l2) = self.past[-1], self.past[0]
                self.sar = min(self.sar, l1, l2) if self.up else max(self.sar, h1, h2)
                if (self.up and lo < self.sar) or (not self.up and h > self.sar):
                    self.up, self.sar, self.speed, self.extreme = not self.up, self.extreme, self.step, lo if self.up else h
                elif self.up and h > self.extreme or not self.up and lo < self.extreme:
                    self.extreme, self.speed = h if self.up else lo, min(self.most, self.speed + self.step)
            self.past = [*self.past, (h, lo)][-2:]
            out[i] = self.sar
        return out


def parabolic_sar(high: np.ndarray, low: np.ndarray, step: float = 0.02, most: float = 0.2) -> np.ndarray:
    return Sar(step, most).values(np.asarray(high, float), np.asarray(low, float))


def with_sar(bars: DataFrame) -> DataFrame:
    """symbol, time and psar of bars."""

    def step(sar: Sar, part: pd.DataFrame) -> pd.DataFrame:
        return part[["symbol", "time"]].assign(psar=sar.values(part["high"].to_numpy(float), part["low"].to_numpy(float)))

    return in_order(bars.select("symbol", "time", "high", "low"), ["symbol"], ["time"], Sar, step, "symbol string, time timestamp_ntz, psar double")


def kept_apart(places: Sequence, gap, last=None) -> list[int]:
    """Which of ascending places stand `gap` or more after the last one kept (before them: `last`): the next is found by bisection."""
    values = np.asarray(places)
    kept, i = [], 0 if last is None else int(np.searchsorted(values, last + gap, side="left"))
    while i < len(values):
        kept.append(i)
        i = int(np.searchsorted(values, values[i] + gap, side="left"))
    return kept


def thin(events: DataFrame, gap: int | str, keys: tuple[str, ...] = ("symbol",), place: str = "row_idx") -> DataFrame:
    """Of events each whose place is `gap` (a number, or a column that the keys hold) or more after the last one kept of its keys."""

    def step(last: list, part: pd.DataFrame) -> pd.DataFrame:
        values = part[place].to_numpy()
        kept = kept_apart(values, part[gap].iloc[0] if isinstance(gap, str) else gap, last[0])
        if kept:
            last[0] = values[kept[-1]]
        return part.iloc[kept]

    return in_order(events, keys, [place], lambda: [None], step, events.schema)


def cooled(rows: DataFrame, keys: tuple[str, ...], width: str, place: str, shared: bool = True) -> DataFrame:
    """Of break-outs in the order of width and place those later than the last one kept by more than max(2, width // 5) bars.

    shared: the last one kept counts for all widths, so that few of a larger width pass once a smaller one came to the end.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g, kept, last = g.sort_values([width, place]), [], {}
        for i, (w, k) in enumerate(zip(g[width], g[place], strict=True)):
            of = None if shared else w
            if of not in last or k > last[of] + max(2, w // 5):
                kept.append(i)
                last[of] = k
        return g.iloc[kept]

    return rows.groupBy(*keys).applyInPandas(run, rows.schema)


ATTEMPTS = "symbol string, side string, episode int, attempt_number int, event_time timestamp_ntz, row_idx int, level double, event_level double, atr double, break_mode string, accepted boolean, recoil_before_attempt_atr double, recoil_ratio_vs_previous double, compression_before_attempt boolean"


def attempt_episodes(events: DataFrame, bars: DataFrame, max_gap: int, tolerance: float) -> DataFrame:
    """Attempts at one level, in episodes: an event goes on with an episode that is `max_gap` bars old at most and near in level.

    A close beyond the level ends its episode. Before each attempt after a failed one, the recoil is how far price went back
    from the episode's level since; a smaller one than before is compression.
    """
    ends = ["low", "high"]

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("row_idx")
        place = right["row_idx"].to_numpy()
        low, high = (right[n].to_numpy(float) for n in ends)
        out, episode = [], 0
        for side, group in left.groupby("side"):
            open_ = None
            for ev in group.sort_values("row_idx").itertuples(index=False):
                if open_ is None or ev.row_idx - open_["last"] > max_gap or abs(ev.level - open_["level"]) / max(ev.atr, 1e-12) > tolerance:
                    episode += 1
                    open_ = {"level": ev.level, "n": 0, "failed": None, "recoil": np.nan}
                recoil = ratio = np.nan
                tighter = False
                if open_["failed"] is not None:
                    a, b = np.searchsorted(place, [open_["failed"] + 1, ev.row_idx + 1])
                    if b > a:
                        recoil = (open_["level"] - low[a:b].min() if side == "BUY" else high[a:b].max() - open_["level"]) / ev.atr
                        if open_["recoil"] > 0:
                            ratio, tighter = recoil / open_["recoil"], bool(recoil < open_["recoil"])
                accepted = ev.break_mode == "CLOSE_BREAK"
                open_["n"] += 1
                out.append((ev.symbol, side, episode, open_["n"], ev.time, ev.row_idx, open_["level"], ev.level, ev.atr, ev.break_mode, accepted, recoil, ratio, tighter))
                open_ |= {"last": ev.row_idx, "failed": ev.row_idx, "recoil": recoil if np.isfinite(recoil) else open_["recoil"]}
                if accepted:
                    open_ = None
        made = pd.DataFrame(out, columns=[f.partition(" ")[0] for f in ATTEMPTS.split(", ")])
        return made.astype(object).where(made.notna(), None)

    return events.groupBy("symbol").cogroup(bars.select("symbol", "row_idx", *ends).groupBy("symbol")).applyInPandas(run, ATTEMPTS)
