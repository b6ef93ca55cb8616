"""Entries that a bar offers and what became of them, the cascade that settles unclear ones, and the decision over many.

For each direction a bar has seven entries: at the close with five stops, and two limits behind the close with one stop. An
entry is scanned over coming bars: a limit waits for the bar that fills it; from there on (that bar included) the first bar
that touches target or stop decides, and one that touches both is AMBIGUOUS. The cascade scans what is ambiguous again over
bars of smaller widths, one width after another: only events with a case still open go on, and what a width settles is
written back. A bar of a smaller width with both leaves the case to the next width.

Bars without atr have INVALID entries, which count as attempts but as nothing else.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebar.operators import asof

c = F.col
# Fixed values of the rules: stops and limits in atr, and the least reliability, resolved entries and expectancy of a grade.
STOPS, LIMITS, LIMIT_STOP = (0.4, 0.5, 0.6, 0.75, 1.0), (0.25, 0.5), 0.75
GRADES = (("A", 0.70, 100, 0.10, 0.08), ("B", 0.55, 60, 0.15, 0.04))
#: (variant, mode, how far behind the close, stop), in the order that breaks ties.
ENTRIES = (*((f"stop_{s:g}_atr", "MARKET", 0.0, s) for s in STOPS), *((f"retrace_{x:g}_atr", f"LIMIT_{x:.2f}", x, LIMIT_STOP) for x in LIMITS))


def scanned(bars: Column, case: Column) -> Column:
    """(filled, label) of a case (side, entry, tp, sl, waits) over bars (at, high, low) in order; label is null where nothing is touched."""
    up = case["side"] > 0
    reached = lambda b: F.when(up, b["low"] <= case["entry"]).otherwise(b["high"] >= case["entry"])
    fill = F.when(case["waits"], F.try_element_at(F.filter(bars, reached), F.lit(1))["at"]).otherwise(F.try_element_at(bars, F.lit(1))["at"])
    won = lambda b: F.when(up, b["high"] >= case["tp"]).otherwise(b["low"] <= case["tp"])
    lost = lambda b: F.when(up, b["low"] <= case["sl"]).otherwise(b["high"] >= case["sl"])
    hit = F.try_element_at(F.filter(bars, lambda b: (b["at"] >= fill) & (won(b) | lost(b))), F.lit(1))
    label = F.when(hit.isNull(), None).when(won(hit) & lost(hit), "AMBIGUOUS").when(won(hit), "TP_FIRST").otherwise("SL_FIRST")
    return F.struct(fill.isNotNull().alias("filled"), label.alias("label"))


def with_cases(b: DataFrame, target: float, horizon: int) -> DataFrame:
    """b with an array column cases: (direction, variant, side, entry, tp, sl, waits, label, filled, settled_by)."""
    rows = []
    for way, side in (("UP", 1), ("DOWN", -1)):
        for name, mode, back, stop in ENTRIES:
            entry = c("close") - side * back * c("atr")
            rows.append(F.struct(F.lit(way).alias("direction"), F.lit(name).alias("variant"), F.lit(side).alias("side"), entry.alias("entry"), (entry + side * target * c("atr")).alias("tp"), (entry - side * stop * c("atr")).alias("sl"), F.lit(mode != "MARKET").alias("waits")))
    coming = F.collect_list(F.struct(c("row_idx").cast("long").alias("at"), "high", "low")).over(Window.partitionBy("symbol").orderBy("time").rowsBetween(1, horizon))

    def labelled(case: Column) -> Column:
        got = scanned(c("_coming"), case)
        none = F.when(~case["waits"], "NO_TOUCH").when(got["filled"], "FILLED_NO_EXIT").otherwise("NOT_FILLED")
        sure = F.coalesce(c("atr") > 0, F.lit(False))
        label = F.when(sure, F.coalesce(got["label"], none)).otherwise("INVALID")
        return case.withField("label", label).withField("filled", sure & (got["filled"] | ~case["waits"])).withField("settled_by", F.lit(None).cast("string"))

    return b.withColumn("_coming", coming).withColumn("_cases", F.array(*rows)).withColumn("cases", F.transform("_cases", labelled)).drop("_coming", "_cases")


def _is_open(case: Column) -> Column:
    return case["label"] == "AMBIGUOUS"


def _settled_by(name: str) -> Callable[[Column], Column]:
    """A case after the bars of one width (in _bars): only an open one changes, and only if they settle it."""

    def settled(case: Column) -> Column:
        got = scanned(c("_bars"), case)
        new = _is_open(case) & F.coalesce(got["label"] != "AMBIGUOUS", F.lit(False))
        return case.withField("label", F.when(new, got["label"]).otherwise(case["label"])).withField("settled_by", F.when(new, F.lit(name)).otherwise(case["settled_by"])).withField("filled", case["filled"] | new)

    return settled


def cascade(events: DataFrame, chain: Sequence[tuple[str, DataFrame]], width: str, horizon: int, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """events (symbol, time, cases) with the ambiguous cases settled by the bars of a chain of widths, the largest first.

    Bars of a smaller width count from the end of the event's own bar to the end of its horizon. keep(table, name) writes a table
    and reads it again; each width reads what the one before left open.
    """
    span = F.expr(f"INTERVAL {width}")
    done, now = [], keep(events, "cascade")
    for name, bars in chain:
        unclear = F.exists("cases", _is_open)
        done.append(now.where(~unclear))
        left = now.where(unclear)
        parents = left.select("symbol", c("time").alias("event"), (c("time") + span).alias("t0"), (c("time") + F.expr(f"INTERVAL {width}") * (horizon + 1)).alias("t1"))
        met = asof.within_bars(parents, bars.select("symbol", "time", "high", "low"), "symbol", "t0", "t1", width)
        seen = met.groupBy(c("p.symbol").alias("symbol"), c("p.event").alias("time")).agg(F.sort_array(F.collect_list(F.struct(c("b.time").alias("at"), "high", "low"))).alias("_bars"))

        written = left.join(seen, ["symbol", "time"], "left").withColumn("cases", F.when(c("_bars").isNull(), c("cases")).otherwise(F.transform("cases", _settled_by(name)))).drop("_bars")
        now = keep(written, "cascade")
    for part in done:
        now = now.unionByName(part)
    return now


def ambiguous(before: DataFrame, after: DataFrame) -> DataFrame:
    """A row for each case that was ambiguous before the cascade: direction, variant, label and settled_by (null: still open)."""
    was = before.select("symbol", "time", F.filter("cases", _is_open).alias("cases")).select("symbol", "time", F.explode("cases").alias("x")).select("symbol", "time", "x.direction", "x.variant")
    now = after.select("symbol", "time", F.explode("cases").alias("x")).select("symbol", "time", "x.direction", "x.variant", "x.label", "x.settled_by")
    return was.join(now, ["symbol", "time", "direction", "variant"])


def executed(attempts: DataFrame, target: float, by: Sequence[str]) -> DataFrame:
    """Counts of entries by group, direction and variant over attempts (`by`, direction, cases), with expectancy, coverage and ambiguity."""
    own = F.filter("cases", lambda x: x["direction"] == c("direction"))
    rows = attempts.select(*by, "direction", F.explode(own).alias("x")).select(*by, "direction", "x.variant", "x.label", "x.filled")
    count = lambda n: F.count_if(c("label") == n)
    g = rows.groupBy(*by, "direction", "variant").agg(F.count("*").alias("total"), count("TP_FIRST").alias("tp"), count("SL_FIRST").alias("sl"), count("AMBIGUOUS").alias("amb"), count("NO_TOUCH").alias("nt"), F.count_if("filled").alias("filled"))
    stop, mode, place = (F.create_map(*(v for x in ENTRIES for v in (F.lit(x[0]), F.lit(k(x))))) for k in (lambda x: x[3], lambda x: x[1], ENTRIES.index))
    g = g.withColumns({"stop": stop[c("variant")], "mode": mode[c("variant")], "place": place[c("variant")]})
    limit, resolved = c("mode") != "MARKET", c("tp") + c("sl")
    return g.withColumns(
        {
            "expectancy": (c("tp") * target - c("sl") * c("stop")) / c("total"),
            "coverage": F.when(limit, c("filled") / c("total")).otherwise(1.0),
            "resolved": resolved,
            "ambiguity": F.coalesce(F.try_divide(c("amb"), F.when(limit, c("filled")).otherwise(resolved + c("amb") + c("nt"))), F.lit(0.0)),
            "reliability": c("total") / (c("total") + 100),
        }
    )


def decided(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Of the variants of each group and direction the one of the best expectancy (ties: the first), with its grade; none if it doesn't pay."""
    names = ("variant", "mode", "total", "expectancy", "coverage", "resolved", "ambiguity", "reliability")
    best = rows.groupBy(*by, "direction").agg(F.max_by(F.struct(*names), F.struct("expectancy", -c("place"))).alias("x")).select(*by, "direction", "x.*")
    pays, n = c("expectancy") > 0, c("resolved")
    grade = F.when(~pays, "D")
    for name, reliable, least, unclear, worth in GRADES:
        grade = grade.when((c("reliability") >= reliable) & (n >= least) & (c("ambiguity") <= unclear) & (c("expectancy") >= worth), name)
    grade = grade.when((c("reliability") >= 0.35) & (n >= 25), "C").otherwise("D")
    return best.withColumns({"confidence_grade": grade, "recommended_entry_mode": F.when(pays, c("mode")).otherwise("NO_TRADE"), "recommended_variant": F.when(pays, c("variant"))})
