"""Linear recursions along a series as windows: acc[i] = keep * acc[i - 1] + y[i], for any keep below 1.

Rows are dealt to blocks of BLOCK by their place (shorter ones for a keep so small that its powers leave a double's range). Inside a block the recursion is a running sum of y[i] / keep ** i, and what
came before counts as the value at the end of the block before, times keep for every row since. Where keep ** BLOCK is below
the precision of doubles (a keep up to about 0.961, a span of 50) the block before is all that counts. For a larger keep the
ends of blocks are added up the same way once more, over groups of blocks whose powers stay inside a double's range, and with
the end of the group before; what older groups add is below 1e-200. So a series needs no loop, and running sums are taken a
block at a time.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1024
#: A block's factor below which older blocks add nothing, and the largest power of e that a block or a group of blocks may reach.
NOTHING, REACH = 1e-17, 500.0


def linear(df: DataFrame, terms: dict[str, tuple[Column, float]], by: str = "symbol") -> DataFrame:
    """df (with row_idx from 1 without gaps, else the query fails) and a column for each (y, keep); a null y counts as 0."""
    if wrong := [n for n, (_, keep) in terms.items() if not 0 < keep < 1]:
        raise ValueError(f"keep must lie between 0 and 1: {wrong}")
    sizes: dict[int, dict] = {}
    for n, (y, keep) in terms.items():
        fits = int(REACH / -math.log(keep))
        sizes.setdefault(min(BLOCK, 1 << max(0, fits.bit_length() - 1)), {})[n] = (y, keep)
    for block, some in sizes.items():
        df = _blocked(df, some, by, block)
    return df


def _blocked(df: DataFrame, terms: dict[str, tuple[Column, float]], by: str, block: int) -> DataFrame:
    place = (F.col("row_idx") - 1) % block
    out = df.withColumn("_block", F.floor((F.col("row_idx") - 1) / block))
    out = out.withColumns({f"_y_{n}": F.coalesce(y, F.lit(0.0)) * F.pow(F.lit(keep), -place) for n, (y, keep) in terms.items()})
    here = Window.partitionBy(by, "_block").orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(by).orderBy("time").rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumns({f"_in_{n}": F.sum(f"_y_{n}").over(here) * F.pow(F.lit(keep), place) for n, (_, keep) in terms.items()})
    last = {n: F.when(place == block - 1, F.col(f"_in_{n}")) for n in terms}
    deep = {n: keep for n, (_, keep) in terms.items() if keep**block > NOTHING}
    for n, keep in deep.items():
        # The value at a block's end with all blocks of its group: what last holds is a block's own part of it.
        size = max(2, int(REACH / (-block * math.log(keep))))
        nth = F.col("_block") % size
        group = Window.partitionBy(by, F.floor(F.col("_block") / size)).orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumn(f"_end_{n}", F.sum(last[n] * F.pow(F.lit(keep), -block * nth)).over(group) * F.pow(F.lit(keep), block * nth))
        whole = F.when((place == block - 1) & (nth == size - 1), F.col(f"_end_{n}"))
        out = out.withColumn(f"_old_{n}", F.coalesce(F.last(whole, True).over(before), F.lit(0.0)))
        last[n] = F.when(place == block - 1, F.col(f"_end_{n}") + F.col(f"_old_{n}") * F.pow(F.lit(keep), block * (nth + 1)))
    out = out.withColumns({f"_before_{n}": F.coalesce(F.last(x, True).over(before), F.lit(0.0)) for n, x in last.items()} | {"_rows": F.count("*").over(before)})
    sure = F.when(F.col("_rows") + 1 == F.col("row_idx"), 1.0).otherwise(F.raise_error(F.lit("row_idx must count the rows of a series from 1")).cast("double"))
    out = out.withColumns({n: (F.col(f"_in_{n}") + F.col(f"_before_{n}") * F.pow(F.lit(keep), place + 1)) * sure for n, (_, keep) in terms.items()})
    return out.drop("_block", "_rows", *(f"{p}_{n}" for n in terms for p in ("_y", "_in", "_before")), *(f"{p}_{n}" for n in deep for p in ("_end", "_old")))


def ewm(x: Column, alpha: float, first: int = 1) -> tuple[Column, float]:
    """The term of acc += alpha * (x - acc) that begins with x at row `first`."""
    n = F.col("row_idx")
    return F.when(n == first, x).when(n > first, alpha * x), 1 - alpha


def wilder(x: Column, width: int, first: int = 1) -> tuple[Column, float]:
    """The term of Wilder's mean: that of the first `width` values, then (width - 1) parts of the old one and one of the new."""
    from tidebar.functions.exprs import past

    n, seed = F.col("row_idx"), first + width - 1
    return F.when(n == seed, F.avg(x).over(past(width))).when(n > seed, x / width), 1 - 1 / width


def wilder_sum(x: Column, width: int, first: int = 1) -> tuple[Column, float]:
    """The same for sums: that of the first `width` values, then less one part in `width`, plus the new value."""
    y, keep = wilder(x, width, first)
    return y * width, keep
