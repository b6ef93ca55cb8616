"""Column expressions with the null rules of the engine: flags are false, not null, while a window warms up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

TINY = 1e-9


def past(n: int, by: str = "symbol", order: str = "time"):
    """The last n rows, this one included."""
    return Window.partitionBy(by).orderBy(order).rowsBetween(-(n - 1), 0)


def ahead(n: int, first: int = 1, by: str = "symbol", order: str = "time"):
    """The next rows, from number `first` to n."""
    return Window.partitionBy(by).orderBy(order).rowsBetween(first, n)


def series(by: str = "symbol", order: str = "time"):
    return Window.partitionBy(by).orderBy(order)


def full(value: Column, n: int, rows: Column) -> Column:
    """Null before n rows are there."""
    return F.when(rows >= n, value)


def guarded(a: Column, b: Column) -> Column:
    """a / (b + 1e-9)."""
    return a / (b + F.lit(TINY))


def over(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return F.try_divide(a, b)


def flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")


def bins(x: Column, edges: Sequence[float], names: Sequence[str], missing: str = "UNKNOWN", right: bool = True) -> Column:
    """Names of the intervals that the edges cut: (a, b] if right, else [a, b)."""
    out = F.when(x.isNull(), F.lit(missing))
    for edge, name in zip(edges, names, strict=False):
        out = out.when(x <= edge if right else x < edge, F.lit(name))
    return out.otherwise(F.lit(names[-1]))


def percent_rank(x: Column, by: str = "symbol") -> Column:
    """Rank over count with the average rank for ties, as a share."""
    ties = F.count(x).over(Window.partitionBy(by, x)) - 1
    return F.when(x.isNotNull(), (F.rank().over(Window.partitionBy(by).orderBy(x.asc_nulls_last())) + ties / 2) / F.count(x).over(Window.partitionBy(by)))


def equal_blocks(rank: Column, n: Column, blocks: int) -> Column:
    """Block from 0 of rank 1..n, with the edges that interpolated quantiles give."""
    return F.greatest(F.lit(0), F.ceil(F.try_divide((rank - 1) * blocks, n - 1)) - 1).cast("int")


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    p = F.try_divide(hits, n)
    base = 1 + z * z / n
    mid, half = (p + z * z / (2 * n)) / base, z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / base
    return mid - half, mid + half
