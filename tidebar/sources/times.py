"""Finding the time of rows whose column and unit are not known: by name, by type, and for numbers by magnitude."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Names in the order in which they are looked for, and from which median on a number counts in a unit.
NAMES = ("event_time", "time", "datetime", "timestamp", "date_time", "date", "open_time", "candle_time")
UNITS = (("ns", 1e17, 1_000_000_000), ("us", 1e14, 1_000_000), ("ms", 1e11, 1_000), ("s", 0.0, 1))
_NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def column_of(df: DataFrame) -> str:
    """The column that holds the time; ValueError with the columns there are if none does."""
    found = next((n for n in NAMES if n in df.columns), None)
    if found is None:
        raise ValueError(f"no column of time: expected one of {', '.join(NAMES)}, found {', '.join(df.columns[:30])}")
    return found


def _median_from(x: Column, edge: float) -> Column:
    """Whether the median of x is `edge` or more, from counts and the two values beside the edge, without a sort."""
    below, n = F.count_if(x < edge), F.count(x)
    middle = (F.max(F.when(x < edge, x)) + F.min(F.when(x >= edge, x))) / 2
    return F.when(2 * below < n, True).when(2 * below > n, False).otherwise(F.coalesce(middle >= edge, F.lit(False)))


def conformed(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """df with event_time as a timestamp, rows without one dropped, and of rows of equal `by` and time the last in the given order.

    Numbers count from 1970 in the unit that the median of their sizes suggests, found in one pass; texts are cast, and one that
    is no time counts as missing, as do numbers that are not finite.
    """
    name = column_of(df)
    kind = dict(df.dtypes)[name]
    if kind.startswith(_NUMERIC):
        x = F.col(name).cast("double")
        size = F.when(~F.isnan(x) & (F.abs(x) != float("inf")), F.abs(x))
        units = df.agg(*(_median_from(size, edge).alias(f"_{u}") for u, edge, _ in UNITS if edge))
        scale = F.lit(1)
        for u, edge, parts in reversed(UNITS):
            scale = F.when(F.col(f"_{u}"), parts).otherwise(scale) if edge else F.lit(parts)
        df = df.join(F.broadcast(units), how="cross")  # one row
        whole = F.col(name).cast("decimal(38,9)") * 1_000_000 / scale
        df = df.withColumn("_at", F.when(size.isNotNull(), F.timestamp_micros(F.floor(whole).cast("long")))).drop(*(f"_{u}" for u, edge, _ in UNITS if edge))
    else:
        df = df.withColumn("_at", F.col(name).try_cast("timestamp"))
    df = df.drop(name).withColumnRenamed("_at", "event_time").where("event_time IS NOT NULL")
    last = Window.partitionBy(*by, "event_time").orderBy(*(x.desc() for x in order))
    return df.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
