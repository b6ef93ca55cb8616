"""Windows of bounded frames without a task a series: rows are dealt to blocks of their places, each with the rows it needs around it.

A frame of the last n rows or the next m needs nothing beyond them. So each block of a series gets the last `before` rows of the
block before and the first `after` rows of the next one, becomes a series of its own under a name of its own, and loses them
again when the features are there. A series of any length is spread over as many tasks as it has blocks, for a copy of
(before + after) / size of its rows. Only what looks back without end (running totals, last values, recursions) must stay outside.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SIZE = 8192


def numbered(df: DataFrame, by: str = "symbol", order: str = "time", grain: str = "DAY") -> DataFrame:
    """df with row_idx, the place in its series from 1: places inside a day, after the totals of the days before."""
    rows = df.withColumn("_day", F.date_trunc(grain, F.col(order)))
    totals = rows.groupBy(by, "_day").agg(F.count("*").alias("_rows"))
    before = Window.partitionBy(by).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.withColumn("_start", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows")  # a row a series and day
    inside = F.row_number().over(Window.partitionBy(by, "_day").orderBy(order))
    return rows.withColumn("_in", inside).join(starts, [by, "_day"]).withColumn("row_idx", (F.col("_start") + F.col("_in")).cast("int")).drop("_day", "_in", "_start")


def in_blocks(df: DataFrame, features: Callable[[DataFrame], DataFrame], before: int, after: int = 0, size: int = SIZE, by: str = "symbol") -> DataFrame:
    """features(df), whose frames reach `before` rows back and `after` rows ahead at most, block by block. Needs row_idx."""
    if before > size or after > size:
        raise ValueError(f"frames of {before} and {after} rows don't fit blocks of {size}")
    place, block = (F.col("row_idx") - 1) % size, F.floor((F.col("row_idx") - 1) / size)
    homes = F.array_compact(F.array(block, F.when(place >= size - before, block + 1), F.when((place < after) & (block > 0), block - 1)))
    rows = df.withColumns({"_series": F.col(by), "_home": block, "_block": F.explode(homes)})
    rows = features(rows.withColumn(by, F.concat_ws("#", F.col(by).cast("string"), F.col("_block").cast("string"))))
    return rows.where("_home = _block").withColumn(by, F.col("_series")).drop("_series", "_home", "_block")
