"""As-of and interval joins without a look ahead.

Both sides are put under each other and sorted once by key and time; the last right row before each left row is carried as
one struct, so nulls in single columns can't mix rows. One shuffle on the key, linear in both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_backward(left: DataFrame, right: DataFrame, by: str, left_time: str, right_time: str, columns: list[str], prefix: str, closed_after: str | None = None, tolerance_seconds: int | None = None) -> DataFrame:
    """left with the columns of the latest right row at or before its time, named with the prefix.

    closed_after: how long after its time a right row may be seen (its bar's width). tolerance_seconds: older rows count as none.
    """
    known = F.col(right_time) if closed_after is None else F.col(right_time) + F.expr(f"INTERVAL {closed_after}")
    rows = right.select(F.col(by), known.alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType).alias("_left"), F.struct(known.alias("_at"), *columns).alias("_right"))
    both = rows.unionByName(left.select(F.col(by), F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.struct("*").alias("_left"), F.lit(None).cast(rows.schema["_right"].dataType).alias("_right")))
    before = Window.partitionBy(by).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("_seen", F.last("_right", ignorenulls=True).over(before)).where("_side = 1")
    fresh = F.lit(True) if tolerance_seconds is None else F.unix_micros(F.col("_t").cast("timestamp")) - F.unix_micros(F.col("_seen._at").cast("timestamp")) <= tolerance_seconds * 1_000_000
    return met.select("_left.*", *[F.when(fresh, F.col(f"_seen.{name}")).alias(prefix + name) for name in columns])


def within_bars(parents: DataFrame, bars: DataFrame, by: str, start: str, end: str, bucket: str) -> DataFrame:
    """parents ⋈ bars with start <= bar time < end: an equi-join on time buckets that the interval covers, then the exact bounds."""
    width = F.expr(f"INTERVAL {bucket}")
    low = F.window(F.col(start), bucket)["start"]
    spread = parents.withColumn("_slot", F.explode(F.sequence(low, F.col(end), width)))
    slotted = bars.withColumn("_slot", F.window(F.col("time"), bucket)["start"])
    joined = spread.alias("p").join(slotted.alias("b"), [F.col(f"p.{by}") == F.col(f"b.{by}"), F.col("p._slot") == F.col("b._slot")])
    return joined.where((F.col("b.time") >= F.col(f"p.{start}")) & (F.col("b.time") < F.col(f"p.{end}")))
