"""Live bars from a stream of ticks, and state over a stream of bars. Results go to tables in a shared folder, not to the driver."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidebar.operators import memory


def ticks(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream of Parquet files of ticks. Watermarks need a timestamp with time zone, so ts is cast in UTC."""
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def live_bars(stream: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Bars in update mode; the newest bar of a symbol is the live one. State is dropped behind the watermark."""
    unique = stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return unique.groupBy(F.window("ts", width).alias("w"), F.col("event_type").alias("symbol")).agg(
        F.min_by("value", "event_id").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "event_id").alias("close"), F.count("*").alias("volume")
    ).select("symbol", F.col("w.start").alias("time"), "open", "high", "low", "close", "volume")


def freshness(time: Column, now: Column, minutes: int = 30) -> Column:
    return F.when(F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(time.cast("timestamp")) <= minutes * 60, "FRESH").otherwise("STALE")


def run_once(bars: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Process what is there and return the last version of each bar.

    Each batch is written to a folder of its own number, so that a batch that runs again after a failure writes over itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/n={number}")

    bars.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    out = bars.sparkSession.read.parquet(path)
    newest = F.struct("batch", "volume")
    return out.groupBy("symbol", "time").agg(*[F.max_by(c, newest).alias(c) for c in ("open", "high", "low", "close", "volume")])


_INPUT = "symbol string, time timestamp_ntz, high double, low double, close double, atr double, energy_score double, range_atr double, breakout_up int, breakout_down int, false_breakout_up int, false_breakout_down int, sweep_high int, sweep_low int"


def _remember(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    kept = memory.LevelMemory(state.get[0] if state.exists else None)
    yield memory.rows_of(kept, pd.concat(list(parts), ignore_index=True))  # one batch of one symbol
    state.update((kept.saved(),))


def remembered(spark: SparkSession, source: str, path: str, checkpoint: str, files_a_batch: int | None = None) -> DataFrame:
    """level_memory over a stream of bars: a state of a few numbers a symbol, saved with the checkpoint."""
    reader = spark.readStream.schema(_INPUT)
    bars = (reader.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else reader).parquet(source)
    rows = bars.groupBy("symbol").applyInPandasWithState(_remember, memory.OUTPUT, "saved string", "append", GroupStateTimeout.NoTimeout)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/n={number}")

    rows.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return memory.without_nan(spark.read.schema(memory.OUTPUT).parquet(path).drop("n"))
