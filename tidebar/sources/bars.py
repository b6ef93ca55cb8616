"""Where bars come from: ticks resampled to open, high, low, close and volume, and files that hold bars already."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType, TimestampNTZType

from tidebar.sources import files

BAR_SCHEMA = StructType(
    [StructField("symbol", StringType()), StructField("timeframe", StringType()), StructField("time", TimestampNTZType())]
    + [StructField(c, DoubleType()) for c in ("open", "high", "low", "close")]
    + [StructField("volume", LongType())]
)
TIME_NAMES = ("time", "event_time", "timestamp", "datetime", "date")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_bars(spark: SparkSession, path: str, kind: str = "parquet", multi_line: bool = False) -> DataFrame:
    """Bars of a Parquet, ORC, CSV or JSON path, conformed to BAR_SCHEMA. CSV columns are read by their header and cast; JSON may hold one object over many lines."""
    reader = spark.read.option("header", True).option("enforceSchema", False) if kind == "csv" else spark.read.option("multiLine", multi_line) if kind == "json" else spark.read
    return conform(reader.format(kind).load(path))


VOLUME_NAMES = ("volume", "tick_volume", "real_volume")


def conform(df: DataFrame) -> DataFrame:
    """The columns of BAR_SCHEMA: time and volume found by name, absent columns null, not-a-number and infinities null."""
    lower = {c.lower(): c for c in df.columns}
    named = {"time": next((lower[n] for n in TIME_NAMES if n in lower), None), "volume": next((lower[n] for n in VOLUME_NAMES if n in lower), None)}
    out = []
    for field in BAR_SCHEMA:
        name = named.get(field.name, lower.get(field.name))
        value = F.col(f"`{name}`").cast(field.dataType) if name else F.lit(None).cast(field.dataType)
        if field.dataType == DoubleType():
            value = F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)
        out.append(value.alias(field.name))
    return df.select(*out)


def write_bars(bars: DataFrame, path: str) -> None:
    """One folder a symbol and timeframe, so that readers prune by both; put in place when it is whole."""
    files.write_table(bars, path, ("symbol", "timeframe"))


def bars_from_ticks(ticks: DataFrame, symbol: Column, ts: Column, price: Column, width: str, order: Column, volume: Column | None = None, spread: Column | None = None) -> DataFrame:
    """Tumbling bars; order tells which of a bar's ticks is first and last. Empty bars are absent. Sums combine map-side. A spread is the last tick's."""
    rows = ticks.select(symbol.alias("symbol"), F.window(ts, width)["start"].alias("time"), price.alias("price"), order.alias("ord"), (F.lit(1) if volume is None else volume).alias("vol"), *([] if spread is None else [spread.alias("spread")]))
    return rows.groupBy("symbol", "time").agg(
        F.min_by("price", "ord").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "ord").alias("close"), F.sum("vol").cast("long").alias("volume"),
        *([] if spread is None else [F.max_by("spread", "ord").alias("spread")]),
    )


def event_bars(spark: SparkSession, sf_dir: str, width: str = "1 hour") -> DataFrame:
    """A symbol for each event type."""
    return bars_from_ticks(table(spark, sf_dir, "events"), F.col("event_type"), F.col("ts"), F.col("value"), width, F.col("event_id"))


def resampled(bars: DataFrame, width: str) -> DataFrame:
    """Bars of a larger width from smaller ones: first, max, min, last and sum. Empty bars are absent."""
    at = F.window("time", width)["start"]
    return bars.groupBy("symbol", at.alias("at")).agg(F.min_by("open", "time").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "time").alias("close"), F.sum("volume").alias("volume")).withColumnRenamed("at", "time")


def walked(bars: DataFrame) -> DataFrame:
    """A price that goes on from bar to bar: the bars' moves (a fiftieth) added up, with a two-hundredth of their wicks.

    For data whose bars do not follow from each other, as chart figures need a price that does.
    """
    w = Window.partitionBy("symbol").orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    move = (F.col("close") - F.col("open")) / 50
    b = bars.withColumns({"_m": move, "_up": (F.col("high") - F.greatest("open", "close")) / 200, "_dn": (F.least("open", "close") - F.col("low")) / 200})
    b = b.withColumn("_at", 100 + F.sum("_m").over(w)).withColumn("_from", F.col("_at") - F.col("_m"))
    return b.select("symbol", "time", F.col("_from").alias("open"), (F.greatest("_from", "_at") + F.col("_up")).alias("high"), (F.least("_from", "_at") - F.col("_dn")).alias("low"), F.col("_at").alias("close"), "volume")


def keep_last(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Of rows with equal keys the last in the given order."""
    last = Window.partitionBy(*keys).orderBy(*[c.desc() for c in order])
    return df.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def drop_live(bars: DataFrame) -> DataFrame:
    """Bars that are over; those without the flag count as over."""
    return bars.where(F.coalesce(F.col("is_live_bar").cast("int"), F.lit(0)) == 0)


def keep_best(df: DataFrame, keys: list[str], quality: str, order: list[Column]) -> DataFrame:
    """Of rows with equal keys the one of the best quality, of these the first in the given order."""
    best = Window.partitionBy(*keys).orderBy(F.col(quality).desc_nulls_last(), *order)
    return df.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def required(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that have all of these columns."""
    return df.dropna(subset=columns)


def of_symbol(df: DataFrame, symbol: str) -> DataFrame:
    """Rows of a symbol, in letters of either case."""
    return df.where(F.upper("symbol") == symbol.upper())


def drop_unchanged(bars: DataFrame) -> DataFrame:
    """Rows whose open, high, low or close differs from the row before."""
    w = Window.partitionBy("symbol").orderBy("time")
    moved = [~F.col(c).eqNullSafe(F.lag(c).over(w)) for c in ("open", "high", "low", "close")]
    return bars.withColumn("_moved", moved[0] | moved[1] | moved[2] | moved[3] | (F.row_number().over(w) == 1)).where("_moved").drop("_moved")
