"""Connected components of a graph given by its links, by rounds of large and small stars.

Each round hangs every node's larger neighbours on its smallest one, then the same for smaller neighbours, until links no
longer change; then each node hangs on the smallest of its component. Links are counted and hashed, never collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.llm.store import cut, drop


def _state(links: DataFrame) -> tuple[int, int]:
    got = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return got[0], got[1]


def _large(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(links: DataFrame) -> DataFrame:
    # Here u > v in every link.
    low = links.groupBy("u").agg(F.min("v").alias("m"))
    hung = links.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def roots(links: DataFrame, name: str = "components") -> DataFrame:
    """node and root (the smallest node of its component) for every node of a link (u, v: longs) other than a root itself."""
    now = cut(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    state = _state(now)
    while True:
        after = cut(_small(_large(now)), name)
        drop(now)
        now, before, state = after, state, _state(after)
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
