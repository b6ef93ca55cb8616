"""Features and pairs of features that go with an outcome: mined singly, ranked by result, and paired by that ranking.

Numbers become quartiles of the training rows (UNKNOWN where a value is missing, where training has fewer than four different
values, or where two quartiles are equal); everything else is taken as text. All features of an event are one array, so that one pass
over the events deals each to its groups of feature and value, for all horizons at once. A group's first rows in time train, the
others test; both are held against the same periods of all events of the side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col
BUCKETS = ("Q1_LOW", "Q2", "Q3", "Q4_HIGH")
MOST_FEATURES = 8
MEASURES = ("success", "return", "mfe", "mae")


def first_part(place: Column, n: Column, ratio: float) -> Column:
    """Whether a place (from 1) lies in the training part, which and whose rest have a row each where there are two."""
    return place <= F.least(F.greatest(F.floor(n * ratio), F.lit(1)), n - 1)


def with_features(events: DataFrame, texts: Sequence[str], numbers: Sequence[str], ratio: float = 0.70, by: str = "symbol", order: str = "time") -> DataFrame:
    """events with an array column features: (feature, value), numbers as quartiles of each series' training rows."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1
    sizes = events.groupBy(by).agg(F.count("*").alias("_n"))  # a row a series
    train = events.withColumn("_k", place).join(F.broadcast(sizes), by).where(c("_k") < F.floor(c("_n") * ratio))
    long = train.select(by, F.explode(F.array(*(F.struct(F.lit(n).alias("feature"), c(n).cast("double").alias("v")) for n in numbers))).alias("x")).select(by, "x.*").where("v IS NOT NULL AND NOT isnan(v)")
    quarters = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    edges = long.groupBy(by, "feature").agg(F.percentile("v", quarters).alias("q"), F.count_distinct("v").alias("m")).where((c("m") >= 4) & (c("q")[0] < c("q")[1]) & (c("q")[1] < c("q")[2]))
    known = edges.groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct("feature", "q"))).alias("_q"))  # a row a series, of as many entries as features

    def bucket(name: str) -> Column:
        q, x = F.try_element_at("_q", F.lit(name)), c(name).cast("double")
        named = F.when(x <= q[0], BUCKETS[0]).when(x <= q[1], BUCKETS[1]).when(x <= q[2], BUCKETS[2]).otherwise(BUCKETS[3])
        return F.when(q.isNull() | x.isNull() | F.isnan(x), "UNKNOWN").otherwise(named)

    values = {n: F.coalesce(c(n).cast("string"), F.lit("UNKNOWN")) for n in texts} | {n: bucket(n) for n in numbers}
    rows = events.join(F.broadcast(known), by, "left")
    return rows.withColumn("features", F.array(*(F.struct(F.lit(n).alias("feature"), v.alias("value")) for n, v in values.items()))).drop("_q")


def measured(groups: DataFrame, keys: Sequence[str], ratio: float = 0.70, by: Sequence[str] = ("symbol", "horizon", "side")) -> DataFrame:
    """Metrics of each group (`by` and keys) in its training and its test part, from rows with time and MEASURES (success as a number)."""
    of = Window.partitionBy(*by, *keys)
    rows = groups.withColumns({"_k": F.row_number().over(of.orderBy("time")), "_n": F.count("*").over(of)}).withColumn("_train", first_part(c("_k"), c("_n"), ratio))
    parts = {"train": c("_train"), "test": ~c("_train")}
    return rows.groupBy(*by, *keys).agg(*(x for p, on in parts.items() for x in (F.count_if(on).alias(f"{p}_n"), *(F.avg(F.when(on, c(m))).alias(f"{p}_{m}") for m in MEASURES), F.percentile(F.when(on, c("return")), F.lit(0.5)).alias(f"{p}_median_return"))))


def baselines(events: DataFrame, ratio: float = 0.70, by: Sequence[str] = ("symbol", "horizon", "side")) -> DataFrame:
    """Success and return of all events of a side in its training and its test part; sides of one event are left out."""
    of = Window.partitionBy(*by)
    rows = events.withColumns({"_k": F.row_number().over(of.orderBy("time")), "_n": F.count("*").over(of)}).where("_n >= 2").withColumn("_train", first_part(c("_k"), c("_n"), ratio))
    return rows.groupBy(*by).agg(*(F.avg(F.when(on, c(m))).alias(f"{p}_{m}_base") for p, on in (("train", c("_train")), ("test", ~c("_train"))) for m in ("success", "return")))


def judged(groups: DataFrame, base: DataFrame, least: tuple[int, int], lift: tuple[float, float] = (0.03, 0.05), by: Sequence[str] = ("symbol", "horizon", "side")) -> DataFrame:
    """Groups with their lifts over the side's baselines and a status."""
    j = groups.join(F.broadcast(base), list(by))  # a row a series, horizon and side
    j = j.withColumns({f"{p}_{m}_lift": c(f"{p}_{m}") - c(f"{p}_{m}_base") for p in ("train", "test") for m in ("success", "return")})
    status = F.when(F.lit(False), "")
    enough = (c("train_n") >= least[0]) & (c("test_n") >= least[1])
    for sign, name in ((1, "ROBUST_POSITIVE"), (-1, "ROBUST_NEGATIVE")):
        test = enough
        for p in ("train", "test"):
            test = test & (sign * c(f"{p}_success_lift") >= lift[0]) & (sign * c(f"{p}_return_lift") >= lift[1]) & (sign * c(f"{p}_return") > 0)
        status = status.when(test, name)
    return j.withColumn("candidate_status", status.otherwise("NOT_ROBUST"))


def ranked(singles: DataFrame, most: int = MOST_FEATURES, by: str = "symbol") -> DataFrame:
    """The features of each series with robust groups by score, the best `most` of them; ties: by name."""
    g = singles.where("candidate_status <> 'NOT_ROBUST'").groupBy(by, "feature").agg(F.count("*").alias("robust_count"), F.avg(F.abs("test_success_lift")).alias("mean_success_lift"), F.avg(F.abs("test_return_lift")).alias("mean_return_lift"))
    g = g.withColumn("score", c("robust_count") + c("mean_success_lift") + c("mean_return_lift"))
    return g.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(c("score").desc(), "feature"))).where(c("place") <= most)


def paired(events: DataFrame, ranks: DataFrame, by: str = "symbol") -> DataFrame:
    """A row for each event and pair of ranked features (the better ranked first), with both values."""
    names = ranks.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("place", "feature"))).alias("_names"))  # a row a series
    values = F.map_from_entries("features")
    rows = events.join(F.broadcast(names), by).withColumn("_v", values)
    pair = lambda a: F.transform(F.filter("_names", lambda b: b["place"] > a["place"]), lambda b: F.struct(a["feature"].alias("feature_1"), b["feature"].alias("feature_2"), F.try_element_at("_v", a["feature"]).alias("value_1"), F.try_element_at("_v", b["feature"]).alias("value_2")))
    return rows.withColumn("_p", F.explode(F.flatten(F.transform("_names", pair)))).select(*events.columns, "_p.*")
