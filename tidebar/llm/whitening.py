"""Whitening of embeddings: principal components from a randomised range finder, rows scaled to unit variance.

The covariance V of all rows is never sampled. One pass counts rows and adds up each dimension in whole numbers. Then a random
block of COMPONENTS + OVERSAMPLE orthonormal columns Q is taken through power passes: each reads all rows, centres them and
adds up V Q, from which Rayleigh-Ritz gives trial components and their residuals. When the residuals of the wanted ones are below
TOLERANCE of the largest variance, they are done; when POWER_PASSES are over, or the rate at which residuals fall says that
they won't get there, Q is expanded to all dimensions, for which one more pass gives V itself and Rayleigh-Ritz all components
to double precision. A last pass measures the covariance of the whitened rows. A task gives one block of dimension by columns,
and blocks are added up by Spark; the driver sees sums of at most dimension squared entries, whatever the number of rows.

Vectors are whole numbers, as a floor on a grid of `scale` steps a unit moved up by `shift` makes them; entries beyond LARGEST
grid steps count as LARGEST. Rows are left out whose vector is null, holds a null, NaN or infinite entry, or is of another length
than most vectors (of lengths that are equally frequent, the longest); so are empty vectors. Repeated rows count as often as they
stand. Components without variance (fewer rows than dimensions, constant vectors) are given with `whitened` null and `explained` 0
(null where nothing varies at all), and are no part of the identity check. A deviation beyond a long is null. An empty table
gives no rows. All other columns are kept by `whiten`, and its own column replaces one of the same name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMPONENTS, OVERSAMPLE, POWER_PASSES = 8, 8, 4
TOLERANCE = 1e-12
SCALE, SHIFT = 1024, 100_000
LARGEST = 2.0**52


@dataclass(frozen=True)
class Whitening:
    """Rows, sums by dimension, range of entries, components in rows by falling variance, and which have any."""

    n: int
    sums: tuple[int, ...]
    least: int
    most: int
    components: np.ndarray
    variances: np.ndarray
    trace: float
    identity_error: float | None
    passes: int
    expanded: bool

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    @property
    def varies(self) -> np.ndarray:
        return self.variances > len(self.sums) * np.finfo(float).eps * self.trace


def on_grid(df: DataFrame, vector_col: str, into: str, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """Rows with a whole vector of the usual length, which `into` holds as whole numbers."""
    size = F.size(vector_col)
    top = df.where(size > 0).groupBy(size.alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    finite = ~F.exists(vector_col, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    kept = df.where((size == (top["size"] if top else 0)) & (size > 0) & F.coalesce(finite, F.lit(False)))
    held = lambda c: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), c.cast("double") * scale))
    return kept.withColumn(into, F.transform(vector_col, lambda c: F.floor(held(c)) + F.lit(shift).cast("long")))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def _sums(rows: DataFrame, vector: str) -> tuple[int, list[int], int, int]:
    """Rows, exact sums by dimension, least and largest entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, least, most = 0, 0, None, None
        for batch in batches:
            if len(batch):
                x = _matrix(batch.column(0))
                low, high = int(x.min()), int(x.max())
                wide = max(abs(low), abs(high)) * len(x) >= 1 << 62
                sums = sums + (x.astype(object) if wide else x).sum(axis=0).astype(object)
                n, least, most = n + len(x), low if least is None else min(least, low), high if most is None else max(most, high)
        if n:
            d = len(sums)
            yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([Decimal(s) for s in sums], pa.decimal128(38, 0)), pa.array([n] * d), pa.array([least] * d, pa.int64()), pa.array([most] * d, pa.int64())], names=["i", "s", "n", "low", "high"])

    parts = rows.select(vector).mapInArrow(run, "i int, s decimal(38,0), n long, low long, high long")
    got = parts.groupBy("i").agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).orderBy("i").collect()
    return (got[0]["n"], [int(r["s"]) for r in got], got[0]["low"], got[0]["high"]) if got else (0, [], 0, 0)


def _added(rows: DataFrame, vector: str, mean: np.ndarray, block: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """The sum over all rows of block(centred rows), a matrix of a fixed shape: one a task, added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if len(batch):
                got = block(_matrix(batch.column(0)) - mean)
                total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(shape[0]), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "v"])

    entries = rows.select(vector).mapInArrow(run, "i int, v array<double>").select("i", F.posexplode("v").alias("j", "v"))
    got = entries.groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros(shape)
    out[got["i"], got["j"]] = got["v"]
    return out


def _covered(rows: DataFrame, vector: str, mean: np.ndarray, n: int, q: np.ndarray) -> tuple[np.ndarray, float]:
    """V Q and the trace of V."""
    d, k = q.shape

    def block(c: np.ndarray) -> np.ndarray:
        # The trace's parts, one a dimension, stand in a column of their own.
        return np.hstack([c.T @ (c @ q), (c * c).sum(axis=0)[:, None]])

    got = _added(rows, vector, mean, block, (d, k + 1)) / n
    return got[:, :k], float(got[:, k].sum())


def ritz(q: np.ndarray, vq: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trial components (in columns) inside Q by falling variance, their variances, and the norms of their residuals."""
    small = q.T @ vq
    values, turn = np.linalg.eigh((small + small.T) / 2)
    values, turn = values[::-1][:k], turn[:, ::-1][:, :k]
    found = q @ turn
    return found, values, np.linalg.norm(vq @ turn - found * values, axis=0)


def fit(rows: DataFrame, vector: str, components: int = COMPONENTS, seed: int = 1) -> Whitening | None:
    """Components of the covariance of all rows of whole-number vectors of one length; None where there are no rows."""
    n, sums, least, most = _sums(rows, vector)
    if not n:
        return None
    d = len(sums)
    k, mean = min(components, d), np.array([s / n for s in sums])
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, min(d, k + OVERSAMPLE))))[0]
    worst, passes, done = np.inf, 0, False
    while not done and passes < POWER_PASSES:
        vq, trace = _covered(rows, vector, mean, n, q)
        passes += 1
        found, values, residuals = ritz(q, vq, k)
        before, worst = worst, float(residuals.max())
        done = q.shape[1] == d or worst <= TOLERANCE * max(values[0], 0)
        falling = worst / before if 0 < before < np.inf else 0.0
        if not done and passes > 1 and worst * falling ** (POWER_PASSES - passes) > TOLERANCE * values[0]:
            break
        q = np.linalg.qr(vq)[0] if not done else q
    if not done:
        q = np.eye(d)
        vq, trace = _covered(rows, vector, mean, n, q)
        passes += 1
        found, values, _ = ritz(q, vq, k)
    model = Whitening(n, tuple(sums), least, most, found.T.copy(), np.maximum(values, 0.0), trace, None, passes, not done)
    return Whitening(**(model.__dict__ | {"identity_error": _identity_error(rows, vector, model)}))


def _project(model: Whitening) -> np.ndarray:
    """Dimension by component, scaled to unit variance; only components that vary."""
    on = model.varies
    return model.components[on].T / np.sqrt(model.variances[on])


def _identity_error(rows: DataFrame, vector: str, model: Whitening) -> float | None:
    """The largest absolute entry of the whitened rows' covariance minus the identity, from one more pass over all rows."""
    scaled = _project(model)
    k = scaled.shape[1]
    if not k:
        return None

    def block(c: np.ndarray) -> np.ndarray:
        w = c @ scaled
        return np.vstack([w.T @ w, w.sum(axis=0)])

    got = _added(rows, vector, model.mean, block, (k + 1, k)) / model.n
    return float(np.abs(got[:k] - np.outer(got[k], got[k]) - np.eye(k)).max())


def whitened(model: Whitening, vector: Column | str) -> Column:
    """An array column: each component's whitened value, null where it doesn't vary."""
    mean, scaled, on = model.mean, _project(model), model.varies

    @F.arrow_udf("array<double>")
    def run(column: pa.Array) -> pa.Array:
        out = np.zeros((len(column), len(on)))
        out[:, on] = (_matrix(column) - mean) @ scaled if len(column) else 0.0
        missing = np.broadcast_to(~on, out.shape).ravel()
        return pa.ListArray.from_arrays(np.arange(len(column) + 1, dtype=np.int32) * len(on), pa.array(out.ravel(), mask=missing))

    return run(vector)


def deviation(model: Whitening, vector: Column | str) -> Column:
    """The exact sum over dimensions of (n x - S)^2, in whole numbers; null beyond a long."""
    n, sums = model.n, model.sums
    step = n * max(abs(model.least), abs(model.most), 1) * 2
    fits = step < 1 << 62 and len(sums) * (n * (model.most - model.least)) ** 2 < 1 << 62

    @F.arrow_udf("long")
    def run(column: pa.Array) -> pa.Array:
        x = _matrix(column) if len(column) else np.zeros((0, len(sums)), np.int64)
        if fits:
            gap = x * n - np.array(sums, np.int64)
            return pa.array((gap * gap).sum(axis=1))
        gap = x.astype(object) * n - np.array(sums, object)
        return pa.array([v if v < 1 << 63 else None for v in (gap * gap).sum(axis=1)], pa.int64())

    return run(vector)


def whiten(df: DataFrame, vector_col: str, into: str = "whitened", components: int = COMPONENTS) -> DataFrame:
    """The rows of df that have a whole vector, with an array column of whitened values."""
    held = "_grid_" + "_".join(df.columns)
    rows = on_grid(df, vector_col, held)
    model = fit(rows, held, components)
    if model is None:
        return rows.withColumn(into, F.lit(None).cast("array<double>")).drop(held)
    return rows.withColumn(into, whitened(model, held)).drop(held)


def op11_whitening(spark, sf_dir: str) -> DataFrame:
    rows = on_grid(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), "embedding", "x").select("vec_id", "x")
    model = fit(rows, "x")
    if model is None:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    share = F.lit(None).cast("array<double>") if model.trace <= 0 else F.array(*(F.lit(float(v / model.trace) if on else 0.0) for v, on in zip(model.variances, model.varies, strict=True)))
    out = rows.select("vec_id", deviation(model, "x").alias("deviation"), whitened(model, "x").alias("w")).select("vec_id", "deviation", F.posexplode("w").alias("k", "whitened"))
    return out.select("vec_id", (F.col("k") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(share, F.col("k")).alias("explained"), F.lit(model.identity_error).cast("double").alias("identity_error"))
