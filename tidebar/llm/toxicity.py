"""Toxicity by compression distance.

Every character of a text's words is written as four bytes, a unit, that hash it and the three before it, so that a shared run
of five letters outweighs the cost of a match, and other text does not compress. Two zstandard dictionaries are trained by the
library, one on toxic and one on ordinary training text. Of each text they get the stretches whose units texts of its label
hold more often than the other label's texts lead to expect, by more than chance: what all texts share says nothing of either.
What the trainer picks from these stretches, and how much, is the library's. The deviations that an excess must have are the
most of DEVIATIONS at which the stretches still reach most toxic texts. Each window of 64 characters of a text is compressed
with both dictionaries; the differences of the two lengths over a text's windows give ten features, and a logistic fit on the
training rows calibrates thresholds on them into a score.

Dictionaries and fit come from at most MAX_LABELLED labelled rows, those with the smallest hash of the id; every document is
scored, in all its windows, however long it is. Copies (texts of one label with the same three smallest hashes of word triples)
lend their words once, by the smallest id; repeated labels of an id count as the largest. A text without letters has no windows
and gets the fit's score for that; a null text counts as empty. Without rows of both labels the score is the share of toxic
labels, 0 without any label. Repeated rows get a score each; empty tables give empty results; a score of exactly one half is
predicted as toxic; columns of other names play no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.llm import textvec as tv
from tidebar.llm.store import cut

MAX_LABELLED = 20_000
WINDOW = 64
N_FEATURES = 10
#: Bytes of a dictionary, the trainer's segments in bytes.
DICTIONARY_BYTES, SEGMENT = 16_384, 64
#: How many deviations an excess must have, the share of toxic texts that stretches must reach, and units in a stretch.
DEVIATIONS, REACHED, STRETCH = (6, 5, 4, 3), 0.8, 2
_WORD = re.compile(r"[^\W\d_]+")


def fold_of(id_column) -> object:
    """The remainder by five of the checksum of an id as text; null ids count as held out."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 5, F.lit(0))


def units(text: str) -> bytes:
    """Four bytes for each character from the fourth on, from it and the three before it."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return tv.rolling(codes, 4).astype(np.uint32).tobytes()


def letters(text: str | None) -> str:
    return " ".join(_WORD.findall((text or "").lower()))


def trained(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary for the samples; too few for the trainer are taken as they are."""
    try:
        return zstandard.train_dictionary(size, samples, k=SEGMENT, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:]


class Dictionaries:
    def __init__(self, toxic: list[bytes], ordinary: list[bytes]):
        """From the training texts of both."""
        self.parts = [trained(ordinary), trained(toxic)]
        self._ready = None

    def __getstate__(self):
        return {"parts": self.parts, "_ready": None}

    def _make(self, content: bytes) -> zstandard.ZstdCompressor:
        params = zstandard.ZstdCompressionParameters.from_level(1, source_size=4 * WINDOW, dict_size=len(content), min_match=7, write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
        if len(content) < 16:
            return zstandard.ZstdCompressor(compression_params=params)
        known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        known.precompute_compress(compression_params=params)
        return zstandard.ZstdCompressor(dict_data=known, compression_params=params)

    def features(self, text: str | None) -> list[float]:
        if self._ready is None:
            self._ready = [self._make(p).compress for p in self.parts]
        ordinary, toxic = self._ready
        raw = units(f" {letters(text)} ")
        pieces = [raw[max(0, i - 20) : i + 4 * WINDOW] for i in range(0, len(raw), 4 * WINDOW)]
        if not pieces:
            return [0.0] * N_FEATURES
        lengths = np.array([(len(ordinary(p)), len(toxic(p)), len(p)) for p in pieces], float)
        gap = lengths[:, 0] - lengths[:, 1]
        saved = lengths[:, 2] - lengths[:, 1]
        top = np.sort(gap)[-3:]
        often = [np.log1p((gap > t).sum()) for t in (3, 6)]
        return [gap.max(), top.sum() / 3, gap.sum() / (len(gap) + 2), *often, 10 * (gap > 3).sum() / (len(gap) + 2), saved.max(), np.sort(saved)[-3:].sum() / 3, saved.sum() / (len(gap) + 2), np.log1p(len(gap))]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, scale and weights (the last is the constant)."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    beta = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve((z.T * (p * (1 - p))) @ z + ridge * np.eye(len(beta)), z.T @ (y - p) - ridge * beta)
        beta += np.clip(step, -3, 3)
    return mean, scale, beta


def _units(text: str | None) -> np.ndarray:
    return np.frombuffer(units(f" {letters(text)} "), np.uint32)


def _unit_counts(rows: DataFrame) -> DataFrame:
    """How many toxic (n1) and how many ordinary (n0) texts have each unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: tuple[list, list] = ([], [])
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found[label].append(np.unique(_units(text)))
            for label, parts in enumerate(found):
                if parts:
                    unit, n = np.unique(np.concatenate(parts), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(unit.astype(np.int64)), pa.array(np.full(len(unit), label, np.int32)), pa.array(n)], names=["unit", "label", "n"])

    counted = rows.select("text", "toxic").mapInArrow(run, "unit long, label int, n long")
    return counted.groupBy("unit").agg(*(F.coalesce(F.sum(F.when(F.col("label") == k, F.col("n"))), F.lit(0)).alias(f"n{k}") for k in (0, 1)))


def stretches(found: np.ndarray, kept: np.ndarray) -> list[bytes]:
    """Runs of at least STRETCH units that are all kept ones."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], np.isin(found, kept).astype(np.int8), [0]])))
    return [found[a:b].tobytes() for a, b in zip(edges[::2], edges[1::2], strict=True) if b - a >= STRETCH]


def _training_texts(rows: DataFrame, kept: dict[tuple[int, int], np.ndarray]) -> DataFrame:
    """level, label, stretch and n: how often; an empty stretch counts the texts that have one. kept: by level and label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[tuple[int, int, bytes], int] = {}
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = _units(text)
                for level in DEVIATIONS:
                    runs = stretches(found, kept[level, label])
                    for r in [*runs, *([b""] if runs else [])]:
                        out[level, label, r] = out.get((level, label, r), 0) + 1
            columns = [pa.array([k[j] for k in out], kind) for j, kind in enumerate((pa.int32(), pa.int32(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(list(out.values()), pa.int64())], names=["level", "label", "stretch", "n"])

    return rows.select("text", "toxic").mapInArrow(run, "level int, label int, stretch binary, n long").groupBy("level", "label", "stretch").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labelled: int = MAX_LABELLED):
    """The dictionaries and the logistic fit; the fit is a number where only one label, or none, is there."""
    known = labels.where(fold_of(F.col(id_col)) != 0).where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.max(label_col).cast("int").alias("toxic"))
    known = known.orderBy(F.xxhash64("_id"), "_id").limit(max_labelled)  # at most 20,000 numbers
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("text"))
    words = F.split("text", r"\s+")
    sketch = F.slice(F.array_sort(F.transform(F.arrays_zip(words, F.slice(words, F.lit(2), F.size(words)), F.slice(words, F.lit(3), F.size(words))), lambda x: F.xxhash64(x))), 1, 3)
    met = rows.join(F.broadcast(known), "_id").withColumn("sketch", sketch)
    rows = cut(met.groupBy("toxic", "sketch").agg(F.min_by("text", F.struct("_id", "text")).alias("text")).select("toxic", "text"), "toxicity")
    totals = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n0, n1 = totals.get(0, 0), totals.get(1, 0)
    if not n0 or not n1:
        return Dictionaries([], []), n1 / (n0 + n1) if n0 + n1 else 0.0
    expected = {1: F.col("n0") * (n1 / n0), 0: F.col("n1") * (n0 / n1)}

    def beyond(label: int, level: float):
        return F.col(f"n{label}") - expected[label] >= level * F.sqrt(expected[label] + level * level)

    flags = [beyond(label, level).alias(f"k{level}_{label}") for level in DEVIATIONS for label in (0, 1)]
    least = min(DEVIATIONS)
    found = _unit_counts(rows).where(beyond(0, least) | beyond(1, least)).select("unit", *flags).toPandas()  # of at most max_labelled texts
    kept = {(level, label): found["unit"].to_numpy()[found[f"k{level}_{label}"].to_numpy(bool)].astype(np.uint32) for level in DEVIATIONS for label in (0, 1)}
    texts = [r.asDict() for r in _training_texts(rows, kept).collect()]
    reached = {r["level"]: r["n"] for r in texts if r["label"] == 1 and not r["stretch"]}
    level = next((x for x in DEVIATIONS if reached.get(x, 0) >= REACHED * n1), least)

    def training(label: int) -> list[bytes]:
        return [bytes(r["stretch"]) for r in sorted(texts, key=lambda r: bytes(r["stretch"])) if r["level"] == level and r["label"] == label and r["stretch"] for _ in range(r["n"])]

    made = Dictionaries(training(1), training(0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [made.features(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.float64())), batch.column(1)], names=["x", "y"])

    got = rows.select("text", "toxic").mapInArrow(run, "x array<double>, y int").toArrow()  # at most max_labelled rows
    return made, fit_logistic(np.array(got["x"].to_pylist(), float), got["y"].to_numpy().astype(float))


def score(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every document, by what train returns."""
    made, fit = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if isinstance(fit, float):
                p = np.full(batch.num_rows, fit)
            else:
                x = np.array([made.features(t) for t in batch.column(1).to_pylist()], float).reshape(-1, N_FEATURES)
                z = np.hstack([(x - fit[0]) / fit[1], np.ones((len(x), 1))])
                p = 1 / (1 + np.exp(-np.clip(z @ fit[2], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], names=["doc_id", "score"])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id long, score double")


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", (fold_of(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
