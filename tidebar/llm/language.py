"""Language identification with a bit-sliced Bloom filter of character n-grams.

Texts become lower-case letters with one blank for each run of anything else; n-grams are runs of four of these. Training
counts the n-grams of every labelled document by language, and all of them go into the filter: an array of bit masks with
one bit for each language and tier of frequency. The first tier has all n-grams of a language, the others those of at least
that share of its n-grams. A look-up joins the masks of three slots with AND, so one probe returns all languages that contain
the n-gram, and how common it is in each. Hits are counted by bit and corrected for the bit's false positives; a language's
score is the sum over its tiers, the largest decides, and its share of all is the score. A tier is a factor of ten in
frequency, so rare n-grams weigh less without being left out.

The filter is built where the counts are: slots are grouped, their bits OR-ed, and only the masks (at most MAX_SLOTS, whatever
the corpus) come to the driver. It has twelve slots an n-gram as long as that bound allows; beyond it the first tier fills up,
which the correction takes out, while the other tiers hold at most one n-gram per share.

Ties go to the language with more training n-grams, then by name. A text without known n-grams gets the commonest language
with an even score; a null text, or one without letters, is `und` with score 0, and so is all without training rows; empty
tables give empty results; repeated rows count each time; very long texts are read whole; columns of other names play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.llm import textvec as tv
from tidebar.llm.store import cut
from tidebar.llm.toxicity import fold_of

GRAM = 4
PROBES = 3
#: Least shares of the tiers; the first tier holds everything.
TIERS = (0.0, 1e-6, 1e-5, 1e-4, 1e-3)
MAX_SLOTS = 1 << 24
SLOTS_A_GRAM = 12
_PART = 16  # bits of a slot's place in its part of the filter
_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def grams_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all n-grams, the text of each, and whether each text has a letter."""
    lowered = [(t or "").lower() for t in texts]
    # Each text has a blank of its own on both sides, so that no n-gram and no word goes from one into the next.
    codes = np.frombuffer("".join(f" {t} " for t in lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter((len(t) + 2 for t in lowered), np.int64, len(lowered))
    text = np.repeat(np.arange(len(texts)), sizes)
    letter = letter_table()[codes]
    has = np.bincount(text[letter], minlength=len(texts)) > 0
    kept = letter.copy()
    kept[1:] |= letter[:-1]  # a blank after each word
    kept[np.cumsum(sizes) - sizes] = has  # and one before the first
    text = text[kept]
    grams = tv.rolling(np.where(letter, codes, np.uint32(32))[kept].astype(np.uint64), GRAM)
    inside = text[: len(grams)] == text[GRAM - 1 :] if len(grams) else np.zeros(0, bool)
    return grams[inside], text[: len(grams)][inside], has


def _blocks(batch: pa.RecordBatch, text_at: int) -> Iterator[tuple[int, int, list[str | None]]]:
    _, at = tv.utf8(batch.column(text_at))
    for a, b in tv.blocks(at, 2 << 20):
        yield a, b, batch.column(text_at)[a:b].to_pylist()


def _counts(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def merged(parts):
            keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            return keys, np.bincount(at, weights=np.concatenate([n for _, n in parts])).astype(np.int64)

        def flush():
            for lang, parts in held.items():
                keys, n = merged(parts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            for a, b, texts in _blocks(batch, 1):
                langs = batch.column(0)[a:b].to_pylist()
                for lang in sorted(set(langs)):
                    grams, _, _ = grams_of([t for t, k in zip(texts, langs, strict=True) if k == lang])
                    keys, n = np.unique(grams, return_counts=True)
                    held.setdefault(lang, []).append((keys, n))
                    size += len(keys)
                if size > 2_000_000:
                    held = {k: [merged(p)] for k, p in held.items()}
                    size = sum(len(p[0][0]) for p in held.values())
                    if size > 1_000_000:
                        yield from flush()
                        size = 0
        yield from flush()

    return rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def probes(grams: np.ndarray, slots: int) -> Iterator[np.ndarray]:
    first, step = tv.mix(grams ^ np.uint64(0x51ED270B)), tv.mix(grams + np.uint64(tv.BASE)) | np.uint64(1)
    for j in range(PROBES):
        yield ((first + np.uint64(j) * step) & np.uint64(slots - 1)).astype(np.int64)


class BitSliced:
    """Masks by slot, in words of 64 bits; bit len(TIERS) * language + tier says that the language has the n-gram in that tier."""

    def __init__(self, langs: list[str], masks: np.ndarray):
        self.langs, self.masks, self.slots = langs, masks, masks.shape[1]
        bits = range(len(langs) * len(TIERS))
        self.false = np.array([np.mean(self._bit(masks[k // 64], k)) ** PROBES for k in bits])

    @staticmethod
    def _bit(masks: np.ndarray, k: int) -> np.ndarray:
        return (masks >> np.uint64(k % 64)) & np.uint64(1)

    def found(self, grams: np.ndarray) -> np.ndarray:
        """The masks of n-grams, a row a word."""
        slots = list(probes(grams, self.slots))
        out = self.masks[:, slots[0]]
        for slot in slots[1:]:
            out &= self.masks[:, slot]
        return out

    def languages(self, gram: str) -> list[str]:
        """All languages that contain an n-gram of GRAM characters, and perhaps a false one."""
        codes = np.frombuffer(gram.encode("utf-32-le"), np.uint32).astype(np.uint64)
        masks = self.found(tv.rolling(codes, GRAM))
        return [lang for n, lang in enumerate(self.langs) if self._bit(masks[n * len(TIERS) // 64], n * len(TIERS))[0]]

    def decide(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        grams, text, has = grams_of(texts)
        n = len(texts)
        total, counts = np.bincount(text, minlength=n), np.zeros((len(self.langs), n))
        masks = self.found(grams)
        for k, false in enumerate(self.false.tolist()):
            hits = np.bincount(text, weights=self._bit(masks[k // 64], k), minlength=n)
            counts[k // len(TIERS)] += np.maximum(0, hits - total * false)
        best, whole = counts.argmax(0), counts.sum(0)
        share = np.where(whole > 0, counts.max(0) / np.where(whole > 0, whole, 1), 1 / len(self.langs))
        return [self.langs[b] if h else "und" for b, h in zip(best.tolist(), has.tolist(), strict=True)], np.where(has, share, 0.0)


def _slots(rows: DataFrame, slots: int) -> DataFrame:
    """part, place, word and mask of the slots of each n-gram, from (gram, word, mask)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slot in probes(batch.column(0).to_numpy().view(np.uint64), slots):
                yield pa.RecordBatch.from_arrays([pa.array((slot >> _PART).astype(np.int32)), pa.array((slot & ((1 << _PART) - 1)).astype(np.int32)), batch.column(1), batch.column(2)], names=["part", "place", "word", "mask"])

    return rows.mapInArrow(run, "part int, place int, word int, mask long").groupBy("part", "place", "word").agg(F.bit_or("mask").alias("mask"))


def _parts(slots: DataFrame) -> DataFrame:
    """A row a part and word of the filter: the places that are set and their masks."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        place, mask = (np.ascontiguousarray(table.column(n).to_numpy()) for n in ("place", "mask"))
        return pa.table({"part": table.column("part")[:1], "word": table.column("word")[:1], "places": pa.array([place.astype("<i4").tobytes()]), "masks": pa.array([mask.astype("<i8").tobytes()])})

    return slots.groupBy("part", "word").applyInArrow(run, "part int, word int, places binary, masks binary")


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_slots: int = MAX_SLOTS) -> BitSliced | None:
    """The filter, learned from text and non-null language of documents outside the held-out fold."""
    rows = docs.where(fold_of(F.col(id_col)) != 0).where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = cut(_counts(rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))), "language")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    sizes = {r["lang"]: r["total"] for r in totals.collect()}  # a row a language
    if not sizes:
        return None
    langs = sorted(sizes, key=lambda k: (-sizes[k], k))
    known = counts.sparkSession.createDataFrame([(k, n, float(sizes[k])) for n, k in enumerate(langs)], "lang string, place int, total double")
    share, bit = F.col("n") / F.col("total"), F.col("place") * len(TIERS)
    mask, word = F.lit(0).cast("long"), F.floor(bit / 64).cast("int")
    for t, least in enumerate(TIERS):  # a language's tiers may lie over two words
        mask = F.when(share >= least, mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), (bit + t) % 64))).otherwise(mask)
    masked = counts.join(F.broadcast(known), "lang")
    if len(langs) * len(TIERS) > 64:
        each = F.explode(F.array_compact(F.array(*(F.when(share >= least, bit + t) for t, least in enumerate(TIERS))))).alias("bit")
        masked = masked.select("gram", each).select("gram", F.floor(F.col("bit") / 64).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit") % 64).alias("mask"))
    else:
        masked = masked.select("gram", word.alias("word"), mask.alias("mask"))
    grams = counts.agg(F.approx_count_distinct("gram")).first()[0]
    slots = min(max_slots, 1 << max(_PART, int(SLOTS_A_GRAM * grams - 1).bit_length()))
    masks = np.zeros((-(-len(langs) * len(TIERS) // 64), slots), np.uint64)
    for r in _parts(_slots(masked, slots)).collect():  # at most `slots` masks a word
        masks[r["word"], (r["part"] << _PART) + np.frombuffer(r["places"], "<i4").astype(np.int64)] = np.frombuffer(r["masks"], "<u8")
    return BitSliced(langs, masks)


def identify(docs: DataFrame, model: BitSliced | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in _blocks(batch, 1):
                langs, scores = shared.value.decide(texts) if shared.value else (["und"] * len(texts), np.zeros(len(texts)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(langs, pa.string()), pa.array(scores)], names=["doc_id", "lang_pred", "score"])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id long, lang_pred string, score double")


def op2_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, train(docs)).select("doc_id", (fold_of(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score")
