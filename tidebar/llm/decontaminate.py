"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned over training token windows.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z became a-z. An item's windows are its runs of `window` words; a
shorter item with words is one window. Window hashes are looked up in sorted arrays behind a 16-bit presence table, and
each hit is verified on the words themselves. A document word inside any occurrence is hit.

The set is broadcast only up to about MAX_WINDOWS windows (counted first); a larger benchmark is scanned in that many parts,
one after another, with the hits so far written between the parts. Longer items than that are cut into pieces that overlap by
a window less one word, so that no part holds one whole. Null texts have no words; very long texts are read whole; null item
ids are left out of the list of items but still hit; empty tables give no rows or no hits; repeated items count once, repeated
documents each time; other columns pass through. `find_hits` refuses columns named like its results (_words, _runs, _items);
`remove_documents` and `remove_spans` take columns of any name.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.llm import textvec as tv
from tidebar.llm.store import cut, drop

WINDOW = 13
MAX_WINDOWS = 500_000
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def normal_words(text: str | None) -> list[bytes]:
    data = tv.LOWER_AZ[np.frombuffer((text or "").encode(), np.uint8)] if text else np.zeros(0, np.uint8)
    return np.where(tv.ALNUM[data], data, 32).astype(np.uint8).tobytes().split()


class Windows:
    """The windows of a part of the benchmark: by their length in words, sorted hashes and the exact words with their items."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        self.names = sorted({name for name, _ in items if name is not None})
        place = {name: k for k, name in enumerate(self.names)}
        self.exact: dict[bytes, set[int]] = {}
        sizes: dict[int, set[bytes]] = {}
        for name, text in items:
            words = normal_words(text)
            size = min(window, len(words))
            for i in range(len(words) - size + 1 if words else 0):
                key = b" ".join(words[i : i + size])
                self.exact.setdefault(key, set()).update([place[name]] if name is not None else [])
                sizes.setdefault(size, set()).add(key)
        self.hashes = {}
        for size, keys in sorted(sizes.items()):
            data, at = tv.utf8(pa.array([k.decode() for k in sorted(keys)]))
            starts, ends, _ = tv.spans(data, at, tv.ALNUM)
            found = np.unique(tv.rolling(tv.span_hashes(data, starts, ends), size)[::size])
            table = np.zeros(1 << 16, bool)
            table[(found >> np.uint64(48)).astype(np.int64)] = True
            self.hashes[size] = (found, table)

    def hits(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int]]]:
        """Words of each text, the text of each word, which words are hit, and (text, item) pairs."""
        data = tv.LOWER_AZ[data]
        starts, ends, text = tv.spans(data, at, tv.ALNUM)
        hashes = tv.span_hashes(data, starts, ends)
        cover, pairs = np.zeros(len(starts) + 1, np.int64), set()
        for size, (found, table) in self.hashes.items():
            grams = tv.rolling(hashes, size)
            likely = np.flatnonzero(table[(grams >> np.uint64(48)).astype(np.int64)])
            likely = likely[text[likely] == text[likely + size - 1]]
            slot = np.minimum(np.searchsorted(found, grams[likely]), len(found) - 1)
            for i in likely[found[slot] == grams[likely]].tolist():
                items = self.exact.get(b" ".join(data[starts[j] : ends[j]].tobytes() for j in range(i, i + size)))
                if items is not None:
                    cover[i] += 1
                    cover[i + size] -= 1
                    pairs.update((int(text[i]), k) for k in items)
        return np.bincount(text, minlength=len(at) - 1), text, np.cumsum(cover[:-1]) > 0, sorted(pairs)


def _runs(flags: np.ndarray) -> list[int]:
    """Starts and ends of runs, in turn."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edges.tolist()


def _scan(docs: DataFrame, part: Windows, text_col: str) -> DataFrame:
    """Adds the part's hits to the columns _words, _runs (word places, start and end in turn) and _items."""
    names = docs.columns
    known = {c: names.index(c) for c in ("_words", "_runs", "_items") if c in names}
    text_at = names.index(text_col)
    rest = [k for k, c in enumerate(names) if c not in known]
    shared = docs.sparkSession.sparkContext.broadcast(part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = shared.value
        for batch in batches:
            data, at = tv.utf8(batch.column(text_at))
            for a, b in tv.blocks(at):
                n_words, text, hit, pairs = windows.hits(data[at[a] : at[b]], at[a : b + 1] - at[a])
                ends = np.cumsum(n_words)
                runs: list[list[int]] = [[] for _ in range(b - a)]
                items: list[set[str]] = [set() for _ in range(b - a)]
                for k in np.unique(text[hit]).tolist():
                    runs[k] = _runs(hit[ends[k] - n_words[k] : ends[k]])
                for k, item in pairs:
                    items[k].add(windows.names[item])
                if known:
                    for k, (old, named) in enumerate(zip(batch.column(known["_runs"])[a:b].to_pylist(), batch.column(known["_items"])[a:b].to_pylist(), strict=True)):
                        if old:
                            flags = np.zeros(int(n_words[k]), bool)
                            for s, e in (*zip(old[::2], old[1::2], strict=True), *zip(runs[k][::2], runs[k][1::2], strict=True)):
                                flags[s:e] = True
                            runs[k] = _runs(flags)
                            items[k].update(named)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k)[a:b] for k in rest), pa.array(n_words.astype(np.int64)), pa.array(runs, pa.list_(pa.int32())), pa.array([sorted(x) for x in items], pa.list_(pa.string()))],
                    names=[*(names[k] for k in rest), "_words", "_runs", "_items"],
                )

    from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType

    schema = StructType([docs.schema[k] for k in rest]).add("_words", LongType()).add("_runs", ArrayType(IntegerType())).add("_items", ArrayType(StringType()))
    return docs.mapInArrow(run, schema)


def find_hits(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """docs with _words (their number), _runs (hit word places, start and end in turn) and _items (ids, as strings)."""
    if taken := {"_words", "_runs", "_items"}.intersection(docs.columns):
        raise ValueError(f"docs has columns named like the results: {sorted(taken)}")
    items = benchmark.select(F.col(item_col).cast("string").alias("name"), F.col(item_text_col).cast("string").alias("text")).where("text is not null")
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    words = F.regexp_extract_all(lowered, F.lit(f"({_WORD})"), F.lit(1))
    items = items.withColumn("words", words).withColumn("n", F.size("words"))
    total = items.agg(F.sum("n")).first()[0] or 0
    parts = max(1, -(-total // max_windows))
    starts = F.sequence(F.lit(1), F.greatest(F.col("n") - window + 1, F.lit(1)), F.lit(max_windows))
    pieces = F.when(F.col("n") <= max_windows, F.array("text")).otherwise(F.transform(starts, lambda k: F.array_join(F.slice("words", k, max_windows + window - 1), " ")))
    items = items.select("name", F.explode(pieces).alias("text"))
    before = None
    for k in range(parts):
        some = items if parts == 1 else items.where(F.pmod(F.xxhash64("name", "text"), F.lit(parts)) == k)
        docs = _scan(docs, Windows([tuple(r) for r in some.collect()], window), text_col)  # at most about max_windows windows
        if k < parts - 1:
            docs = cut(docs, "decontaminate")
            if before is not None:
                drop(before)
            before = docs
    return docs


def is_contaminated(hits: DataFrame) -> DataFrame:
    """Adds _hit (hit words) and _contaminated (hit words are at least a twentieth of all)."""
    n_hit = F.aggregate(F.sequence(F.lit(0), F.size("_runs") - 1), F.lit(0).cast("long"), lambda n, i: n + F.get("_runs", i) * F.when(i % 2 == 1, 1).otherwise(-1))
    hits = hits.withColumn("_hit", F.when(F.size("_runs") > 0, n_hit).otherwise(0).cast("long"))
    return hits.withColumn("_contaminated", (F.col("_hit") > 0) & (20 * F.col("_hit") >= F.col("_words")))


def remove_documents(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without the contaminated ones."""
    own = [f"c{k}" for k in range(len(docs.columns))]  # whatever the columns are called
    hits = is_contaminated(find_hits(docs.toDF(*own), benchmark, own[docs.columns.index(text_col)]))
    return hits.where(~F.col("_contaminated")).select(*own).toDF(*docs.columns)


def remove_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """docs whose texts lack the hit words; what stands between words stays."""
    names, at_runs = [f"c{k}" for k in range(len(docs.columns))], len(docs.columns)
    text_at = docs.columns.index(text_col)
    renamed = docs.toDF(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, out = batch.column(text_at).to_pylist(), []
            for text, runs in zip(texts, batch.column(at_runs).to_pylist(), strict=True):
                if runs:
                    data = np.frombuffer(text.encode(), np.uint8)
                    starts, ends, _ = tv.spans(tv.LOWER_AZ[data], np.array([0, len(data)]), tv.ALNUM)
                    keep = np.ones(len(data), bool)
                    for s, e in zip(runs[::2], runs[1::2], strict=True):
                        keep[starts[s] : ends[e - 1]] = False
                    text = data[keep].tobytes().decode()
                out.append(text)
            columns = batch.columns[:at_runs]
            columns[text_at] = pa.array(out, batch.schema.field(text_at).type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return find_hits(renamed, benchmark, names[text_at]).select(*names, "_runs").mapInArrow(run, renamed.schema).toDF(*docs.columns)


def op4_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    hits = is_contaminated(find_hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))
    return hits.select(
        "doc_id", F.col("_words").alias("n_words"), F.col("_hit").alias("n_hit"), F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("_items")), 256).alias("items_sha256"), F.col("_contaminated").alias("contaminated"),
    )


OP4_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT DISTINCT item, n, array_to_string(ws[i:i + n - 1], ' ') AS g FROM (SELECT item, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM (SELECT *, least(13, len(ws)) AS n FROM b WHERE len(ws) > 0))),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT k, n, i, array_to_string(ws[i:i + n - 1], ' ') AS g FROM (SELECT k, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, sizes WHERE len(ws) >= n)),
hits AS (SELECT k, i, dw.n, item FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
words AS (SELECT k, count(DISTINCT j) AS n_hit FROM (SELECT DISTINCT k, unnest(range(i, i + n)) AS j FROM hits) GROUP BY k),
items AS (SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT k, item FROM hits) GROUP BY k)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(s, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN words USING (k) LEFT JOIN items USING (k)
"""
