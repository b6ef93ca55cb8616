"""Removal of repeated byte strings by suffix arrays.

Every byte of a string of `length` bytes that starts at two places or more, in one document or several, goes. Sorting all
suffixes of a corpus together is out of reach, so starts are dealt to shards by content. Of the `gram`-byte hashes in a
string of `length` bytes the leftmost smallest one is its anchor: equal strings have equal anchors. Runs of starts with the
same anchor place make a context, from the first start to the end of the last one's string.

* An anchor hash that occurs once in the corpus has no repeats. If all its contexts are equal, all their starts repeat.
* Other contexts (where copies begin, end or differ) go, once each, to shards by anchor hash, several anchors to a shard. A
  shard makes the suffix array of its contexts by refinement (Larsson and Sadakane): sorted by eight bytes, then by twice as
  many again and again, of the groups that are still tied alone. Common prefixes of neighbours follow from Kasai's rule that
  a suffix shares at most one byte less than the one before it: only where the bytes before two neighbours differ are they
  compared, all others count down from there. Runs of neighbours that share `length` bytes repeat.
* An anchor hash with more contexts than a shard takes is dealt to several shards by context. Each shard gives the sorted
  digests of its distinct strings; those that two shards have are sent back to these shards, which look their starts up in
  them by binary search. No task holds such an anchor whole.

Null texts count as empty; shorter texts than `length` stay; texts longer than a block are read in windows that overlap by
`length` - 1 bytes; rows that are equal in id and text are two documents; ids may be null or repeat; empty tables give empty
results; columns besides id and text play no part. Contexts are told
apart by two 64-bit hashes (their own and their anchor's), strings of several shards by 128-bit digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.llm import textvec as tv
from tidebar.llm.store import cut, drop, shuffle_partitions

LENGTH = 200
GRAM = 72
SHARD_BYTES = 1 << 19
BLOCK_BYTES = 1 << 19
#: Anchors that are joined by broadcast are at most so many, whatever the corpus.
MAX_HOT = 20_000
LEAST_HOT = 10_000
_ODD = np.uint64(tv.BASE)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the `gram` bytes from each place on, from hashes of 1, 2, 4 and so on."""
    have, width = tv.mix(data.astype(np.uint64) + np.uint64(1)), 1
    out, done = None, 0
    while True:
        if gram & width:  # the widths of the binary digits of `gram`, one after another
            part = have[done : len(data) - gram + 1 + done]
            out = part if out is None else _joined(out, part)
            done += width
        if 2 * width > gram:
            return out
        have, width = _joined(have[:-width], have[width:]), 2 * width


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = a * _ODD
    h += b
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h


def contexts(data: np.ndarray, at: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Anchor hash, context hash, text, first and last start of each context; starts count from their text's begin."""
    none = tuple(np.zeros(0, np.int64) for _ in range(5))
    if len(data) < length:
        return none
    grams = gram_hashes(data, gram)
    keys = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    width = length - gram + 1
    step = 1
    while 2 * step <= width:
        keys = np.minimum(keys[:-step], keys[step:])
        step *= 2
    if width > step:
        keys = np.minimum(keys[: len(keys) - (width - step)], keys[width - step :])
    # Starts whose string ends in their own text; strings over two texts are skipped, so their keys don't matter.
    starts = np.flatnonzero(np.repeat(at[1:], np.diff(at))[: len(keys)] - np.arange(len(keys)) >= length)
    if not len(starts):
        return none
    anchor = (keys[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    text = np.searchsorted(at, starts, side="right") - 1
    first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])]))
    last = np.concatenate([first[1:], [len(starts)]]) - 1
    s, e, t = starts[first], starts[last], text[first]
    return grams[anchor[first]].view(np.int64), tv.span_hashes(data, s, e + length).view(np.int64), t, s - at[t], e - at[t]


def windows(data: np.ndarray, at: np.ndarray, length: int, gram: int, most: int = BLOCK_BYTES) -> Iterator[tuple[np.ndarray, ...]]:
    """contexts() of all texts, block by block; a longer text in overlapping windows (which may cut a context in two)."""
    for a, b in tv.blocks(at, most):
        if b - a > 1 or at[b] - at[a] <= 2 * most:
            anchor, context, text, s, e = contexts(data[at[a] : at[b]], at[a : b + 1] - at[a], length, gram)
            yield anchor, context, text + a, s, e
            continue
        for low in range(int(at[a]), int(at[b]) - length + 1, most):
            high = min(int(at[b]), low + most + length - 1)
            anchor, context, text, s, e = contexts(data[low:high], np.array([0, high - low]), length, gram)
            yield anchor, context, text + a, s + low - at[a], e + low - at[a]


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, zeros after the end."""
    return np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), 0, (1,))


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Places of all suffixes in their order, by Larsson-Sadakane refinement: places alone in their group are done."""
    n = len(data)
    key = _words(data)[:n].byteswap()
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    head = np.concatenate([[True], ranked[1:] != ranked[:-1]])[:n]
    # A zero byte and the end are one to `key`: suffixes that end in the first eight bytes are told apart by their length.
    near = order > n - 8
    if near.any():
        tie = np.lexsort((np.minimum(n - order, 8), np.cumsum(head)))
        order = order[tie]
        left, ranked = np.minimum(n - order, 8), key[order]
        head = np.concatenate([[True], (ranked[1:] != ranked[:-1]) | (left[1:] != left[:-1])])
    width, rank = 8, np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    while True:
        alone = head & np.concatenate([head[1:], [True]])
        tied = np.flatnonzero(~alone)
        if not len(tied):
            return order
        places = order[tied]
        group, ahead = rank[places], places + width
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        both = (group << 32) | second
        by = np.argsort(both, kind="stable")
        order[tied], both = places[by], both[by]
        head[tied] = np.concatenate([[True], both[1:] != both[:-1]])
        rank[order[tied]] = tied[np.maximum.accumulate(np.where(head[tied], np.arange(len(tied)), 0))]
        width *= 2


def common_prefixes(data: np.ndarray, order: np.ndarray) -> np.ndarray:
    """How many bytes each suffix of the array shares with the one before it, by Kasai's rule."""
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    place = np.arange(n)
    # The rule counts down where the bytes before both are equal; elsewhere bytes are compared, eight at a time.
    fresh = (before <= 0) | (place == 0) | (data[place - 1] != data[np.maximum(before, 1) - 1])
    shared = np.zeros(n, np.int64)
    live = np.flatnonzero(fresh & (before >= 0))
    words = _words(data)
    a, b = live.copy(), before[live]
    while len(live):
        differ = words[np.minimum(a, n)] ^ words[np.minimum(b, n)]
        same = np.where(differ == 0, 8, np.bitwise_count((differ & -differ) - np.uint64(1)) >> 3)
        shared[live] += same
        on = (same == 8) & (np.maximum(a, b) + 8 < n)
        live, a, b = live[on], a[on] + 8, b[on] + 8
    shared = np.minimum(shared, n - np.maximum(place, before))
    last = np.maximum.accumulate(np.where(fresh, place, 0))
    return np.where(before >= 0, np.maximum(0, shared[last] - (place - last)), 0)[order]


def _runs(flags: np.ndarray) -> list[int]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edges.tolist()


def _shard(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many starts each context has, where each start stands in the shard, and which of them repeat in it."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts])
    counts = sizes - length + 1
    places = tv.gathered(np.cumsum(sizes) - sizes, counts)
    order = suffix_array(data)
    group = np.empty(len(data), np.int64)
    group[order] = np.cumsum(common_prefixes(data, order) < length) - 1
    # Other suffixes go on into the next context, so they don't count.
    return counts, places, np.bincount(group[places])[group[places]] > 1


def _resolve(rows: DataFrame, length: int, shard_bytes: int) -> DataFrame:
    """anchor, salt, context, runs of repeated starts, from (anchor, salt, parts, context, packed) sorted by anchor and salt in each partition.

    Where an anchor has several parts, also the digests of all starts of the context, and in one row those of the shard.
    """
    schema = "anchor long, salt int, context long, runs array<int>, digests binary, all binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loosen = zstandard.ZstdDecompressor()
        held: list[tuple[int, int, int, int, bytes]] = []
        size = 0

        def judged(part: list[tuple[int, int, int, int, bytes]]) -> pa.RecordBatch:
            counts, places, flags = _shard([x[4] for x in part], length)
            stops = np.cumsum(counts)
            runs = [_runs(f) for f in np.split(flags, stops[:-1])]
            digests: list[bytes | None] = [None] * len(part)
            every: list[bytes | None] = [None] * len(part)
            if part[0][2] > 1:
                raw = b"".join(x[4] for x in part)
                found = [hashlib.blake2b(raw[p : p + length], digest_size=16).digest() for p in places.tolist()]
                digests = [b"".join(found[b - n : b]) for b, n in zip(stops.tolist(), counts.tolist(), strict=True)]
                every[0] = b"".join(sorted(set(found)))
            columns = [pa.array([x[k] for x in part], kind) for k, kind in ((0, pa.int64()), (1, pa.int32()), (3, pa.int64()))]
            return pa.RecordBatch.from_arrays([*columns, pa.array(runs, pa.list_(pa.int32())), pa.array(digests, pa.binary()), pa.array(every, pa.binary())], names=["anchor", "salt", "context", "runs", "digests", "all"])

        for batch in batches:
            for anchor, salt, parts, context, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (anchor, salt) != held[-1][:2] and (size >= shard_bytes or parts > 1 or held[-1][2] > 1):
                    yield judged(held)
                    held, size = [], 0
                held.append((anchor, salt, parts, context, loosen.decompress(packed)))
                size += len(held[-1][4])
        if held:
            yield judged(held)

    return rows.mapInArrow(run, schema)


def _merged(found: DataFrame) -> DataFrame:
    """anchor, context and runs, with what repeats in several shards of an anchor."""
    split = F.expr("transform(sequence(0, length(all) div 16 - 1), i -> substring(all, 16 * i + 1, 16))")
    each = found.where("all is not null").select("anchor", "salt", F.explode(split).alias("digest"))
    shared = each.groupBy("anchor", "digest").agg(F.collect_list("salt").alias("salts")).where("size(salts) > 1")
    back = shared.select("anchor", F.explode("salts").alias("salt"), "digest")
    hot = found.where("digests is not null").select("anchor", "salt", "context", "runs", "digests")

    def run(contexts: pa.Table, known: pa.Table) -> pa.Table:
        """One shard: its contexts, and the digests of it that other shards have too."""
        ranked, out = np.sort(np.frombuffer(b"".join(known.column("digest").to_pylist()), "S16")), []
        for runs, digests in zip(contexts.column("runs").to_pylist(), contexts.column("digests").to_pylist(), strict=True):
            own = np.frombuffer(digests, "S16")
            flags = np.zeros(len(own), bool)
            for a, b in zip(runs[::2], runs[1::2], strict=True):
                flags[a:b] = True
            if len(ranked):
                flags |= ranked[np.minimum(np.searchsorted(ranked, own), len(ranked) - 1)] == own
            out.append(_runs(flags))
        return pa.table({"anchor": contexts.column("anchor"), "context": contexts.column("context"), "runs": pa.array(out, pa.list_(pa.int32()))})

    keys = ("anchor", "salt")
    merged = hot.groupBy(*keys).cogroup(back.groupBy(*keys)).applyInArrow(run, "anchor long, context long, runs array<int>")
    return found.where("digests is null").select("anchor", "context", "runs").unionByName(merged)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def _packed(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([squeeze((t or "").encode()) for t in batch.column(2).to_pylist()], pa.binary())], names=["doc_id", "text_hash", "packed"])

    return docs.mapInArrow(run, "doc_id long, text_hash long, packed binary")


def _anchors(docs: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = tv.utf8(batch.column(2))
            ids, hashes = batch.column(0), batch.column(1)
            for anchor, context, text, s, e in windows(data, at, length, gram):
                take = pa.array(text)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(context), ids.take(take), hashes.take(take), pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32))], names=["anchor", "context", "doc_id", "text_hash", "first", "last"])

    return docs.mapInArrow(run, "anchor long, context long, doc_id long, text_hash long, first int, last int")


def _cut_out(rows: DataFrame, length: int) -> DataFrame:
    """anchor, salt, parts, context and packed bytes of each context, from (packed, spans)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loosen, squeeze = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1).compress
        for whole in batches:
            for low in range(0, whole.num_rows, 200):
                packed, spans = whole.slice(low, 200).columns
                x, owner = spans.flatten(), np.repeat(np.arange(len(spans)), spans.value_lengths().to_numpy())
                first, last = (x.field(n).to_numpy() for n in ("first", "last"))
                pieces, at = [], -1
                for k, a, b in zip(owner.tolist(), first.tolist(), last.tolist(), strict=True):
                    if k != at:
                        raw, at = loosen.decompress(packed[k].as_py(), max_output_size=1 << 31), k
                    pieces.append(squeeze(raw[a : b + length]))
                yield pa.RecordBatch.from_arrays([*(x.field(n) for n in ("anchor", "salt", "parts", "context")), pa.array(pieces, pa.binary())], names=["anchor", "salt", "parts", "context", "packed"])
            pa.default_memory_pool().release_unused()

    return rows.mapInArrow(run, "anchor long, salt int, parts int, context long, packed binary")


def repeated_starts(docs: DataFrame, length: int, gram: int, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, text_hash and starts: ranges of starts of repeated strings (first, and one after the last), from keyed documents."""
    anchors = cut(_anchors(docs, length, gram), "suffix-anchors")
    twice = cut(anchors.groupBy("anchor").agg(F.count("*").alias("n"), F.min("context").alias("low"), F.max("context").alias("high")).where("n > 1").select("anchor", "n", (F.col("low") != F.col("high")).alias("mixed")), "suffix-twice")
    # Anchors with a large share of all rows are met by broadcast, so that no task gets them whole.
    often = max(LEAST_HOT, -(-(twice.agg(F.sum("n")).first()[0] or 0) // MAX_HOT))
    hot, cold = F.broadcast(twice.where(F.col("n") > often).drop("n")), twice.where(F.col("n") <= often).drop("n")
    shared = cut(anchors.join(hot, "anchor").unionByName(anchors.join(hot, "anchor", "left_anti").join(cold, "anchor")), "suffix-shared")
    drop(anchors, twice)
    mixed = shared.where("mixed")
    kinds = cut(mixed.groupBy("anchor", "context").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "text_hash", "first", "last")).alias("one")), "suffix-kinds")
    # A context has at most 2 length - gram bytes. Anchors with more of them than a shard takes get several.
    parts = F.ceil(F.count("*") * (2 * length - gram) / F.lit(shard_bytes)).cast("int")
    many = kinds.groupBy("anchor").agg(parts.alias("parts")).where("parts > 1")
    dealt_out = kinds.join(many, "anchor", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    span = F.struct("anchor", F.pmod(F.col("context"), F.col("parts").cast("long")).cast("int").alias("salt"), "parts", "context", "one.first", "one.last")
    wanted = dealt_out.select("one.doc_id", "one.text_hash", span.alias("x")).groupBy("doc_id", "text_hash").agg(F.collect_list("x").alias("spans"))
    met = _packed(docs).dropDuplicates(["doc_id", "text_hash"]).alias("d").join(wanted.alias("w"), F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("d.text_hash") == F.col("w.text_hash"))).select("packed", "spans")
    dealt = _cut_out(met, length).repartition(shuffle_partitions(docs.sparkSession), "anchor", "salt").sortWithinPartitions("anchor", "salt", "context")
    sharded = cut(_resolve(dealt, length, shard_bytes), "suffix-found")
    found = _merged(sharded)
    whole = cut(found.join(kinds.select("anchor", "context", "n", (F.col("n") > 1).alias("whole")), ["anchor", "context"]), "suffix-judged")
    # Contexts with a large share of the rows are met by broadcast too: fewer than MAX_HOT, as each has more than that share.
    frequent = max(LEAST_HOT, -(-(kinds.agg(F.sum("n")).first()[0] or 0) // MAX_HOT))
    few, rest = F.broadcast(whole.where(F.col("n") > frequent).drop("n")), whole.where(F.col("n") <= frequent).drop("n")
    judged = mixed.join(few, ["anchor", "context"]).unionByName(mixed.join(few.select("anchor", "context"), ["anchor", "context"], "left_anti").join(rest, ["anchor", "context"]))
    every = F.array(F.col("first"), F.col("last") + 1)
    some = judged.select("doc_id", "text_hash", F.when(F.col("whole"), every).otherwise(F.transform("runs", lambda x: x + F.col("first"))).alias("r")).where("size(r) > 0")
    ranges = shared.where("not mixed").select("doc_id", "text_hash", every.alias("r")).unionByName(some)
    out = cut(ranges.groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_list("r")).alias("starts")), "suffix-starts")
    drop(shared, kinds, sharded, whole)
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, kept (bytes), n_bytes, n_removed, n_spans and kept_sha256, a row per document."""
    keyed = _keyed(docs, id_col, text_col)
    starts = repeated_starts(keyed, length, gram)
    met = _packed(keyed).alias("d").join(starts.alias("s"), F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("d.text_hash") == F.col("s.text_hash")), "left").select("d.doc_id", "packed", "starts")
    schema = "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loosen = zstandard.ZstdDecompressor()
        for whole in batches:
            for low in range(0, whole.num_rows, 500):
                batch = whole.slice(low, 500)
                kept, counts = [], []
                for packed, ranges in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    raw = loosen.decompress(packed, max_output_size=1 << 31)
                    n = len(raw)
                    gone, spans = 0, 0
                    if ranges:
                        edge = np.zeros(n + 1, np.int64)
                        np.add.at(edge, ranges[::2], 1)
                        np.add.at(edge, np.array(ranges[1::2]) - 1 + length, -1)
                        cover = np.cumsum(edge[:-1]) > 0
                        gone, spans = int(cover.sum()), len(_runs(cover)) // 2
                        raw = np.frombuffer(raw, np.uint8)[~cover].tobytes()
                    kept.append(raw)
                    counts.append((n, gone, spans))
                columns = [pa.array([x[k] for x in counts], pa.int64()) for k in range(3)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()), *columns, pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())], names=[f.partition(" ")[0] for f in schema.split(", ")])

    return met.mapInArrow(run, schema)


def op5_suffixes(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")
