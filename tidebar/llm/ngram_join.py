"""Exact n-gram Jaccard join by universe-partition pigeonhole.

A document's set holds the hashes of its distinct `width`-word shingles (all its words as one if they are fewer). Two sets
link when `den` * intersection >= `num` * union. Documents with equal sets form a class, known by the hash of the set.

Size bands. A pair (a <= b in size) that links differs in at most (a + b) (den - num) / (den + num) shingles. Bands cover the
sizes; in the band of the smaller set, that is at most U. Each set signs in every band in which its partner may be the
smaller one.

Segments. In a band the universe of hashes is dealt to m segments, j of which also sign their one-deletion
neighbourhoods. A segment that differs costs one of the U differences, or two in a neighbourhood segment, so with
m + j >= U + 1 a linked pair shares a signature. The allocation (m, j) takes the fewest signatures for the band among those
that leave hardly a set with an empty segment, as that would be a very common signature: small bands get few segments
with neighbourhoods, large ones m = U + 1 + x without. In the latter a linked pair shares x + 1 segments, so x empty ones
need not sign; the few sets with more empty segments sign that they have, once a band.

Candidates. Signatures with the same classes count once. Inside a signature, two classes are candidates if their sizes fit and
their bitmaps do: each shingle flips one of 512 or more bits, so sets cannot differ in fewer shingles than bits. Only the
components of these candidates leave the signature, as stars. A signature of more than MAX_GROUP classes, or one that would
take too many comparisons, gives one star of all its classes instead, which only makes candidate clusters larger.

Verification. The components of all stars are candidate clusters, which hold all links. A cluster's texts meet in blocks of
about `block_bytes`, one task a pair of blocks, and an inverted index counts all intersections there exactly. Only a spanning
forest of the links found leaves a task. Components of the forests are the result. No pair of a group is emitted as a row.

Shingles and classes are known by 64-bit hashes. Null or wordless texts have empty sets and link with nothing; very long
texts are hashed whole; equal rows fall into one class; ids may repeat or be null; empty tables give empty results;
columns of any other names pass through keep_one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce
from math import exp, lgamma, log

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.llm import textvec as tv
from tidebar.llm.components import roots
from tidebar.llm.store import cut, drop, shuffle_partitions

BAND = 0.7
RARE = 1e-5
BLOCK_BYTES = 4 << 20
MAX_GROUP = 20_000
#: Signatures are met in so many parts.
SIGN_PARTS = 4
#: Shared signatures of a part (24 bytes each) that are broadcast at most.
MAX_BROADCAST = 2_000_000
#: Bytes of bitmaps that one signature may compare.
MAX_COMPARED = 1 << 31
#: From so many shingles on a bitmap has four times as many bits.
BITMAP_STEPS = (400, 1600, 6400)


def shingles(data: np.ndarray, at: np.ndarray, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text, A-Z lowered."""
    data = tv.LOWER_AZ[data]
    starts, ends, text = tv.spans(data, at, tv.NOT_SPACE)
    words = tv.span_hashes(data, starts, ends)
    grams = tv.rolling(words, width)
    stops = np.searchsorted(text, np.arange(len(at)))
    out = []
    for k in range(len(at) - 1):
        low, high = int(stops[k]), int(stops[k + 1])
        if high - low >= width:
            out.append(np.unique(grams[low : high - width + 1]))
        else:
            out.append(tv.mix(tv.rolling(words[low:high], high - low) + np.uint64(high - low)) if high > low else np.zeros(0, np.uint64))
    return out


class Plan:
    """Bands and allocations for a threshold num / den."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.lows: list[int] = [1]
        self.allocations: list[tuple[int, int, int]] = []

    def _allocate(self, low: int, high: int) -> tuple[int, int, int]:
        """(segments, how many of them with neighbourhoods, how many empty segments a set may have without signing them)."""
        most = (high + self.den * high // self.num) * (self.den - self.num) // (self.den + self.num)
        if not most:
            return 1, 0, 0
        choices = []
        for j in range(most // 2 + 2):
            m = max(j, most + 1 - j)
            empty = m * (1 - 1 / m) ** low
            choices.append((empty > RARE, m - j + j * (high / m + 1), m, j, 0))
        for silent in range(1, 16):
            m = most + 1 + silent
            empty = m * (1 - 1 / m) ** low
            # About the chance of more than `silent` empty segments, if they come independently.
            chance = exp((silent + 1) * log(empty) - lgamma(silent + 2)) if empty < silent + 1 else 1.0
            choices.append((chance > RARE, m, m, 0, silent))
        return min(choices)[2:]

    def band(self, size: int) -> int:
        while self.lows[-1] <= size:
            low = self.lows[-1]
            high = max(low, int(low / BAND))
            self.allocations.append(self._allocate(low, high))
            self.lows.append(high + 1)
        return int(np.searchsorted(self.lows, size, side="right")) - 1

    def signatures(self, grams: np.ndarray) -> np.ndarray:
        size = len(grams)
        if not size:
            return np.zeros(0, np.uint64)
        out = []
        for band in range(self.band(-(-self.num * size // self.den)), self.band(size) + 1):
            m, j, silent = self.allocations[band]
            tag = tv.mix(np.arange(m + 1, dtype=np.uint64) + np.uint64((band + 1) << 32))
            mixed = tv.mix(grams + tag[m])
            segment = ((mixed >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
            values = tv.mix(mixed)
            sums = np.zeros(m, np.uint64)
            np.add.at(sums, segment, values)
            full = np.bincount(segment, minlength=m) > 0
            signs = tv.mix(sums + tag[:m])
            if silent:
                out.append(signs[full])
                empty = np.flatnonzero(~full)
                if len(empty) > silent:
                    out.append(tv.mix(tag[m:] ^ np.uint64(1 << 40)))
            else:
                out.append(signs)
            if j:
                near = segment < j
                out.append(tv.mix(sums[segment[near]] - values[near] + tag[segment[near]]))
        return np.unique(np.concatenate(out))


@lru_cache(8)
def _plan(num: int, den: int) -> Plan:
    return Plan(num, den)


def _class(grams: np.ndarray) -> int:
    """The hash of a set, as a signed long; 0 for the empty set."""
    if not len(grams):
        return 0
    h = tv.rolling(grams, 1)
    return int(tv.mix(np.array([h.sum(dtype=np.uint64)]) * np.uint64(tv.BASE) + np.uint64(len(grams)))[0].view(np.int64)) or 1


def bitmap(grams: np.ndarray) -> bytes:
    """Each shingle flips the bit of its hash; smaller bitmaps are larger ones folded by halves."""
    bits = 512 << 2 * sum(len(grams) >= step for step in BITMAP_STEPS)
    flips = np.bincount((grams & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8)).tobytes()


def sketch(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, class, bits, signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = _plan(num, den)
        for batch in batches:
            data, at = tv.utf8(batch.column(2))
            for a, b in tv.blocks(at):
                sets = shingles(data[at[a] : at[b]], at[a : b + 1] - at[a], width)
                signs = [plan.signatures(s) for s in sets]
                stops = pa.array(np.cumsum([0] + [len(s) for s in signs]).astype(np.int32))
                lists = pa.ListArray.from_arrays(stops, pa.array(np.concatenate(signs).view(np.int64)))
                columns = [pa.array([len(s) for s in sets], pa.int64()), pa.array([_class(s) for s in sets], pa.int64()), pa.array([bitmap(s) if len(s) else b"" for s in sets], pa.binary()), lists]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], *columns], names=["doc_id", "text_hash", "n_shingles", "class", "bits", "signs"])

    return docs.select("doc_id", "text_hash", "text").mapInArrow(run, "doc_id long, text_hash long, n_shingles long, class long, bits binary, signs array<long>")


def stars(classes: list[int], sizes: list[int], bits: list[bytes], num: int, den: int) -> list[tuple[int, int]]:
    """(class, smallest class of its component) over the candidates of one signature; all hang on one where that is too dear."""
    width = min(map(len, bits))
    order = np.argsort(classes)
    names, n = np.array(classes)[order], np.array(sizes)[order]
    maps = np.empty((len(bits), width // 8), np.uint64)
    for row, k in enumerate(order.tolist()):
        folded = np.frombuffer(bits[k], np.uint64).reshape(-1, width // 8)
        maps[row] = np.bitwise_xor.reduce(folded, 0)
    free = np.arange(len(names))
    out, left = [], MAX_COMPARED
    while len(free):
        root, queue, free = int(free[0]), [int(free[0])], free[1:]
        while queue and len(free):
            i = queue.pop()
            left -= len(free) * width
            if left < 0:
                return [(int(x), int(names[0])) for x in names[1:]]
            near = free[(den * n[free] >= num * n[i]) & (num * n[free] <= den * n[i])]
            differ = np.bitwise_count(maps[near] ^ maps[i]).sum(1, dtype=np.int64)
            near = near[(den + num) * differ <= (den - num) * (n[near] + n[i])]
            out += [(int(names[k]), int(names[root])) for k in near.tolist()]
            queue += near.tolist()
            free = free[~np.isin(free, near, assume_unique=True)]
    return out


def _candidates(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Stars (u, v) from (sign, class, n_shingles, bits), sorted by sign in each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign, held = None, []

        def table() -> pa.RecordBatch:
            found = stars(*map(list, zip(*held, strict=True)), num, den)
            return pa.RecordBatch.from_arrays([pa.array([u for u, _ in found], pa.int64()), pa.array([v for _, v in found], pa.int64())], names=["u", "v"])

        for batch in batches:
            for key, node, size, bits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != sign:
                    if len(held) > 1:
                        yield table()
                    sign, held = key, []
                held.append((node, size, bits))
        if len(held) > 1:
            yield table()

    return rows.mapInArrow(run, "u long, v long")


def _forest(sets: list[np.ndarray], side: list[int], nodes: list[int], num: int, den: int) -> list[tuple[int, int]]:
    """A spanning forest of the links. side: 0 or 1 of each set's block; only pairs over both are new if there are two."""
    sizes = np.array([len(s) for s in sets])
    keys, frequency = np.unique(np.concatenate(sets), return_counts=True)
    slots = [np.searchsorted(keys, s) for s in sets]
    # Prefix filter: linked sets share one of the shingles that are rarest here, of each the first n - ceil(t n) + 1.
    heads = [k[np.lexsort((k, frequency[k]))[: len(k) + (-num * len(k)) // den + 1]] for k in slots]
    place = np.repeat(np.arange(len(sets)), [len(h) for h in heads])
    flat = np.concatenate(heads)
    order = np.argsort(flat, kind="stable")
    owner = place[order]
    begin = np.searchsorted(flat[order], np.arange(len(keys) + 1))
    parent = list(range(len(sets)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    two, out, sides = len(set(side)) > 1, [], np.array(side)
    table = None
    for i in range(len(sets)):
        low, n = begin[heads[i]], begin[heads[i] + 1] - begin[heads[i]]
        if n.sum() == len(heads[i]):
            continue
        others = np.unique(owner[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())])
        others = others[others > i]
        others = others[(den * sizes[others] >= num * sizes[i]) & (num * sizes[others] <= den * sizes[i])]
        if two:
            others = others[sides[others] != side[i]]
        if len(others) > 100:  # a dense group: count all at once
            if table is None:
                table = np.argsort(np.concatenate(slots), kind="stable")
                table = np.repeat(np.arange(len(sets)), sizes)[table], np.concatenate([[0], np.cumsum(frequency)])
            low, n = table[1][slots[i]], frequency[slots[i]]
            common = np.bincount(table[0][np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())], minlength=len(sets))[others]
            others = others[den * common >= num * (sizes[others] + sizes[i] - common)]
        root = find(i)
        for k in others.tolist():
            other = find(k)
            if other == root:
                continue
            if table is None or len(others) <= 100:
                at = np.minimum(np.searchsorted(slots[i], slots[k]), len(slots[i]) - 1)
                common_k = int(np.count_nonzero(slots[i][at] == slots[k]))
                if den * common_k < num * (int(sizes[i] + sizes[k]) - common_k):
                    continue
            parent[max(root, other)] = min(root, other)
            root = min(root, other)
            out.append((nodes[i], nodes[k]))
    return out


def _verify(rows: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Links (u, v) from rows (cluster, pair, side, class, packed), sorted by cluster and pair in each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loosen = zstandard.ZstdDecompressor()
        key, held = None, {}

        def links() -> list[tuple[int, int]]:
            if len(held) < 2:
                return []
            texts = pa.array([loosen.decompress(p, max_output_size=1 << 31) if p else b"" for _, p in held.values()], pa.large_binary())
            data, at = tv.utf8(texts.cast(pa.large_string()))
            got = [s for a, b in tv.blocks(at) for s in shingles(data[at[a] : at[b]], at[a : b + 1] - at[a], width)]
            same = [k for k, (node, s) in enumerate(zip(held, got, strict=True)) if _class(s) == node]  # not another text of the same id
            return _forest([got[k] for k in same], [list(held.values())[k][0] for k in same], [list(held)[k] for k in same], num, den) if len(same) > 1 else []

        def table(found: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([u for u, _ in found], pa.int64()), pa.array([v for _, v in found], pa.int64())], names=["u", "v"])

        for batch in batches:
            for cluster, pair, side, node, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (cluster, pair) != key:
                    if found := links():
                        yield table(found)
                    key, held = (cluster, pair), {}
                held[node] = (side, packed)
        if found := links():
            yield table(found)

    return rows.mapInArrow(run, "u long, v long")


def _packed(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            texts = batch.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([squeeze((t or "").encode()) for t in texts], pa.binary()), pa.array([len(t or "") for t in texts], pa.int64())], names=["doc_id", "text_hash", "packed", "size"])

    return docs.mapInArrow(run, "doc_id long, text_hash long, packed binary, size long")


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 4, den: int = 5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id (the smallest id that links reach, its own included) and the text hash of that document, a row per document."""
    spark = docs.sparkSession
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(F.col(f"`{text_col}`").cast("string")).alias("text_hash"), F.col(f"`{text_col}`").cast("string").alias("text"))
    known = cut(sketch(docs, width, num, den), "ngram-join")
    signs = known.select("class", F.explode("signs").alias("sign"))
    digest = F.bit_xor(F.xxhash64("class", F.lit(11)))

    def part(rows: DataFrame, k: int) -> DataFrame:
        return rows.where(F.pmod("sign", F.lit(SIGN_PARTS)) == k)

    def shared(k: int) -> DataFrame:
        # Dealt out first: a signature and a class are less to ship than the columns of a partial aggregate.
        found = part(signs, k).repartition(shuffle_partitions(spark), "sign").groupBy("sign").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.count("*").alias("n"), digest.alias("digest")).where("low < high")
        return found.groupBy("low", "high", "n", "digest").agg(F.min("sign").alias("sign"))

    def holders(k: int) -> DataFrame:
        # Shared signatures are few beside all; beyond MAX_BROADCAST of them both sides are sorted and merged.
        chosen = part(groups, k)
        way = "broadcast" if chosen.count() <= MAX_BROADCAST else "merge"
        return part(signs, k).join(chosen.select("sign", "low", "n").hint(way), "sign")

    # Signatures are met in parts, one after another, so that shuffles on disk at once hold one part only.
    parts = [cut(shared(k), "ngram-join") for k in range(SIGN_PARTS)]
    groups = cut(reduce(DataFrame.unionByName, parts).groupBy("low", "high", "n", "digest").agg(F.min("sign").alias("sign")), "ngram-join")
    drop(*parts)
    parts = [cut(holders(k), "ngram-join") for k in range(SIGN_PARTS)]
    met = reduce(DataFrame.unionByName, parts)
    large = met.where(F.col("n") > MAX_GROUP).where("class <> low").select(F.col("class").alias("u"), F.col("low").alias("v"))
    classes = known.where("class <> 0").groupBy("class").agg(F.first("n_shingles").alias("n_shingles"), F.first("bits").alias("bits"))
    small = met.where(F.col("n") <= MAX_GROUP).select("sign", "class").distinct().join(classes, "class").select("sign", "class", "n_shingles", "bits")
    small = small.repartition(shuffle_partitions(spark), "sign").sortWithinPartitions("sign", "class")
    clusters = roots(large.unionByName(_candidates(small, num, den)), "ngram-join")
    signed, known = known, cut(known.drop("signs", "bits"), "ngram-join")
    drop(signed, groups, *parts)
    member = clusters.select("root", F.col("node").alias("class")).unionByName(clusters.select("root", F.col("root").alias("class")).distinct())
    one = known.where("class <> 0").groupBy("class").agg(F.min(F.struct("doc_id", "text_hash")).alias("one"))
    wanted = member.join(one, "class").select("root", "class", F.col("one.doc_id").alias("w_id"), F.col("one.text_hash").alias("w_hash"))
    packed = _packed(docs)
    texts = cut(packed.join(wanted, packed["doc_id"].eqNullSafe(wanted["w_id"]) & (packed["text_hash"] == wanted["w_hash"])).select("root", "class", "packed", "size"), "ngram-join")
    blocks = texts.groupBy("root").agg(F.ceil(F.sum("size") / block_bytes).cast("int").alias("n"))
    split = texts.join(blocks, "root").withColumn("block", F.pmod(F.xxhash64("class", F.lit(7)), F.col("n")).cast("int"))
    # Block b meets every block c: in the pair (smaller, larger), one pair more for its own.
    met = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    met = met.select("root", (F.least("block", "other").cast("long") * F.col("n") + F.greatest("block", "other")).alias("pair"), (F.col("block") > F.col("other")).cast("int").alias("side"), "class", "packed")
    met = met.repartition(shuffle_partitions(spark), "root", "pair").sortWithinPartitions("root", "pair", "class")
    links = roots(_verify(met, width, num, den), "ngram-join")
    drop(texts, clusters)
    # The first document of a component: ids before nulls, then the smallest.
    ids = known.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first"))
    rooted = ids.join(links.select(F.col("node").alias("class"), "root"), "class", "left").select("class", "first", F.coalesce("root", "class").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("first").alias("top")), "root").select("class", "top")
    out, own = known.join(named, "class"), F.col("n_shingles") == 0
    return out.select("doc_id", "text_hash", "n_shingles", F.when(own, F.col("doc_id")).otherwise(F.col("top.doc_id")).alias("component_id"), F.when(own, F.col("text_hash")).otherwise(F.col("top.text_hash")).alias("component_hash"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """docs with one document of each component: that of the smallest id, of equal ids the smallest text hash. Of rows equal in both, one stays."""
    found = cut(components(docs, id_col, text_col, width, num, den), "ngram-join")
    same = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_hash") == F.col("component_hash"))
    gone = found.where(~same).select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).distinct()
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc"), F.xxhash64(F.col(f"`{text_col}`").cast("string")).alias("hash"))
    kept = rows.join(gone, F.col("doc").eqNullSafe(F.col("gone_id")) & (F.col("hash") == F.col("gone_hash")), "left_anti")
    # Wordless texts link with nothing, so their copies stay. Only rows that repeat are dealt out.
    many = found.where(same & (F.col("n_shingles") > 0)).groupBy(F.col("doc_id").alias("many_id"), F.col("text_hash").alias("many_hash")).count().where("count > 1").drop("count")
    marked = kept.join(many, F.col("doc").eqNullSafe(F.col("many_id")) & (F.col("hash") == F.col("many_hash")), "left")
    return marked.where(F.col("many_hash").isNull()).unionByName(marked.where(F.col("many_hash").isNotNull()).dropDuplicates(["many_id", "many_hash"])).select("row.*")


def op10_ngram_join(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return components(docs, width=3, num=90, den=100, block_bytes=1 << 20).select("doc_id", "n_shingles", "component_id")
