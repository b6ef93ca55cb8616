"""Groups of spelling variants: words one edit apart, by a positional q-gram index and a count filter.

`near_words` joins words with words that differ by one inserted, deleted or replaced code point. Each word, padded at both ends,
has length + 2 three-letter grams. One edit destroys at most three of the longer word's, so a near pair shares at least
max(length) - 1 (the one-edit overlap bound) in places that fit: equal places for words of one length, equal or next places for
words that differ by one. It follows that near words share one of the four rarest grams of each, and two of the five rarest.
Words are therefore dealt to blocks by their four rarest grams; a gram with more than HOT_BLOCK words deals its words on by
their second shared gram. A block is an inverted index: a posting list for each gram, place and length, sorted by word. Lists
of all words of a batch are merged side by side: the head that is the need-th smallest of a word's lists is the next that can
reach the bound (what a heap of heads would give after need - 1 pops), and all lists below leap to it. What reaches the bound
is verified letter by letter, and given in the smallest block that both words share, so that each pair comes once.

Rarity comes from counts of all words' grams in 2^20 buckets, and rare is told from frequent by that table alone (4 MB); grams
that share a bucket only add candidates. Words are counted in numpy, a block of texts at a time, and pre-aggregated.

`group` gives each word's form (the most frequent near word, if at least twice as frequent; ties: the smallest in code-point order)
and root, by following forms. Forms grow in frequency, so they have no cycles; pointers are doubled until none moves.

Null texts have no words; empty texts neither; a text of any length is read whole; a null id counts as an empty string in the
checksum that picks the runs to damage; repeated rows count as often as they stand; empty tables give no rows; other columns
play no part. `near_words` takes words of at least three code points, each once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.llm import textvec as tv
from tidebar.llm.store import cut, drop, shuffle_partitions

SHORTEST, LEAST, EDIT_MOD = 5, 3, 97
BUCKET_BITS = 20
PREFIX = 4
HOT_BLOCK = 20_000
#: Words of a partition that are counted before they are sent on, and block rows that are merged together.
HELD_WORDS, MERGED_ROWS = 300_000, 60_000
_NONE = np.int64(1 << 62)
_LETTER = tv.byte_table(lambda b: 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A)
_ONE = tv.byte_table(lambda b: b == 1)


def runs(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of each maximal run of A-Z, a-z and U+00C0-U+00FF, which are the two-byte characters that begin with C3."""
    lead = data == 0xC3
    inside = _LETTER[data] | lead
    inside[1:] |= lead[:-1]
    return tv.spans(inside.astype(np.uint8), at, _ONE)


def _counted(ids: list[str], data: np.ndarray, at: np.ndarray, counts: dict[bytes, int]) -> None:
    """Add the words of a block of texts to counts, one run in EDIT_MOD with a letter less."""
    low = tv.LOWER_AZ[data]
    starts, ends, owner = runs(data, at)
    if not len(starts):
        return
    first, own = tv.distinct_spans(low, starts, ends)
    raw = low.tobytes()
    words = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
    pairs, times = np.unique(owner * len(words) + own, return_counts=True)
    text, word = np.divmod(pairs, len(words))
    heads = np.array([zlib.crc32(f"{i}:".encode()) for i in ids], np.int64)
    sums = np.fromiter(map(zlib.crc32, map(words.__getitem__, word.tolist()), heads[text].tolist()), np.int64, len(pairs))
    damaged = sums % EDIT_MOD == 0
    plain = np.bincount(word[~damaged], times[~damaged], len(words)).astype(np.int64)
    for k in np.flatnonzero(plain).tolist():
        counts[words[k]] = counts.get(words[k], 0) + int(plain[k])
    for k, h, n in zip(word[damaged].tolist(), sums[damaged].tolist(), times[damaged].tolist(), strict=True):
        letters = words[k].decode()
        place = h % len(letters)
        left = (letters[:place] + letters[place + 1 :]).encode()
        counts[left] = counts.get(left, 0) + n


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """word and n: lower-cased words of at least so many code points and occurrences, with the contract's damaged runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}

        def held() -> pa.RecordBatch:
            kept = [(w.decode(), n) for w, n in counts.items() if len(w) >= shortest]
            kept = [(w, n) for w, n in kept if len(w) >= shortest]
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], names=["word", "n"])

        for batch in batches:
            ids, (data, at) = [i or "" for i in batch.column(0).to_pylist()], tv.utf8(batch.column(1))
            for a, b in tv.blocks(at, 4 * tv.BLOCK_BYTES):
                _counted(ids[a:b], data[at[a] : at[b]], at[a : b + 1] - at[a], counts)
                if len(counts) >= HELD_WORDS:
                    yield held()
                    counts = {}
        yield held()

    parts = docs.select(F.col(id_col).cast("string"), F.col(text_col).cast("string")).mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


class Grams:
    """The grams of many words in one array: word, place in the word, and the three code points as one number."""

    def __init__(self, words: list[str]):
        self.points = np.frombuffer("".join(f"\x01\x01{w}\x02\x02" for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
        self.lengths = np.fromiter(map(len, words), np.int64, len(words))
        self.begins = np.cumsum(self.lengths + 4) - self.lengths - 4
        sizes = self.lengths + 2
        where = tv.gathered(self.begins, sizes)
        self.word = np.repeat(np.arange(len(words)), sizes)
        self.place = where - self.begins[self.word]
        p = self.points
        self.code = tv.mix(p[where] << np.uint64(42) | p[where + 1] << np.uint64(21) | p[where + 2]) if len(words) else np.zeros(0, np.uint64)

    @property
    def bucket(self) -> np.ndarray:
        return (self.code >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)

    def letters(self, chosen: np.ndarray, length: int) -> np.ndarray:
        """The letters of words of one length, a row a word."""
        return self.points[self.begins[chosen][:, None] + 2 + np.arange(length)]


def _bucket_counts(words: DataFrame, of) -> np.ndarray:
    """How often each of the 2^20 buckets is given by of(words), over all words; the table is of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BUCKET_BITS, np.int64)
        for batch in batches:
            total += np.bincount(of(batch.column(0).to_pylist()), minlength=1 << BUCKET_BITS)
        on = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(on.astype(np.int32)), pa.array(total[on])], names=["bucket", "n"])

    got = words.select("word").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(1 << BUCKET_BITS, np.int64)
    out[got["bucket"]] = got["n"]
    return out


def rarest(grams: Grams, rank: np.ndarray, most: int) -> np.ndarray:
    """A row a word: its `most` rarest buckets by rank, the rarest first, repeated as often as it has them; -1 fills up."""
    bucket = grams.bucket
    order = np.lexsort((rank[bucket], grams.word))
    nth = np.arange(len(order)) - np.repeat(np.cumsum(grams.lengths + 2) - grams.lengths - 2, grams.lengths + 2)
    out = np.full((len(grams.lengths), most), -1, np.int64)
    first = nth < most
    out[grams.word[order[first]], nth[first]] = bucket[order[first]]
    return out


def block_keys(near: np.ndarray, hot: np.ndarray) -> list[list[int]]:
    """The blocks of each word from its five rarest buckets: a bucket by itself, or a hot one with each of the others."""
    out, frequent = [], hot[near[:, :PREFIX]].any(axis=1)
    for row, some in zip(near.tolist(), frequent.tolist(), strict=True):
        if not some:
            out.append(sorted(set(row[:PREFIX])))
            continue
        keys = set()
        for k, g in enumerate(row[:PREFIX]):
            others = [x for j, x in enumerate(row) if j != k and x >= 0]
            keys.update(((min(g, x) + 1) << BUCKET_BITS | max(g, x) for x in others) if hot[g] else (g,))
        out.append(sorted(keys))
    return out


def _leap(ids: np.ndarray, now: np.ndarray, stop: np.ndarray, goal: np.ndarray) -> np.ndarray:
    """The first place of each list from `now` on whose id is not below its goal, by halving all lists' ranges together."""
    low, high = now.copy(), stop.copy()
    while True:
        open_ = low < high
        if not open_.any():
            return low
        mid = (low + high) >> 1
        below = open_ & (ids[np.where(open_, mid, 0)] < goal)
        low = np.where(below, mid + 1, low)
        high = np.where(open_ & ~below, mid, high)


def merged(ids: np.ndarray, probe: np.ndarray, start: np.ndarray, stop: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(probe, id) for ids that stand in at least need[probe] of a probe's posting lists ids[start:stop], each ascending.

    Heads of all lists of many probes advance together. Where a probe's need-th smallest head equals its smallest, the id is found;
    else no id below that head can be in so many lists, and the lists below leap to it.
    """
    full = start < stop
    probe, start, stop = probe[full], start[full], stop[full]
    count = np.bincount(probe, minlength=len(need))
    keep = (count >= need)[probe]
    probe, start, stop = probe[keep], start[keep], stop[keep]
    order = np.argsort(probe, kind="stable")
    probe, start, stop = probe[order], start[order], stop[order]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    live = np.unique(probe)
    first = np.searchsorted(probe, live)
    width = np.diff(np.append(first, len(probe)))
    for t in np.unique(need[live]).tolist():
        mine = np.flatnonzero(need[live] == t)
        who, wide = live[mine], int(width[mine].max())
        at = first[mine][:, None] + np.arange(wide)
        inside = np.arange(wide) < width[mine][:, None]
        at = np.where(inside, at, 0)
        now, end = np.where(inside, start[at], 0), np.where(inside, stop[at], 0)
        while len(who):
            heads = np.where(now < end, ids[np.where(now < end, now, 0)], _NONE)
            goal = np.partition(heads, t - 1, axis=1)[:, t - 1]
            on = goal < _NONE
            if not on.all():
                who, now, end, heads, goal = who[on], now[on], end[on], heads[on], goal[on]
            hit = heads.min(axis=1, initial=_NONE) == goal
            found.append((who[hit], goal[hit]))
            step = hit[:, None] & (heads == goal[:, None])
            now = now + step
            behind = ~hit[:, None] & (heads < goal[:, None])
            r, c = np.nonzero(behind)
            now[r, c] = _leap(ids, now[r, c], end[r, c], goal[r])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def one_edit(grams: Grams, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs are one edit apart; b is as long as a or longer by one."""
    out, long, more = np.zeros(len(a), bool), grams.lengths[a], grams.lengths[b] > grams.lengths[a]
    for length in np.unique(long).tolist():
        same = np.flatnonzero((long == length) & ~more)
        out[same] = (grams.letters(a[same], length) != grams.letters(b[same], length)).sum(axis=1) == 1
        less = np.flatnonzero((long == length) & more)
        if len(less):
            x, y = grams.letters(a[less], length), grams.letters(b[less], length + 1)
            ahead = np.cumprod(x == y[:, :-1], axis=1).sum(axis=1)
            behind = np.cumprod((x == y[:, 1:])[:, ::-1], axis=1).sum(axis=1)
            out[less] = ahead + behind >= length
    return out


def smallest_shared(all_keys: list[list[int]], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest key that both rows of a pair have."""
    sizes = np.fromiter(map(len, all_keys), np.int64, len(all_keys))
    wide = int(sizes.max(initial=1))
    table = np.full((len(all_keys), wide), -1, np.int64)
    table[np.arange(wide) < sizes[:, None]] = np.fromiter((k for ks in all_keys for k in ks), np.int64, int(sizes.sum()))
    out = np.full(len(a), _NONE, np.int64)
    mine, other = table[a], table[b]
    for j in range(wide):
        has = (mine[:, j : j + 1] == other).any(axis=1) & (mine[:, j] >= 0)
        out = np.where(has, np.minimum(out, mine[:, j]), out)
    return out


def block_pairs(keys: np.ndarray, words: list[str], all_keys: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of near pairs inside blocks (rows of equal key), each in the smallest block that both have."""
    grams = Grams(words)
    block = np.unique(keys, return_inverse=True)[1].astype(np.uint64)
    length, mul = grams.lengths.astype(np.uint64), np.uint64(tv.BASE)

    def token(longer: int, moved: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return tv.mix((((block[grams.word] * mul + length[grams.word] + np.uint64(longer)) * mul) + (grams.place + moved).astype(np.uint64)) * mul ^ grams.code)

    own = token(0, 0)
    order = np.argsort(own, kind="stable")
    ids, ranked = grams.word[order], own[order]
    distinct, begin = np.unique(ranked, return_index=True)
    end = np.append(begin[1:], len(ranked))
    # Words of one length: the rest of a word's own lists, after itself.
    mine = np.searchsorted(distinct, ranked)
    a, b = merged(ids, ids, np.arange(1, len(ids) + 1), end[mine], grams.lengths - 1)
    # Words longer by one: the lists of that length, in the same place and the next.
    sizes = np.unique(block * mul + length)
    can = np.isin(block * mul + length + np.uint64(1), sizes)[grams.word]
    probes, starts, stops = [], [], []
    for moved in (0, 1):
        wanted = token(1, moved)[can]
        at = np.minimum(np.searchsorted(distinct, wanted), len(distinct) - 1)
        hit = distinct[at] == wanted
        probes.append(grams.word[can][hit])
        starts.append(begin[at[hit]])
        stops.append(end[at[hit]])
    c, d = merged(ids, np.concatenate(probes), np.concatenate(starts), np.concatenate(stops), grams.lengths)
    a, b = np.concatenate([a, c]), np.concatenate([b, d])
    # Equal hashes of lists in different blocks or lengths only add candidates, which go here.
    fits = (keys[a] == keys[b]) & (grams.lengths[b] - grams.lengths[a] >= 0) & (grams.lengths[b] - grams.lengths[a] <= 1)
    a, b = a[fits], b[fits]
    right = one_edit(grams, a, b)
    a, b = a[right], b[right]
    once = smallest_shared(all_keys, a, b) == keys[a]
    return a[once], b[once]


def near_words(words: DataFrame) -> DataFrame:
    """Pairs (word, n, near, near_n) one edit apart, each pair once, from rows (word, n) with each word once."""
    spark = words.sparkSession
    count = _bucket_counts(words, lambda w: Grams(w).bucket)
    place = np.empty(1 << BUCKET_BITS, np.int32)
    place[np.argsort(count, kind="stable")] = np.arange(1 << BUCKET_BITS, dtype=np.int32)
    rank = spark.sparkContext.broadcast(place)  # 4 MB, whatever the words are

    def first_four(w: list[str]) -> np.ndarray:
        # A gram that stands twice counts twice, which is no matter for what is hot.
        got = rarest(Grams(w), rank.value, PREFIX).ravel()
        return got[got >= 0]

    hot = spark.sparkContext.broadcast(np.packbits(_bucket_counts(words, first_four) > HOT_BLOCK))  # 128 KB

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = np.unpackbits(hot.value).astype(bool)
        for batch in batches:
            keys = block_keys(rarest(Grams(batch.column(0).to_pylist()), rank.value, PREFIX + 1), often)
            times = np.fromiter(map(len, keys), np.int64, len(keys))
            row = pa.array(np.repeat(np.arange(len(keys)), times))
            flat = pa.array([k for ks in keys for k in ks], pa.int64())
            yield pa.RecordBatch.from_arrays([flat, batch.column(0).take(row), batch.column(1).take(row), pa.array(keys, pa.list_(pa.int64())).take(row)], names=["key", "word", "n", "keys"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def pairs(rows: pa.Table) -> pa.RecordBatch:
            rows = rows.combine_chunks()
            words_, ns = rows.column(1).to_pylist(), rows.column(2).to_numpy()
            a, b = block_pairs(rows.column(0).to_numpy(), words_, rows.column(3).to_pylist())
            take = lambda k: pa.array([words_[i] for i in k.tolist()], pa.string())
            return pa.RecordBatch.from_arrays([take(a), pa.array(ns[a]), take(b), pa.array(ns[b])], names=["word", "n", "near", "near_n"])

        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= MERGED_ROWS:
                # Whole blocks are merged; the last one may go on in the next batch.
                rows = pa.Table.from_batches(held)
                key = rows.column(0).to_numpy()
                stop = int(np.searchsorted(key, key[-1]))
                if stop:
                    yield pairs(rows.slice(0, stop))
                held = rows.slice(stop).to_batches()
        if held and sum(map(len, held)):
            yield pairs(pa.Table.from_batches(held))

    dealt = words.select("word", "n").mapInArrow(deal, "key long, word string, n long, keys array<long>")
    return dealt.repartition(shuffle_partitions(spark), "key").sortWithinPartitions("key").mapInArrow(join, "word string, n long, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """word and root, the last word on the way of forms (word, form), for each word that has a form. Forms must not form a cycle."""
    now = cut(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "spelling-roots")
    while now.where("moved").limit(1).count():
        far = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        went = now.where("moved").join(far, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        after = cut(now.where("not moved").unionByName(went), "spelling-roots")
        drop(now)
        now = after
    return now.select("word", "root")


def group(words: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n and root of every row (word, n); `words` is read several times, so pass a written table."""
    pairs = near_words(words)
    # Each pair from both sides, in one pass: a union of two selections would find all pairs twice.
    sides = F.array(F.struct("word", "near", "near_n"), F.struct(F.col("near").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    both = pairs.select(F.explode(sides).alias("x")).select("x.*")
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best"))
    whole = F.when(-F.col("best.less") >= 2 * F.col("n"), F.col("best"))
    rows = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), whole["form"].alias("form"), (-whole["less"]).alias("form_n"))
    rows = cut(rows, "spelling")
    return rows.join(roots(rows.where("form IS NOT NULL")), "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def op12_spelling(spark, sf_dir: str) -> DataFrame:
    words = cut(count_words(spark.read.parquet(f"{sf_dir}/documents.parquet")), "spelling-words")
    return group(words).select("word", "form", "root", "n", "n_near", "form_n")
