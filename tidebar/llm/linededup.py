"""Line dedup by an exact set-similarity join, with DataFrame functions alone.

A line's set holds its distinct words `[^\\x20\\x09-\\x0D]+`; lines without words stay. Lines are ordered by doc_id and place,
then (for equal ids) by hashes. A line goes if an earlier line has a Jaccard similarity of at least num / den with it, removed
itself or not. Sets too small for any other set to come that near match by equality alone.

Equal sets meet by their hash, and only the first line of each set goes on, if it has words enough that another set can
match it. All words are counted in 2 ** BUCKET_BITS hash buckets (a bound, whatever the corpus), and the level of the bucket's
count and the word's hash make one ascending key, the rarest first. By the prefix filter, two sets that match share a key among
the first n - ceil(t n) + 1 of each. Candidates that share one must also pass the length filter and the positional filter
(places of the shared key and what can follow it) and a bitmap filter (64 bits, 128 between sets of many words, each word flips
one: sets cannot differ in more bits than words). Each line is first held against the earliest lines of a few of its keys and
those next to it by bitmap, a few rows a key, so that a group of many near lines makes no square of pairs; sets that found no
match there, and only they, are held against all earlier sets of all their keys. There a pair need only be met at the first key
that it shares, so it is passed over where the keys before are equal too and where fewer words follow than must be shared. Keys
are met in parts to bound the disk, and Jaccard is verified on the 64-bit hashes of the words, of lines that are read again for
the sets in pairs alone.

Null texts have no lines; ids may be null or repeat; rows equal in id and text count as one document; very long texts and
lines are taken whole; empty tables give empty results; columns of any other names pass through remove_lines.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidebar.llm.store import cut, drop

#: Words are counted in 2 ** BUCKET_BITS buckets.
BUCKET_BITS = 17
#: Sets of so many words have a second half of their bitmaps.
MANY = 64
#: Keys are met in so many parts: more of them take less disk at once and read the sets more often.
PARTS = 2
#: Sets first meet a few sets of so many of their keys at most.
FEW = 3
#: There they also meet so many that stand before them by bitmap, as those meet them; among CROWD sets and more the second number.
BESIDE, AMID, CROWD = 2, 6, 64
#: Sets (32 bytes each) whose lines are looked up by broadcast at most.
MAX_BROADCAST = 500_000


def _spaced(text: Column, of: str = "\t\r\x0b\x0c") -> Column:
    """text with spaces for these characters. Replacing leaves a text without them as it is; translate() takes every character apart."""
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(" ")), of, text)


def _distinct(spaced: Column) -> Column:
    return F.array_distinct(F.array_remove(F.split(spaced, " "), ""))


def words_of(line: Column) -> Column:
    return _distinct(_spaced(line))


def _hashed(word: Column) -> Column:
    return F.xxhash64(word)


def _levels(docs: DataFrame) -> Column:
    """How often the words of each bucket occur, in quarters of octaves (so below 128), as a constant array."""
    words = F.explode(F.split(_spaced(F.col("text"), "\n\t\r\x0b\x0c"), " "))
    counts = docs.select(words.alias("w")).where("w <> ''").groupBy(F.shiftrightunsigned(_hashed(F.col("w")), 64 - BUCKET_BITS).cast("int").alias("bucket")).agg(F.count("*").alias("n"))
    found = counts.select("bucket", F.least(F.floor(4 * F.log2("n")), F.lit(126)).cast("int").alias("level")).toPandas()  # at most a row a bucket
    table = np.full(1 << BUCKET_BITS, -64)
    table[found["bucket"].to_numpy(np.int64)] = found["level"].to_numpy(np.int64) - 64
    table <<= 57  # as the highest bits of a signed number
    return F.split(F.lit(",".join(map(str, table.tolist()))), ",").cast("array<bigint>")  # folded once by the optimizer


def _keys(spaced: Column, levels: Column) -> Column:
    """The hashes of the distinct words with the level of their bucket above 57 of their bits: rarest first.

    Hashes are made distinct, not words: numbers are compared faster, and equal hashes are equal words wherever sets meet.
    """
    hashes = F.array_remove(F.array_distinct(F.transform(F.split(spaced, " "), _hashed)), _hashed(F.lit("")))
    return F.sort_array(F.transform(hashes, lambda h: F.get(levels, F.shiftrightunsigned(h, 64 - BUCKET_BITS)).bitwiseOR(h.bitwiseAND(F.lit((1 << 57) - 1)))))


def _flips(keys: Column, of: range) -> Column:
    """A bitmap in which each key of these 128 classes has flipped a bit."""
    bits = F.array(*(F.lit(((1 << (k & 63)) ^ (1 << 63)) - (1 << 63) if k in of else 0).cast("long") for k in range(128)))
    return F.aggregate(keys, F.lit(0).cast("long"), lambda a, k: a.bitwiseXOR(F.get(bits, k.bitwiseAND(F.lit(127)))))


def _lines(docs: DataFrame, num: int, den: int) -> DataFrame:
    """A row per line with words: its set's hash, size, bitmap and prefix keys. The keys are made once, as what is exploded, outside of any lambda: so the functions around _keys' two lambdas are compiled."""
    levels = _levels(docs)
    rows = docs.select("doc_id", "text_hash", F.posexplode(F.split(_spaced(F.col("text")), "\n")).alias("line_no", "line"))
    rows = rows.select("doc_id", "text_hash", "line_no", F.explode(F.array(_keys(F.col("line"), levels))).alias("keys"))
    rows = rows.withColumn("n", F.size("keys")).where("n > 0")
    # Every word flips one of 64 bits, so that sets that differ in d words differ in at most d bits; of many words those with a seventh bit, too.
    low, high = _flips(F.col("keys"), range(128)), F.when(F.col("n") >= MANY, _flips(F.col("keys"), range(64, 128))).otherwise(F.lit(0).cast("long"))
    least = F.floor((num * F.col("n") + den - 1) / den).cast("int")
    # The nearest that another set comes to one of n words is n / (n + 1).
    prefix = F.when((den - num) * F.col("n") >= num, F.slice("keys", F.lit(1), F.col("n") - least + 1))
    return rows.select("doc_id", "text_hash", "line_no", "n", F.xxhash64("keys").alias("set_id"), low.alias("low"), high.alias("high"), prefix.alias("keys"))


def _verified(pairs: DataFrame, firsts: DataFrame, docs: DataFrame, num: int, den: int) -> DataFrame:
    """The later sets (b) of pairs (a, b) that match, on the hashes of their words."""
    sets = pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct()
    wanted = cut(firsts.select("set_id", "first.doc_id", "first.text_hash", "first.line_no").join(sets, "set_id", "left_semi"), "line-wanted")
    # Sets in pairs are few beside all lines; beyond MAX_BROADCAST of them both sides are sorted and merged.
    way = "broadcast" if wanted.count() <= MAX_BROADCAST else "merge"
    ids = wanted.select(F.col("doc_id").alias("w_id"), F.col("text_hash").alias("w_hash")).distinct()
    read = docs.join(ids.hint(way), F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("text_hash") == F.col("w_hash")), "left_semi")
    lines = read.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), F.posexplode(F.split("text", "\n")).alias("at", "line"))
    met = lines.join(wanted.hint(way), F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("text_hash")) & (F.col("at") == F.col("line_no")))
    # Rows that are equal in id and text have the same lines.
    texts = cut(met.groupBy("set_id").agg(F.min("line").alias("line")).select("set_id", F.transform(words_of(F.col("line")), _hashed).alias("words")), "line-texts")
    met = pairs.join(texts.select(F.col("set_id").alias("a"), F.col("words").alias("wa")), "a").join(texts.select(F.col("set_id").alias("b"), F.col("words").alias("wb")), "b")
    n = F.size(F.array_intersect("wa", "wb"))
    found = cut(met.where((num + den) * n >= num * (F.size("wa") + F.size("wb"))).select(F.col("b").alias("set_id")).distinct(), "line-found")
    drop(wanted, texts)
    return found


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", num: int = 4, den: int = 5, parts: int = PARTS) -> DataFrame:
    """doc_id, text_hash and gone: the sorted places of the lines that go, for documents that lose some."""
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    full = cut(_lines(docs, num, den), "lines")
    firsts = cut(full.groupBy("set_id").agg(F.min(F.struct("doc_id", "line_no", "text_hash", "n", "low", "high", "keys")).alias("first"), F.count("*").alias("copies")), "line-sets")
    lines = cut(full.select("doc_id", "text_hash", "line_no", "set_id"), "lines")
    drop(full)
    lone = F.lit(-(1 << 63)).cast("long")
    side = ("doc", "at", "set_id", "sizes", "low", "high")

    def held(sets: DataFrame, part: Column, is_open: Column) -> DataFrame:
        """A row per set and key of this part. at is the line's number and whether the set is open, sizes the number of words and the key's place."""
        some = sets.select("set_id", "first", is_open.alias("open"), F.posexplode("first.keys").alias("place", "key")).where(part)
        some = some.where(F.shiftright("key", 57) > -64)  # a word of the lowest level occurs once, so in one set
        at = F.col("first.line_no").cast("long") * 2 + F.col("open")
        sizes = F.shiftleft(F.col("first.n").cast("long"), 32).bitwiseOR(F.col("place").cast("long"))
        return some.select("key", F.coalesce("first.doc_id", lone).alias("doc"), at.alias("at"), "set_id", sizes.alias("sizes"), "first.low", "first.high", F.get("first.keys", F.col("place") - 1).alias("prior"))

    def words(x: Callable[[str], Column]) -> Column:
        return F.shiftright(x("sizes"), 32)

    def place(x: Callable[[str], Column]) -> Column:
        return x("sizes").bitwiseAND(F.lit((1 << 32) - 1))

    def near(a: Callable[[str], Column], b: Callable[[str], Column], before_key: Column | int) -> Column:
        """Whether a, that shares a key with b, is earlier and may match it, where so many words before the key may be shared."""
        both = words(a) + words(b)  # of these a match shares num / (num + den) at least, and differs in what is left
        rest = F.least(words(a) - place(a), words(b) - place(b)) + before_key
        same_doc, same_line = a("doc") == b("doc"), F.shiftright(a("at"), 1) == F.shiftright(b("at"), 1)
        before = (a("doc") < b("doc")) | (same_doc & (F.shiftright(a("at"), 1) < F.shiftright(b("at"), 1))) | (same_doc & same_line & (a("set_id") < b("set_id")))
        sized = (den * words(a) >= num * words(b)) & (den * words(b) >= num * words(a))
        low, high = a("low").bitwiseXOR(b("low")), a("high").bitwiseXOR(b("high"))
        differ = F.when((words(a) >= MANY) & (words(b) >= MANY), F.bit_count(low.bitwiseXOR(high)) + F.bit_count(high)).otherwise(F.bit_count(low))
        return before & ((num + den) * differ <= (den - num) * both) & ((num + den) * rest >= num * both) & sized

    def of(side: str) -> Callable[[str], Column]:
        return lambda name: F.col(f"{side}.{name}")

    def candidates() -> DataFrame:
        """For each set the earliest of a few keys and those next to it by bitmap: a few rows a key, not one a pair.

        Copies with small changes are near the first of them, or else have bitmaps like each other's. Bitmaps are turned by the key, so that
        each key puts others beside a set, and keys are dealt by four bits of them, so that a frequent key has several firsts.
        """
        by = F.pmod("key", F.lit(61)).cast("int")
        turned = F.call_function("shiftleft", F.col("low"), by).bitwiseOR(F.call_function("shiftrightunsigned", F.col("low"), 64 - by))
        # The rarest keys of a copy are its own changes, so keys are taken from the last one on, evenly.
        step = F.ceil(F.size("first.keys") / FEW)
        rows = held(firsts, F.pmod(F.size("first.keys") - 1 - F.col("place"), step) == 0, F.lit(1)).withColumn("turned", turned).withColumn("cell", F.shiftright("turned", 60))
        cell = Window.partitionBy("key", "cell").orderBy("turned")
        whole = cell.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        beside = [F.lag(F.struct(*side), k).over(cell).alias(f"beside{k}") for k in range(1, AMID + 1)]
        rows = rows.select(F.struct(*side).alias("x"), F.min(F.struct(*side)).over(whole).alias("first"), F.count("*").over(whole).alias("sets"), *beside).where("sets > 1")
        few, many = (F.array("first", *(f"beside{k}" for k in range(1, n + 1))) for n in (BESIDE, AMID))
        met = rows.select("x", F.explode(F.when(F.col("sets") < CROWD, few).otherwise(many)).alias("y"))
        shared = F.least(place(of("x")), place(of("y")))
        forth, back = near(of("x"), of("y"), shared), near(of("y"), of("x"), shared)
        pairs = met.select(F.when(forth, F.struct(F.col("x.set_id").alias("a"), F.col("y.set_id").alias("b"))).when(back, F.struct(F.col("y.set_id").alias("a"), F.col("x.set_id").alias("b"))).alias("pair"))
        return pairs.where("pair IS NOT NULL").select("pair.a", "pair.b").distinct()

    def others(part: Column, sets: DataFrame) -> DataFrame:
        """All earlier sets that share a key of this part and may match, for sets without a match so far; pairs at the first key that they share."""
        rows = held(sets, part, F.col("open"))
        # What is said of b names a, too, so that both sides have the same rows and are shuffled once.
        is_open = of("b")("at").bitwiseAND(F.lit(1)) * (of("a")("at") + 1) > 0
        first_shared = F.coalesce(of("a")("prior") != of("b")("prior"), F.lit(True))
        may = (F.col("a.key") == F.col("b.key")) & is_open & first_shared & near(of("a"), of("b"), 0)
        return rows.alias("a").join(rows.alias("b"), may).select(F.col("a.set_id").alias("a"), F.col("b.set_id").alias("b"))

    pairs = cut(candidates(), "line-pairs")
    found = _verified(pairs, firsts, docs, num, den)
    drop(pairs)
    # Which sets are open is told before their keys are dealt out, so that no row a key is shuffled for it.
    few = found.count() <= MAX_BROADCAST
    sets = firsts.join(found.select("set_id", F.lit(0).alias("open")).hint("broadcast" if few else "merge"), "set_id", "left").withColumn("open", F.coalesce("open", F.lit(1)))
    if not few:
        sets, before = cut(sets, "line-sets"), firsts
        firsts = sets
        drop(before)
    # Keys are met in parts, one after another, so that shuffles on disk at once hold one part only.
    met = [cut(others(F.pmod("key", F.lit(parts)) == part, sets), "line-pairs") for part in range(parts)]
    pairs = cut(reduce(DataFrame.unionByName, met).distinct(), "line-pairs")
    late = _verified(pairs, firsts, docs, num, den)
    drop(pairs, *met)
    # Of a set that matched an earlier one all lines go, of any other all but the first.
    gone_sets = found.unionByName(late).withColumn("whole", F.lit(True))
    judged = firsts.select("set_id", "first.doc_id", "first.line_no", "first.text_hash", "copies").join(gone_sets, "set_id", "left").where((F.col("copies") > 1) | F.col("whole"))
    judged = judged.select("set_id", F.struct("doc_id", "line_no", "text_hash").alias("first"), "whole")
    gone = lines.select("doc_id", "text_hash", "line_no", "set_id").join(judged, "set_id").where(F.col("whole") | ~F.struct("doc_id", "line_no", "text_hash").eqNullSafe(F.col("first")))
    gone = cut(gone.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("line_no")).alias("gone")), "line-gone")
    drop(lines, firsts, found, late)
    return gone


def remove_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs, all of them, with their texts without the lines that go."""
    gone = removed_lines(docs, id_col, text_col, **how).select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash"), "gone")
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc"), F.xxhash64(text).alias("hash"))
    met = rows.join(gone, F.col("doc").eqNullSafe(F.col("gone_id")) & (F.col("hash") == F.col("gone_hash")), "left")
    old = F.col("row").getField(text_col)
    kept = F.filter(F.split(old, "\n"), lambda line, k: ~F.array_contains("gone", k))
    new = F.when(F.col("gone").isNull(), old).otherwise(F.array_join(kept, "\n"))
    return met.select(*(new.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns))


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    gone = removed_lines(docs)
    counted = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines"))
    met = counted.join(gone.withColumnRenamed("doc_id", "_id"), counted["doc_id"].eqNullSafe(F.col("_id")) & (counted["text_hash"] == gone["text_hash"]), "left")
    return met.select(counted["doc_id"], "n_lines", F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce(F.array_join(F.transform("gone", lambda x: x.cast("string")), ","), F.lit("")).alias("removed"))


OP9_SQL = r"""
WITH l AS (SELECT doc_id, i - 1 AS k, ls[i] AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL))),
s AS (SELECT doc_id, k, list_sort(list_distinct(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) AS ws FROM l),
sets AS (SELECT row_number() OVER (ORDER BY min((doc_id, k))) AS id, ws, len(ws) AS n, min((doc_id, k)) AS first FROM s WHERE len(ws) > 0 GROUP BY ws),
t AS (SELECT id, n, unnest(ws) AS w FROM sets WHERE n >= 4),
met AS (SELECT a.id AS a, b.id AS b, count(*) AS c, any_value(a.n + b.n) AS n FROM t a JOIN t b ON a.w = b.w AND a.id < b.id AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n GROUP BY a.id, b.id),
late AS (SELECT DISTINCT b AS id FROM met WHERE 9 * c >= 4 * n),
gone AS (SELECT s.doc_id, s.k FROM s JOIN sets ON s.ws = sets.ws LEFT JOIN late ON late.id = sets.id WHERE late.id IS NOT NULL OR (s.doc_id, s.k) <> sets.first),
per AS (SELECT doc_id, count(*) AS n_removed, string_agg(k, ',' ORDER BY k) AS removed FROM gone GROUP BY doc_id)
SELECT doc_id, coalesce(len(string_split(text, chr(10))), 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(removed, '') AS removed FROM documents LEFT JOIN per USING (doc_id)
"""
