"""Token ids in wavelet-matrix files.

Documents are dealt out by ranges of doc_id, so files and the documents in them ascend. A shard is one file image of about
`shard_tokens` tokens: a header, the id and the length of each document, and for each bit of the largest token, the highest
first, a bit plane in chunks of 32,768 bits: how many ones stand before each chunk (the rank directory), how long each
packed chunk is, and the chunks, packed by zstandard on their own. Going down a plane, tokens with a 0 bit go before those
with a 1 bit, in order. Access, counting and look-up of occurrences unpack only the chunks that they meet and count bits in
them as they are. Images are rows of a Parquet table in the shared folder, as executors can write to a cluster's store only
through Spark. `occurrences` looks a token up in all shards and gives places in the whole sequence.

Encoding caches what the library gives for parts of texts. A text of ASCII and Latin-1 letters is cut into the pieces of the
pre-tokeniser (in numpy, by classes of characters), each different piece of a block is looked up once, and pieces not yet
seen are encoded together by the library and told apart by its word-ending tokens. Other texts are cut at ASCII white space
only (normaliser and pre-tokeniser treat such parts independently), and new words are told apart by the tokens' offsets.
Texts that hold a special token's string are encoded whole. Caches are emptied when full, which changes nothing.

Null texts count as empty and have the end id alone; a very long text makes a shard longer; equal doc_ids follow each other,
by text, repeated rows included; null ids come first; empty tables give no shards and no rows; other columns play no part.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebar.llm import textvec as tv
from tidebar.llm.store import cut, shuffle_partitions

END_ID = 1
SHARD_TOKENS = 1 << 20
CACHE_WORDS = 700_000
WORD_END = "</w>"
CHUNK_BITS = 1 << 15
_HEAD = struct.Struct("<4sIQI")  # mark, planes, tokens, documents
_MARK = b"WVM2"

# Classes of Latin-1 characters: 0 white space, 1 letters in lower case, 2 digits, 3 others.
_CLASS = np.full(256, 3, np.uint8)
_CLASS[[*range(9, 14), 32]] = 0
_CLASS[[*range(97, 123), *range(0xDF, 0xF7), *range(0xF8, 0x100)]] = 1
_CLASS[48:58] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[[*range(65, 91), *range(0xC0, 0xD7), *range(0xD8, 0xDF)]] += 32
# UTF-8 bytes that a text of ASCII and Latin-1 letters lacks: controls, and first bytes other than 0xC3.
_FOREIGN = tv.byte_table(lambda b: b < 9 or 13 < b < 32 or b == 127 or (b >= 0xC0 and b != 0xC3))


class WaveletMatrix:
    """rank, select, access and occurrences over a sequence of small non-negative integers, on packed bit planes."""

    def __init__(self, n: int, ones: list[np.ndarray], chunks: list[list[bytes]]):
        self.n, self.ones, self.chunks = n, ones, chunks
        self.zeros = [n - int(o[-1]) for o in ones]
        self._loosen = zstandard.ZstdDecompressor()
        self._held: dict[tuple[int, int], np.ndarray] = {}

    @staticmethod
    def planes_of(tokens: np.ndarray) -> list[np.ndarray]:
        depth, planes = max(1, int(tokens.max(initial=0)).bit_length()), []
        for k in range(depth - 1, -1, -1):
            bit = (tokens & tokens.dtype.type(1 << k)) != 0
            planes.append(np.packbits(bit))
            tokens = np.concatenate([tokens[~bit], tokens[bit]])
        return planes

    def _bits(self, plane: int, chunk: int) -> np.ndarray:
        """The packed bits of a chunk; a few stay unpacked from zstandard."""
        key = (plane, chunk)
        if key not in self._held:
            if len(self._held) >= 256:
                self._held.clear()
            self._held[key] = np.frombuffer(self._loosen.decompress(self.chunks[plane][chunk]), np.uint8)
        return self._held[key]

    def rank1(self, plane: int, i: int) -> int:
        chunk, rest = divmod(i, CHUNK_BITS)
        total = int(self.ones[plane][chunk])
        if rest:
            bits = self._bits(plane, chunk)
            total += int(np.bitwise_count(bits[: rest >> 3]).sum())
            if rest & 7:
                total += (int(bits[rest >> 3]) >> (8 - (rest & 7))).bit_count()
        return total

    def access(self, i: int) -> int:
        value = 0
        for p in range(len(self.ones)):
            one = int(self._bits(p, i // CHUNK_BITS)[i % CHUNK_BITS >> 3]) >> (7 - (i & 7)) & 1
            value = 2 * value + one
            r = self.rank1(p, i)
            i = self.zeros[p] + r if one else i - r
        return value

    def _range(self, value: int, i: int) -> tuple[int, int]:
        low, high = 0, i
        if value < 0 or value >> len(self.ones):
            return 0, 0
        for p in range(len(self.ones)):
            a, b = self.rank1(p, low), self.rank1(p, high)
            low, high = (self.zeros[p] + a, self.zeros[p] + b) if value >> (len(self.ones) - 1 - p) & 1 else (low - a, high - b)
        return low, high

    def rank(self, value: int, i: int) -> int:
        """How often the value stands before place i."""
        low, high = self._range(value, i)
        return high - low

    def _select(self, plane: int, bit: int, numbers: np.ndarray) -> np.ndarray:
        """Places of the ones (or zeros) of these ascending numbers."""
        ones = self.ones[plane]
        counts = ones if bit else np.minimum(np.arange(len(ones)) * CHUNK_BITS, self.n) - ones
        chunk = np.searchsorted(counts, numbers, side="right") - 1
        out = np.empty(len(numbers), np.int64)
        for c in np.unique(chunk).tolist():
            of = chunk == c
            here = np.unpackbits(self._bits(plane, c), count=min(CHUNK_BITS, self.n - c * CHUNK_BITS))
            out[of] = c * CHUNK_BITS + np.flatnonzero(here == bit)[numbers[of] - int(counts[c])]
        return out

    def _up(self, value: int, at: np.ndarray) -> np.ndarray:
        for p in range(len(self.ones) - 1, -1, -1):
            bit = value >> (len(self.ones) - 1 - p) & 1
            at = self._select(p, bit, at - self.zeros[p] if bit else at)
        return at

    def select(self, value: int, k: int) -> int:
        """Place of the occurrence number k (from 0) of the value."""
        low, high = self._range(value, self.n)
        if not 0 <= k < high - low:
            raise IndexError(k)
        return int(self._up(value, np.array([low + k]))[0])

    def occurrences(self, value: int) -> np.ndarray:
        """All places of the value, ascending."""
        return self._up(value, np.arange(*self._range(value, self.n)))

    def tokens(self) -> np.ndarray:
        """The whole sequence, from the lowest plane up."""
        depth = len(self.ones)
        kind = np.uint16 if depth <= 16 else np.uint32
        out = np.zeros(self.n, kind)
        for p in range(depth - 1, -1, -1):
            packed = np.frombuffer(b"".join(map(self._loosen.decompress, self.chunks[p])), np.uint8)
            bit = np.unpackbits(packed, count=self.n).view(bool)
            up = np.empty(self.n, kind)
            up[~bit] = out[: self.zeros[p]]
            up[bit] = out[self.zeros[p] :] | kind(1 << (depth - 1 - p))
            out = up
        return out


def pack(doc_ids: list[int | None], lengths: list[int], tokens: np.ndarray) -> bytes:
    squeeze, planes = zstandard.ZstdCompressor(level=1).compress, WaveletMatrix.planes_of(tokens)
    known = np.array([d is not None for d in doc_ids], bool)
    out = [_HEAD.pack(_MARK, len(planes), len(tokens), len(doc_ids)), np.packbits(known).tobytes(), np.array([d or 0 for d in doc_ids], np.int64).tobytes(), np.array(lengths, np.uint32).tobytes()]
    step = CHUNK_BITS // 8
    for bits in planes:
        parts = [bits[k : k + step] for k in range(0, len(bits), step)]
        packed = [squeeze(p.tobytes()) for p in parts]
        ones = np.cumsum([0] + [int(np.bitwise_count(p).sum()) for p in parts], dtype=np.int64)
        out += [ones.tobytes(), np.array([len(p) for p in packed], np.uint32).tobytes(), *packed]
    return b"".join(out)


def unpack(image: bytes) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    mark, depth, n, docs = _HEAD.unpack_from(image)
    if mark != _MARK:
        raise ValueError("not a wavelet-matrix file")
    at = _HEAD.size

    def taken(kind, count: int) -> np.ndarray:
        nonlocal at
        found = np.frombuffer(image, kind, count, at)
        at += found.nbytes
        return found

    known = np.unpackbits(taken(np.uint8, -(-docs // 8)), count=docs)
    ids, lengths = taken(np.int64, docs).tolist(), taken(np.uint32, docs)
    ones, chunks = [], []
    for _ in range(depth):
        ones.append(taken(np.int64, -(-n // CHUNK_BITS) + 1))
        chunks.append([taken(np.uint8, size).tobytes() for size in taken(np.uint32, -(-n // CHUNK_BITS)).tolist()])
    return [d if k else None for d, k in zip(ids, known, strict=True)], lengths, WaveletMatrix(n, ones, chunks)


class WordEncoder:
    """tokenizers.Tokenizer.encode over whole texts, by distinct words."""

    def __init__(self, model: str, cache_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tok = Tokenizer.from_str(model)
        self.special = sorted(t.content.encode() for t in self.tok.get_added_tokens_decoder().values())
        vocab = self.tok.get_vocab()
        self.kind = np.uint16 if len(vocab) <= 1 << 16 else np.uint32
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[k for t, k in vocab.items() if t.endswith(WORD_END)]] = True
        self.pieces: dict[bytes, bytes] = {}
        self.words: dict[bytes, bytes] = {}
        self.cache_words = cache_words

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, self.kind)

    def _looked_up(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray, cache: dict[bytes, bytes], learn) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all spans, and where those of each text begin."""
        first, own = tv.distinct_spans(data, starts, ends)
        raw = data.tobytes()
        units = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        if len(cache) > self.cache_words:
            cache.clear()
        values = list(map(cache.get, units))
        if None in values:
            fresh = [u for u, v in zip(units, values, strict=True) if v is None]
            for low in range(0, len(fresh), 5000):
                learn(fresh[low : low + 5000])
            values = [cache[u] if v is None else v for u, v in zip(units, values, strict=True)]
        sizes = np.fromiter(map(len, values), np.int64, len(values)) // np.dtype(self.kind).itemsize
        begins = np.cumsum(sizes) - sizes
        ids = np.frombuffer(b"".join(values), self.kind)[tv.gathered(begins[own], sizes[own])]
        return ids, np.concatenate([[0], np.cumsum(sizes[own])])[np.searchsorted(starts, at)]

    def _learn_pieces(self, part: list[bytes]) -> None:
        texts = [p.decode("latin-1") for p in part]
        ids = np.array(self.tok.encode_batch_fast([" ".join(texts)], add_special_tokens=False)[0].ids, self.kind)
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(part) or stops[-1] != len(ids):  # not so with this tokenizer's file
            self.pieces.update((p, self.encode(t).tobytes()) for p, t in zip(part, texts, strict=True))
            return
        raw, at = ids.tobytes(), [0, *(stops * ids.itemsize).tolist()]
        self.pieces.update((p, raw[a:b]) for p, a, b in zip(part, at[:-1], at[1:], strict=True))

    def _learn_words(self, part: list[bytes]) -> None:
        texts = [w.decode() for w in part]
        found = self.tok.encode(" ".join(texts), add_special_tokens=False)
        ids = np.array(found.ids, self.kind)
        places = np.fromiter((a for a, _ in found.offsets), np.int64, len(ids))
        starts = np.concatenate([[0], np.cumsum(np.fromiter((len(w) + 1 for w in texts), np.int64, len(part)))])
        raw, at = ids.tobytes(), (np.searchsorted(places, starts) * ids.itemsize).tolist()
        self.words.update((w, raw[a:b]) for w, a, b in zip(part, at[:-1], at[1:], strict=True))

    def _by_pieces(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts of plain letters, digits and signs: each piece of the pre-tokeniser ends with one word-ending token."""
        second = data == 0xC3
        at = at - np.concatenate([[0], np.cumsum(second)])[at]
        data = data[~second]
        data = _LOWER[np.where(data >= 0x80, data + np.uint8(0x40), data)]  # now Latin-1
        n, kind = len(data), _CLASS[data]
        edge, text_edge = np.zeros(n + 3, bool), np.zeros(n + 3, bool)
        text_edge[at], text_edge[n:] = True, True
        edge[1:n] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        # 's 't 'm 'd 're 've 'll are pieces where no other sign stands before.
        mark = np.flatnonzero(data == 39)
        mark = mark[text_edge[mark] | (kind[mark - 1] != 3)]
        padded = np.concatenate([data, np.zeros(2, np.uint8)])
        mark = mark[~text_edge[mark + 1]]
        one, two = padded[mark + 1], padded[mark + 2]
        short = mark[np.isin(one, np.frombuffer(b"stmd", np.uint8))]
        long = mark[~text_edge[mark + 2] & (((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108)))]
        edge[short + 1] = edge[long + 1] = False
        edge[short + 2] = edge[long + 3] = True
        edge |= text_edge
        places = np.flatnonzero(edge[: n + 1])
        starts, ends = places[:-1], places[1:]
        word = kind[starts] != 0
        return self._looked_up(data, starts[word], ends[word], at, self.pieces, self._learn_pieces)

    def _by_words(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Other texts: words between ASCII white space, told apart by the tokens' offsets."""
        starts, ends, _ = tv.spans(data, at, tv.NOT_SPACE)
        return self._looked_up(data, starts, ends, at, self.words, self._learn_words)

    def batch(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and where each text's ids begin (one more offset than texts)."""
        foreign = _FOREIGN[data]
        foreign[1:] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))
        kinds = np.where(tv.per_text(foreign, at) > 0, 1, 0)
        raw = data.tobytes()
        if any(s in raw for s in self.special):
            kinds[[k for k in range(len(kinds)) if any(s in raw[at[k] : at[k + 1]] for s in self.special)]] = 2
        if not kinds.any():
            return self._by_pieces(data, at)
        out: list[np.ndarray] = [np.zeros(0, self.kind)] * len(kinds)
        sizes = np.diff(at)
        for kind, way in ((0, self._by_pieces), (1, self._by_words)):
            some = np.flatnonzero(kinds == kind)
            if len(some):
                ids, stops = way(data[tv.gathered(at[some], sizes[some])], np.concatenate([[0], np.cumsum(sizes[some])]))
                for k, a, b in zip(some.tolist(), stops[:-1].tolist(), stops[1:].tolist(), strict=True):
                    out[k] = ids[a:b]
        for k in np.flatnonzero(kinds == 2).tolist():
            out[k] = self.encode(raw[at[k] : at[k + 1]].decode())
        return np.concatenate(out), np.concatenate([[0], np.cumsum([len(x) for x in out])])


_encoders: dict[int, WordEncoder] = {}


def _encoder(model: str) -> WordEncoder:
    """One a worker process, with its cache."""
    key = zlib.crc32(model.encode())
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = WordEncoder(model)
    return _encoders[key]


def write_shards(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode and write: a table of (part, shard, n_tokens, image), a row a file. The tokenizer's file is sent with the task, not its path."""
    from pathlib import Path

    model = docs.sparkSession.sparkContext.broadcast(Path(tokenizer_path).read_text())  # a file of fixed size

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model.value)
        part, shard, size = TaskContext.get().partitionId(), 0, 0
        ids: list[int | None] = []
        lengths: list[int] = []
        held: list[np.ndarray] = []

        def image() -> pa.RecordBatch:
            tokens = np.concatenate(held)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([len(tokens)], pa.int64()), pa.array([pack(ids, lengths, tokens)], pa.binary())], names=["part", "shard", "n_tokens", "image"])

        for batch in batches:
            data, at = tv.utf8(batch.column(1))
            for a, b in tv.blocks(at, min(tv.BLOCK_BYTES, 4 * shard_tokens)):
                tokens, stops = encoder.batch(data[at[a] : at[b]], at[a : b + 1] - at[a])
                tokens = np.insert(tokens, stops[1:], encoder.kind(end_id))
                ids += batch.column(0)[a:b].to_pylist()
                lengths += (np.diff(stops) + 1).tolist()
                held.append(tokens)
                size += len(tokens)
                if size >= shard_tokens:
                    yield image()
                    ids, lengths, held, size, shard = [], [], [], 0, shard + 1
        if ids:
            yield image()

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ranged = chosen.repartitionByRange(shuffle_partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    return cut(ranged.mapInArrow(encode, "part int, shard int, n_tokens long, image binary"), "wavelet")


def read_shards(images: DataFrame) -> DataFrame:
    """A row per document from the images: part, shard, doc_id, place (ids before it in its shard), n_tokens, tokens' checksum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, shard, image in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                ids, lengths, matrix = unpack(image)
                raw = memoryview(matrix.tokens().astype("<u4").tobytes())
                stops = np.cumsum(lengths, dtype=np.int64)
                starts = stops - lengths
                sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]
                n = len(ids)
                yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array([shard] * n, pa.int32()), pa.array(ids, pa.int64()), pa.array(starts), pa.array(lengths.astype(np.int64)), pa.array(sums, pa.int64())], names=["part", "shard", "doc_id", "place", "n_tokens", "ids_crc32"])

    return images.select("part", "shard", "image").mapInArrow(run, "part int, shard int, doc_id long, place long, n_tokens long, ids_crc32 long")


def occurrences(images: DataFrame, token: int) -> DataFrame:
    """doc_id and place (in the whole sequence) of every occurrence of a token, from the rank directories of the shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, shard, image in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                ids, lengths, matrix = unpack(image)
                found = matrix.occurrences(token)
                owner = np.searchsorted(np.cumsum(lengths, dtype=np.int64), found, side="right")
                n = len(found)
                yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array([shard] * n, pa.int32()), pa.array([ids[k] for k in owner.tolist()], pa.int64()), pa.array(found)], names=["part", "shard", "doc_id", "place"])

    rows = images.select("part", "shard", "image").mapInArrow(run, "part int, shard int, doc_id long, place long")
    return rows.join(shard_starts(images), ["part", "shard"]).select("doc_id", (F.col("first") + F.col("place")).alias("place"))


def shard_starts(images: DataFrame) -> DataFrame:
    """How many ids stand before each shard: sums in parts, then over the parts (one row each)."""
    sizes = images.select("part", "shard", "n_tokens")
    inside = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return sizes.withColumn("inside", inside).join(before, "part").select("part", "shard", (F.col("inside") + F.col("before")).alias("first"))


def op3_wavelet(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    images = write_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
    rows = read_shards(images).join(shard_starts(images), ["part", "shard"])
    return rows.select("doc_id", (F.col("first") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")
