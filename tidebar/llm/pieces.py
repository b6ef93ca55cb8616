"""SentencePiece encoding and decoding: batched Viterbi in numpy.

A model file gives pieces and scores. Text gets a blank before it (if the model says so), blanks become U+2581, and the text
is cut into units before each run of U+2581 and around line breaks, which no piece crosses (this is verified when a model
is loaded; otherwise the whole text is one unit). The best segmentation of a unit has the largest sum of scores; characters
without a piece become byte pieces at the score of an unknown character (the lowest score less ten). Distinct units that the
cache lacks are encoded together: units of equal length, however long, advance as rows of one array. Hashes of all substrings
probe the sorted hashes of the piece keys of each length (behind a table of the hashes' leading bits), and at each place the
largest sum over all piece lengths is kept with its back pointer. Of equal sums the longest last piece wins. Chosen pieces
are compared with the text; a unit that differs (a hash collision) is encoded again in plain Python. The cache is emptied
when full, which changes nothing.

Decoding gathers the bytes of pieces and byte pieces, and takes the first blank away, so that it returns the text. A text
that holds U+2581 itself comes back with blanks there; ids that are not UTF-8 together decode with U+FFFD.

Null texts have no ids and decode to null; empty texts have an empty list; empty tables give empty tables; repeated rows are
encoded one by one; a column that is named like a result is replaced by it. Models whose normaliser changes characters or
removes blanks are refused.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from tidebar.llm import textvec as tv

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
CACHE_UNITS = 1_000_000
#: Scores that are held at once: units, places and piece lengths multiplied.
MAX_CELLS = 1 << 19
_ODD = np.uint64(0xD6E8FEB86659FD93)
_LEAD = np.uint64(46)


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """The fields of a protocol-buffer message, in order."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(raw):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        elif key & 7 == 1:
            at += 8
            yield key >> 3, raw[at - 8 : at]
        elif key & 7 == 5:
            at += 4
            yield key >> 3, raw[at - 4 : at]
        else:
            size = varint()
            at += size
            yield key >> 3, raw[at - size : at]


class Pieces:
    """A model: pieces in the order of their ids, ready for search."""

    def __init__(self, model: bytes):
        self.text: list[str] = []
        self.kind: list[int] = []
        scores: list[float] = []
        self.dummy = True
        normaliser: dict[int, object] = {}
        for field, value in _fields(model):
            if field == 1:
                got = dict(_fields(value))
                self.text.append(got.get(1, b"").decode())
                scores.append(struct.unpack("<f", got[2])[0] if 2 in got else 0.0)
                self.kind.append(got.get(3, NORMAL))
            elif field == 3:
                normaliser = dict(_fields(value))
        self.dummy = bool(normaliser.get(3, 1))
        if normaliser.get(2) or normaliser.get(4, 1) or not normaliser.get(5, 1):
            raise ValueError("the model's normaliser does more than add a blank")
        normal = [k for k, t in enumerate(self.kind) if t in (NORMAL, USER)]
        self.byte_id = {int(self.text[k][3:5], 16): k for k, t in enumerate(self.kind) if t == BYTE}
        self.byte_of = {k: b for b, k in self.byte_id.items()}
        self.unknown_id = self.kind.index(UNKNOWN)
        self.score = {self.text[k]: (scores[k], k) for k in normal}
        self.unknown = min((scores[k] for k in normal), default=0.0) - 10.0
        by_length: dict[int, list[str]] = {}
        for t in self.score:
            by_length.setdefault(len(t), []).append(t)
        self.keys = {}
        for n, texts in sorted(by_length.items()):
            hashes = self._whole(np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).reshape(-1, n).astype(np.uint64))
            order = np.argsort(hashes)
            lead = np.zeros(1 << 18, bool)
            lead[(hashes >> _LEAD).astype(np.int64)] = True
            self.keys[n] = (hashes[order], np.array([self.score[t][0] for t in texts])[order], np.array([self.score[t][1] for t in texts], np.int32)[order], lead)
        joined = any(SPACE in t.lstrip(SPACE) or ("\n" in t and len(t) > 1) for t in self.score)
        self.units = None if joined else re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")
        self.cache: dict[bytes, bytes] = {}
        self.code, self.code_at, self.code_size = self._blob([t.encode("utf-32-le") for t in self.text], np.uint32)
        self.byte, self.byte_at, self.byte_size = self._blob([bytes([self.byte_of[k]]) if k in self.byte_of else t.replace(SPACE, " ").encode() for k, t in enumerate(self.text)], np.uint8)

    @staticmethod
    def _blob(parts: list[bytes], kind) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.array([len(p) // np.dtype(kind).itemsize for p in parts], np.int64)
        return np.frombuffer(b"".join(parts), kind), np.cumsum(sizes) - sizes, sizes

    @staticmethod
    def _whole(codes: np.ndarray) -> np.ndarray:
        h = np.zeros(len(codes), np.uint64)
        for j in range(codes.shape[1]):
            h = h * np.uint64(tv.BASE) + codes[:, j] + np.uint64(1)
        return h * _ODD

    def plain(self, unit: str) -> list[int]:
        """The same search without hashes, a unit at a time."""
        best, back = [0.0], [0]
        for j in range(1, len(unit) + 1):
            top, step, known = best[j - 1] + self.unknown, 1, unit[j - 1] in self.score
            if known:
                top = best[j - 1] + self.score[unit[j - 1]][0]
            for n in self.keys:
                if 1 < n <= j and unit[j - n : j] in self.score and (s := best[j - n] + self.score[unit[j - n : j]][0]) >= top:
                    top, step = s, n
            best.append(top)
            back.append(step)
        out, j = [], len(unit)
        while j:
            part = unit[j - back[j] : j]
            out += [self.score[part][1]] if part in self.score else self._bytes(part)[::-1]
            j -= back[j]
        return out[::-1]

    def _bytes(self, char: str) -> list[int]:
        return [self.byte_id.get(b, self.unknown_id) for b in char.encode("utf-8", "surrogatepass")] if self.byte_id else [self.unknown_id]

    def _equal(self, units: list[str], length: int) -> list[bytes]:
        """Units of one length as columns of arrays; row j is about what ends before place j."""
        n, cols, widest = len(units), np.arange(len(units)), min(length, max(self.keys, default=1))
        codes = np.ascontiguousarray(np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(n, length).T)
        sums = np.zeros((length + 1, n), np.uint64)
        for j in range(length):
            sums[j + 1] = sums[j] * np.uint64(tv.BASE) + codes[j] + np.uint64(1)
        best = np.full((widest + length + 1, n), -np.inf)  # `widest` rows before the first place
        best[widest] = 0.0
        hop, ids = np.ones((length + 1, n), np.int32), np.full((length + 1, n), -1, np.int32)
        step = max(1, MAX_CELLS // (widest * n))
        for low in range(0, length, step):
            high = min(length, low + step)
            score, number = np.full((high - low, widest, n), -np.inf), np.full((high - low, widest, n), -1, np.int32)
            for k, (keys, scores, numbers, lead) in self.keys.items():
                first = max(low + 1, k)
                if k > widest or first > high:
                    continue
                probe = (sums[first : high + 1] - sums[first - k : high + 1 - k] * np.uint64(pow(tv.BASE, k, 1 << 64))) * _ODD
                likely = np.flatnonzero(lead[(probe >> _LEAD).astype(np.int64)])
                probe = probe.ravel()[likely]
                slot = np.minimum(np.searchsorted(keys, probe), len(keys) - 1)
                found = keys[slot] == probe
                row, col = np.divmod(likely[found], n)
                score[row + first - 1 - low, widest - k, col] = scores[slot[found]]
                number[row + first - 1 - low, widest - k, col] = numbers[slot[found]]
            single = score[:, widest - 1]
            single[np.isneginf(single)] = self.unknown
            for j in range(low + 1, high + 1):
                sums_to = best[j : j + widest] + score[j - 1 - low]  # the longest piece first, so that it wins ties
                pick = sums_to.argmax(0)
                best[widest + j], hop[j], ids[j] = sums_to[pick, cols], widest - pick, number[j - 1 - low][pick, cols]
        path, at = [], np.full(n, length)
        while at.any():
            path.append(np.where(at > 0, ids[at, cols], -2))
            at = at - np.where(at > 0, hop[at, cols], 0)
        path = np.stack(path[::-1], 1)  # a row a unit
        count, plain = (path != -2).sum(1), (path == -1).any(1)
        chosen = path[path >= 0]
        if not plain.any():
            places = tv.gathered(self.code_at[chosen], self.code_size[chosen])
            if len(places) != n * length or (self.code[places] != codes.T.ravel()).any():
                plain[:] = True
        raw, stops = path[path != -2].astype("<i4").tobytes(), [0, *(4 * np.cumsum(count)).tolist()]
        return [np.array(self.plain(u), "<i4").tobytes() if p else raw[a:b] for u, p, a, b in zip(units, plain.tolist(), stops[:-1], stops[1:], strict=True)]

    def _learn(self, units: list[bytes]) -> None:
        by_length: dict[int, list[tuple[bytes, str]]] = {}
        for raw in units:
            text = raw.decode().replace(" ", SPACE)
            by_length.setdefault(len(text), []).append((raw, text))
        for length, group in by_length.items():
            most = max(1, MAX_CELLS // (16 * length))
            for low in range(0, len(group), most):
                part = group[low : low + most]
                self.cache.update(zip([r for r, _ in part], self._equal([t for _, t in part], length), strict=True))

    def _normal(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The texts with their first blank, U+2581 as blanks."""
        if SPACE.encode() in (raw := data.tobytes()):
            data, at = tv.utf8(pa.array([raw[a:b].replace(SPACE.encode(), b" ") for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary()).cast(pa.string()))
        if not self.dummy:
            return data, at
        some = np.diff(at) > 0
        return np.insert(data, at[:-1][some], 32), at + np.concatenate([[0], np.cumsum(some)])

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after another, and where each text's ids begin (one more offset than texts)."""
        data, at = self._normal(data, at)
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(at), np.int64)
        edge = np.zeros(len(data) + 1, bool)
        if self.units:
            blank, line = data == 32, data == 10
            edge[:-1] = line | blank
            edge[1:-1] &= ~(blank[1:] & blank[:-1])
            edge[1:] |= line
        edge[at] = True
        places = np.flatnonzero(edge)
        starts, ends = places[:-1], places[1:]
        first, own = tv.distinct_spans(data, starts, ends)
        raw = data.tobytes()
        units = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        if len(self.cache) > CACHE_UNITS:
            self.cache.clear()
        values = list(map(self.cache.get, units))
        if None in values:
            self._learn([u for u, v in zip(units, values, strict=True) if v is None])
            values = [self.cache[u] if v is None else v for u, v in zip(units, values, strict=True)]
        sizes = np.fromiter(map(len, values), np.int64, len(values)) // 4
        begins = np.cumsum(sizes) - sizes
        ids = np.frombuffer(b"".join(values), "<i4")[tv.gathered(begins[own], sizes[own])]
        done = np.concatenate([[0], np.cumsum(sizes[own])])
        return ids, done[np.searchsorted(starts, at)]

    def decode(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of the texts of lists of ids."""
        data = self.byte[tv.gathered(self.byte_at[ids], self.byte_size[ids])]
        done = np.concatenate([[0], np.cumsum(self.byte_size[ids])])[at]
        if not self.dummy or not len(data):
            return data, done
        first = done[:-1][np.diff(done) > 0]
        first = first[data[first] == 32]
        keep = np.ones(len(data), bool)
        keep[first] = False
        return data[keep], done - np.searchsorted(first, done)


_loaded: dict[int, Pieces] = {}


def _model(raw: bytes) -> Pieces:
    """One model a worker, with its cache."""
    key = zlib.crc32(raw)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Pieces(raw)
    return _loaded[key]


def _blocks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, at = tv.utf8(column)
    for a, b in tv.blocks(at):
        yield a, b, data[at[a] : at[b]], at[a : b + 1] - at[a]


def _texts(data: np.ndarray, at: np.ndarray, missing: pa.Array) -> pa.Array:
    raw = data.tobytes()
    return pa.array([None if m else raw[a:b].decode("utf-8", "replace") for a, b, m in zip(at[:-1].tolist(), at[1:].tolist(), missing.to_pylist(), strict=True)], pa.string())


def encode(docs: DataFrame, model_path: str, text_col: str = "text", ids_col: str = "piece_ids", decoded_col: str | None = None) -> DataFrame:
    """docs with the ids of each text, and if asked what they decode to. One pass, no shuffle."""
    if text_col in (ids_col, decoded_col):
        raise ValueError("a result can't be named like the texts")
    shared = docs.sparkSession.sparkContext.broadcast(Path(model_path).read_bytes())  # a file of fixed size
    docs = docs.drop(*(c for c in (ids_col, decoded_col) if c in docs.columns))
    rows, at = docs.toDF(*(f"c{k}" for k in range(len(docs.columns)))), docs.columns.index(text_col)  # whatever the columns are called
    schema = StructType(list(rows.schema)).add("ids", ArrayType(IntegerType(), False))
    if decoded_col:
        schema = schema.add("decoded", StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _model(shared.value)
        for batch in batches:
            for a, b, data, offsets in _blocks(batch.column(at)):
                ids, stops = pieces.encode(data, offsets)
                missing = batch.column(at)[a:b].is_null()
                out = [*(c[a:b] for c in batch.columns), pa.ListArray.from_arrays(pa.array(stops.astype(np.int32)), pa.array(ids), type=pa.list_(pa.field("element", pa.int32(), False)), mask=missing)]
                if decoded_col:
                    out.append(_texts(*pieces.decode(ids, stops), missing))
                yield pa.RecordBatch.from_arrays(out, names=schema.names)

    return rows.mapInArrow(run, schema).toDF(*docs.columns, ids_col, *([decoded_col] if decoded_col else []))


def decode(rows: DataFrame, model_path: str, ids_col: str = "piece_ids", text_col: str = "decoded") -> DataFrame:
    """rows with the text of each list of ids."""
    if text_col == ids_col:
        raise ValueError("a result can't be named like the ids")
    shared = rows.sparkSession.sparkContext.broadcast(Path(model_path).read_bytes())
    rows = rows.drop(text_col) if text_col in rows.columns else rows
    names, at = rows.columns, rows.columns.index(ids_col)
    rows = rows.toDF(*(f"c{k}" for k in range(len(names))))
    schema = StructType(list(rows.schema)).add("decoded", StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _model(shared.value)
        for whole in batches:
            for low in range(0, whole.num_rows, 500):
                batch = whole.slice(low, 500)
                lists = batch.column(at).to_pylist()
                stops = np.cumsum([0] + [len(x or ()) for x in lists])
                ids = np.fromiter((k for x in lists for k in x or ()), np.int64, int(stops[-1]))
                yield pa.RecordBatch.from_arrays([*batch.columns, _texts(*pieces.decode(ids, stops), batch.column(at).is_null())], names=schema.names)

    return rows.mapInArrow(run, schema).toDF(*names, text_col)


def digest(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (of the ids as little-endian 32-bit integers) and whether decoding returns the text."""
    shared = docs.sparkSession.sparkContext.broadcast(Path(model_path).read_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, blank = _model(shared.value), SPACE.encode()
        for batch in batches:
            for a, b, data, at in _blocks(batch.column(1)):
                ids, stops = pieces.encode(data, at)
                back, ends = pieces.decode(ids, stops)
                if len(back) == len(data) and (back == data).all() and (ends == at).all():
                    same = np.ones(b - a, bool)
                else:
                    raw, got = data.tobytes(), back.tobytes()
                    same = np.array([got[s:e] == raw[x:y].replace(blank, b" ") for s, e, x, y in zip(ends[:-1], ends[1:], at[:-1], at[1:], strict=True)], bool)
                image, cuts = memoryview(ids.astype("<i4").tobytes()), (4 * stops).tolist()
                sums = [zlib.crc32(image[s:e]) for s, e in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(np.diff(stops)), pa.array(sums, pa.int64()), pa.array(same)], names=["doc_id", "n_pieces", "ids_crc32", "round_trip"])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, round_trip boolean")


def op7_pieces(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
