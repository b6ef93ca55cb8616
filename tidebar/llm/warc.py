"""WARC archives in seekable Zstandard bundles.

A row becomes a WARC record. Of records with equal payloads of at least `min_bytes`, the one with the smallest id is a
`response`, the others are `revisit` records that name it and hold its HTTP headers without the payload; smaller payloads are
all responses. Records are grouped into frames of about FRAME_BYTES, each compressed on its own; a bundle is about
BUNDLE_BYTES of frames and ends with a skippable frame that holds the seek table (the public seekable format: compressed and
plain size and checksum of each frame, then a footer). Any Zstandard reader can unpack a bundle from its start. The index maps
a record's identifier to its bundle, its frame, and its offset inside the unpacked frame, so that a look-up unpacks one frame.

Bundles are rows of a Parquet table in the shared folder (name, image, index of the records), as executors can write to a
cluster's store only through Spark. Payloads are equal if their SHA-256 is. The smallest id of each is found by a pre-aggregated
count. Payloads that more than one row in HOT_SHARE has (fewer than HOT_SHARE of them, whatever the size) are broadcast and
stay where they are; all others meet their first record by a shuffle in which no key has more than that share.

Null payloads count as empty; a very long one has a frame of its own. Null ids come last; of rows equal in id and payload, one
is the response and the others revisit it, and each has a record of its own. A null url is written as urn:x-unknown; white space
and controls in it are percent-encoded. An empty table gives no bundles and no rows; other columns play no part.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.llm.store import cut, drop

FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 8 << 20
LEVEL = 3
HOT_SHARE = 200
DATE = "1970-01-01T00:00:00Z"

# Fixed values of the seekable format and of the WARC standard.
_SKIPPABLE, _SEEKABLE, _CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_INDEX = pa.list_(pa.struct([("record_id", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())]))
_BUNDLE = "bundle string, image binary, index array<struct<record_id:string,frame:int,offset:bigint,length:bigint>>"
_RECORD = "record_id string, page_id string, record_type string, refers_to string, payload_bytes long, payload_digest string, payload binary"


def base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def record_uri(page_id: str | None, row: int) -> str:
    """An identifier that tells rows with equal ids apart; `-` stands for a null id."""
    return f"urn:x-page:{'-' if page_id is None else quote(page_id, safe='')}:{row}"


def page_of(uri: str) -> str | None:
    name = uri.split(":")[2]
    return None if name == "-" else unquote(name)


def record(uri: str, url: str | None, digest: str, payload_bytes: int, payload: bytes | None, refers_to: str | None, date: str = DATE) -> bytes:
    """One record: a response with its payload, or a revisit of `refers_to`, whose block is the HTTP head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()
    block = head if refers_to else head + (payload or b"")
    target = quote(url, safe="!#$%&'()*+,/:;=?@[]~") if url else "urn:x-unknown"
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: <{uri}>", f"WARC-Date: {date}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to:
        lines += [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: <{refers_to}>"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return b"".join(("\r\n".join(lines).encode(), block, b"\r\n\r\n"))


class Bundle:
    """Frames as they come, then the seek table."""

    def __init__(self):
        self.out: list[bytes] = []
        self.table: list[bytes] = []
        self.index: list[dict] = []
        self.size = self.held = 0
        self._pending: list[bytes] = []
        self._pack = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)

    def add(self, uri: str, raw: bytes) -> None:
        if self.held and self.held + len(raw) > FRAME_BYTES:
            self.end_frame()
        self.index.append({"record_id": uri, "frame": len(self.table), "offset": self.held, "length": len(raw)})
        self._pending.append(raw)
        self.held += len(raw)
        self.size += len(raw)

    def end_frame(self) -> None:
        plain = b"".join(self._pending)
        packed = self._pack.compress(plain)
        self.out.append(packed)
        self.table.append(struct.pack("<III", len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
        self._pending, self.held = [], 0

    def image(self) -> bytes:
        if self.held:
            self.end_frame()
        entries = b"".join(self.table)
        footer = struct.pack("<IBI", len(self.table), _CHECKSUMS, _SEEKABLE)
        return b"".join((*self.out, struct.pack("<II", _SKIPPABLE, len(entries) + len(footer)), entries, footer))


def seek_table(image: bytes) -> list[tuple[int, int, int, int]]:
    """Place, packed size, plain size and checksum of each frame, from the footer."""
    frames, flags, mark = struct.unpack_from("<IBI", image, len(image) - 9)
    if mark != _SEEKABLE:
        raise ValueError("no seek table at the end of the bundle")
    width, place, out = 12 if flags & _CHECKSUMS else 8, 0, []
    first = len(image) - 9 - width * frames
    for k in range(frames):
        packed, plain, *check = struct.unpack_from("<III" if width == 12 else "<II", image, first + k * width)
        out.append((place, packed, plain, check[0] if check else -1))
        place += packed
    return out


def frame(image: bytes, entry: tuple[int, int, int, int]) -> bytes:
    """One frame, unpacked and checked; nothing else of the bundle is."""
    place, packed, plain, check = entry
    got = zstandard.ZstdDecompressor().decompress(memoryview(image)[place : place + packed], max_output_size=plain)
    if len(got) != plain or (check >= 0 and xxhash.xxh64_intdigest(got) & 0xFFFFFFFF != check):
        raise ValueError("a frame differs from the seek table")
    return got


def parse(raw: bytes, at: int = 0) -> tuple[dict, int]:
    """The record at a place of an unpacked frame as the columns of _RECORD, and where the next begins. The digest of a payload is taken anew."""
    stop = raw.index(b"\r\n\r\n", at)
    fields = dict(line.split(": ", 1) for line in raw[at:stop].decode().split("\r\n")[1:])
    block = raw[stop + 4 : stop + 4 + int(fields["Content-Length"])]
    head, _, payload = block.partition(b"\r\n\r\n")
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    size = next(int(line.split(b":")[1]) for line in head.split(b"\r\n") if line.startswith(b"Content-Length:"))
    if kind == "response" and (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()) != (size, digest):
        raise ValueError(f"{fields['WARC-Record-ID']}: the payload differs from its digest")
    uri, refers = fields["WARC-Record-ID"].strip("<>"), fields.get("WARC-Refers-To", "").strip("<>")
    out = {"record_id": uri, "page_id": page_of(uri), "record_type": kind, "refers_to": page_of(refers) if refers else None, "payload_bytes": size, "payload_digest": digest, "payload": payload if kind == "response" else None}
    return out, stop + 4 + len(block) + 4


def with_first_records(pages: DataFrame, id_col: str, url_col: str, payload_col: str, min_bytes: int) -> tuple[DataFrame, tuple[DataFrame, ...]]:
    """Rows (page_id, row, url, payload, bytes, sha1, first_id, first_row), and the tables to drop when they are written.

    first_id and first_row name the response with the same payload, which for a response is itself.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.monotonically_increasing_id().alias("row"), F.col(url_col).cast("string").alias("url"), F.encode(payload, "UTF-8").alias("payload"))
    rows = cut(rows.select("*", F.length("payload").cast("long").alias("bytes"), F.sha1("payload").alias("sha1"), F.unhex(F.sha2("payload", 256)).alias("sha256")), "warc-rows")
    mine = F.struct(F.col("page_id").isNull().alias("last"), "page_id", "row")
    first = cut(rows.where(F.col("bytes") >= min_bytes).groupBy("sha256").agg(F.min(mine).alias("first"), F.count("*").alias("n")), "warc-first")
    often = first.where(F.col("n") * HOT_SHARE > rows.count()).select("sha256", "first")
    # Hot payloads by broadcast (fewer than HOT_SHARE rows), the others by a shuffle; small payloads are their own.
    equal = rows.where(F.col("bytes") >= min_bytes)
    hot = equal.join(F.broadcast(often), "sha256")
    cold = equal.join(F.broadcast(often.select("sha256")), "sha256", "left_anti").join(first.select("sha256", "first").hint("shuffle_hash"), "sha256")
    own = rows.where(F.col("bytes") < min_bytes).withColumn("first", mine)
    both = hot.unionByName(cold).unionByName(own) if min_bytes > 0 else hot.unionByName(cold)
    is_first = F.col("first.row") == F.col("row")
    return both.select("page_id", "row", "url", F.when(is_first, F.col("payload")).alias("payload"), "bytes", "sha1", F.col("first.page_id").alias("first_id"), F.col("first.row").alias("first_row")), (rows, first)


def write_bundles(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, date: str = DATE) -> DataFrame:
    """Write the records of all rows: a table of (bundle, image, index), a row a bundle."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, bundle = TaskContext.get().partitionId(), 0, Bundle()

        def finished() -> pa.RecordBatch:
            image = bundle.image()
            return pa.RecordBatch.from_arrays([pa.array([f"{part:06d}-{k:06d}"]), pa.array([image], pa.binary()), pa.array([bundle.index], _INDEX)], names=["bundle", "image", "index"])

        for batch in batches:
            for page, row, url, payload, size, sha1, first_id, first_row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                uri = record_uri(page, row)
                bundle.add(uri, record(uri, url, base32(sha1), size, payload, None if first_row == row else record_uri(first_id, first_row), date))
                if bundle.size >= BUNDLE_BYTES:
                    yield finished()
                    k, bundle = k + 1, Bundle()
        if bundle.index:
            yield finished()

    rows, tables = with_first_records(pages, id_col, url_col, payload_col, min_bytes)
    rows = rows.withColumns({"page_id": F.col("page_id").cast("string"), "first_id": F.col("first_id").cast("string")})
    out = cut(rows.mapInArrow(pack, _BUNDLE), "warc")
    drop(*tables)
    return out


def index(bundles: DataFrame) -> DataFrame:
    """record_id, bundle, frame, offset (in the unpacked frame) and length of every record."""
    return bundles.select("bundle", F.explode("index").alias("r")).select("r.record_id", "bundle", "r.frame", "r.offset", "r.length")


def _batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = [("record_id", pa.string()), ("page_id", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in kinds], names=[n for n, _ in kinds])


def read_bundles(bundles: DataFrame) -> DataFrame:
    """Every record of the bundles: record_id, page_id, record_type, refers_to (page id), payload_bytes, payload_digest, payload (null for a revisit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(0):
                image = value.as_py()
                for entry in seek_table(image):
                    raw, at, rows = frame(image, entry), 0, []
                    while at < len(raw):
                        got, at = parse(raw, at)
                        rows.append(got)
                    yield _batch(rows)

    return bundles.select("image").mapInArrow(run, _RECORD)


def fetch(bundles: DataFrame, wanted: DataFrame) -> DataFrame:
    """The records whose record_id is in `wanted` (a column record_id), by the index: only frames that hold one are unpacked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for image, places in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                image, held, rows = image.as_py(), (-1, b""), []
                table = seek_table(image)
                for place in sorted(places, key=lambda p: (p["frame"], p["offset"])):
                    if held[0] != place["frame"]:
                        held = (place["frame"], frame(image, table[place["frame"]]))
                    rows.append(parse(held[1], place["offset"])[0])
                yield _batch(rows)

    found = index(bundles).join(wanted.select("record_id").distinct(), "record_id").groupBy("bundle").agg(F.collect_list(F.struct("frame", "offset")).alias("places"))
    return bundles.select("bundle", "image").join(found, "bundle").select("image", "places").mapInArrow(run, _RECORD)


def op13_warc(spark, sf_dir: str) -> DataFrame:
    records = read_bundles(write_bundles(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return records.select(F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


OP13_SQL = """
WITH rows AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
hashed AS (SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS h, sha256(body) AS same FROM rows),
ranked AS (SELECT *, row_number() OVER (PARTITION BY same ORDER BY page_id NULLS LAST) AS k, first_value(page_id) OVER (PARTITION BY same ORDER BY page_id NULLS LAST) AS first_id FROM hashed)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(h, (1 + 5 * (i // 4))::BIGINT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31), 1)), '') AS payload_digest,
  CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN first_id END AS refers_to
FROM ranked
"""
