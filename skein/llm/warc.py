"""Seekable Zstandard bundles of WARC records: independent frames, a record index, and a footer seek table."""

from __future__ import annotations

import base64
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.shared import read_files, ready, scratch, staged, table, write_files

#: Bytes of records in a frame, and compressed bytes of a bundle; a larger record is a frame or a bundle of its own.
FRAME, BUNDLE = 256 << 10, 8 << 20
#: Fixed values of the formats: skippable frame for the record index, for the seek table, the seek table's closing number.
INDEX, SEEK, CLOSING = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
ENDING = struct.pack("<I", CLOSING)
_SPACE = uuid.UUID("9b0d4f0e-3f0b-5f52-8f0e-2f1f3f6f5a11")
_DATE = "1970-01-01T00:00:00Z"


def record(page_id: int | None, url: str | None, copy: int, digest: str, size: int, payload: bytes | None, refers: tuple | None) -> tuple[str, bytes]:
    """A record's identifier and bytes; payload None makes a revisit of refers (page_id, url)."""

    def name(page_id: int | None, url: str | None, copy: int) -> str:
        return f"<urn:uuid:{uuid.uuid5(_SPACE, json.dumps([page_id, url, copy, digest]))}>"

    me = name(page_id, url, copy)
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if payload is None else 'response'}", f"WARC-Record-ID: {me}", f"WARC-Date: {_DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url))
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Bytes: {size}"]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if payload is None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(*refers, 0)}"]
        if refers[0] is not None:
            lines.append(f"X-Refers-To-Page-ID: {refers[0]}")
    else:
        lines.append("Content-Type: text/html")
    body = payload or b""
    lines.append(f"Content-Length: {len(body)}")
    return me, "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


class Bundle:
    """Collects records to frames; close() gives the file's bytes."""

    def __init__(self) -> None:
        import zstandard

        self.zstd = zstandard.ZstdCompressor(level=3, write_content_size=True)
        self.frames, self.sizes, self.index, self.open, self.bytes = [], [], [], [], 0
        self.size = self.held = 0

    def add(self, me: str, data: bytes) -> None:
        if self.held and self.held + len(data) > FRAME:
            self._frame()
        self.index.append((me, len(self.frames), self.held, len(data)))
        self.open.append(data)
        self.held += len(data)

    def _frame(self) -> None:
        raw = b"".join(self.open)
        self.frames.append(self.zstd.compress(raw))
        self.sizes.append((len(self.frames[-1]), len(raw)))
        self.size += len(self.frames[-1])
        self.open, self.held = [], 0

    def close(self) -> bytes:
        if self.open:
            self._frame()
        index = zlib.compress(json.dumps(self.index).encode())
        frames = [*self.frames, struct.pack("<II", INDEX, len(index)) + index]
        sizes = [*self.sizes, (8 + len(index), 0)]
        seek = b"".join(struct.pack("<II", *s) for s in sizes) + struct.pack("<IB", len(sizes), 0) + ENDING
        return b"".join([*frames, struct.pack("<II", SEEK, len(seek)), seek])


def seek_table(data: bytes) -> list[tuple[int, int, int]]:
    """(offset, compressed size, size) of each frame, the record index last."""
    n, descriptor, closing = struct.unpack("<IBI", data[-9:])
    if closing != CLOSING or descriptor:
        raise ValueError("no seek table: not a bundle, or cut short")
    at, out = 0, []
    for a, b in struct.iter_unpack("<II", data[-9 - 8 * n : -9]):
        out.append((at, a, b))
        at += a
    return out


def record_index(data: bytes) -> list[tuple[str, int, int, int]]:
    """(record identifier, frame, offset in the frame, bytes) of each record."""
    at, size, _ = seek_table(data)[-1]
    return [tuple(x) for x in json.loads(zlib.decompress(data[at + 8 : at + size]))]


def fetch(data: bytes, me: str) -> dict:
    """One record by its identifier; only its frame is decompressed."""
    import zstandard

    frames = seek_table(data)
    _, k, offset, size = next(x for x in record_index(data) if x[0] == me)
    at, packed, _ = frames[k]
    return parse(zstandard.ZstdDecompressor().decompress(data[at : at + packed])[offset : offset + size])[0]


def parse(raw: bytes) -> tuple[dict, int]:
    """The record at the start of raw, its headers by lower-cased name and `payload`, and its bytes."""
    head, _, _ = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    out = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
    start = len(head) + 4
    end = start + int(out["content-length"])
    if lines[0] != "WARC/1.1" or raw[end : end + 4] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    return out | {"payload": raw[start:end]}, end + 4


def records(data: bytes) -> Iterator[dict]:
    """All records of a bundle, a frame at a time, each found by the index."""
    import zstandard

    frames, unzip, now, raw = seek_table(data), zstandard.ZstdDecompressor(), -1, b""
    for me, k, offset, size in record_index(data):
        if k != now:
            at, packed, n = frames[k]
            raw, now = unzip.decompress(data[at : at + packed], max_output_size=max(n, 1)), k
        found, used = parse(raw[offset : offset + size])
        if used != size or found["warc-record-id"] != me:
            raise ValueError(f"the index misplaces {me}")
        yield found


def _bundles(batches):
    held = Bundle()
    for batch in batches:
        for page_id, url, copy, digest, size, payload, to_id, to_url in zip(*(batch.column(c) for c in ("page_id", "url", "copy", "digest", "size", "payload", "to_id", "to_url"))):
            b32 = base64.b32encode(bytes.fromhex(digest.as_py())).decode()
            held.add(*record(page_id.as_py(), url.as_py(), copy.as_py(), b32, size.as_py(), payload.as_py(), (to_id.as_py(), to_url.as_py())))
            if held.size + held.held // 4 >= BUNDLE:
                yield pa.RecordBatch.from_arrays([pa.array([held.close()[:-4]], pa.binary())], ["data"])
                held = Bundle()
    if held.index:
        yield pa.RecordBatch.from_arrays([pa.array([held.close()[:-4]], pa.binary())], ["data"])


def write_archives(pages: DataFrame, path: str) -> None:
    """Writes a record per row of pages (page_id, url, html) to bundles under path; equal payloads are stored once.

    Of rows with equal payloads that with the largest page_id (nulls smallest, ties by url) is the response and the others
    revisit it; of rows equal in all three columns one may be the response. Identical rows are counted before the
    shuffle, so a payload that a third of all rows holds moves once per partition; revisits are made from
    identifiers alone. Null html is an empty payload. Other columns are ignored.
    """
    ready(pages.sparkSession)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    pages = pages.withColumn("digest", F.sha1("payload"))
    row = F.sha1(F.concat_ws("\x01", "digest", F.coalesce(F.col("page_id").cast("string"), F.lit("-")), F.coalesce(F.concat(F.lit("u"), "url"), F.lit("-"))).cast("binary"))
    pages = pages.withColumn("row", row)
    light = staged(pages.groupBy("row", "digest", "page_id", "url").agg(F.count("*").alias("n"), F.first(F.octet_length("payload")).cast("long").alias("size")), "pages")
    best = light.groupBy("digest").agg(F.max(F.struct("page_id", "url", "row")).alias("best"), F.max("size").alias("size"))
    best = staged(best.select("digest", F.col("best.page_id").alias("to_id"), F.col("best.url").alias("to_url"), F.col("best.row").alias("best")), "best")
    known = light.join(best, "digest")
    again = known.withColumn("copies", F.col("n") - F.when(F.col("row") == F.col("best"), 1).otherwise(0)).where("copies > 0")
    again = again.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    once = pages.groupBy("row").agg(F.first("payload").alias("payload"))
    first = once.join(known.where("row = best").drop("digest").join(best.select(F.col("best").alias("row"), "digest"), "row"), "row")
    cols = ["page_id", "url", "copy", "digest", "size", "payload", "to_id", "to_url"]
    out = first.withColumn("copy", F.lit(0).cast("long")).select(cols).union(again.withColumn("payload", F.lit(None).cast("binary")).select(cols))
    write_files(out.mapInArrow(_bundles, "data binary"), "data", path, ENDING)


def _read(batches):
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("record_id", pa.string()), ("payload", pa.binary())])
    number = lambda x: None if x is None else int(x)

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    for batch in batches:
        for x in batch.column("content"):
            rows, held = [], 0
            for r in records(x.as_py()):
                rows.append((number(r.get("x-page-id")), int(r["x-payload-bytes"]), r["warc-payload-digest"].removeprefix("sha1:"), r["warc-type"], number(r.get("x-refers-to-page-id")), r["warc-record-id"], r["payload"] if r["warc-type"] == "response" else None))
                held += len(r["payload"])
                if len(rows) >= 1000 or held > 4 << 20:
                    yield out(rows)
                    rows, held = [], 0
            if rows:
                yield out(rows)


def read_archives(spark, path: str) -> DataFrame:
    """Each record of the bundles under path; payload is null for revisits."""
    ready(spark)
    return read_files(spark, path).select("content").mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, payload binary")


def op7_warc(spark, sf_dir: str) -> DataFrame:
    path = scratch(spark, "archives")
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path).drop("record_id", "payload")


OP7_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
b AS (SELECT *, array_to_string(list_transform(range(0, 8), lambda i: array_to_string(list_transform(range(0, 4), lambda j:
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + ((('0x' || substr(hex, (5 * i + 1)::INT, 5))::BIGINT >> (15 - 5 * j)::INT) & 31)::INT]), '')), '') AS payload_digest FROM p),
r AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS best, row_number() OVER (PARTITION BY hex ORDER BY page_id DESC) = 1 AS first FROM b)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN NOT first THEN best END AS refers_to FROM r
"""
