"""Operator 6: WARC archives by way of a chunked record table.

Payloads become rows of (record, chunk number, bytes); the digests of a payload are carried
from chunk to chunk and stand in the rows of its first and last one. Every later step (finding equal
payloads, writing, reading back) works on chunk rows, so no step after the read of
the page's cell holds a whole record. In the archive a chunk is a segment of its
record as the WARC 1.1 standard has it: the first one is the response, the others are
``continuation`` records with a segment number and the identifier of the first. Records with a
payload that another record has are ``revisit`` records that refer to it.

Archives are written and read by Spark's text source, so they go wherever Spark can write. A
record starts with a line ``WARC/1.1``, by which the reader splits files among tasks; the
writer therefore cuts payloads inside that line where they contain it. Reading back checks every
Content-Length, joins the segments of a record in order as a stream and checks its digest.

Defined cases: a null html is an empty payload; a null url leaves the header out; line breaks in
a url are percent-encoded; of equal payloads the smallest page_id is the response, nulls
last, then the first row as staged; repeated rows are records of their own;
an empty table gives an archive without records.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flagframe.session import scratch_path, staged

CHUNK_BYTES = 1 << 16
LEAST_BYTES = 0
DATE = "2000-01-01T00:00:00Z"
START = b"WARC/1.1\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BATCH_BYTES = 1 << 22
BROADCAST_ROWS = 500_000

CHUNK_SCHEMA = "record long, page_id long, url string, chunk int, last boolean, data binary, payload_bytes long, sha1 string, sha256 string"


def cuts(payload: bytes, chunk_bytes: int) -> Iterator[tuple[int, int]]:
    """(start, end) of the chunks: none longer than ``chunk_bytes``, none with a record start in it."""
    start, size = 0, len(payload)
    while True:
        end = min(size, start + chunk_bytes)
        mark = payload.find(START, start, end)
        if mark < 0 and payload.endswith(START[:-2], start, end):
            mark = end - len(START) + 2  # the line break after the block would complete it
        if mark >= 0:
            end = mark + 4
        yield start, end
        start = end
        if start >= size:
            return


def _batched(rows: Iterator[tuple], schema: pa.Schema, heavy: int) -> Iterator[pa.RecordBatch]:
    """Record batches bounded by the bytes of column ``heavy``."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[heavy] or b"") + 256
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(column[i].as_py() for column in batch.columns)


_CHUNKS = pa.schema(
    [
        ("record", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("chunk", pa.int32()), ("last", pa.bool_()),
        ("data", pa.binary()), ("payload_bytes", pa.int64()), ("sha1", pa.string()), ("sha256", pa.string()),
    ]
)


def _chunked(chunk_bytes: int):
    def rows(batches):
        for record, page_id, url, payload in _rows(batches):
            payload = payload or b""
            one, two = hashlib.sha1(), hashlib.sha256()
            view = memoryview(payload)
            places = list(cuts(payload, chunk_bytes))
            for start, end in places:
                one.update(view[start:end])
                two.update(view[start:end])
            ends = len(payload), base64.b32encode(one.digest()).decode()
            for chunk, (start, end) in enumerate(places):
                last = chunk == len(places) - 1
                about = ends if last or not chunk else (None, None)
                yield record, page_id, url, chunk, last, payload[start:end], *about, two.hexdigest() if last else None

    return lambda batches: _batched(rows(batches), _CHUNKS, 5)


def chunk_table(pages: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per chunk; the first and the last chunk of a record carry its length and digest."""
    columns = (F.monotonically_increasing_id().alias("record"), F.col("page_id").cast("long"), F.col("url").cast("string"), F.encode(F.col("html").cast("string"), "UTF-8").alias("payload"))
    return staged(pages.select(*columns).mapInArrow(_chunked(chunk_bytes), CHUNK_SCHEMA), "warc-chunks")


def revisit_table(chunks: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """The records that revisit another one: record, response."""
    ends = chunks.where("last").where(F.col("payload_bytes") >= least_bytes).select("record", "page_id", "payload_bytes", "sha256")
    first = ends.groupBy("sha256", "payload_bytes").agg(F.min(F.struct(F.col("page_id").isNull(), "page_id", "record"))["record"].alias("first"))
    later = ends.join(first, ["sha256", "payload_bytes"]).where("first <> record")
    return staged(later.select("record", F.col("first").alias("response")), "warc-revisits")


# --- writing -----------------------------------------------------------------------------------


def _identifier(record: int, chunk: int = 0) -> str:
    h = hashlib.md5(f"{record}/{chunk}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def _record(row: tuple, date: str) -> bytes:
    record, page_id, url, chunk, last, data, sha1, payload_bytes, response = row
    revisit = response != record
    kind = "revisit" if revisit else "continuation" if chunk else "response"
    block = b"" if revisit else data if chunk else HTTP + data
    headers = [f"WARC-Type: {kind}", f"WARC-Record-ID: {_identifier(record, chunk)}", f"WARC-Date: {date}", f"Content-Length: {len(block)}"]
    if url is not None and not chunk:
        safe = url.replace("\r", "%0D").replace("\n", "%0A").replace("WARC/1.1", "WARC%2F1.1")
        headers.append(f"WARC-Target-URI: {safe}")
    if not chunk:
        headers.append("Content-Type: application/http;msgtype=response")
        headers.append(f"WARC-Payload-Digest: sha1:{sha1}")
        if page_id is not None:
            headers.append(f"X-Page-ID: {page_id}")
    if revisit:
        headers += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_identifier(response)}"]
    elif chunk or not last:
        headers.append(f"WARC-Segment-Number: {chunk + 1}")
        if chunk:
            headers.append(f"WARC-Segment-Origin-ID: {_identifier(record)}")
        if last:
            headers.append(f"WARC-Segment-Total-Length: {len(HTTP) + payload_bytes}")
    return START + "\r\n".join(headers).encode() + b"\r\n\r\n" + block


def write_archives(chunks: DataFrame, revisits: DataFrame, path: str, date: str = DATE, compression: str = "gzip") -> None:
    """Write the records as WARC files under ``path``, one file per task."""
    schema = pa.schema([("value", pa.binary())])
    # pairs of numbers: broadcast up to a size, shuffled beyond
    again = F.broadcast(revisits) if revisits.count() <= BROADCAST_ROWS else revisits
    known = chunks.join(again, "record", "left").where(F.col("response").isNull() | (F.col("chunk") == 0))
    data, response = F.when(F.col("response").isNull(), F.col("data")), F.coalesce("response", "record")
    rows = known.select("record", "page_id", "url", "chunk", "last", data.alias("data"), "sha1", "payload_bytes", response.alias("response"))
    lines = rows.mapInArrow(lambda batches: _batched(((_record(row, date),) for row in _rows(batches)), schema, 0), "value binary")
    lines.select(F.col("value").cast("string")).write.option("lineSep", "\r\n\r\n").option("compression", compression).text(path)


# --- reading -----------------------------------------------------------------------------------

_SEGMENTS = pa.schema(
    [
        ("id", pa.string()), ("origin", pa.string()), ("segment", pa.int32()), ("kind", pa.string()), ("page_id", pa.int64()),
        ("refers", pa.string()), ("declared", pa.string()), ("data", pa.binary()), ("payload_bytes", pa.int64()), ("sha1", pa.string()),
    ]
)
SEGMENT_SCHEMA = (
    "id string, origin string, segment int, kind string, page_id long, refers string, declared string, data binary, payload_bytes long, sha1 string"
)


def _parsed(value: bytes) -> tuple:
    head, _, rest = value.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n"))
    length = int(fields["Content-Length"])
    if rest[length:] != b"\r\n\r\n":
        raise ValueError(f"the block of {fields['WARC-Record-ID']} does not end where its Content-Length says")
    block, number = rest[:length], fields.get("WARC-Segment-Number")
    if fields["WARC-Type"] == "response":
        block = block.partition(b"\r\n\r\n")[2]
    whole = number is None and fields["WARC-Type"] == "response"
    page = fields.get("X-Page-ID")
    return (
        fields["WARC-Record-ID"], fields.get("WARC-Segment-Origin-ID", fields["WARC-Record-ID"]), int(number) if number else None,
        fields["WARC-Type"], int(page) if page else None, fields.get("WARC-Refers-To"),
        fields.get("WARC-Payload-Digest", "").removeprefix("sha1:"), block if number else None,
        len(block) if whole else None, base64.b32encode(hashlib.sha1(block).digest()).decode() if whole else None,
    )


_WHOLE = pa.schema([(n, _SEGMENTS.field(n).type) for n in ("id", "page_id", "declared", "data", "payload_bytes", "sha1")])


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments sorted by (origin, segment) to one row per record, with a running digest."""

    def rows():
        origin, first, digest, size, expected = None, None, None, 0, 1
        for own, segment, page_id, declared, data in _rows(batches):
            if own != origin:
                if origin is not None:
                    yield origin, *first, None, size, base64.b32encode(digest.digest()).decode()
                origin, first, digest, size, expected = own, (page_id, declared), hashlib.sha1(), 0, 1
            if segment != expected:
                raise ValueError(f"{origin} lacks segment {expected}")
            digest.update(data)
            size += len(data)
            expected += 1
        if origin is not None:
            yield origin, *first, None, size, base64.b32encode(digest.digest()).decode()

    return _batched(rows(), _WHOLE, 3)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Per record of the archives: id, page_id, payload_bytes, payload_digest, record_type, refers_to."""
    values = spark.read.option("lineSep", START.decode()).text(path).where("length(value) > 0").select(F.col("value").cast("binary"))
    parse = lambda batches: _batched((_parsed(value) for (value,) in _rows(batches)), _SEGMENTS, 7)
    parsed = staged(values.mapInArrow(parse, SEGMENT_SCHEMA), "warc-segments")
    whole = parsed.where("segment IS NULL AND kind = 'response'").select("id", "page_id", "declared", "payload_bytes", "sha1")
    split = parsed.where("segment IS NOT NULL").select("origin", "segment", "page_id", "declared", "data")
    joined = (
        split.repartition("origin").sortWithinPartitions("origin", "segment")
        .mapInArrow(_streamed, "id string, page_id long, declared string, data binary, payload_bytes long, sha1 string").drop("data")
    )
    responses = whole.unionByName(joined)
    wrong = F.raise_error(F.concat(F.lit("digest of "), "id"))
    responses = responses.withColumn("sha1", F.when(F.col("sha1") == F.col("declared"), F.col("sha1")).otherwise(wrong))
    revisits = parsed.where("kind = 'revisit'").select("id", "page_id", "refers", "declared")
    of = responses.select(F.col("id").alias("refers"), F.col("page_id").alias("refers_to"), "payload_bytes")
    found = revisits.join(of, "refers")
    columns = ["id", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return responses.select(
        "id", "page_id", "payload_bytes", F.col("sha1").alias("payload_digest"), F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to")
    ).unionByName(
        found.withColumnRenamed("declared", "payload_digest").withColumn("record_type", F.lit("revisit")).select(*columns)
    )


def round_trip(
    pages: DataFrame, path: str | None = None, chunk_bytes: int = CHUNK_BYTES, least_bytes: int = LEAST_BYTES, compression: str = "gzip"
) -> DataFrame:
    """Write ``pages`` as WARC archives under ``path`` (a scratch folder by default) and read them back."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    chunks = chunk_table(pages, chunk_bytes)
    write_archives(chunks, revisit_table(chunks, least_bytes), path, compression=compression)
    return read_archives(spark, path).drop("id")


# DuckDB has no base32, so the twin spells the SHA-1 out in groups of five bits.
ORACLE = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, unhex(sha1(coalesce(html, ''))) AS h FROM pages
), r AS (
  SELECT page_id, payload_bytes,
    list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      CAST(substr(CAST(CAST(h AS BIT) AS VARCHAR), CAST(i * 5 + 1 AS BIGINT), 5) AS BIT)::INTEGER + 1, 1)), 'string_agg', '') AS payload_digest,
    min(page_id) OVER (PARTITION BY payload) AS first
  FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM r
"""
