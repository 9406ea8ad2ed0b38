"""WARC archives: records written, segmented and deduplicated, and put together again.

Writing: every page becomes one record. Pages with equal payloads share one response record, of
the largest page_id; the others are revisit records that name it. Payloads travel in chunked
transfer framing; a block over `SEGMENT_BYTES` is split into a first segment and continuation
records. Archives are gzipped files in the shared folder, written by Spark's text writer with the
record terminator as its line separator.

Reading: each archive is walked by Content-Length, so a payload may hold any bytes. Continuation
records are grouped by their origin id and ordered by segment number; the total length is
verified, the chunks are decoded, and the payload is checked against its digest.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import table
from quarry.plans.session import shared_dir

SEGMENT_BYTES = 16_384
CHUNK_BYTES = 4096
#: Payload bytes that a writing task holds at a time, about.
BATCH_BYTES = 8 << 20
#: Records of an archive file at most.
ARCHIVE_RECORDS = 1000
END = b"\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def unchunk(body: bytes) -> bytes:
    """The payload of a chunked body; a broken frame raises ValueError."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not n:
            return b"".join(out)
        if body[at + n : at + n + 2] != b"\r\n":
            raise ValueError("a chunk does not end where its length says")
        out.append(body[at : at + n])
        at += n + 2


def record_id(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def _record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + END + block


def _split(block: bytes, size: int) -> list[bytes]:
    """Pieces of about size bytes that do not split a UTF-8 character."""
    out, at = [], 0
    while at < len(block):
        end = at + size
        while end < len(block) and block[end] & 0xC0 == 0x80:
            end += 1
        out.append(block[at:end])
        at = end
    return out or [b""]


def records_of(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, segment: int = SEGMENT_BYTES, row: str = "0") -> list[bytes]:
    """The WARC records of one page, without their terminators; row tells repeated rows apart."""
    name = record_id(f"page/{page_id}")
    target = "".join((url or "").split()) or f"urn:page:{page_id}"
    common = [("WARC-Date", DATE), ("WARC-Target-URI", target), ("X-Page-Id", page_id), ("WARC-Payload-Digest", f"sha1:{digest32(payload)}"), ("X-Payload-Length", len(payload))]
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    kind = "application/http; msgtype=response"
    if refers_to is not None:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        headers = [("WARC-Type", "revisit"), ("WARC-Record-ID", name), *common, ("WARC-Profile", profile), ("WARC-Refers-To", record_id(f"page/{refers_to}")), ("X-Refers-To-Page", refers_to), ("Content-Type", kind)]
        return [_record(headers, head)]
    pieces = _split(head + _frame(payload), segment)
    first = [("WARC-Type", "response"), ("WARC-Record-ID", name), *common, ("Content-Type", kind)]
    if len(pieces) == 1:
        return [_record(first, pieces[0])]
    out = [_record([*first, ("X-Row", row), ("WARC-Segment-Number", 1)], pieces[0])]
    for i, piece in enumerate(pieces[1:], 2):
        last = sum(map(len, pieces)) if i == len(pieces) else None
        headers = [("WARC-Type", "continuation"), ("WARC-Record-ID", record_id(f"page/{page_id}/{i}")), ("WARC-Date", DATE), ("WARC-Target-URI", target), ("WARC-Segment-Origin-ID", name), ("X-Row", row), ("WARC-Segment-Number", i), ("WARC-Segment-Total-Length", last)]
        out.append(_record(headers, piece))
    return out


def _frame(payload: bytes) -> bytes:
    """Chunked framing whose chunks end between characters, so that each file is UTF-8 text."""
    parts = _split(payload, CHUNK_BYTES) if payload else []
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def referrals(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) with digest (hex SHA-1) and refers_to of the record that it revisits.

    One narrow pass finds the largest page_id of each payload, summed up before the shuffle. Rows
    that tie on page_id and payload are all responses.
    """
    rows = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    first = rows.groupBy("digest").agg(F.max("page_id").alias("keeper"))
    refers = F.when(F.col("page_id") < F.col("keeper"), F.col("keeper"))
    return rows.join(first, "digest").withColumn("refers_to", refers).drop("keeper")


def write_archives(pages: DataFrame, path: str, segment: int = SEGMENT_BYTES) -> None:
    """Writes the records of pages (page_id, url, html) as gzipped archives under path.

    Null html is an empty payload and a null or blank url becomes a urn of the page; repeated rows
    get records of their own; an empty table writes no records; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth = TaskContext.get().partitionId(), 0
        for batch in batches:
            found, size = [], 0
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                nth += 1
                found += [r.decode() for r in records_of(page_id, url, html.encode(), refers_to, segment, f"{part}.{nth}")]
                size += len(html)
                if size > BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["value"])
                    found, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["value"])

    records = referrals(pages).select("page_id", "url", "html", "refers_to").mapInArrow(run, "value string")
    writer = records.write.option("lineSep", END.decode()).option("compression", "gzip")
    writer.option("maxRecordsPerFile", ARCHIVE_RECORDS).text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record of an archive, walked by Content-Length."""
    at = 0
    while at < len(data):
        end = data.index(END, at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record starts at byte {at}")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        start = end + len(END)
        stop = start + int(headers["Content-Length"])
        if data[stop : stop + len(END)] != END:
            raise ValueError(f"the record at byte {at} is not terminated")
        yield headers, data[start:stop]
        at = stop + len(END)


_RECORD = "origin string, kind string, segment int, total long, page_id long, digest string, length long, refers_to long, block binary"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row a record of the archives under path; origin is the id of a record's first segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda h, k: int(h[k]) if k in h else None
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for h, block in parse(zlib.decompress(content.as_py(), wbits=47)):
                    rows.append({
                        "origin": f"{h.get('WARC-Segment-Origin-ID', h['WARC-Record-ID'])} {h.get('X-Row')}", "kind": h["WARC-Type"], "segment": number(h, "WARC-Segment-Number"),
                        "total": number(h, "WARC-Segment-Total-Length"), "page_id": number(h, "X-Page-Id"), "digest": h.get("WARC-Payload-Digest"),
                        "length": number(h, "X-Payload-Length"), "refers_to": number(h, "X-Refers-To-Page"), "block": block,
                    })
                yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInArrow(run, _RECORD)


_SCHEMA = pa.schema([("origin", pa.string()), ("kind", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("page_id", pa.int64()), ("digest", pa.string()), ("length", pa.int64()), ("refers_to", pa.int64()), ("block", pa.binary())])
_PAGE = "page_id long, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"
_PAGE_SCHEMA = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())])


def _page(row: dict, block: bytes) -> dict:
    """The page that a whole block holds; for a revisit, what its headers say of the payload.

    Archives of other writers need not have a payload digest or length: then there is nothing to check.
    """
    digest, payload, length = (row["digest"] or "").removeprefix("sha1:") or None, None, row["length"]
    if row["kind"] == "response":
        head, body = block.split(END, 1)
        payload = unchunk(body) if b"transfer-encoding: chunked" in head.lower() else body
        found = digest32(payload)
        if digest not in (None, found) or length not in (None, len(payload)):
            raise ValueError(f"the payload of page {row['page_id']} does not match its digest")
        digest, length = found, len(payload)
    return {"page_id": row["page_id"], "record_type": row["kind"], "payload": payload, "payload_bytes": length, "payload_digest": digest, "refers_to": row["refers_to"]}


def reassemble(records: DataFrame) -> DataFrame:
    """Pages from records; only records in segments are shuffled, by their origin.

    A segment that is missing, doubled or of another total length raises ValueError.
    """

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                rows = batch.slice(i, 256).to_pylist()
                yield pa.RecordBatch.from_pylist([_page(r, r["block"]) for r in rows], schema=_PAGE_SCHEMA)

    def joined(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["segment"])
        if [r["segment"] for r in rows] != list(range(1, len(rows) + 1)):
            raise ValueError(f"segments of {rows[0]['origin']} are missing or doubled")
        block = b"".join(r["block"] for r in rows)
        if rows[-1]["total"] != len(block):
            raise ValueError(f"segments of {rows[0]['origin']} have another total length")
        return pa.Table.from_pylist([_page(rows[0], block)], schema=_PAGE_SCHEMA)

    whole = records.where("segment is null").mapInArrow(single, _PAGE)
    parts = records.where("segment is not null").groupBy("origin").applyInArrow(joined, _PAGE)
    return whole.unionAll(parts)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(table(spark, sf_dir, "pages"), path)
    found = reassemble(read_records(spark, path))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: RFC 4648 letters, five bits each of the 160 bits of a SHA-1.
ORACLE = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages
), d AS (SELECT page_id, octet_length(encode(html)) AS n, sha1(html) AS h FROM p
), b AS (
  SELECT page_id, n, h, array_to_string(list_transform(range(0, 16), lambda i: bin(CAST(('0x' || h[i * 2 + 1 : i * 2 + 2]) AS BIGINT) + 256)[2:]), '')
    || array_to_string(list_transform(range(16, 20), lambda i: bin(CAST(('0x' || h[i * 2 + 1 : i * 2 + 2]) AS BIGINT) + 256)[2:]), '') AS bits FROM d
), e AS (
  SELECT page_id, n, h, array_to_string(list_transform(range(0, 32), lambda i:
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + 16 * CAST(bits[i * 5 + 1] AS INT) + 8 * CAST(bits[i * 5 + 2] AS INT) + 4 * CAST(bits[i * 5 + 3] AS INT) + 2 * CAST(bits[i * 5 + 4] AS INT) + CAST(bits[i * 5 + 5] AS INT)]), '') AS digest FROM b
), k AS (SELECT h, max(page_id) AS keeper FROM e GROUP BY h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id < keeper THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < keeper THEN keeper END AS refers_to
FROM e JOIN k USING (h)
"""
