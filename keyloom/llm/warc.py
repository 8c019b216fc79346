"""WARC archives: writing with segmentation and revisits, reading with segment reassembly.

Files are written by Spark's text sink: a row is a record, and the sink's line separator CRLF CRLF is
the end of a WARC record, so the files are gzipped WARC/1.1 on any store that Spark writes. Payloads are
UTF-8 text. A block is an HTTP response with chunked transfer framing; long blocks are cut into a
first record with WARC-Segment-Number 1 and continuation records that name its id.

Reading takes whole files (their size is bounded by the writer), parses records by Content-Length,
and groups only segmented records by origin id: ordered by number, length verified, framing decoded.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import new_path, stash

#: Characters of a record's block, characters of a chunk of the framing, records of a file.
SEGMENT, CHUNK, FILE_RECORDS = 65_536, 16_384, 500
LEAST_REVISIT = 100
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_DATE = "2024-01-01T00:00:00Z"
_HEAD = re.compile(rb"WARC/1\.[01]\r\n((?:[^\r\n]+\r\n)*)\r\n")
_OUT = "page_id long, origin string, number int, total long, record_type string, refers_to long, status string, payload_bytes long, payload_digest string, block binary"


def assign_types(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """page_id, url, html, payload_bytes, digest, first_id: first_id is the smallest page_id of equal payloads of `least` bytes or more."""
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("payload_bytes", F.octet_length("html").cast("long")).withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    groups = rows.where(F.col("payload_bytes") >= least).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies"))
    return rows.join(groups.where("copies > 1").select("digest", "first_id"), "digest", "left")


def _record(row: tuple) -> Iterator[str]:
    page, url, html, size, digest, first, nth = row
    name = lambda kind, *x: f"<urn:uuid:{uuid.uuid5(_NAMESPACE, ':'.join(map(str, (kind, *x))))}>"
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank")
    top = f"WARC-Date: {_DATE}\r\nWARC-Target-URI: {uri}\r\nX-Page-Id: {'' if page is None else page}\r\nWARC-Payload-Digest: sha256:{digest}\r\nContent-Type: application/http; msgtype=response\r\n"
    status = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    key = (uuid.uuid4(),) if page is None else (page, digest, nth)
    own = name("record", *key)
    if first is not None and page != first:
        block = f"{status}Content-Length: {size}\r\n\r\n"
        yield f"WARC/1.1\r\nWARC-Type: revisit\r\nWARC-Record-ID: {own}\r\n{top}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: {name('record', first, digest, 1)}\r\nX-Refers-To-Page: {first}\r\nContent-Length: {len(block.encode())}\r\n\r\n{block}"
        return
    parts = [html[i : i + CHUNK] for i in range(0, len(html), CHUNK)]
    block = status + "Transfer-Encoding: chunked\r\n\r\n" + "".join(f"{len(p.encode()):x}\r\n{p}\r\n" for p in parts) + "0\r\n\r\n"
    pieces = [block[i : i + SEGMENT] for i in range(0, len(block), SEGMENT)]
    many, total = len(pieces) > 1, len(block.encode())
    for number, piece in enumerate(pieces, 1):
        kind = "response" if number == 1 else "continuation"
        this = own if number == 1 else name("segment", *key, number)
        more = f"WARC-Segment-Number: {number}\r\n" if many else ""
        more += f"WARC-Segment-Origin-ID: {own}\r\n" if number > 1 else ""
        more += f"WARC-Segment-Total-Length: {total}\r\n" if many and number == len(pieces) else ""
        yield f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {this}\r\n{top}{more}Content-Length: {len(piece.encode())}\r\n\r\n{piece}"


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[str] = []
        size = 0
        columns = [c for c in batch.columns]
        for i in range(batch.num_rows):
            for text in _record(tuple(c[i].as_py() for c in columns)):
                out.append(text)
                size += len(text)
            if size > 8 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])
                out, size = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])


def write_warc(pages: DataFrame, path: str, least: int = LEAST_REVISIT) -> str:
    """Writes WARC files of `pages` (page_id, url, html) to the folder `path` and returns it.

    Null html is an empty payload, null url about:blank. Of equal payloads of `least` bytes or more
    the smallest page_id is the response; rows that repeat that page_id and payload are responses too.
    Each record has an id of its own: rows that repeat a page_id and payload are numbered, rows without a
    page_id get a random one. An empty table makes no records.
    """
    alone = F.when(F.col("page_id").isNull(), F.rand())  # spreads rows without an id
    typed = assign_types(pages, least).withColumn("alone", alone)
    typed = typed.withColumn("nth", F.row_number().over(Window.partitionBy("digest", "page_id", "alone").orderBy("url")))
    typed = typed.select("page_id", "url", "html", "payload_bytes", "digest", "first_id", "nth")
    records = typed.mapInArrow(_records, "value string")
    records.write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", FILE_RECORDS).option("compression", "gzip").text(path)
    return path


def dechunk(body: bytes) -> bytes | None:
    """Payload of a chunked body; None where the framing is broken."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            return None
        size = body[at:end].split(b";")[0].strip()
        if not re.fullmatch(rb"[0-9A-Fa-f]+", size):
            return None
        n, at = int(size, 16), end + 2
        if n == 0:
            return b"".join(out)
        if body[at + n : at + n + 2] != b"\r\n":
            return None
        out.append(body[at : at + n])
        at += n + 2


def payload_of(block: bytes) -> bytes | None:
    """Payload of an HTTP response block, transfer framing removed; None where it is broken."""
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        return None
    return dechunk(body) if re.search(rb"(?im)^transfer-encoding:\s*chunked\s*$", head.replace(b"\r", b"")) else body


def plain(data: bytes) -> bytes:
    """Content of a file of gzip members, one for all records or one each; other files as they are."""
    return gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record, by Content-Length."""
    at = 0
    while at < len(data):
        m = _HEAD.match(data, at)
        if not m:  # between damaged records: go on at the next version line
            at = data.find(b"\r\n\r\nWARC/1.", at)
            if at < 0:
                return
            at += 4
            continue
        fields = dict((k.strip().lower(), v.strip()) for k, _, v in (line.partition(":") for line in m[1].decode("utf-8", "replace").split("\r\n") if line))
        size = int(fields.get("content-length", "0"))
        yield fields, data[m.end() : m.end() + size]
        at = m.end() + size
        while data.startswith(b"\r\n", at):
            at += 2


def _finished(block: bytes) -> tuple[str, int, str]:
    payload = payload_of(block)
    return ("broken", 0, "") if payload is None else ("ok", len(payload), hashlib.sha256(payload).hexdigest())


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = lambda x: int(x) if x else None
    names = [x.split()[0] for x in _OUT.split(", ")]
    kinds = pa.schema([("page_id", pa.int64()), ("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("status", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("block", pa.binary())])
    for batch in batches:
        for data in batch.column(0):
            rows, size = [], 0
            for h, block in parse_warc(plain(data.as_buffer().to_pybytes())):
                kind, page = h.get("warc-type"), number(h.get("x-page-id"))
                if kind == "continuation" or "warc-segment-number" in h:
                    rows.append((page, h.get("warc-segment-origin-id", h.get("warc-record-id")), int(h["warc-segment-number"]), number(h.get("warc-segment-total-length")), kind, None, None, None, None, block))
                    size += len(block)
                elif kind == "revisit":
                    length = re.search(rb"(?im)^content-length:\s*(\d+)", block)
                    rows.append((page, None, None, None, kind, number(h.get("x-refers-to-page")), "ok" if length else "broken", int(length[1]) if length else 0, h.get("warc-payload-digest", "").removeprefix("sha256:"), None))
                elif kind == "response":
                    rows.append((page, None, None, None, kind, None, *_finished(block), None))
                if len(rows) >= 5000 or size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows), kinds)], names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows), kinds)], names)


def _joined(pdf):
    import pandas as pd

    pdf = pdf.sort_values("number")
    block, total = b"".join(pdf["block"]), pdf["total"].dropna()
    whole = list(pdf["number"]) == list(range(1, len(pdf) + 1)) and len(total) and int(total.iloc[-1]) == len(block)
    status, size, digest = _finished(block) if whole else ("incomplete", 0, "")
    first = pdf["page_id"].iloc[0]
    return pd.DataFrame({"page_id": pd.array([None if pd.isna(first) else int(first)], "Int64"), "record_type": ["response"], "refers_to": pd.array([None], "Int64"), "status": [status], "payload_bytes": [size], "payload_digest": [digest]})


def read_warc(spark, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, status of each page in the archives.

    status: ok, broken (bad framing) or incomplete (a segment lacks or the total length differs); the
    latter two have no bytes and an empty digest. No record is dropped. A folder without records gives
    an empty result.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    parsed = stash(files.mapInArrow(_parsed, _OUT), "warc-parsed")
    columns = ["page_id", "record_type", "refers_to", "status", "payload_bytes", "payload_digest"]
    whole = parsed.where("number IS NULL").select(*columns)
    parts = parsed.where("number IS NOT NULL").select("origin", "number", "total", "page_id", "block")
    joined = parts.groupBy("origin").applyInPandas(_joined, "page_id long, record_type string, refers_to long, status string, payload_bytes long, payload_digest string")
    return whole.unionByName(joined).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "status")


def op10_warc(spark, sf_dir: str) -> DataFrame:
    """Whole pages table, written as WARC and read back: page_id, payload_bytes, payload_digest, record_type, refers_to, status."""
    path = write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), new_path(spark, "warc"))
    return read_warc(spark, path)


OP10_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), d AS (
  SELECT page_id, octet_length(payload) AS payload_bytes, sha256(payload) AS payload_digest FROM p
), f AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first_id FROM d
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN first_id IS NULL OR first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first_id <> page_id THEN first_id END AS refers_to, 'ok' AS status
FROM f
"""
