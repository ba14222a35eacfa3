r"""WARC archives: writing captures, reading them back, assembling transactions.

A capture is three records, named by page_id, url and payload: a response (or a revisit of an earlier response with the same payload), the request, and
metadata. They are written by Spark's text sink with ``\r\n\r\n`` as the line separator, which is just what
ends a WARC record, so any file system that Spark writes to can hold the archives. Reading takes records by their
Content-Length, whatever they contain, in one pass over each file. Assembly brings request, response and metadata together by
their concurrent-to identifiers, also where one names another that names the response, or where the response names
the request, and emits one nested row per capture.

Cases: null html is an empty payload; a null url an empty target; of equal payloads of MIN_SHARED bytes or more the record of the smallest page_id is the response
(a null page_id is never one that others revisit); repeated rows give as many captures; an empty table gives no rows; other columns are ignored;
line ends in a url are percent-encoded.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placemill.llm.common import shared_dir, written

MIN_SHARED = 100
#: An archive holds so many records and so many bytes at most, or one capture. Reading one takes its compressed bytes and one record of memory.
RECORDS_PER_FILE = 12_000
FILE_BYTES = 512 << 20
#: Pages of like size share archives: bounds of the classes, in bytes of html.
CLASSES = (32 << 10, 1 << 20, 32 << 20)
CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def _text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def _record(kind: Column, record_id: Column, content_type: str, block: Column, *headers: tuple[str, Column]) -> Column:
    """One record without its end; a header whose value is null is left out."""
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))
    head = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", F.lit(DATE)), *headers, ("Content-Type", F.lit(content_type)), ("Content-Length", F.octet_length(block).cast("string"))]
    return F.concat(F.lit("WARC/1.1" + CRLF), *(line(n, v) for n, v in head), F.lit(CRLF), block)


def _record_id(kind: str, page_id: Column, url: Column, digest: Column) -> Column:
    """Pages that share a page_id have records of their own where url or payload differ."""
    return F.concat(F.lit("<urn:capture:"), _text(page_id), F.lit(":"), F.substring(digest, 1, 32), F.md5(url), F.lit(f":{kind}>"))


def _url(pages: DataFrame) -> Column:
    return F.regexp_replace(F.regexp_replace(_text(pages["url"]), "\r", "%0D"), "\n", "%0A")


def payloads_of(pages: DataFrame) -> DataFrame:
    """``page_id, url, digest, n``, written: what is known of each page but for its html, which stays where it is."""
    return written(pages.select("page_id", _url(pages).alias("url"), F.sha2(_text(F.col("html")), 256).alias("digest"), F.octet_length(_text(F.col("html"))).alias("n")), "payloads")


def revisits(light: DataFrame) -> DataFrame:
    """``page_id, digest, first, first_url``: pages whose payload another page, ``first``, holds already."""
    shared = light.filter(F.col("n") >= MIN_SHARED)
    groups = shared.groupBy("digest").agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("f"), F.count("*").alias("copies")).filter("copies > 1 and f is not null")
    return written(shared.join(groups, "digest").filter("not (page_id <=> f.page_id)").select("page_id", "digest", F.col("f.page_id").alias("first"), F.col("f.url").alias("first_url")).distinct(), "revisits")


def archive_lines(pages: DataFrame, again: DataFrame) -> DataFrame:
    """``value``: the records of the captures of ``pages``, of which ``again`` are revisits."""
    again = again.select(F.col("page_id").alias("r_page"), F.col("digest").alias("r_digest"), "first", "first_url")
    page = pages.select("page_id", _url(pages).alias("url"), _text(F.col("html")).alias("html")).withColumn("digest", F.sha2("html", 256))
    page = page.join(again, F.col("page_id").eqNullSafe(F.col("r_page")) & (F.col("digest") == F.col("r_digest")), "left")
    is_revisit = F.col("first").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length("html").cast("string"), F.lit(CRLF + CRLF))
    own = _record_id("response", F.col("page_id"), F.col("url"), F.col("digest"))
    uri, digest = ("WARC-Target-URI", F.col("url")), ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest")))
    response = _record(
        F.when(is_revisit, "revisit").otherwise("response"), own, "application/http;msgtype=response", F.concat(http, F.when(is_revisit, "").otherwise(F.col("html"))), uri, digest,
        ("WARC-Refers-To", F.when(is_revisit, _record_id("response", F.col("first"), F.col("first_url"), F.col("digest")))), ("WARC-Profile", F.when(is_revisit, PROFILE)),
    )
    path = F.regexp_replace("url", "^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "")
    asked = F.concat(F.lit("GET "), F.when(path == "", "/").otherwise(path), F.lit(f" HTTP/1.1{CRLF}Host: "), F.regexp_extract("url", "^[A-Za-z][A-Za-z0-9+.-]*://([^/]*)", 1), F.lit(CRLF + CRLF))
    request = _record(F.lit("request"), _record_id("request", F.col("page_id"), F.col("url"), F.col("digest")), "application/http;msgtype=request", asked, uri, ("WARC-Concurrent-To", own))
    fields = F.concat(F.coalesce(F.concat(F.lit("page-id: "), F.col("page_id").cast("string"), F.lit(CRLF)), F.lit("")), F.lit(f"via: table{CRLF}"))
    metadata = _record(F.lit("metadata"), _record_id("metadata", F.col("page_id"), F.col("url"), F.col("digest")), "application/warc-fields", fields, uri, ("WARC-Concurrent-To", own))
    return page.select(F.explode(F.array(request, response, metadata)).alias("value"))


def write(pages: DataFrame, path: str, classes: tuple[int, ...] = CLASSES) -> None:
    """The archives of ``pages``, by classes of size, so that FILE_BYTES bounds a file whatever the mix of pages."""
    light = payloads_of(pages)
    again = revisits(light)
    top = light.agg(F.max("n")).first()[0]
    below = -1
    for upto in (*classes, None):
        size = F.octet_length(_text(F.col("html")))
        if top is not None and top > below and (upto is None or below < 0 or not light.filter((F.col("n") > below) & (F.col("n") <= upto)).isEmpty()):
            some = pages.filter((size > below) & (size <= upto)) if upto is not None else pages.filter(size > below)
            # a capture has three records; those without html are short
            most = 3 if upto is None else max(3, min(RECORDS_PER_FILE, 3 * (FILE_BYTES // upto)))
            archive_lines(some, again).write.mode("append").option("lineSep", CRLF + CRLF).option("compression", "gzip").option("maxRecordsPerFile", most).text(path)
        below = upto
    if top is None:
        archive_lines(pages, again).write.mode("append").text(path)


def unpacked(data: bytes, chunk: int = 1 << 20) -> Iterator[bytes]:
    """An archive's bytes in pieces; gzip members, one or many, are decompressed as they come."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    view, at = memoryview(data), 0
    while at < len(view):
        member = zlib.decompressobj(31)
        while not member.eof:
            part = member.unconsumed_tail
            if not part:
                if at >= len(view):
                    raise ValueError("a gzip member is cut short")
                part = view[at : at + (1 << 16)]
                at += len(part)
            if piece := member.decompress(part, chunk):
                yield piece
        at -= len(member.unused_data)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers, names in lower case, and block of each record of an archive; one record is in memory at a time."""
    buffer, pieces = bytearray(), unpacked(data)

    def fill(size: int) -> bool:
        """Whether the buffer has so many bytes, if need be after reading on."""
        while len(buffer) < size:
            piece = next(pieces, None)
            if piece is None:
                return False
            buffer.extend(piece)
        return True

    while fill(1):
        if fill(2) and buffer[:2] == b"\r\n":
            del buffer[:2]
            continue
        end = buffer.find(b"\r\n\r\n")
        while end < 0 and fill(len(buffer) + 1):
            end = buffer.find(b"\r\n\r\n")
        if end < 0 or not buffer.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at {bytes(buffer[:40])!r}")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in buffer[:end].decode("utf-8", "replace").split("\r\n")[1:])}
        start, size = end + 4, int(head["content-length"])
        if not fill(start + size):
            raise ValueError(f"record {head.get('warc-record-id')} is cut short")
        yield head, bytes(buffer[start : start + size])
        del buffer[: start + size]


RECORD_SCHEMA = "record_id string, type string, concurrent_to string, refers_to string, target_uri string, date string, digest string, payload_bytes long, fields map<string,string>, payload binary"
_RECORD_ARROW = pa.schema([(n, pa.string()) for n in ("record_id", "type", "concurrent_to", "refers_to", "target_uri", "date", "digest")] + [("payload_bytes", pa.int64()), ("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])


def _row(head: dict[str, str], block: bytes, keep_payload: bool) -> dict:
    kind = head.get("warc-type", "")
    payload, fields = block, {}
    if "application/http" in head.get("content-type", ""):
        http, _, rest = block.partition(b"\r\n\r\n")
        first, *lines = http.decode("utf-8", "replace").split("\r\n")
        fields = {"": first} | {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        payload = rest
    elif head.get("content-type", "") == "application/warc-fields":
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in block.decode("utf-8", "replace").split("\r\n") if x)}
    revisit = kind == "revisit"
    said = head.get("warc-payload-digest", "").removeprefix("sha256:")
    digest = said if revisit else hashlib.sha256(payload).hexdigest()
    if kind == "response" and said and said != digest:
        raise ValueError(f"payload of {head.get('warc-record-id')} differs from its digest")
    return {
        "record_id": head.get("warc-record-id"), "type": kind, "concurrent_to": head.get("warc-concurrent-to"), "refers_to": head.get("warc-refers-to"),
        "target_uri": head.get("warc-target-uri"), "date": head.get("warc-date"), "digest": digest,
        "payload_bytes": int(fields.get("content-length", 0)) if revisit else len(payload), "fields": list(fields.items()), "payload": payload if keep_payload and not revisit else None,
    }


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row a record of the archives under ``path``, plain or gzip, by record or whole."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                data = content.as_py()
                rows, held = [], 0
                for head, block in parse(data):
                    rows.append(_row(head, block, payloads))
                    held += len(block) if payloads else 0
                    if len(rows) >= 4000 or held > 8_000_000:
                        yield pa.RecordBatch.from_pylist(rows, _RECORD_ARROW)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _RECORD_ARROW)

    # one file a row in a batch, whatever their number
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(fn, RECORD_SCHEMA)


def assemble(records: DataFrame) -> DataFrame:
    """One row a capture: capture_id, and structs response, request and metadata (null where there is none)."""
    main = F.col("type").isin("response", "revisit", "resource")
    hops = records.filter("concurrent_to is not null").select(F.when(main, F.col("concurrent_to")).otherwise(F.col("record_id")).alias("hop"), F.when(main, F.col("record_id")).otherwise(F.col("concurrent_to")).alias("to"))
    hops = hops.groupBy("hop").agg(F.min("to").alias("to"))
    aim = F.coalesce(F.when(main, F.col("record_id")), F.col("concurrent_to"), F.col("record_id"))
    aimed = records.withColumn("aim", aim).join(hops, F.col("aim") == F.col("hop"), "left")
    capture = F.when(main, F.col("record_id")).otherwise(F.coalesce("to", "aim"))
    body = F.struct(*records.columns)
    pick = lambda test: F.first(F.when(test, body), ignorenulls=True)
    grouped = aimed.groupBy(capture.alias("capture_id")).agg(pick(main).alias("response"), pick(F.col("type") == "request").alias("request"), pick(F.col("type") == "metadata").alias("metadata"), F.greatest(F.count_if(main), F.lit(1)).cast("int").alias("n"))
    return grouped.withColumn("n", F.explode(F.sequence(F.lit(1), F.col("n")))).drop("n")


def round_trip(pages: DataFrame, payloads: bool = False) -> DataFrame:
    """Captures of ``pages`` written to archives in the shared folder, read back and assembled."""
    path = f"{shared_dir(pages.sparkSession)}/placemill/warc-{uuid.uuid4().hex}"
    write(pages, path)
    return assemble(written(read(pages.sparkSession, path, payloads), "records"))  # parsed once, joined twice


def digest_rows(captures: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url of assembled captures of ``write``."""
    return captures.select(
        F.col("metadata.fields")["page-id"].cast("long").alias("page_id"),
        F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        F.nullif(F.regexp_extract("response.refers_to", "^<urn:capture:(-?[0-9]+):", 1), F.lit("")).cast("long").alias("refers_to"),
        F.col("response.target_uri").alias("url"),
    )


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, url, strlen(html) AS payload_bytes, sha256(html) AS payload_digest FROM p),
m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND first <> page_id THEN first END AS refers_to, url
FROM m
"""
