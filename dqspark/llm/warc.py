"""WARC archives: writing captures as transactions, reading them back, and assembling the transactions.

A capture is three records: a request, a response (or a revisit, for a payload that another capture holds) and
metadata; request and metadata name the response in WARC-Concurrent-To. Archives are plain WARC/1.1 files written by
Spark's text writer, whose line separator is the blank line that ends each record, so any store that Spark writes to
will do. Reading goes by Content-Length, so payloads may hold anything.

Defined results: a null html is an empty payload; a null page id is written without one and is smaller than any
other; rows that repeat are captures of their own, with the same type; of pages with equal payloads and equal ids each is a
response; other columns, whatever their names, are not written; an empty table gives an archive without records. Files hold
so many captures that together they stay far below 2 GiB, by the longest payload there is; a single payload may have up to 1 GiB.
In archives that others wrote, a record without a type is skipped; one whose length is missing, no number or beyond the
end of the file is skipped up to the next record's first line; a request or metadata record whose response isn't there makes no capture.
"""

from __future__ import annotations

import base64
import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, through

#: Captures that one archive file holds at most, and about how many bytes; a reader holds one file at a time.
FILE_CAPTURES, FILE_BYTES = 1024, 1 << 28
DATE = "2024-01-01T00:00:00Z"
CRLF = "\r\n"
HTTP = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}{CRLF}"
CAPTURE = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, record_id string, request_id string, metadata_id string"


def base32_sha1(payload):
    """Upper-case base32 of the SHA-1, by blocks of 20 bits."""
    digest = F.sha1(payload)
    digits = F.concat(*[F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)])
    return F.translate(digits, "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def urn(kind: str, uid):
    h = F.md5(F.concat_ws(":", F.lit(kind), uid))
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"), F.substring(h, 13, 4), F.lit("-"), F.substring(h, 17, 4), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def write(pages: DataFrame, path: str, work: Workspace, min_bytes: int = 0, date: str = DATE, file_captures: int = FILE_CAPTURES, file_bytes: int = FILE_BYTES) -> None:
    """Archive pages(page_id, url, html) under path.

    Of equal payloads of at least min_bytes bytes the one with the largest page id is a response. Payloads are known by
    their digests; those that repeat are found by a partly pre-aggregated count, and only this list of digests is joined.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    page = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("html"), base32_sha1(payload).alias("digest"), F.octet_length(payload).cast("long").alias("bytes"))
    repeats = page.where(F.col("bytes") >= min_bytes).groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("first_id")).where("n > 1").select(F.col("digest").alias("r_digest"), "first_id")
    repeats = work.save(repeats, "repeats")
    page = page.withColumn("uid", F.monotonically_increasing_id().cast("string"))
    rows = page.join(repeats, (F.col("digest") == F.col("r_digest")) & (F.col("bytes") >= min_bytes), "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    key = F.concat_ws(":", F.col("page_id"), F.col("digest"), F.col("uid"))
    target = F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), "[\\r\\n]", " ")

    def record(kind, record_id, headers, body):
        """`body` is followed by the blank line that the text writer adds."""
        head = [F.lit(f"WARC/1.1{CRLF}WARC-Type: "), kind, F.lit(f"{CRLF}WARC-Record-ID: "), record_id, F.lit(f"{CRLF}WARC-Date: {date}{CRLF}WARC-Target-URI: "), target]
        for name, value in headers:
            head += [F.lit(f"{CRLF}{name}: "), value]
        return F.concat(*head, F.lit(f"{CRLF}Content-Length: "), F.octet_length(body).cast("string"), F.lit(CRLF + CRLF), body)

    main = urn("response", key)
    digest = F.concat(F.lit("sha1:"), F.col("digest"))
    response = record(F.lit("response"), main, [("Content-Type", F.lit("application/http;msgtype=response")), ("WARC-Payload-Digest", digest)], F.concat(F.lit(HTTP), F.col("html")))
    revisited = record(F.lit("revisit"), main, [("Content-Type", F.lit("application/http;msgtype=response")), ("WARC-Payload-Digest", digest), ("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))], F.lit(HTTP))
    request = record(F.lit("request"), urn("request", key), [("Content-Type", F.lit("application/http;msgtype=request")), ("WARC-Concurrent-To", main)], F.concat(F.lit("GET "), target, F.lit(f" HTTP/1.1{CRLF}{CRLF}")))
    fields = F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(CRLF))
    metadata = record(F.lit("metadata"), urn("metadata", key), [("Content-Type", F.lit("application/warc-fields")), ("WARC-Concurrent-To", main)], fields)
    lines = rows.select(F.concat_ws(CRLF + CRLF, request, F.when(revisit, revisited).otherwise(response), metadata).alias("value"))
    longest = pages.agg(F.max(F.octet_length("html"))).first()[0] or 0
    held = max(1, min(file_captures, file_bytes // (longest + 4096)))
    lines.write.option("lineSep", CRLF + CRLF).option("maxRecordsPerFile", held).mode("overwrite").text(path)


def parse(content: bytes | memoryview):
    """(headers by lower-case name, block) of each record of an archive; see the module for records that are malformed."""
    content, at = bytes(content), 0
    while (end := content.find(b"\r\n\r\n", at)) >= 0:
        lines = content[at:end].decode("utf-8", "replace").split(CRLF)
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = headers.get("content-length", "")
        size = int(size) if size.isascii() and size.isdigit() else -1
        if size < 0 or end + 4 + size > len(content):
            found = content.find(b"\r\nWARC/1.", at + 1)
            if found < 0:
                return
            at = found + 2
            continue
        if headers.get("warc-type"):
            yield headers, content[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def read(spark, path: str, with_payload: bool = False) -> DataFrame:
    """One row per record: type, ids, target, digest by header and of the bytes read, length, and the block if asked for."""
    schema = "record_type string, record_id string, concurrent_to string, url string, header_digest string, payload_digest string, payload_bytes long, fields string" + (", payload binary" if with_payload else "")

    def records(batches):
        names = [x.split()[0] for x in schema.split(", ")]
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for headers, block in parse(content.as_buffer()):
                    kind = headers["warc-type"]
                    body = block.partition(b"\r\n\r\n")[2] if kind in ("response", "revisit") else block
                    digest = base64.b32encode(hashlib.sha1(body).digest()).decode() if kind == "response" else None
                    row = (kind, headers.get("warc-record-id"), headers.get("warc-concurrent-to"), headers.get("warc-target-uri"), headers.get("warc-payload-digest", "").removeprefix("sha1:") or None, digest, len(body), block.decode("utf-8", "replace") if kind == "metadata" else None)
                    rows.append((*row, body) if with_payload else row)
                    if len(rows) >= 2000:
                        yield batch_of(names, rows)
                        rows = []
                if rows:
                    yield batch_of(names, rows)

    def batch_of(names, rows):
        types = [pa.string()] * 6 + [pa.int64(), pa.string()] + [pa.binary()] * with_payload
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return through(files, records, schema)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: its response or revisit, request and metadata, met by concurrent-to identifiers.

    The three meet by grouping on the response's id: three records a group, whatever the payloads.
    """
    names = [c for c in records.columns if c != "concurrent_to"]
    one = F.struct(*names)
    is_main = F.col("record_type").isin("response", "revisit")
    root = F.when(is_main, F.col("record_id")).otherwise(F.col("concurrent_to"))
    met = records.withColumn("_root", root).groupBy("_root").agg(F.first(F.when(is_main, one), True).alias("response"), F.first(F.when(F.col("record_type") == "request", one), True).alias("request"), F.first(F.when(F.col("record_type") == "metadata", one), True).alias("metadata"))
    return met.where(F.col("response").isNotNull()).drop("_root")


def captures(spark, path: str, work: Workspace) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every capture; revisits are resolved by payload digest."""
    page_id = F.regexp_extract("metadata.fields", "page-id: (-?[0-9]+)", 1).try_cast("long")
    rows = work.save(assemble(read(spark, path)).select(page_id.alias("page_id"), F.col("response.url").alias("url"), F.col("response.record_type").alias("record_type"), F.col("response.payload_bytes").alias("bytes"), F.col("response.payload_digest").alias("digest"), F.col("response.header_digest").alias("claimed")), "captures")
    responses = rows.where("record_type = 'response'").groupBy("digest").agg(F.max("page_id").alias("to_page"), F.max("bytes").alias("to_bytes")).withColumnRenamed("digest", "to_digest")
    direct = rows.where("record_type = 'response'").select("page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    again = rows.where("record_type = 'revisit'").join(responses, F.col("claimed") == F.col("to_digest"), "left")
    return direct.unionByName(again.select("page_id", F.col("to_bytes").alias("payload_bytes"), F.col("claimed").alias("payload_digest"), "record_type", F.col("to_page").alias("refers_to")))


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write archives to the shared folder and return what reading them back gives."""
    work = Workspace(pages.sparkSession, "warc")
    path = f"{work.path}/archives"
    write(pages, path, work, min_bytes)
    out = captures(pages.sparkSession, path, work)
    work.drop("archives")
    return out
