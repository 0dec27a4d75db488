"""WARC archives: writing request, response or revisit, and metadata records, reading them back, and assembling captures.

Writing: the payload digest (SHA-1 in base 32) and length of each page are worked out in Spark; per digest the smallest
page_id is found by a pre-aggregated grouping and joined back on narrow rows (digests that hold more than one in HOT_SHARE of
all rows, so at most HOT_SHARE of them, by broadcast). Every page becomes three records, each a gzip member of its own;
members are packed until an archive has ARCHIVE bytes, and Spark's writer commits one file for each archive to the shared
folder. So an archive is bounded by ARCHIVE and one capture. Reading: the archives come as binary rows and are parsed record
by record as streams. A revisit's WARC-Refers-To is the WARC-Record-ID of the response that it repeats. Transaction assembly:
request and metadata records name their capture in WARC-Concurrent-To; one grouping on the capture's id joins them with the
response or revisit record into one nested row per capture.

Defined results: a null html is an empty payload; a null url is written as about:blank, control characters in it as %20;
rows that repeat page_id and html are one capture (with the smallest url); a null page_id is a response of its own (and comes
back as null); payloads under `least` bytes are never revisits; ties cannot occur among page ids; extra columns are ignored;
an empty table gives no captures.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, scratch_path

ARCHIVE, HOT_SHARE = 8 << 20, 1000
DATE = "2024-01-01T00:00:00Z"

# The alphabets of radix 32 and of base 32.
RADIX_32, BASE_32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 of a string's UTF-8 bytes in base 32: eight times 20 bits of the hexadecimal digest."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*parts)), RADIX_32, BASE_32)


def urn(*parts: Column) -> Column:
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(F.md5(F.concat_ws("|", *parts)), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def record(kind: Column | str, headers: list[tuple[str, Column]], content_type: str, block: Column) -> Column:
    """One record without the two line ends that follow it; a header with a null value is left out."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.lit(f"WARC-Date: {DATE}"), *(F.concat(F.lit(f"{k}: "), v) for k, v in headers)]
    lines += [F.lit(f"Content-Type: {content_type}"), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), block)


def with_few_hot(rows: DataFrame, sides: DataFrame, key: str, total: int) -> DataFrame:
    """rows joined with sides (key, n, ...; n: rows that hold the key, total: all rows): keys with more than one in HOT_SHARE
    of all rows, which are at most HOT_SHARE, are broadcast, so that no such key is one task."""
    hot = sides.filter(F.col("n") * HOT_SHARE > total)
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(sides.filter(F.col("n") * HOT_SHARE <= total), key)).drop("n")


def with_decisions(pages: DataFrame, least: int) -> DataFrame:
    """pages (page_id, url, html) with digest, size and refers_to (the page that holds the same payload, null for responses)."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("about:blank")), r"[\x00-\x20\x7F]", "%20").alias("url"), html.alias("html"))
    pages = pages.withColumns({"digest": base32_sha1(F.col("html")), "size": F.octet_length("html").cast("long")})
    narrow = cut(pages.select("page_id", "digest", "size").filter(F.col("size") >= least), "digests")
    first = narrow.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"), F.count("*").alias("n")).filter("last > first").drop("last")
    later = with_few_hot(narrow, first, "digest", narrow.count()).filter("page_id > first").select("page_id", "digest", F.col("first").alias("refers_to")).distinct()
    return pages.join(later, ["page_id", "digest"], "left")


def write_archives(pages: DataFrame, path: str, least: int = 0, archive: int = ARCHIVE) -> None:
    """Write all pages as archives under path."""
    p = with_decisions(pages, least)
    page, digest = F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.col("digest")
    # A response's id follows from its page and payload alone, so that its revisits can name it; a page without id has its url.
    own = F.when(F.col("page_id").isNull(), urn(F.lit("capture"), F.lit(""), F.col("url"), digest)).otherwise(urn(F.lit("capture"), page, digest))
    target = urn(F.lit("capture"), F.col("refers_to").cast("string"), digest)
    revisit = F.col("refers_to").isNotNull()
    uri = ("WARC-Target-URI", F.col("url"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n"))
    response = record(
        F.when(revisit, "revisit").otherwise("response"),
        [
            ("WARC-Record-ID", own),
            uri,
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
            ("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
            ("WARC-Refers-To", F.when(revisit, target)),
        ],
        "application/http; msgtype=response",
        F.when(revisit, http).otherwise(F.concat(http, F.col("html"))),
    )
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1)
    request = record("request", [("WARC-Record-ID", urn(F.lit("request"), own)), uri, ("WARC-Concurrent-To", own)], "application/http; msgtype=request", F.concat(F.lit("GET "), F.col("url"), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit("\r\n\r\n")))
    metadata = record("metadata", [("WARC-Record-ID", urn(F.lit("metadata"), own)), uri, ("WARC-Concurrent-To", own)], "application/warc-fields", F.concat(F.lit("page-id: "), page, F.lit("\r\n")))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for records in zip(*batch.columns, strict=True):
                for r in records:
                    held.append(gzip.compress(r.as_buffer().to_pybytes() + b"\r\n\r\n", 5, mtime=0))
                    size += len(held[-1])
                if size >= archive:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["value"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["value"])

    rows = p.select(request.alias("request"), response.alias("response"), metadata.alias("metadata")).mapInArrow(packed, "value binary")
    # One archive is one row and one file. The text writer writes bytes as they are; gzip readers skip the zero byte at the end.
    rows.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in small letters) and block of each record."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {line[:40]!r}")
        headers: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8").partition(":")
            headers[name.lower()] = value.strip()
        yield headers, stream.read(int(headers["content-length"]))


RECORD = "type string, record_id string, concurrent_to string, uri string, refers_to string, payload_digest string, payload_bytes long, fields string"


def read_records(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """One row per record of the archives under path. For responses digest and length are those of the payload as read, for
    revisits as recorded; with payload its text too."""

    def row(headers: dict[str, str], block: bytes) -> tuple:
        kind, digest, size, fields, body = headers["warc-type"], None, None, None, None
        if kind == "response":
            _, _, body = block.partition(b"\r\n\r\n")
            digest, size = base64.b32encode(hashlib.sha1(body).digest()).decode(), len(body)
            if headers.get("warc-payload-digest", f"sha1:{digest}") != f"sha1:{digest}":
                raise ValueError(f"payload of {headers['warc-record-id']} doesn't have its digest")
        elif kind == "revisit":
            digest = headers["warc-payload-digest"].removeprefix("sha1:")
            size = next(int(x.split(b":")[1]) for x in block.split(b"\r\n") if x.lower().startswith(b"content-length:"))
        else:
            fields = block.decode("utf-8")
        out = kind, headers["warc-record-id"], headers.get("warc-concurrent-to"), headers.get("warc-target-uri"), headers.get("warc-refers-to"), digest, size, fields
        return (*out, body.decode("utf-8", "replace") if body is not None else None) if payload else out

    schema = RECORD + (", payload string" if payload else "")
    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.int64() if x.endswith(" long") else pa.string() for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                held = 0
                for headers, block in parse(gzip.GzipFile(fileobj=io.BytesIO(content.as_py()))):
                    rows.append(row(headers, block))
                    held += len(block) * payload
                    if len(rows) >= 10_000 or held > 16 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(run, schema)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, capture, request, metadata (of several the smallest; null if missing)."""
    is_capture = F.col("type").isin("response", "revisit")
    body = [c for c in records.columns if c not in ("record_id", "concurrent_to", "fields")]
    capture = F.when(is_capture, F.struct(*body))
    request = F.when(F.col("type") == "request", F.struct("record_id", "uri", "fields"))
    metadata = F.when(F.col("type") == "metadata", F.struct("record_id", "uri", "fields"))
    key = F.when(is_capture, F.col("record_id")).otherwise(F.coalesce("concurrent_to", "record_id"))
    grouped = records.groupBy(key.alias("capture_id")).agg(F.min(capture).alias("capture"), F.min(request).alias("request"), F.min(metadata).alias("metadata"))
    return grouped.filter(F.col("capture").isNotNull())


def captures(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write pages as archives, read them back, and return per page what became of it."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, path, least)
    nested = assemble(read_records(spark, path))
    rows = nested.select(
        F.regexp_extract(F.coalesce(F.col("metadata.fields"), F.lit("")), r"page-id: (-?\d+)", 1).try_cast("long").alias("page_id"),
        F.col("capture.payload_bytes").alias("payload_bytes"),
        F.col("capture.payload_digest").alias("payload_digest"),
        F.col("capture.type").alias("record_type"),
        F.col("capture_id").alias("record_id"),
        F.col("capture.refers_to").alias("target"),
    )
    rows = cut(rows, "captures")  # read three times below
    revisits = rows.filter(F.col("record_type") == "revisit")
    responses = rows.filter(F.col("record_type") == "response")
    asked = revisits.groupBy("target").agg(F.count("*").alias("n"))
    held = asked.join(responses.select(F.col("record_id").alias("target"), F.col("page_id").alias("refers_to")), "target", "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    found = with_few_hot(revisits, held, "target", revisits.count())
    return responses.withColumn("refers_to", F.lit(None).cast("long")).select(columns).unionByName(found.select(columns))
