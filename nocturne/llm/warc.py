"""WARC archives with revisit resolution.

Headers (page id, address, payload digest and length) are shuffled by payload digest; of
equal payloads the one with the least page id is the original, and every other header
becomes a revisit record that refers to it.  Payloads are not part of this: the pages that
revisit none are joined to their payloads by digest and page id, so a page that comes a
million times is one payload in one task and no more.  The archives are written by
Spark's text writer, a file a row: a warcinfo record and then records up to FILE_BYTES (or
one longer record), with the blank lines that end a record between them, so a lost executor's
files are written again by the commit protocol.  A file is one gzip stream.  Reading goes
record by record along the stream, by Content-Length, since payloads may hold any separator.

Defined results: null html is an empty payload; payloads shorter than ``min_bytes`` are
never revisits; rows that share page id and payload are all responses if that id is the
least; a null page id is no other record's original unless all are null; a very long page
is a file of its own; page ids may be of any type that has a text form (read_archive is
told the type); an empty table gives an empty archive; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import time
import uuid
from collections.abc import Iterator
from typing import IO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nocturne.llm.common import materialize, new_path

END = "\r\n\r\n"
#: Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEX32, RFC32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
FILE_BYTES = 64 << 20


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 SHA-1: the 160 bits as 8 groups of 20, each 5 hex digits and 4 base32 digits."""
    digest = F.sha1(F.encode(payload, "UTF-8"))
    groups = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*groups)), HEX32, RFC32)


def resolve(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, html (null: a revisit), payload_digest, payload_bytes and refers_to (null: a response)."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html")).withColumns(
        {"payload_digest": base32_sha1(F.col("html")), "payload_bytes": F.octet_length("html").cast("long")}
    )
    heads = materialize(rows.drop("html"), "heads")
    long_enough = heads.where(F.col("payload_bytes") >= min_bytes)
    # Written, so that the joins are between two shuffles, of which a hot payload's can be split.
    originals = materialize(long_enough.groupBy("payload_digest").agg(F.min("page_id").alias("original"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "originals")
    again = long_enough.join(originals, "payload_digest").where(~F.col("page_id").eqNullSafe(F.col("original")))
    again = materialize(again.select(*heads.columns, F.col("original").alias("refers_to")), "revisits")
    gone = again.select(F.col("page_id").alias("_page"), F.col("payload_digest").alias("_digest")).distinct()
    first = rows.join(gone, (F.col("payload_digest") == F.col("_digest")) & F.col("page_id").eqNullSafe(F.col("_page")), "left_anti")
    return first.withColumn("refers_to", F.lit(None).cast(heads.schema["page_id"].dataType)).unionByName(again, allowMissingColumns=True)


def records(resolved: DataFrame) -> DataFrame:
    """One WARC record a row, dated now, without the blank lines at its end."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    again = F.col("refers_to").isNotNull()
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(END)
    )
    block = F.when(again, http).otherwise(F.concat(http, F.col("html")))
    rows = resolved.withColumn("_block", block)
    safe = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20]", "%20")
    head = F.concat(
        F.lit(f"{VERSION}\r\n"),
        F.when(again, F.lit("WARC-Type: revisit\r\n")).otherwise(F.lit("WARC-Type: response\r\n")),
        line("WARC-Record-ID", urn(F.col("page_id"))),
        line("WARC-Date", F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        F.when(F.length(safe) > 0, line("WARC-Target-URI", safe)).otherwise(F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(again, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", urn(F.col("refers_to"))))).otherwise(F.lit("")),
        F.lit("Content-Type: application/http;msgtype=response\r\n"),
        line("Content-Length", F.octet_length("_block").cast("string")),
        F.lit("\r\n"),
    )
    return rows.select(F.concat(head, F.col("_block")).alias("value"))


def files(rows: DataFrame, most: int = FILE_BYTES) -> DataFrame:
    """Records put together to files of about ``most`` bytes, each behind a warcinfo record."""
    info = "software: nocturne\r\nformat: WARC File Format 1.1\r\n"
    top = f"{VERSION}\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{{}}>\r\nWARC-Date: {{}}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n{info}"

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []
        size = 0

        def put() -> pa.RecordBatch:
            now = time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())
            whole = END.join([top.format(uuid.uuid4(), now), *held])
            held.clear()
            return pa.record_batch([pa.array([whole], pa.string())], names=["value"])

        for batch in batches:
            for x in batch.column(0):
                record = x.as_py()
                if held and size + 4 * len(record) > most and size + len(record.encode()) > most:
                    yield put()
                    size = 0
                held.append(record)
                size += len(record.encode())
        if held:
            yield put()

    return rows.mapInArrow(kernel, "value string")


def write_archive(pages: DataFrame, path: str, min_bytes: int = 0, most: int = FILE_BYTES, compression: str = "gzip") -> None:
    """Archives of about ``most`` bytes, each file one gzip stream (or plain, with compression="none")."""
    rows = files(records(resolve(pages, min_bytes)), most)
    rows.write.option("lineSep", END).option("maxRecordsPerFile", 1).option("compression", compression).text(path)


def parse(stream: IO[bytes]) -> Iterator[tuple[dict[bytes, bytes], bytes]]:
    """(header fields, block) of each record, one at a time in memory."""
    while line := stream.readline():
        if not line.strip():
            continue
        fields = {}
        while (line := stream.readline()).strip():
            name, _, value = line.partition(b":")
            fields[name] = value.strip()
        yield fields, stream.read(int(fields[b"Content-Length"]))


def read_archive(spark: SparkSession, path: str, payloads: bool = False, page_id: str = "long") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to (and payload) of every record."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = lambda urn: urn[10:-1].decode() if urn and len(urn) > 11 else None

        def put(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows)) or [()] * 6
            kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
            names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
            keep = len(names) if payloads else 5
            return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)][:keep], names=names[:keep])

        for batch in batches:
            for content in batch.column(0):
                rows: list[tuple] = []
                size_held = 0
                stream = io.BytesIO(content.as_buffer())
                packed = stream.read(2) == b"\x1f\x8b"
                stream.seek(0)
                for fields, block in parse(gzip.GzipFile(fileobj=stream) if packed else stream):
                    kind = fields[b"WARC-Type"].decode()
                    if kind == "warcinfo":
                        continue
                    head, _, payload = block.partition(b"\r\n\r\n")
                    if kind == "response":
                        size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    else:
                        size, digest = int(head.rpartition(b"Content-Length: ")[2]), fields[b"WARC-Payload-Digest"].decode()[5:]
                    rows.append((name(fields[b"WARC-Record-ID"]), size, digest, kind, name(fields.get(b"WARC-Refers-To")), payload if payloads else None))
                    size_held += len(payload) if payloads else 0
                    if len(rows) == 10_000 or size_held > 1 << 24:
                        yield put(rows)
                        rows, size_held = [], 0
                yield put(rows)

    schema = "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string"
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    found = found.mapInArrow(kernel, schema + ", payload binary" * payloads)
    return found.withColumns({c: F.col(c).cast(page_id) for c in ("page_id", "refers_to")})


def warc_round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write the archive of ``pages`` to the shared folder and read it back."""
    path = new_path(pages.sparkSession, "warc")
    write_archive(pages, path, min_bytes)
    return read_archive(pages.sparkSession, path, page_id=pages.schema["page_id"].dataType.simpleString())
