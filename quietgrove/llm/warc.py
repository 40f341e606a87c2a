"""WARC archives: writing, reading, and resolving repeated payloads to revisit records.

``write_pages`` stores one ``response`` record per page. ``deduplicate`` reads archives, shuffles
only what a record's headers say by payload digest (and length), picks one response per payload,
and joins that back: records with the same payload become ``revisit`` records that name the
response; revisits that were there before are joined to it as well. New archives get fresh headers
and record ids. Payloads are never shuffled by digest: the resolution has a row per repeated record
and is joined by record id, with a broadcast only while Spark measures it to be small.
``read_archives`` gives the records as a table, ``resolved`` joins revisits to their responses.

Picking the response is an aggregation with map-side combining, and the joins are plain equi-joins
whose hot keys (a payload that a third of all pages share) adaptive execution splits; no group of
copies is gathered.

Archives are text files whose lines end with the two empty lines that end a record, so Spark writes
them in parallel and byte for byte. They are compressed as a whole; the reader also takes archives
compressed record by record, or not at all. Records are found by their Content-Length, so a payload
may hold anything. A file holds about ``ARCHIVE_BYTES`` of payload and is parsed by one task.

Payloads are equal if their SHA-1 digests are. HTTP headers stay with their record, also with a revisit.
Records of other types (requests, metadata) keep their block.

Defined cases: a null payload is an empty one; without a key or URL the header is left out, and the
key reads back as null. Control characters in URLs and text keys are percent-encoded. Null keys come
last when the response is picked; of equal keys any one is the response. Repeated rows are records of
their own. Revisits without a response in the archives stay as they are and refer to nothing. An
empty table gives archives without records and an empty result. A broken archive raises an error.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from typing import BinaryIO, Iterator, Optional

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quietgrove.llm.common import let
from quietgrove.scratch import Scratch

#: Bytes of payload in one file, on average.
ARCHIVE_BYTES = 32 << 20
#: Bytes of records that the reader returns at a time.
BATCH_BYTES = 8 << 20
_END = "\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Fixed value: digits of base 32.
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_RECORD = pa.schema([
    ("archive", pa.string()), ("at", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()),
    ("key", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("refers_to_id", pa.string()),
    ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("content_type", pa.string()),
    ("http", pa.binary()), ("payload", pa.binary())])
_RECORD_DDL = ("archive string, at long, record_type string, record_id string, key string, target_uri string, "
               "date string, refers_to_id string, payload_digest string, payload_bytes long, "
               "content_type string, http binary, payload binary")
_RESPONSE = "application/http;msgtype=response"


# -- writing -----------------------------------------------------------------------------


def base32_sha1(data: Column) -> Column:
    """Upper-case base 32 of a SHA-1 digest: each five hexadecimal digits are four of base 32."""
    def four(digest: Column, i: Column) -> Column:
        number = F.conv(F.substr(digest, i * 5 + 1, F.lit(5)), 16, 10).cast("int")
        return let(number, lambda v: F.concat(*[
            F.substr(F.lit(_BASE32), F.shiftright(v, shift).bitwiseAND(31) + 1, F.lit(1))
            for shift in (15, 10, 5, 0)]))

    return let(F.sha1(data), lambda digest: F.array_join(
        F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: four(digest, i)), ""))


def _one_line(value: Column) -> Column:
    """A header's value cannot hold control characters: they are percent-encoded."""
    signs = F.split(value, "")
    return F.when(~value.rlike(r"[\x00-\x1F\x7F]"), value).otherwise(F.array_join(F.transform(
        signs, lambda c: F.when(c.rlike(r"[\x00-\x1F\x7F]"), F.concat(F.lit("%"), F.lpad(F.hex(F.ascii(c)), 2, "0")))
        .otherwise(c)), ""))


def _header(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value)


def _record(kind: Column, fields: list[tuple[str, Column]], content_type: Column, http: Column,
            payload: Column) -> Column:
    """One record without the two empty lines after it; null headers and parts are left out."""
    block = F.concat(F.coalesce(http, F.lit("")), F.coalesce(payload, F.lit("")))
    head = F.concat_ws(_END, F.lit("WARC/1.1"), _header("WARC-Type", kind),
                       *[_header(name, value) for name, value in fields],
                       _header("Content-Type", content_type),
                       _header("Content-Length", F.octet_length(block).cast("string")))
    return F.concat(head, F.lit(_END + _END), block)


def _http(payload_bytes: Column) -> Column:
    return F.concat(F.lit(f"HTTP/1.1 200 OK{_END}Content-Type: text/html;charset=UTF-8{_END}Content-Length: "),
                    payload_bytes.cast("string"), F.lit(_END + _END))


def _save(records: DataFrame, path: str, mean_bytes: float) -> None:
    rows = max(1, int(ARCHIVE_BYTES / max(mean_bytes, 1.0)))
    records.write.option("lineSep", _END + _END).option("compression", "gzip").option(
        "maxRecordsPerFile", rows).text(path)


def _id(value: Column) -> Column:
    return F.concat(F.lit("<urn:uuid:"), value, F.lit(">"))


def write_pages(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html",
                date: Optional[str] = None) -> None:
    """Archives at ``path`` with a response record per row. ``date`` is the time of capture (now)."""
    text = F.coalesce(F.col(f"`{payload}`").cast("string"), F.lit(""))
    rows = pages.select(_one_line(F.col(f"`{key}`").cast("string")).alias("key"),
                        _one_line(F.col(f"`{url}`").cast("string")).alias("target"), text.alias("payload"),
                        F.octet_length(text).cast("bigint").alias("size"))
    mean = rows.agg(F.avg("size")).first()[0] or 0.0
    now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()),
                        "yyyy-MM-dd'T'HH:mm:ss'Z'")
    fields = [("WARC-Record-ID", _id(F.expr("uuid()"))), ("WARC-Date", F.lit(date) if date else now),
              ("WARC-Target-URI", F.col("target")), ("WARC-Record-Key", F.col("key")),
              ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_sha1(F.col("payload"))))]
    _save(rows.select(_record(F.lit("response"), fields, F.lit(_RESPONSE), _http(F.col("size")),
                              F.col("payload"))), path, mean)


# -- reading -----------------------------------------------------------------------------


def parse(stream: BinaryIO, name: str = "archive") -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Place, headers (names in lower case) and block of each record."""
    at = 0
    while True:
        begin, line = at, stream.readline()
        at += len(line)
        if not line:
            return
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"{name}: no record at byte {begin}")
        headers: dict[str, str] = {}
        last = None
        while True:
            line = stream.readline()
            at += len(line)
            if not line.strip():
                break
            if line[:1] in b" \t" and last:
                headers[last] += " " + line.decode("utf-8", "replace").strip()
                continue
            field, _, value = line.decode("utf-8", "replace").partition(":")
            last = field.strip().lower()
            headers[last] = value.strip()
        size = int(headers.get("content-length", "0"))
        block = stream.read(size)
        if len(block) < size:
            raise ValueError(f"{name}: the record at byte {begin} is cut off")
        at += size
        yield begin, headers, block


def _opened(content: bytes) -> BinaryIO:
    raw = io.BytesIO(content)
    return io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 20) if content[:2] == b"\x1f\x8b" else raw


def _bare(value: Optional[str]) -> Optional[str]:
    """A record id without its brackets and scheme."""
    return value.strip("<>").removeprefix("urn:uuid:") if value else None


def _facts(name: str, at: int, headers: dict[str, str], block: bytes, with_payload: bool) -> tuple:
    kind, http, payload, length = headers.get("warc-type"), None, block, None
    if headers.get("content-type", "").lower().startswith("application/http"):
        http, gap, payload = block.partition(b"\r\n\r\n")
        http += gap
        for line in http.split(b"\r\n")[1:]:
            field, _, value = line.partition(b":")
            if field.strip().lower() == b"content-length" and value.strip().isdigit():
                length = int(value)
    if kind == "revisit":
        digest = headers.get("warc-payload-digest", "").rpartition(":")[2] or None
        payload = None
    else:
        digest, length = base64.b32encode(hashlib.sha1(payload).digest()).decode(), len(payload)
    return (name, at, kind, _bare(headers.get("warc-record-id")), headers.get("warc-record-key"),
            headers.get("warc-target-uri"), headers.get("warc-date"), _bare(headers.get("warc-refers-to")),
            digest, length, headers.get("content-type"), *((http, payload) if with_payload else (None, None)))


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """A row per record below ``path``. Digests and lengths are those of the payloads as read; a
    revisit has those that its headers give and no payload. Without ``with_payload`` nothing but
    these facts leaves the task that parses a file."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content")):
                name, rows, held = name.as_py(), [], 0
                for at, headers, block in parse(_opened(content.as_py()), name):
                    rows.append(_facts(name, at, headers, block, with_payload))
                    held += 200 + (len(block) if with_payload else 0)
                    if held >= BATCH_BYTES:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(records, _RECORD_DDL)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _RECORD)], schema=_RECORD)


# -- revisits ----------------------------------------------------------------------------


def resolution(headers: DataFrame, key_type: str = "bigint", min_bytes: int = 0) -> DataFrame:
    """``record_id, head``: records that repeat a payload of at least ``min_bytes``, and the response
    that holds it (the smallest key)."""
    same, long_enough = "payload_digest", F.coalesce(F.col("payload_bytes") >= min_bytes, F.lit(True))
    known = headers.where(F.col(same).isNotNull() & F.col("record_type").isin("response", "revisit") & long_enough)
    order = F.struct(F.col("key").isNull().alias("late"), F.col("key").cast(key_type).alias("key"),
                     "record_id", "target_uri", "date")
    heads = known.groupBy(same).agg(F.min(F.when(F.col("record_type") == "response", order)).alias("head"),
                                    F.count("*").alias("n"))
    heads = heads.where((F.col("n") > 1) & F.col("head").isNotNull()).select(same, "head")
    return known.select("record_id", same).join(heads, same).where(
        F.col("record_id") != F.col("head.record_id")).select(F.col("record_id").alias("repeated"), "head")


def _fresh(record_id: Column) -> Column:
    """A new id that follows from the old one, so that records can name each other's."""
    return F.regexp_replace(F.md5(F.concat(F.lit("deduplicated:"), record_id)),
                            "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def deduplicate(spark: SparkSession, source: str, target: str, key_type: str = "bigint", min_bytes: int = 0
                ) -> None:
    """Archives at ``target`` with the records of those at ``source``; repeated payloads are revisits."""
    with Scratch(spark) as scratch:
        headers = scratch.save(read_archives(spark, source).drop("http", "payload"))
        found = scratch.save(resolution(headers, key_type, min_bytes))
        kept = headers.agg(F.avg(F.when(F.col("record_type") != "revisit", F.col("payload_bytes")))).first()[0]
        rows = read_archives(spark, source, True).join(found, F.col("record_id") == F.col("repeated"), "left")
        repeats = F.col("head").isNotNull()
        revisit = repeats | (F.col("record_type") == "revisit")
        kind = F.when(revisit, F.lit("revisit")).otherwise(F.col("record_type"))
        has_payload = kind.isin("response", "revisit")
        refers = F.when(repeats, _fresh(F.col("head.record_id")))
        fields = [
            ("WARC-Record-ID", _id(_fresh(F.col("record_id")))), ("WARC-Date", F.col("date")),
            ("WARC-Target-URI", F.col("target_uri")), ("WARC-Record-Key", F.col("key")),
            ("WARC-Payload-Digest", F.when(has_payload, F.concat(F.lit("sha1:"), F.col("payload_digest")))),
            ("WARC-Profile", F.when(revisit, F.lit(_PROFILE))),
            ("WARC-Refers-To", _id(F.coalesce(refers, F.when(revisit, F.col("refers_to_id"))))),
            ("WARC-Refers-To-Target-URI", F.col("head.target_uri")), ("WARC-Refers-To-Date", F.col("head.date"))]
        _save(rows.select(_record(kind, fields, F.col("content_type"), F.col("http").cast("string"), F.when(
            ~revisit, F.col("payload").cast("string")))), target, kept or 0.0)


def resolved(records: DataFrame, key_type: str = "bigint") -> DataFrame:
    """``key, payload_bytes, payload_digest, record_type, refers_to`` of each record of archives;
    ``refers_to`` is the key of the response that a revisit names. ``records`` is read three times,
    so it should be stored."""
    records = records.withColumn("key", F.col("key").cast(key_type))
    responses = records.where(F.col("record_type") == "response").select(
        F.col("record_id").alias("named"), F.col("key").alias("refers_to"),
        F.col("payload_bytes").alias("full_bytes"), F.col("payload_digest").alias("full_digest"))
    columns = ["key", "payload_bytes", "payload_digest", "record_type"]
    alone = records.where("record_type <> 'revisit'").select(
        *columns, F.lit(None).cast(key_type).alias("refers_to"))
    revisits = records.where("record_type = 'revisit'").join(
        responses, F.col("refers_to_id") == F.col("named"), "left").select(
        "key", F.coalesce("full_bytes", "payload_bytes").alias("payload_bytes"),
        F.coalesce("full_digest", "payload_digest").alias("payload_digest"), "record_type", "refers_to")
    return alone.unionByName(revisits)
