"""WARC archives without repeated payloads.

``resolve`` shuffles record headers (id, digest, length) only: of the records that share a payload of at least ``least`` bytes the one with the
largest id is the original, found by partial aggregation, and the others are joined to it. ``write_archives`` writes each record
under a fresh header, a revisit without its payload, through Spark's text sink, so to any file system Spark writes to.
``read_archives`` parses the files by Content-Length, and ``rejoin`` gives revisits the size of the original they refer to.

Null payloads are empty. Records shorter than ``least``, or without an id, are always responses. Repeated rows with the largest id are all
responses. A null URI gives a record without a target URI; control characters in a URI are percent-encoded. Extra columns are not read.
"""

from __future__ import annotations

import gzip
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEAST = 1000


def records(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html") -> DataFrame:
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    return pages.select(F.col(id_col).alias("page_id"), F.col(uri_col).cast("string").alias("url"), payload.alias("payload")).withColumns(
        {"digest": F.sha1(F.encode("payload", "UTF-8")), "length": F.octet_length("payload").cast("long")}
    )


def resolve(headers: DataFrame, least: int = LEAST) -> DataFrame:
    """(page_id, digest, refers_to, refers_to_uri) of every header (page_id, url, digest, length) that repeats an earlier kept payload."""
    long = headers.select("page_id", "url", "digest", "length").filter((F.col("length") >= least) & F.col("page_id").isNotNull())
    originals = (
        long.groupBy("digest")
        .agg(F.max(F.struct("page_id", "url")).alias("first"), F.count("*").alias("n"))
        .filter("n > 1").select("digest", F.col("first.page_id").alias("refers_to"), F.col("first.url").alias("refers_to_uri"))
    )
    return long.join(originals, "digest").filter("page_id != refers_to").select("page_id", "digest", "refers_to", "refers_to_uri").distinct()


def record_id(page_id: Column) -> Column:
    h = F.md5(F.concat(F.lit("page:"), page_id.cast("string")))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def uri(column: Column) -> Column:
    for code in (0x0D, 0x0A, 0x09, 0x20):
        column = F.replace(column, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return column


def field(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def write_archives(rows: DataFrame, revisits: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", records_per_file: int = 2000) -> None:
    """Writes ``records`` rows, those in ``revisits`` without their payload, as gzipped WARC/1.1 files of bounded size."""
    joined = rows.join(revisits, ["page_id", "digest"], "left")
    again = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("length"), F.lit("\r\n\r\n"))
    block = F.concat(http, F.when(again, F.lit("")).otherwise(F.col("payload")))
    size = F.octet_length(http) + F.when(again, F.lit(0)).otherwise(F.col("length"))
    header = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(again, F.lit("revisit")).otherwise(F.lit("response")), F.lit("\r\n"),
        field("WARC-Record-ID", F.coalesce(record_id(F.col("page_id")), F.concat(F.lit("<urn:sha1:"), F.col("digest"), F.lit(">")))),
        F.lit(f"WARC-Date: {date}\r\n"), field("WARC-Target-URI", uri(F.col("url"))),
        F.when(again, F.lit(f"WARC-Profile: {PROFILE}\r\n")).otherwise(F.lit("")),
        field("WARC-Refers-To", record_id(F.col("refers_to"))), field("WARC-Refers-To-Target-URI", F.when(again, uri(F.col("refers_to_uri")))),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), field("X-Page-ID", F.col("page_id").cast("string")),
        field("X-Refers-To-Page-ID", F.col("refers_to").cast("string")),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), size, F.lit("\r\n\r\n"),
    )
    # the sink ends each row with a line feed: the last byte of the record
    joined.select(F.concat(header, block, F.lit("\r\n\r")).alias("value")).write.option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


HEADER = re.compile(rb"([^:\r\n]+): ?([^\r\n]*)\r\n")


def parse(content: bytes):
    """Each record of a gzipped archive as (header fields, payload)."""
    raw, at = gzip.decompress(content) if content else b"", 0
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        start = raw.index(b"\r\n", at) + 2
        if not raw.startswith(b"WARC/", at):
            raise ValueError(f"no record begins at byte {at}")
        fields = {k.decode().lower(): v.decode() for k, v in HEADER.findall(raw[start : end + 2])}
        size = int(fields["content-length"])
        block = raw[end + 4 : end + 4 + size]
        yield fields, block[block.index(b"\r\n\r\n") + 4 :]
        at = end + 4 + size + 4


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, record_type, digest, refers_to, payload binary) of all records below ``path``."""

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                rows = [(f.get("x-page-id"), f.get("warc-target-uri"), f["warc-type"], f["warc-payload-digest"].removeprefix("sha1:"), f.get("x-refers-to-page-id"), p) for f, p in parse(content.as_py())]
                for i in range(0, len(rows), 256):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, pa.binary() if k == 5 else pa.string()) for k, c in enumerate(zip(*rows[i : i + 256]))], names=["page_id", "url", "record_type", "digest", "refers_to", "payload"]
                    )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(run, "page_id string, url string, record_type string, digest string, refers_to string, payload binary")


def rejoin(archived: DataFrame) -> DataFrame:
    """Every record with its full payload's size: a revisit takes that of the response it refers to."""
    rows = archived.withColumn("payload_bytes", F.octet_length("payload").cast("long")).drop("payload")
    responses = rows.filter("record_type = 'response'")
    originals = responses.filter("page_id is not null").groupBy(F.col("page_id").alias("refers_to"), "digest").agg(F.max("payload_bytes").alias("original_bytes"))
    revisits = rows.filter("record_type = 'revisit'").drop("payload_bytes").join(originals, ["refers_to", "digest"], "left").withColumnRenamed("original_bytes", "payload_bytes")
    return responses.unionByName(revisits)
