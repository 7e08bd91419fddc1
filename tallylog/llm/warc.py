"""WARC archives with revisit records for repeated payloads.

Record headers (id, digest, length) are shuffled by payload digest; of equal payloads the
one with the largest page id stays a response and the others become revisits of it. The
decision goes back to the rows by row number, and the archives are written by Spark's
text sink, one record per row with fresh headers and the WARC record end as separator,
so a lost or repeated task leaves no half-written record. Reading parses each archive
as a stream and joins revisits to the original responses by digest.

Archives are gzip files of at most ``records_per_archive`` records and about 64 MiB of
payload, since an archive is read by one task. They are compressed as a whole, not per record.

Defined cases: a null payload counts as empty; a null page id is written without id and
comes last among equals; of rows that repeat page id and payload one is the response;
control characters of a URL are percent-encoded; a very long payload is one record, in an archive of its
own if need be; extra columns are ignored, whatever their names; an empty table writes no records.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallylog.functions.ids import uuid_from
from tallylog.llm.batches import BATCH_BYTES, bounded_batches
from tallylog.llm.common import ROW, stored, with_rows

LEAST_BYTES = 1000
#: An archive is read by one task: at most so many records, and about so many bytes of payload.
RECORDS_PER_ARCHIVE, ARCHIVE_BYTES = 2000, 64 << 20

#: Fixed values of the WARC 1.1 format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_END = "\r\n\r\n"


def records_of(pages: DataFrame) -> DataFrame:
    """``page_id, url, payload`` of web pages, with the payload's digest and length.

    ``digest`` is the lower-case hex SHA-1. ``payload`` may be null in records whose payload
    is known by its digest only (revisits read from an archive).
    """
    payload = F.coalesce("html", F.lit(""))
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        "url",
        payload.alias("payload"),
        F.sha1(F.encode(payload, "UTF-8")).alias("digest"),
        F.octet_length(payload).cast("long").alias("n_bytes"),
    )


def resolve(headers: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """``row, original_id`` for each header; ``original_id`` is null where the record is a response.

    Headers of equal digests are reduced to the original per task before they are shuffled.
    The join is on a key of its own, so that a digest with very many records is split.
    """
    large = headers.where(F.col("n_bytes") >= least_bytes)
    whole = large.where("has_payload")
    originals = whole.groupBy(F.unhex("digest").alias("d")).agg(
        F.max_by(ROW, F.coalesce("page_id", F.lit(-(1 << 63)))).alias("original_row"),
        F.max("page_id").alias("original_id"),
    )
    originals = originals.select(F.lower(F.hex("d")).alias("digest"), "original_row", "original_id")
    later = F.col(ROW) != F.col("original_row")
    return large.select(ROW, "digest").join(originals, "digest").where(later).select(ROW, "original_id", F.lit(True).alias("revisit"))


def _record_id(page_id: Column, digest: Column, written_at: str) -> Column:
    return F.concat(F.lit("<urn:uuid:"), uuid_from(F.lit(written_at), F.coalesce(page_id.cast("string"), F.lit("")), digest), F.lit(">"))


def record_text(written_at: str) -> Column:
    """The record of a row of page_id, url, payload, digest, n_bytes, revisit and original_id."""
    end = "\r\n"
    url = F.regexp_replace(F.regexp_replace("url", "[\\x00-\\x20\\x7f]", "%20"), "^$", "about:blank")
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{end}Content-Type: text/html; charset=utf-8{end}Content-Length: "),
        F.col("n_bytes").cast("string"),
        F.lit(end + end),
    )
    block = F.octet_length(http) + F.when(F.col("revisit"), 0).otherwise(F.col("n_bytes"))

    def field(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(end)), F.lit(""))

    original = _record_id(F.col("original_id"), F.col("digest"), written_at)
    revisit = F.concat(
        field("WARC-Profile", F.lit(REVISIT_PROFILE)),
        field("WARC-Refers-To", original),
        field("WARC-Refers-To-Date", F.lit(written_at)),
        field("X-Refers-To-Page", F.col("original_id").cast("string")),
    )
    return F.concat(
        F.lit(f"{VERSION}{end}"),
        field("WARC-Type", F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response"))),
        field("WARC-Record-ID", F.when(F.col("revisit"), F.concat(F.lit("<urn:uuid:"), uuid_from(F.lit(written_at), F.col(ROW)), F.lit(">"))).otherwise(_record_id(F.col("page_id"), F.col("digest"), written_at))),
        field("WARC-Date", F.lit(written_at)),
        field("WARC-Target-URI", url),
        field("X-Page-Id", F.col("page_id").cast("string")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        field("X-Payload-Length", F.col("n_bytes").cast("string")),
        F.when(F.col("revisit"), revisit).otherwise(F.lit("")),
        field("Content-Type", F.lit("application/http; msgtype=response")),
        field("Content-Length", block.cast("string")),
        F.lit(end),
        http,
        F.when(F.col("revisit"), F.lit("")).otherwise(F.col("payload")),
    )


def write_archives(records: DataFrame, path: str, least_bytes: int = LEAST_BYTES, records_per_archive: int = RECORDS_PER_ARCHIVE) -> None:
    """Write the records as deduplicated archives in the folder ``path``.

    ``records`` is a projection of a table scan, since its rows are numbered twice.
    """
    written_at = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = with_rows(records)
    headers = stored(rows.select(ROW, "page_id", "digest", "n_bytes", F.col("payload").isNotNull().alias("has_payload")))
    mean = headers.agg(F.avg("n_bytes")).first()[0] or 1.0
    records_per_archive = max(1, min(records_per_archive, int(ARCHIVE_BYTES / max(mean, 1.0))))
    decided = rows.join(resolve(headers, least_bytes), ROW, "left").withColumn(
        "revisit", F.coalesce("revisit", F.col("payload").isNull())
    )
    decided.select(record_text(written_at)).write.option("lineSep", RECORD_END).option("compression", "gzip").option(
        "maxRecordsPerFile", records_per_archive
    ).text(path)


def _parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record."""
    stream = io.BytesIO(content)
    if content[:2] == b"\x1f\x8b":
        stream = gzip.GzipFile(fileobj=stream)
    stream = io.BufferedReader(stream, 1 << 20)
    while line := stream.readline():
        if not line.strip():
            continue
        fields = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.decode("utf-8").partition(":")
            fields[name.lower()] = value.strip()
        yield fields, stream.read(int(fields["content-length"]))


_READ = {
    "page_id": ("long", pa.int64()),
    "url": ("string", pa.string()),
    "record_type": ("string", pa.string()),
    "digest": ("string", pa.string()),
    "n_bytes": ("long", pa.int64()),
    "payload": ("string", pa.string()),
}


def _number(text: str | None) -> int | None:
    return None if text is None else int(text)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """``page_id, url, record_type, digest, n_bytes, payload`` of each response and revisit.

    Digest and length of a response are computed from the payload read; a header that says
    otherwise is an error. A revisit's come from its headers; its payload is null.
    """
    bounded_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = list(_READ)
        for batch in batches:
            for content in batch.column("content"):
                rows, held = [], 0
                for fields, block in _parse(content.as_py()):
                    kind = fields.get("warc-type")
                    if kind not in ("response", "revisit"):
                        continue
                    stated = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    payload, size = None, _number(fields.get("x-payload-length"))
                    if kind == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
                        if stated not in (None, digest):
                            raise ValueError(f"record {fields.get('warc-record-id')}: payload digest is {digest}, not {stated}")
                        stated = digest
                    text = payload.decode("utf-8") if payloads and payload is not None else None
                    rows.append((_number(fields.get("x-page-id")), fields.get("warc-target-uri"), kind, stated, size, text))
                    held += len(block)
                    if held > BATCH_BYTES:
                        yield _batch(rows, names)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows, names)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, ", ".join(f"{n} {k}" for n, (k, _) in _READ.items()))


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, _READ[n][1]) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names
    )


def with_originals(records: DataFrame) -> DataFrame:
    """Records with the page id of the response that a revisit refers to (``refers_to``)."""
    originals = (
        records.where((F.col("record_type") == "response"))
        .groupBy(F.unhex("digest").alias("d"))
        .agg(F.max("page_id").alias("refers_to"))
        .select(F.lower(F.hex("d")).alias("digest"), "refers_to")
    )
    revisits = records.where(F.col("record_type") == "revisit").join(originals, "digest", "left")
    return records.where(F.col("record_type") == "response").withColumn("refers_to", F.lit(None).cast("long")).unionByName(revisits)


def rewrite_archives(spark: SparkSession, source: str, target: str, **options) -> None:
    """Read archives and write them deduplicated, with fresh headers."""
    rows = stored(read_archives(spark, source).drop("record_type"))
    write_archives(rows, target, **options)


#: DuckDB SQL of the query over ``pages``.
SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), q AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS original
  FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> original THEN original END AS refers_to
FROM q
"""
