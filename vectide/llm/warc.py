"""WARC archives with revisit records for repeated payloads, and their reader."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_slices

# payloads of at least so many bytes are revisited
LEAST_BYTES = 0
# records carry one stated date, so that a rerun writes the same archives
DATE = "2020-01-01T00:00:00Z"
FILE_RECORDS = 4000
# rows and bytes of payloads returned at once
_READ_ROWS, _READ_BYTES = 1000, 2**22
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "urn:x-page:"
# digits of base 32 in their order: those of conv(), and those fixed by RFC 4648
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Bare base-32 SHA-1 of a binary column: 32 characters of 5 bits of the 160."""
    digest = F.sha1(payload)
    digits = F.concat(
        *[
            F.lpad(F.conv(F.substring(digest, at, 10), 16, 32), 8, "0")
            for at in range(1, 41, 10)
        ]
    )
    return F.translate(digits, _DIGITS, _BASE32)


def resolve_revisits(headers: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """Adds `refers_to`, `refers_url` to `(page_id, url, payload_digest, payload_bytes)`.

    Of records with one digest (of at least `least` bytes), that with the largest id is the
    original and gets nulls; the others point to it. Originals are found by an aggregate
    with one row per digest and task, so a payload that most pages share is no hot group;
    the join back sends a hot digest's headers only, without payloads.
    """
    originals = (
        headers.filter(F.col("payload_bytes") >= least)
        .groupBy("payload_digest")
        .agg(F.max(F.struct("page_id", "url")).alias("_original"), F.count("*").alias("_n"))
        .filter("_n > 1 and _original.page_id is not null")
        .select("payload_digest", "_original")
    )
    other = ~F.col("page_id").eqNullSafe(F.col("_original.page_id")) & F.col(
        "_original"
    ).isNotNull()
    return headers.join(originals, "payload_digest", "left").select(
        *headers.columns,
        F.when(other, F.col("_original.page_id")).alias("refers_to"),
        F.when(other, F.col("_original.url")).alias("refers_url"),
    )


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing if the value is null; line breaks in a value become spaces."""
    clean = F.regexp_replace(value.cast("string"), "[\r\n]", " ")
    return F.coalesce(F.concat(F.lit(f"{name}: "), clean, F.lit("\r\n")), F.lit(""))


def write_warc(
    pages: DataFrame,
    path: str,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    least: int = LEAST_BYTES,
    date: str = DATE,
) -> None:
    """Writes one record per row of `pages` to compressed archives in the folder `path`.

    A record is its header lines, an empty line and its payload; two line breaks end it.
    Payloads are text, so Spark's text writer with that line end writes valid archives to any
    store. Revisits carry headers only. Headers are shuffled and joined without payloads.

    Null html: an empty payload. A null id cannot be referred to; such rows still revisit
    an equal payload that has an id. Rows that repeat an original's id are responses too.
    Null url: no target line. An empty table writes an empty folder.
    """
    payload = F.coalesce(F.col(html).cast("string"), F.lit(""))
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"),
        F.col(url).cast("string").alias("url"),
        payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        base32_sha1(payload.cast("binary")).alias("payload_digest"),
    )
    headers = rows.select("page_id", "url", "payload_bytes", "payload_digest")
    revisits = (
        resolve_revisits(headers, least)
        .filter("refers_to is not null")
        .select(
            F.col("page_id").alias("_page"),
            F.col("payload_digest").alias("_digest"),
            "refers_to",
            "refers_url",
        )
        .distinct()
    )
    joined = rows.join(
        revisits,
        rows["page_id"].eqNullSafe(revisits["_page"])
        & (rows["payload_digest"] == revisits["_digest"]),
        "left",
    )
    revisit = F.col("refers_to").isNotNull()
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    reference = F.concat(F.lit(f"<{_ID}"), F.col("refers_to"), F.lit(">"))
    record = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _line("WARC-Record-ID", F.concat(F.lit(f"<{_ID}"), F.col("page_id"), F.lit(">"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        _line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        _line("WARC-Refers-To", reference),
        _line("WARC-Refers-To-Target-URI", F.col("refers_url")),
        _line("X-Payload-Length", F.col("payload_bytes")),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.octet_length(body)),
        F.lit("\r\n"),
        body,
    )
    (
        joined.select(record.alias("value"))
        .write.option("lineSep", "\r\n\r\n")
        .option("compression", "gzip")
        .option("maxRecordsPerFile", FILE_RECORDS)
        .text(path)
    )


_END = b"\r\n\r\n"
_FIRST = b"WARC/1.1\r\n"


def parse_records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and body of each record of a stream of bytes, whatever chunks it comes in.

    Bodies are taken by their stated length, so they may hold what ends a record; no more than one
    record is held.
    """
    held = bytearray()
    fields: dict[str, str] = {}
    start = end = 0
    for chunk in chunks:
        held += chunk
        while True:
            if not end:
                start = held.find(_END)
                if start < 0:
                    break
                if not held.startswith(_FIRST):
                    raise ValueError(f"No WARC record at {bytes(held[:40])!r}.")
                lines = held[len(_FIRST) : start].decode().split("\r\n")
                fields = dict(line.split(": ", 1) for line in lines)
                start += len(_END)
                end = start + int(fields["Content-Length"])
            if len(held) < end + len(_END):
                break
            yield fields, bytes(held[start:end])
            del held[: end + len(_END)]
            end = 0
    if held:
        raise ValueError("An archive ends inside a record.")


_RECORD = pa.schema(
    [
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("record_type", pa.string()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("refers_to", pa.int64()),
        ("html", pa.string()),
    ]
)


def _page(reference: str | None) -> int | None:
    return None if reference is None else int(reference.strip("<>").removeprefix(_ID))


def _read(payloads: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def row(fields: dict[str, str], body: bytes) -> dict:
        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
        response = fields["WARC-Type"] == "response"
        if response:
            found = base64.b32encode(hashlib.sha1(body).digest()).decode()
            if found != digest:
                raise ValueError(f"The payload of {fields} has digest {found}.")
        return {
            "page_id": _page(fields.get("WARC-Record-ID")),
            "url": fields.get("WARC-Target-URI"),
            "record_type": fields["WARC-Type"],
            "payload_bytes": int(fields["X-Payload-Length"]),
            "payload_digest": digest,
            "refers_to": _page(fields.get("WARC-Refers-To")),
            "html": body.decode() if payloads and response else None,
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = (
            text + _END for batch in batches for _, texts in text_slices(batch, "value") for text in texts
        )
        rows, size = [], 0
        for fields, body in parse_records(chunks):
            rows.append(row(fields, body))
            size += len(body) if payloads else 0
            if len(rows) >= _READ_ROWS or size >= _READ_BYTES:
                yield pa.RecordBatch.from_pylist(rows, _RECORD)
                rows, size = [], 0
        yield pa.RecordBatch.from_pylist(rows, _RECORD)

    return run


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of all archives in `path`; digests of responses are verified.

    `(page_id, url, record_type, payload_bytes, payload_digest, refers_to, html)`; `html` is
    null for revisits (their payload is that of `refers_to`) and without `payloads`. Archives are
    streamed, so their size does not matter; a task holds one record, and a few to return.
    """
    # compressed files are not split: a task streams each from its start
    chunks = (
        spark.read.option("pathGlobFilter", "part-*")
        .text(path, lineSep="\r\n\r\n")
        .select(F.col("value").cast("binary").alias("value"))
    )
    return chunks.mapInArrow(
        _read(payloads),
        "page_id long, url string, record_type string, payload_bytes long, "
        "payload_digest string, refers_to long, html string",
    )
