"""Web archives: records of page captures, written, read back and joined.

The project stores no web captures, so this works on any table of page_id, url and
html. A capture is three records: the request, the response (or a revisit of an equal
payload) and metadata; request and metadata name the response in WARC-Concurrent-To.

Archives are written as gzipped text with the record separator as line end, which is
exactly the file format, so Spark's own writer puts them on any file system. They are
read as whole files of bounded size and cut by the records' content lengths.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanledger.session import checkpoint_root

CRLF = "\r\n"
#: Records of one archive file.
FILE_RECORDS = 6000
CAPTURED_AT = "2024-01-01T00:00:00Z"

RECORDS = (
    "record_id string, record_type string, target_uri string, concurrent_to string, refers_to string, "
    "payload_digest string, payload_bytes long, page_id long, payload string"
)


def base32_digest(hexadecimal: Column) -> Column:
    """The 40 hexadecimal digits of a SHA-1 as 32 upper-case base32 characters."""
    chunks = [
        F.lpad(F.conv(F.substring(hexadecimal, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)
    ]
    return F.translate(
        F.concat(*chunks), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    )


def _record(fields: list[tuple[str, Column]], block: Column) -> Column:
    """One record as text, without its closing separator; fields that are null are left out."""
    lines = [F.when(v.isNotNull(), F.concat(F.lit(f"{CRLF}{name}: "), v)) for name, v in fields]
    size = F.concat(F.lit(f"{CRLF}Content-Length: "), F.octet_length(block).cast("string"))
    head = [F.coalesce(x, F.lit("")) for x in [*lines, size]]
    return F.concat(F.lit("WARC/1.1"), *head, F.lit(CRLF * 2), block)


def write_archives(
    pages: DataFrame,
    folder: str,
    page_id: str = "page_id",
    url: str = "url",
    source: str = "html",
    min_revisit_bytes: int = 0,
    captured_at: str = CAPTURED_AT,
) -> None:
    """Write three records for each page into gzipped archives in ``folder``.

    Of pages with equal payloads of at least ``min_revisit_bytes`` bytes, the one
    with the smallest id is the response, the others revisit it. If several rows have
    that id, each is a response and the first with the smallest url is revisited. A null
    html is an empty payload; a page without id is a response unless one with an id has
    its payload. Each row is a capture of its own, a repeated one too: its place in the
    table's files enters its record ids.
    """
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"),
        F.regexp_replace(F.coalesce(F.col(url).cast("string"), F.lit("")), "[\r\n]+", "%0D%0A").alias("url"),
        F.coalesce(F.col(source).cast("string"), F.lit("")).alias("payload"),
        F.monotonically_increasing_id().alias("place"),
    ).withColumn("sha1", F.sha1("payload"))
    size = F.octet_length("payload")
    first = rows.where((size >= min_revisit_bytes) & F.col("page_id").isNotNull()).groupBy("sha1").agg(
        F.min(F.struct("page_id", "url", "place")).alias("first")
    )
    first = first.select("sha1", *[F.col(f"first.{k}").alias(v) for k, v in (("page_id", "first_id"), ("url", "first_url"), ("place", "first_place"))])
    rows = rows.join(first, "sha1", "left")

    def record_id(kind: str, item: str, address: Column, place: str = "place") -> Column:
        digest = F.md5(F.concat_ws("|", F.lit(kind), F.coalesce(F.col(item).cast("string"), F.lit("-")), address, "sha1", F.col(place).cast("string")))
        parts = [F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
        return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))

    own = record_id("response", "page_id", F.col("url"))
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    digest = F.concat(F.lit("sha1:"), base32_digest(F.col("sha1")))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        size.cast("string"), F.lit(CRLF * 2),
    )
    date, uri = ("WARC-Date", F.lit(captured_at)), ("WARC-Target-URI", F.col("url"))

    def fields(kind: Column, name: Column, content_type: str, *more) -> list[tuple[str, Column]]:
        typed = ("Content-Type", F.lit(content_type))
        return [("WARC-Type", kind), ("WARC-Record-ID", name), date, uri, *more, typed]

    response = _record(
        fields(
            F.when(revisit, "revisit").otherwise("response"), own, "application/http; msgtype=response",
            ("WARC-Payload-Digest", digest),
            ("WARC-Refers-To", F.when(revisit, record_id("response", "first_id", F.col("first_url"), "first_place"))),
            ("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        ),
        F.concat(http, F.when(revisit, "").otherwise(F.col("payload"))),
    )
    with_response = ("WARC-Concurrent-To", own)
    request = _record(
        fields(F.lit("request"), record_id("request", "page_id", F.col("url")), "application/http; msgtype=request", with_response),
        F.concat(F.lit("GET "), F.col("url"), F.lit(f" HTTP/1.1{CRLF * 2}")),
    )
    metadata = _record(
        fields(F.lit("metadata"), record_id("metadata", "page_id", F.col("url")), "application/warc-fields", with_response),
        F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(CRLF)),
    )
    records = rows.select(F.explode(F.array(request, response, metadata)).alias("record"))
    records.write.option("lineSep", CRLF * 2).option("maxRecordsPerFile", FILE_RECORDS).option(
        "compression", "gzip"
    ).text(folder)


def records_of(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record."""
    at = 0
    while (end := archive.find(b"\r\n\r\n", at)) >= 0:
        lines = archive[at:end].decode("utf-8", "replace").split(CRLF)
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        start = end + 4
        stop = start + int(fields.get("content-length", 0))
        yield fields, archive[start:stop]
        at = stop + 4


def _row(fields: dict[str, str], block: bytes, with_payload: bool) -> tuple:
    kind, digest, size, page, payload = fields.get("warc-type"), None, None, None, None
    if kind in ("response", "revisit"):
        head, _, body = block.partition(b"\r\n\r\n")
        if kind == "response":
            digest, size = base64.b32encode(hashlib.sha1(body).digest()).decode(), len(body)
            payload = body.decode("utf-8", "replace") if with_payload else None
        else:
            digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
            for line in head.decode("utf-8", "replace").split(CRLF):
                name, _, value = line.partition(":")
                if name.lower() == "content-length":
                    size = int(value)
    elif kind == "metadata":
        for line in block.decode("utf-8", "replace").split(CRLF):
            name, _, value = line.partition(":")
            if name == "page-id" and value.strip():
                page = int(value)
    names = ("warc-target-uri", "warc-concurrent-to", "warc-refers-to")
    return fields.get("warc-record-id"), kind, *(fields.get(x) for x in names), digest, size, page, payload


def _read(frames: Iterator[pd.DataFrame], with_payload: bool) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in RECORDS.split(", ")]
    for frame in frames:
        for content in frame["content"]:
            data = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else bytes(content)
            rows = [_row(*x, with_payload) for x in records_of(data)]
            out = pd.DataFrame(rows, columns=names)
            for name in ("payload_bytes", "page_id"):
                out[name] = out[name].astype("Int64")
            yield out


def read_records(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """One row for each record of the archives in ``folder``.

    The digest and size of a response are those of the payload read, a revisit's those
    that its headers give for the full payload.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("content")
    return files.mapInPandas(lambda frames: _read(frames, with_payload), RECORDS)


def captures(records: DataFrame) -> DataFrame:
    """One nested row for each capture: request, response, metadata and its refers_to page.

    Records that name the same response in concurrent_to belong to its capture. A
    request or metadata record whose response is missing gives a capture with a null
    response; a missing request or metadata record is null.
    """
    answers = F.col("record_type").isin("response", "revisit")
    key = F.when(answers, F.col("record_id")).otherwise(F.coalesce("concurrent_to", "record_id"))
    whole = F.struct(*[c for c in records.columns if c != "payload"], F.col("payload").alias("payload"))

    def one(*kinds: str) -> Column:
        return F.max(F.when(F.col("record_type").isin(*kinds), whole)).alias(kinds[0])

    joined = (
        records.withColumn("capture_id", key).where(F.col("record_type").isin("request", "response", "revisit", "metadata"))
        .groupBy("capture_id").agg(one("request"), one("response", "revisit"), one("metadata"))
    )
    named = joined.select(
        F.col("capture_id").alias("named"), F.col("metadata.page_id").alias("refers_to_page")
    ).where("named IS NOT NULL")
    # Captures that revisit nothing look up themselves, so they do not meet in one task.
    refers = F.col("response.refers_to")
    joined = joined.withColumn("looked_up", F.coalesce(refers, "capture_id"))
    found = joined.join(named, joined["looked_up"] == named["named"], "left")
    return found.select(
        "capture_id", "request", "response", "metadata", F.when(refers.isNotNull(), F.col("refers_to_page")).alias("refers_to_page")
    )


def archive_pages(pages: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Write ``pages`` to archives, read these and return their captures.

    Without ``folder`` a new one in the shared checkpoint folder is used.
    """
    spark = pages.sparkSession
    folder = folder or f"{checkpoint_root(spark)}/archives-{uuid.uuid4().hex}"
    write_archives(pages, folder, **options)
    return captures(read_records(spark, folder))
