"""Content-addressed web archive: payload bytes once, record headers apart, records put together by joins.

`write_archive` stores every distinct payload once under its SHA-256 and, for every page, the exact header block of its
WARC record. The record with the smallest page_id of equal payloads is a response, later ones are revisits that name it.
`read_payloads` checks that the stored bytes still have the digest they are filed under; `read_records` joins headers
and payloads to whole records again.

A payload that a third of all pages share is reduced before the shuffle; joins are on the digest and may be split.

Edge cases: null html is an empty payload; a null page_id counts as larger than any other and is written without an
identifier of its own; of rows equal in page_id and payload the first written is the response; an empty table makes an
empty archive; other columns are ignored; payloads smaller than `least` are responses each.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgertide.llm.work import settle, work_folder

#: Fixed values of the WARC 1.1 format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURED = "2000-01-01T00:00:00Z"
BASE32 = ("0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


@dataclass(frozen=True)
class Archive:
    """Folders of an archive: `headers` (a row per record) and `payloads` (a row per distinct payload)."""

    spark: SparkSession
    folder: str

    def headers(self) -> DataFrame:
        return self.spark.read.schema(
            "page_id BIGINT, record_key BIGINT, sha256 BINARY, record_type STRING, refers_to BIGINT, header STRING"
        ).parquet(f"{self.folder}/headers")

    def payloads(self) -> DataFrame:
        return self.spark.read.schema("sha256 BINARY, payload BINARY").parquet(f"{self.folder}/payloads")


def sha1_base32(payload: Column) -> Column:
    """Upper-case base32 of SHA-1: every ten hex digits are eight base32 digits."""
    digits = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digits, k, 10), 16, 32), 8, "0") for k in (1, 11, 21, 31)]
    return F.translate(F.upper(F.concat(*parts)), *BASE32)


def write_archive(pages: DataFrame, captured: str = CAPTURED, least: int = 0) -> Archive:
    """Write all pages (page_id, url, html) as an archive in the shared folder."""
    spark = pages.sparkSession
    archive = Archive(spark, work_folder(spark, "warc"))
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    read = pages.select("page_id", "url", payload.alias("payload"))
    read = read.withColumn("sha256", F.unhex(F.sha2("payload", 256)))
    slim = settle(
        read.select(
            "page_id", "url", "sha256", sha1_base32(F.col("payload")).alias("sha1"),
            F.length("payload").cast("long").alias("size"), F.monotonically_increasing_id().alias("record_key"),
        ),
        "warc-records",
    )
    # one row per distinct payload; equal digests with different bytes would show as low <> high
    stored = read.groupBy("sha256").agg(F.min("payload").alias("payload"), F.max("payload").alias("other"))
    stored = stored.select(
        "sha256",
        F.when(F.col("payload") == F.col("other"), F.col("payload"))
        .otherwise(F.raise_error(F.lit("two payloads have one SHA-256"))).alias("payload"),
    )
    stored.write.parquet(f"{archive.folder}/payloads")

    order = F.struct(F.col("page_id").isNull().alias("unnamed"), "page_id", "record_key")
    first = slim.groupBy("sha256").agg(F.min(order).alias("first"))
    known = slim.join(first, "sha256").withColumn(
        "response", (F.col("size") < least) | (F.col("record_key") == F.col("first.record_key"))
    )
    record_type = F.when(F.col("response"), "response").otherwise("revisit")
    known.select(
        "page_id", "record_key", "sha256", record_type.alias("record_type"),
        F.when(~F.col("response"), F.col("first.page_id")).alias("refers_to"),
        _header(captured).alias("header"),
    ).write.parquet(f"{archive.folder}/headers")
    return archive


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("unnamed")), F.lit(">"))


def _header(captured: str) -> Column:
    """The exact header block of a record, its closing blank line included."""
    response, line = F.col("response"), F.lit("\r\n")
    plain_url = F.translate(F.coalesce("url", F.lit("")), "\r\n", "")
    fields = [
        F.lit(VERSION),
        F.concat(F.lit("WARC-Type: "), F.when(response, "response").otherwise("revisit")),
        F.concat(F.lit("WARC-Record-ID: "), _record_id(F.col("page_id"))),
        F.concat(F.lit("WARC-Target-URI: "), plain_url),
        F.lit(f"WARC-Date: {captured}"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.when(~response, F.concat(F.lit("WARC-Refers-To: "), _record_id(F.col("first.page_id")))),
        F.when(~response, F.lit(f"WARC-Profile: {PROFILE}")),
        F.concat(F.lit("Content-Length: "), F.when(response, F.col("size")).otherwise(F.lit(0)).cast("string")),
    ]
    return F.concat(F.concat_ws("\r\n", *fields), line, line)  # absent fields are left out


def read_payloads(archive: Archive) -> DataFrame:
    """sha256, payload; fails where stored bytes do not have the digest they are filed under."""
    return archive.payloads().select(
        "sha256",
        F.when(F.unhex(F.sha2("payload", 256)) == F.col("sha256"), F.col("payload"))
        .otherwise(F.raise_error(F.lit("stored payload does not match its digest"))).alias("payload"),
    )


def read_records(archive: Archive) -> DataFrame:
    """Whole records: page_id, header, payload (the full one for revisits too), record (the bytes of the WARC record)."""
    joined = archive.headers().join(read_payloads(archive), "sha256")
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    record = F.concat(F.encode("header", "UTF-8"), body, F.lit(b"\r\n\r\n"))
    return joined.select("page_id", "record_type", "refers_to", "header", "payload", record.alias("record"))


def read_summary(archive: Archive) -> DataFrame:
    """Per page what its archived record says: identifiers and type from the header, size and digest from the stored bytes.

    Fails where a header and its payload or its side columns disagree. Digests are worked out once per stored payload,
    so the payloads are not shuffled; `read_records` gives the records themselves.
    """
    stored = read_payloads(archive).select(
        "sha256", F.length("payload").cast("long").alias("payload_bytes"),
        sha1_base32(F.col("payload")).alias("payload_digest"),
    )
    field = lambda name: F.regexp_extract("header", rf"(?m)^{name}: (.*?)\r?$", 1)
    page = lambda name: F.regexp_extract(field(name), "^<urn:page:(-?[0-9]+)>$", 1).try_cast("bigint")
    kind, named, first = field("WARC-Type"), page("WARC-Record-ID"), page("WARC-Refers-To")
    full = (kind == "revisit") | (field("Content-Length") == F.col("payload_bytes").cast("string"))
    agrees = (
        (F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", "") == F.col("payload_digest")) & full
        & named.eqNullSafe(F.col("page_id")) & first.eqNullSafe(F.col("refers_to")) & (kind == F.col("record_type"))
    )
    joined = archive.headers().join(stored, "sha256")
    sound = F.when(agrees, F.col("payload_digest")).otherwise(F.raise_error(F.lit("header and payload disagree")))
    return joined.select(
        named.alias("page_id"), "payload_bytes", sound.alias("payload_digest"), kind.alias("record_type"),
        first.alias("refers_to"),
    )
