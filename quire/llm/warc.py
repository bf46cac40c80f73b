"""Content-addressed web archive (operator 9).

Every payload is stored once under its SHA-256, deflated, so that little moves
and little is kept; exact record headers live in a table of their own; a record
is header + payload again after one join.

Defined cases: null html is the empty payload; null page_id sorts below all
others and is written as ``null``; rows that repeat both page_id and payload
are equal records and get the same type; url may be null (no target header);
payloads may have any length; other columns don't matter (see common.pick). An
empty table gives an empty archive.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import pick, stored, table

DATE = "1970-01-01T00:00:00Z"  # pages carry no fetch time


def base32_of_hex(hex40: Column) -> Column:
    """RFC 4648 base-32 of 40 hex digits: 10 digits are 40 bits are 8 symbols."""
    chunks = [F.lpad(F.conv(F.substring(hex40, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(
        F.upper(F.concat(*chunks)),
        "0123456789ABCDEFGHIJKLMNOPQRSTUV",
        "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    )


@dataclass
class Archive:
    records: DataFrame  # page_id, header (bytes), strong (SHA-256 hex of the payload)
    payloads: DataFrame  # strong, packed (deflated payload): one row a payload


def _line(name: str, value: Column) -> Column:
    """A header line; null value gives no line. CR and LF can't occur in a value."""
    safe = F.regexp_replace(F.regexp_replace(value, "\r", "%0D"), "\n", "%0A")
    return F.coalesce(F.concat(F.lit(name + ": "), safe, F.lit("\r\n")), F.lit(""))


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(">"))


def _slices(batches, rows: int = 500):
    """Batches of few rows: payloads unpack to several times their size."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def _pack(batches):
    """(strong, payload) → (strong, packed)."""
    for b in _slices(batches):
        packed = [zlib.compress(x, 1) for x in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(packed, pa.binary())], names=["strong", "packed"])


def _unpack(batches):
    """The last column, packed, as payload; null stays null."""
    for b in _slices(batches):
        out = [None if x is None else zlib.decompress(x) for x in b.column(b.num_columns - 1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, pa.binary())], names=[*b.schema.names[:-1], "payload"])


def write_archive(pages: DataFrame, min_bytes: int = 0) -> Archive:
    """Records and payloads of pages(page_id, url, html), written to the shared folder.

    Of equal payloads of min_bytes or more, the largest page_id is the
    response and the others revisit it; smaller payloads are all responses.
    """
    raw = pick(pages, "page_id", "url", "html").withColumn("payload", F.encode(F.coalesce("html", F.lit("")), "UTF-8"))
    raw = raw.withColumn("strong", F.sha2("payload", 256))
    meta = raw.select("page_id", "url", "strong", F.sha1("payload").alias("weak"), F.octet_length("payload").cast("long").alias("n"))
    keepers = meta.where(F.col("n") >= min_bytes).groupBy("strong").agg(F.max("page_id").alias("keeper"))
    # One row a payload on the right; the rows of one payload shared by very many pages are narrow.
    rows = meta.join(keepers.hint("shuffle_hash"), "strong", "left")
    response = (F.col("n") < min_bytes) | F.col("page_id").eqNullSafe(F.col("keeper"))
    digest = F.concat(F.lit("sha1:"), base32_of_hex(F.col("weak")))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        F.when(response, F.lit("WARC-Type: response\r\n")).otherwise(F.lit("WARC-Type: revisit\r\n")),
        _line("WARC-Record-ID", _urn(F.col("page_id"))),
        _line("WARC-Target-URI", F.col("url")),
        F.lit(f"WARC-Date: {DATE}\r\n"),
        _line("WARC-Payload-Digest", digest),
        F.when(response, F.lit("")).otherwise(_line("WARC-Refers-To", _urn(F.col("keeper")))),
        F.when(response, F.lit("")).otherwise(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n")),
        _line("Content-Length", F.col("n").cast("string")),
        F.lit("\r\n"),
    )
    records = stored(rows.select("page_id", F.encode(header, "UTF-8").alias("header"), "strong"), "warc-records")
    # dropDuplicates keeps one copy per map task before the exchange, so a hot payload moves a few times only.
    packed = raw.select("strong", "payload").mapInArrow(_pack, "strong string, packed binary")
    payloads = stored(packed.dropDuplicates(["strong"]), "warc-payloads")
    return Archive(records, payloads)


def read_archive(archive: Archive) -> DataFrame:
    """Original record bytes (page_id, record), each payload checked against its strong digest."""
    # The payloads, one row each, are the build side, a shuffle partition of them at a time; AQE splits the
    # records of a payload that very many share. Left: a record whose payload is lost must not vanish in silence.
    joined = archive.records.join(archive.payloads.hint("shuffle_hash"), "strong", "left").select("page_id", "header", "strong", "packed")
    kind = archive.records.schema["page_id"].dataType.simpleString()
    whole = joined.mapInArrow(_unpack, f"page_id {kind}, header binary, strong string, payload binary")
    record = (
        F.when(F.col("payload").isNull(), F.raise_error(F.lit("payload is missing")).cast("binary"))
        .when(F.sha2("payload", 256) == F.col("strong"), F.concat(F.col("header"), F.col("payload"), F.lit(b"\r\n\r\n")))
        .otherwise(F.raise_error(F.lit("payload does not match its digest")).cast("binary"))
    )
    return whole.select("page_id", record.alias("record"))


def parse_records(records: DataFrame) -> DataFrame:
    """WARC fields of whole record bytes, with the payload cut out by Content-Length."""
    # The header ends at the first empty line; it is short, the payload is not.
    text = records.withColumn("_head", F.split_part(F.decode("record", "ISO-8859-1"), F.lit("\r\n\r\n"), F.lit(1)))
    field = lambda name: F.nullif(F.regexp_extract("_head", rf"(?m)^{name}: ([^\r\n]*)", 1), F.lit(""))
    parsed = text.select("page_id", "record", "_head", field("WARC-Type").alias("record_type"), field("WARC-Payload-Digest").alias("digest"), field("WARC-Refers-To").alias("refers"), field("Content-Length").cast("int").alias("n"))
    return parsed.withColumn("payload", F.substring(F.col("record"), F.length("_head") + 5, F.col("n")))


def archive_report(archive: Archive) -> DataFrame:
    """One row a page, from the bytes read back."""
    back = parse_records(read_archive(archive))
    weak = base32_of_hex(F.sha1("payload"))
    refers = F.regexp_extract("refers", r"^<urn:page:(-?\d+)>$", 1)
    return back.select(
        "page_id",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.when(F.concat(F.lit("sha1:"), weak) == F.col("digest"), weak).otherwise(F.raise_error(F.lit("record does not match its digest"))).alias("payload_digest"),
        "record_type",
        F.when(F.col("record_type") == "revisit", refers.try_cast("long")).alias("refers_to"),
    )


def op9_warc(spark, sf_dir):
    return archive_report(write_archive(table(spark, sf_dir, "pages"), min_bytes=0))


# Five hex digits are 20 bits are four base-32 symbols.
OP9_SQL = """
with p as (select page_id, encode(coalesce(html, '')) as payload from pages),
h as (select page_id, octet_length(payload) as n, sha1(payload) as hx from p),
b as (select page_id, n, hx, list_transform(range(0, 8), lambda i: cast('0x' || substr(hx, cast(5 * i + 1 as int), 5) as int)) as v from h),
d as (select page_id, n, array_to_string(list_transform(v, lambda x:
  substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x >> 15) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> 10) & 31) + 1, 1) ||
  substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> 5) & 31) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x & 31) + 1, 1)), '') as digest from b),
k as (select *, max(page_id) over (partition by digest) as keeper from d)
select page_id, cast(n as bigint) as payload_bytes, digest as payload_digest,
  case when page_id is not distinct from keeper then 'response' else 'revisit' end as record_type,
  case when page_id is not distinct from keeper then null else keeper end as refers_to
from k
"""
