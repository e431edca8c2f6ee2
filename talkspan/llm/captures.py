r"""WARC archives: writing pages as transactions, and assembling transactions from archives.

A page becomes three records: its response (or a revisit of an earlier record with the same payload), the request, and a
metadata record; the latter two name the first in WARC-Concurrent-To. Archives are written and read through Spark's text
source, so any file system that Spark reaches will do: the writer ends each record with the two line ends of the format,
the reader cuts files at version lines and puts pieces together again by Content-Length, since a payload may hold such a
line. Archives are gzip files, read from their beginning by one task each, record by record; a task holds one record.

`transactions` joins request, response and metadata records through their concurrent-to identifiers into one nested row
per capture, and `resolved` joins revisits to the record they refer to.

Defined results: a null or empty payload is an empty block; pages with equal payloads keep the smallest page id as
response (a null page id counts as larger than any other; rows that repeat a page id and its payload are each archived,
under one identifier, and are both responses or both revisits); several requests or metadata records of one capture give that
with the smallest record id and their number, the others are in `further`; a record may name several captures and stands
beside each; requests and metadata without a capture are in `orphans`. Bytes behind the end of a record (records of another
version of the format too) and uncompressed archives of more than one split are errors. Other input columns are not
archived.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of the format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_RADIX32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
_END = "\r\n"
_GAP = _END + _END


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1: each five hexadecimal digits are four base32 digits."""
    digits = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digits, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), _RADIX32, BASE32)


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *parts))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _record(kind: str | Column, fields: list[tuple[str, Column | None]], block: Column) -> Column:
    """A record without the line ends that close it. A field whose value is null is left out."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    lines = [F.concat(F.lit("WARC-Type: "), kind)]
    lines += [F.concat(F.lit(f"{name}: "), value.cast("string")) for name, value in fields]
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(F.concat_ws(_END, F.lit(VERSION), *lines), F.lit(_GAP), block)


def records(pages: DataFrame, date: str = "2024-01-01T00:00:00Z", least_bytes: int = 0) -> DataFrame:
    """`record`: the WARC records of all pages, those of a page behind each other.

    Payloads of at least `least_bytes` bytes that were archived under a smaller page id become revisits.
    """
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"),
                        payload.alias("payload"))
    rows = rows.withColumns({"digest": base32_sha1(F.col("payload").cast("binary")), "n": F.octet_length("payload")})
    one_each = rows.groupBy("digest").agg(F.min("page_id").alias("first_id"))
    rows = rows.join(one_each, "digest")
    again = (F.col("n") >= least_bytes) & (F.col("first_id") < F.coalesce("page_id", F.lit((1 << 63) - 1)))
    again = F.coalesce(again, F.lit(False))
    name = lambda kind, page: _uuid(F.lit(kind), F.coalesce(page.cast("string"), F.lit("null")), F.col("digest"))
    own, first = name("capture", F.col("page_id")), name("capture", F.col("first_id"))
    uri = F.regexp_replace("url", r"[\x00-\x20\x7F]", "")
    uri = F.when(uri == "", F.lit("about:blank")).otherwise(uri)
    parts = F.regexp_extract(uri, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^#]*)", 2)
    host = F.regexp_extract(uri, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{_END}Content-Type: text/html; charset=utf-8{_END}Content-Length: "),
        F.col("n").cast("string"), F.lit(_GAP),
    )
    common = [("WARC-Target-URI", uri), ("WARC-Date", F.lit(date))]
    when = lambda value: F.when(again, value)
    answer = _record(
        F.when(again, F.lit("revisit")).otherwise(F.lit("response")),
        [("WARC-Record-ID", own), *common, ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
         ("WARC-Refers-To", when(first)), ("WARC-Profile", when(F.lit(REVISIT_PROFILE))),
         ("Content-Type", F.lit("application/http; msgtype=response"))],
        F.concat(http, F.when(again, F.lit("")).otherwise(F.col("payload"))),
    )
    request = _record(
        "request",
        [("WARC-Record-ID", name("request", F.col("page_id"))), ("WARC-Concurrent-To", own), *common,
         ("Content-Type", F.lit("application/http; msgtype=request"))],
        F.concat(F.lit("GET "), F.when(parts == "", F.lit("/")).otherwise(parts), F.lit(f" HTTP/1.1{_END}Host: "), host,
                 F.lit(_GAP)),
    )
    metadata = _record(
        "metadata",
        [("WARC-Record-ID", name("metadata", F.col("page_id"))), ("WARC-Concurrent-To", own), *common,
         ("Content-Type", F.lit("application/warc-fields"))],
        F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(_END)),
    )
    return rows.select(F.explode(F.array(answer, request, metadata)).alias("record"))


def write(pages: DataFrame, path: str, **options) -> None:
    """Writes the records of `pages` as gzip archives, one per task."""
    records(pages, **options).write.option("lineSep", _GAP).option("compression", "gzip").text(path)


RECORD = T.StructType([
    T.StructField("record_id", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("concurrent_to", T.ArrayType(T.StringType())),
    T.StructField("refers_to", T.StringType()),
    T.StructField("uri", T.StringType()),
    T.StructField("date", T.StringType()),
    T.StructField("digest", T.StringType()),
    T.StructField("head", T.StringType()),
    T.StructField("body", T.BinaryType()),
    T.StructField("body_bytes", T.LongType()),
    T.StructField("body_digest", T.StringType()),
])
_NAMES = {
    "warc-record-id": "record_id", "warc-type": "type",
    "warc-refers-to": "refers_to", "warc-target-uri": "uri", "warc-date": "date", "warc-payload-digest": "digest",
}
_LENGTH = re.compile(rb"^content-length:[ \t]*(\d+)", re.IGNORECASE | re.MULTILINE)


def _fields(head: bytes) -> dict[str, list[str]]:
    out = {}
    for line in head.decode("utf-8", "replace").split(_END):
        name, colon, value = line.partition(":")
        if colon:
            out.setdefault(name.strip().lower(), []).append(value.strip())
    return out


def parse_record(head: bytes, block: bytes, payloads: bool = True) -> dict:
    """One record: its fields, and for HTTP content the head and the body apart (null without `payloads`)."""
    named = _fields(head)
    out = dict.fromkeys((f.name for f in RECORD), None) | {_NAMES[k]: v[0] for k, v in named.items() if k in _NAMES}
    out["concurrent_to"] = named.get("warc-concurrent-to", [])
    if out["digest"]:
        out["digest"] = out["digest"].rpartition(":")[2]
    if named.get("content-type", [""])[0].lower().startswith("application/http"):
        top, gap, body = block.partition(_GAP.encode())
        out["head"], out["body"] = top.decode("utf-8", "replace"), body if payloads else None
    else:
        body = out["body"] = block
    out["body_bytes"] = len(body)
    out["body_digest"] = base64.b32encode(hashlib.sha1(body).digest()).decode()
    return out


def _whole_records(pieces):
    """(head, block) of each record from the pieces between version lines, in file order; None begins a file."""
    version, held = (VERSION + _END).encode(), None
    for piece in pieces:
        if piece is None:
            if held:
                raise ValueError("an archive ends within a record")
            held = None
            continue
        if held is None:
            if not piece:  # what stands before the first version line
                continue
            held, have = [piece], len(piece)
            head, gap, _ = piece.partition(_GAP.encode())
            length = _LENGTH.search(head)
            if not gap or not length:
                raise ValueError("a record without a head or a Content-Length")
            need = len(head) + len(gap) + int(length[1])
        else:
            held.append(piece)
            have += len(version) + len(piece)
        if have >= need:
            raw = version.join(held)
            if raw[need:].strip(b"\r\n"):  # another version's records, or a Content-Length that is too small
                raise ValueError("bytes behind the end of a record")
            yield head, raw[len(head) + len(gap) : need]
            held = None
    if held:
        raise ValueError("an archive ends within a record")


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of all archives below `path`; without `payloads` only the sizes of HTTP bodies are kept."""
    pieces = spark.read.option("lineSep", VERSION + _END).text(path)
    pieces = pieces.select(F.col("value").cast("binary").alias("piece"), F.col("_metadata.file_path").alias("file"),
                           F.col("_metadata.file_block_start").alias("block_start"))

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(RECORD)

        def stream():
            last = None
            for batch in batches:
                for piece, file, block_start in zip(*batch.columns):
                    if block_start.as_py():
                        raise ValueError("archives that are not compressed must fit into one split")
                    name = file.as_py()
                    if name != last:
                        last = name
                        yield None
                    yield piece.as_py()

        rows, size = [], 0
        for head, block in _whole_records(stream()):
            rows.append(parse_record(head, block, payloads))
            size += len(block)
            if size > 1 << 22 or len(rows) >= 2000:
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    from talkspan.llm.arrays import bounded_batches

    bounded_batches(spark)
    return pieces.mapInArrow(run, RECORD)


def _beside(rows: DataFrame, kind: str) -> DataFrame:
    """The smallest record of a kind for each capture, and how many there are."""
    fields = F.struct("record_id", "date", "head", "body").alias(kind)
    own = rows.where(F.col("type") == kind).select(fields, F.explode("concurrent_to").alias("capture"))
    least = F.min_by(kind, F.col(kind)["record_id"]).alias(kind)
    return own.groupBy(F.col("capture").alias("record_id")).agg(least, F.count(F.lit(1)).alias(f"n_{kind}"))


def further(rows: DataFrame) -> DataFrame:
    """The request and metadata records that stand beside a capture as `transactions` has it: `capture_id` and all but the
    smallest record of each kind."""
    own = rows.where(F.col("type").isin("request", "metadata"))
    own = own.select(F.explode("concurrent_to").alias("capture_id"), *[f.name for f in RECORD if f.name != "concurrent_to"])
    least = own.groupBy("capture_id", "type").agg(F.min("record_id").alias("first"))
    return own.join(least, ["capture_id", "type"]).where(F.col("record_id") > F.col("first")).drop("first")


def transactions(rows: DataFrame) -> DataFrame:
    """One nested row per capture: the response or revisit, its request and its metadata, joined by identifier."""
    captures = rows.where(F.col("type").isin("response", "revisit"))
    captures = captures.select(
        "record_id", "uri", F.col("type").alias("capture_type"), "digest", "refers_to",
        F.struct("date", "head", "body", "body_bytes", "body_digest").alias("response"),
    )
    for kind in ("request", "metadata"):
        captures = captures.join(_beside(rows, kind), "record_id", "left")
    return captures.withColumns({f"n_{k}": F.coalesce(f"n_{k}", F.lit(0)) for k in ("request", "metadata")})


def orphans(rows: DataFrame) -> DataFrame:
    """Requests and metadata records whose capture is not there."""
    captures = rows.where(F.col("type").isin("response", "revisit")).select(F.col("record_id").alias("capture_id"))
    own = rows.where(F.col("type").isin("request", "metadata"))
    named = own.select("record_id", F.explode("concurrent_to").alias("capture_id"))
    return own.join(named.join(captures, "capture_id", "left_semi"), "record_id", "left_anti")


def flat(captures: DataFrame) -> DataFrame:
    """`record_id, page_id, payload_bytes, payload_digest, record_type, refers_to` of captures. Size and digest of a
    response are those of the body that was read; a revisit has the size that its HTTP head names and the digest of its
    header."""
    said = F.regexp_extract(F.col("metadata.body").cast("string"), r"(?m)^page-id: *(-?\d+)", 1)
    length = F.regexp_extract("response.head", r"(?im)^content-length: *(\d+)", 1).cast("long")
    return captures.select(
        "record_id", F.when(said != "", said.cast("long")).alias("page_id"),
        F.when(F.col("capture_type") == "response", F.col("response.body_bytes")).otherwise(length).alias("payload_bytes"),
        F.when(F.col("capture_type") == "response", F.col("response.body_digest")).otherwise(F.col("digest"))
        .alias("payload_digest"), F.col("capture_type").alias("record_type"), "refers_to",
    )


def resolved(captures: DataFrame) -> DataFrame:
    """The result of `flat` with the page that holds the payload in `refers_to` instead of its record."""
    first = captures.where(F.col("record_type") == "response")
    first = first.groupBy(F.col("record_id").alias("refers_to")).agg(F.min("page_id").alias("first_page"))
    # a response refers to nothing; it looks for itself, so that responses don't meet under a null key
    out = captures.withColumn("key", F.coalesce("refers_to", "record_id"))
    out = out.join(first.withColumnRenamed("refers_to", "key"), "key", "left")
    page = F.when(F.col("refers_to").isNotNull(), F.col("first_page")).alias("refers_to")
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", page)
