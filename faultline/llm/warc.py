"""WARC archives: write transactions, read them back, assemble them through concurrent-to identifiers.

A page becomes three records that name each other by ``WARC-Concurrent-To``: a request, a response (or
a revisit, if an equal payload of at least MIN_REVISIT bytes has a larger page id) and metadata. Records
are text of UTF-8 with a Content-Length in bytes, and Spark's text writer puts the record separator
between them and compresses the file, so its committer and retries write the archives, in whatever
store the folder is in.

Pages are dealt to as many files as their bytes need (FILE_BYTES each, about; a file is one gzip
stream, since Spark's writer compresses files, not records). Reading inflates a file piece by piece and
follows the Content-Length of each record, so a task holds the compressed file and one slice of records;
texts inside a payload that look like records do not matter. Assembly groups the records of a
transaction by the response's identifier and emits one nested row per capture.

Null html is an empty payload; a null url is an empty target. Payloads are equal if their SHA-1 and their
length are. A capture is named by its page id, the start of its payload's digest and a number that tells
repeated rows apart, so every row is a capture of its own. A row with a null page id is never the
response of a revisit, and it revisits nothing.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultline.llm.common import checkpoint_dir

#: Bytes of a payload that may be a revisit, at least; bytes of payloads in an archive file, about; bytes
#: that are inflated, and that are passed on, at once.
MIN_REVISIT, FILE_BYTES, PIECE, SLICE = 1000, 16_000_000, 1 << 18, 4_000_000
#: Fixed values of the format.
CRLF, END = "\r\n", "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD_FIELDS = "type string, id string, concurrent_to string, target string, refers_to string, payload_digest string, payload_bytes bigint, page bigint, body string"


def _id(kind: str, name: Column) -> Column:
    return F.concat(F.lit(f"<urn:page:{kind}:"), name, F.lit(">"))


def _name(page: Column, digest: Column, number: Column) -> Column:
    return F.concat_ws(".", F.coalesce(page.cast("string"), F.lit("null")), F.substring(digest, 1, 16), number.cast("string"))


def _record(kind: str, headers: list[tuple[str, Column]], body: Column) -> Column:
    """A record without the separator that ends it; a header whose value is null is left out."""
    lines = [F.concat(F.lit(f"{name}: "), value) for name, value in headers]
    size = F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string"))
    return F.concat(F.concat_ws(CRLF, F.lit("WARC/1.1"), F.lit(f"WARC-Type: {kind}"), *lines, size), F.lit(END), body)


def records(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """Three rows per page: ``value``, the text of a record."""
    target = F.regexp_replace(F.coalesce(F.col(url_column), F.lit("")), r"[\r\n]+", " ")
    payload = F.coalesce(F.col(html_column), F.lit(""))
    rows = pages.select(F.col(id_column).alias("page"), target.alias("target"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha1(F.col("payload").cast("binary")), "size": F.octet_length("payload").cast("long")})

    # Only ids and digests are grouped; of a digest's pages the last is the response. The pages
    # themselves are shuffled by their id, so that a common payload never meets in one task; those
    # without an id by what they hold.
    at = F.coalesce(F.col("page").cast("string"), F.concat(F.lit("null."), F.hex(F.xxhash64("target", "digest"))))
    rows = rows.withColumn("at", at)
    narrow = rows.select("page", "at", "digest", "size").where((F.col("size") >= MIN_REVISIT) & F.col("page").isNotNull())
    shared = narrow.groupBy("digest", "size").agg(F.max("page").alias("last"), F.count("*").alias("n")).where("n > 1").drop("n")
    revisits = narrow.join(shared, ["digest", "size"]).where("page < last").select("at", "digest", "last").distinct()
    files = max(1, -(-(rows.agg(F.sum("size")).first()[0] or 0) // FILE_BYTES))
    rows = rows.repartition(files, "at", "digest").join(revisits, ["at", "digest"], "left")
    repeats = Window.partitionBy("at", "digest").orderBy("target")
    rows = rows.withColumn("name", _name(F.col("page"), F.col("digest"), F.row_number().over(repeats)))

    response, revisit = _id("response", F.col("name")), F.col("last").isNotNull()
    common = [("WARC-Record-ID", response), ("WARC-Date", F.lit(DATE)), ("WARC-Target-URI", F.col("target")), ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest"))]
    own = [("X-Payload-Length", F.col("size").cast("string")), ("X-Page-ID", F.col("page").cast("string"))]
    kept = _record("response", [*common, *own, ("Content-Type", F.lit("text/html; charset=utf-8"))], F.col("payload"))
    again = _record("revisit", [*common, *own, ("WARC-Profile", F.lit(PROFILE)), ("WARC-Refers-To", _id("response", _name(F.col("last"), F.col("digest"), F.lit(1))))], F.lit(""))
    asked = _record("request", [("WARC-Record-ID", _id("request", F.col("name"))), ("WARC-Date", F.lit(DATE)), ("WARC-Target-URI", F.col("target")), ("WARC-Concurrent-To", response)], F.concat(F.lit("GET "), "target"))
    about = _record("metadata", [("WARC-Record-ID", _id("metadata", F.col("name"))), ("WARC-Date", F.lit(DATE)), ("WARC-Concurrent-To", response), ("Content-Type", F.lit("application/warc-fields"))], F.concat(F.lit("page: "), F.coalesce(F.col("page").cast("string"), F.lit("null"))))
    return rows.select(F.explode(F.array(asked, F.when(revisit, again).otherwise(kept), about)).alias("value"))


def write(pages: DataFrame, folder: str) -> None:
    """The archives of the pages, under ``folder``."""
    records(pages).write.option("lineSep", END).option("compression", "gzip").text(folder)


def _inflated(data: bytes) -> Iterator[bytes]:
    """The pieces of a gzip file of one member or more."""
    member, left = zlib.decompressobj(31), memoryview(data)
    while left or member.unconsumed_tail:
        yield member.decompress(member.unconsumed_tail or left[:PIECE], 4 * PIECE)
        if not member.unconsumed_tail:
            left = left[PIECE:]
        if member.eof:
            rest = member.unused_data
            left = memoryview(rest + bytes(left)) if rest else left
            member = zlib.decompressobj(31)


def _parse(pieces: Iterator[bytes]) -> Iterator[tuple]:
    """The records of a file, from pieces of any size; what is not yet read is held once."""
    held, at = bytearray(), 0

    def more() -> bool:
        nonlocal at
        piece = next(pieces, None)
        if piece is None:
            return False
        if at:
            del held[:at]
            at = 0
        held.extend(piece)
        return True

    while at < len(held) or more():
        if at == len(held):
            continue
        searched = at
        while (cut := held.find(b"\r\n\r\n", searched)) < 0:
            searched = max(len(held) - 3, at) - at
            if not more():
                raise ValueError("an archive ends inside a header")
            searched += at
        head = dict(line.split(": ", 1) for line in held[at:cut].decode().split(CRLF)[1:])
        at = cut + 4
        size = int(head["Content-Length"])
        while len(held) - at < size + 4:
            if not more():
                raise ValueError("an archive ends inside a record")
        body = bytes(held[at : at + size])
        at += size + 4
        if held[at - 4 : at] != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")
        kind, digest = head["WARC-Type"], head.get("WARC-Payload-Digest", "").removeprefix("sha1:") or None
        if kind == "response" and hashlib.sha1(body).hexdigest() != digest:
            raise ValueError(f"payload digest of {head['WARC-Record-ID']} does not match")
        length = int(head["X-Payload-Length"]) if "X-Payload-Length" in head else None
        page = int(head["X-Page-ID"]) if "X-Page-ID" in head else None
        yield kind, head["WARC-Record-ID"], head.get("WARC-Concurrent-To"), head.get("WARC-Target-URI"), head.get("WARC-Refers-To"), digest, length, page, body.decode()


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The records of all archives in a folder; digests of payloads are checked."""
    names = [x.split()[0] for x in RECORD_FIELDS.split(", ")]
    types = [pa.int64() if n in ("payload_bytes", "page") else pa.string() for n in names]

    def batch_of(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*found), types)], names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                found, size = [], 0
                for record in _parse(_inflated(content.as_py())):
                    found.append(record)
                    size += len(record[-1]) + 1000
                    if size > SLICE:
                        yield batch_of(found)
                        found, size = [], 0
                if found:
                    yield batch_of(found)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    return files.where("length > 0").select("content").mapInArrow(work, RECORD_FIELDS)


def assemble(records: DataFrame, bodies: bool = True) -> DataFrame:
    """One row per capture: its identifier, and ``request``, ``response`` and ``metadata`` as structs.
    Without ``bodies`` the payloads stay out of the shuffle."""
    fields = ["type", "id", "target", "refers_to", "payload_digest", "payload_bytes", "page", *["body"] * bodies]
    part = lambda *kinds: F.max(F.when(F.col("type").isin(*kinds), F.struct(*fields)))
    return records.groupBy(F.coalesce("concurrent_to", "id").alias("capture")).agg(part("request").alias("request"), part("response", "revisit").alias("response"), part("metadata").alias("metadata"))


def round_trip(pages: DataFrame, bodies: bool = True) -> DataFrame:
    """Write the pages' archives to the shared folder, read them back and assemble the captures."""
    spark = pages.sparkSession
    folder = f"{checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write(pages, folder)
    return assemble(read(spark, folder), bodies)


def digest(pages: DataFrame) -> DataFrame:
    """The query's rows: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    r = F.col("response")
    return round_trip(pages, bodies=False).select(
        r["page"].alias("page_id"),
        r["payload_bytes"].alias("payload_bytes"),
        r["payload_digest"].alias("payload_digest"),
        r["type"].alias("record_type"),
        F.regexp_extract(r["refers_to"], r":(-?\d+)\.", 1).cast("long").alias("refers_to"),
    )
