"""WARC archives: writing with revisits and segments, reading with segment reassembly.

`write_archives` turns rows of pages into WARC/1.1 records: a `response` record for one row of each group of equal
payloads, a `revisit` record for the others, and `continuation` records where a block is longer than the segment
size. The records are written by Spark's text sink as gzip files (a record's closing CRLF CRLF ends in the sink's
line feed, so the files hold WARC records and nothing else), which works on every file system that Spark can write.
`read_archives` parses whole files, groups the segments by the identifier of the origin record, orders them by
segment number, verifies numbers and total length, and decodes chunked transfer framing.

Defined cases: null payload is empty; null page_id is written as `null` and read back as null; every row has a record
of its own, and of rows that repeat page_id and payload one has the plain identifier, the others one with a copy's
number behind it; a null page_id with a payload that no other page has is a response; an empty table gives archives without records; a record whose segments are
incomplete or whose length or digest disagrees is returned with ``verified`` false and what could be read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.shared import base32_sha1, materialise, new_folder, table

SEGMENT_BYTES = 16 << 10
CHUNK_BYTES = 4 << 10
ID = "<urn:page:%s:%s>"

RECORD = T.StructType([
    T.StructField("record_id", T.StringType()), T.StructField("record_type", T.StringType()),
    T.StructField("target_uri", T.StringType()), T.StructField("refers_to_id", T.StringType()),
    T.StructField("header_digest", T.StringType()), T.StructField("origin_id", T.StringType()),
    T.StructField("segment", T.IntegerType()), T.StructField("total_length", T.LongType()),
    T.StructField("block", T.BinaryType()), T.StructField("cut", T.BooleanType()),
])
PAYLOAD = T.StructType([T.StructField("payload", T.BinaryType()), T.StructField("digest", T.StringType())])


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Payload in chunked transfer framing."""
    parts = [payload[k : k + size] for k in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unchunk(body: bytes) -> bytes:
    """The payload of a body in chunked framing; extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0].strip() or b"0", 16)
        if size == 0:
            return b"".join(out)
        if end + 2 + size > len(body):
            raise ValueError("a chunk is cut off")
        out.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size


def http_payload(block: bytes) -> bytes:
    """The payload of an HTTP response block."""
    head, _, body = block.partition(b"\r\n\r\n")
    return unchunk(body) if re.search(rb"(?im)^transfer-encoding:.*chunked", head) else body


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r"  # the sink adds the last line feed


def page_records(page_id, url, digest, keep_id, payload: bytes | None, segment_bytes: int, copy: int | None = None) -> list[bytes]:
    """The records of one page, without their last byte."""
    me = ID % ("null" if page_id is None else page_id, digest if copy is None else f"{digest}:copy-{copy}")
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    common = [("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if payload is None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
        origin = ID % (keep_id, digest)
        return [_record([("WARC-Type", "revisit"), ("WARC-Record-ID", me), ("WARC-Refers-To", origin), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), *common, ("Content-Type", "application/http;msgtype=response")], block)]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    first = [("WARC-Type", "response"), ("WARC-Record-ID", me), *common, ("Content-Type", "application/http;msgtype=response")]
    if len(block) <= segment_bytes:
        return [_record(first, block)]
    parts = [block[k : k + segment_bytes] for k in range(0, len(block), segment_bytes)]
    out = [_record([*first, ("WARC-Segment-Number", 1)], parts[0])]
    for n, part in enumerate(parts[1:], 2):
        fields = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"{me[:-1]}:{n}>"), ("WARC-Segment-Origin-ID", me), ("WARC-Segment-Number", n), *common[:2]]
        out.append(_record(fields + [("WARC-Segment-Total-Length", len(block))] * (n == len(parts)), part))
    return out


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES) -> None:
    """Write a record per page to path; of equal payloads of least_bytes or more the largest id is the response."""
    page = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    page = page.withColumns({"n": F.octet_length("payload"), "own": F.sha2("payload", 256)})
    group = ["own", "n"]
    keep = page.groupBy(*group).agg(F.max("page_id").alias("keep_id"))
    joined = page.join(keep, group)
    first = F.col("page_id").eqNullSafe(F.col("keep_id")) | (F.col("n") < least_bytes)
    rows = joined.select("page_id", "url", base32_sha1(F.col("payload")).alias("digest"), "keep_id", F.when(first, F.col("payload")).alias("payload"))
    repeated = materialise(page.groupBy("page_id").count().where("count > 1").select(F.col("page_id").alias("_again")), "repeated")
    if repeated.isEmpty():
        rows = rows.withColumn("copy", F.lit(None).cast("long"))
    else:
        same = F.col("page_id").eqNullSafe(F.col("_again"))
        again = materialise(rows.join(repeated, same, "left_semi").withColumn("copy", F.monotonically_increasing_id()), "copies")
        plain = again.groupBy("page_id", "digest").agg(F.min("copy").alias("copy")).select("copy", F.lit(True).alias("_plain"))
        again = again.join(plain, "copy", "left").withColumn("copy", F.when(F.col("_plain").isNull(), F.col("copy")))
        rows = rows.join(repeated, same, "left_anti").withColumn("copy", F.lit(None).cast("long")).unionByName(again.drop("_plain"))

    def records(batches):
        for batch in batches:
            for cols in zip(*(batch.column(k) for k in range(6)), strict=True):
                *plain, copy = (x.as_py() for x in cols)
                found = page_records(*plain, segment_bytes, copy)
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["value"])

    rows.mapInArrow(records, "value binary").select(F.col("value").cast("string").alias("value")).write.text(path, compression="gzip", lineSep="\n")


def parse_archive(data: bytes):
    """The records of one archive, compressed in any number of gzip members or not at all. A record that the archive's end
    cuts off, in its header or in its block, is marked as cut."""
    if data[:2] == b"\x1f\x8b":
        out = []
        while data[:2] == b"\x1f\x8b":
            member = zlib.decompressobj(31)
            try:
                out.append(member.decompress(data))
            except zlib.error:  # what came before the damage counts
                break
            data = member.unused_data
        data = b"".join(out)
    view, at = memoryview(data), 0
    while (at := data.find(b"WARC/1.", at)) >= 0:
        end, cut = data.find(b"\r\n\r\n", at), False
        if end < 0:
            end, cut = len(data), True
        fields = {}
        for line in data[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
            k, _, v = line.partition(":")
            fields[k.strip().lower()] = v.strip()
        number = lambda k: int(fields[k]) if fields.get(k, "").isdecimal() else None
        size = number("content-length")
        cut |= size is None or end + 4 + size > len(data)
        size = size or 0
        block = bytes(view[end + 4 : end + 4 + size])
        at = end + 4 + size
        segment = number("warc-segment-number")
        yield (
            fields.get("warc-record-id"), fields.get("warc-type"), fields.get("warc-target-uri"), fields.get("warc-refers-to"),
            (fields.get("warc-payload-digest") or "").rpartition(":")[2] or None,
            fields.get("warc-segment-origin-id", fields.get("warc-record-id")) if segment else None,
            segment, number("warc-segment-total-length"), block, cut,
        )


def archive_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives under path, segments apart."""

    def parse(batches):
        names = RECORD.fieldNames()
        kinds = [pa.string()] * 6 + [pa.int32(), pa.int64(), pa.binary(), pa.bool_()]
        for batch in batches:
            for data in batch.column(0):
                rows, held = [], 0
                for record in parse_archive(data.as_py()):
                    rows.append(record)
                    held += len(record[-2]) + 500
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, RECORD)


@F.arrow_udf(PAYLOAD)
def decode(block: pa.Array) -> pa.Array:
    """The payload of each HTTP block and its digest; both null where the framing is broken."""
    payloads, digests = [], []
    for b in block:
        try:
            found = http_payload(b.as_py())
        except (ValueError, TypeError, AttributeError):
            found = None
        payloads.append(found)
        digests.append(None if found is None else digest_of(found))
    return pa.StructArray.from_arrays([pa.array(payloads, pa.binary()), pa.array(digests, pa.string())], ["payload", "digest"])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per logical record: record_id, record_type, target_uri, refers_to_id, header_digest, digest, payload, verified."""
    records = archive_records(spark, path)
    keep = ["record_id", "record_type", "target_uri", "refers_to_id", "header_digest"]
    whole = records.where("origin_id IS NULL").select(*keep, "block", (~F.col("cut")).alias("complete"))
    parts = records.where("origin_id IS NOT NULL").groupBy("origin_id").agg(
        *[F.min_by(c, "segment").alias(c) for c in keep[1:]],
        F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("parts"),
        F.max("total_length").alias("total"), F.max("cut").alias("cut"),
    )
    block = F.reduce("parts", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["block"]))
    numbered = F.col("parts.segment") == F.sequence(F.lit(1), F.size("parts"))
    parts = parts.withColumn("block", block).select(F.col("origin_id").alias("record_id"), *keep[1:], "block", F.coalesce(numbered & (F.octet_length("block") == F.col("total")) & ~F.col("cut"), F.lit(False)).alias("complete"))
    out = whole.unionByName(parts).withColumn("d", decode("block"))
    response = F.col("record_type") == "response"
    return out.select(
        *keep, F.when(response, F.col("d.payload")).alias("payload"), F.when(response, F.col("d.digest")).alias("digest"),
        (F.col("complete") & (~response | F.coalesce(F.col("d.digest") == F.col("header_digest"), F.lit(False)))).alias("verified"),
    )


def page_of(record_id) -> F.Column:
    """The page that a record identifier names."""
    return F.try_to_number(F.nullif(F.regexp_extract(record_id, r"^<urn:page:(-?\d+|null):", 1), F.lit("")), F.lit("S9999999999999999999")).cast("long")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "archives")
    write_archives(table(spark, sf_dir, "pages"), path)
    records = read_archives(spark, path).select("record_id", "record_type", "refers_to_id", "header_digest", "digest", F.octet_length("payload").cast("long").alias("bytes"), "verified")
    # these archives were written here: a record that fails its checks is an error, not a row
    checked = F.when(F.col("verified"), F.col("record_id")).otherwise(F.raise_error(F.concat(F.lit("not verified: "), F.coalesce("record_id", F.lit("a record without id")))))
    records = materialise(records.withColumn("record_id", checked).drop("verified"), "records")
    sizes = records.where("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("bytes").alias("there"))
    revisit = F.col("record_type") == "revisit"
    return records.join(sizes, "refers_to_id", "left").select(
        page_of(F.col("record_id")).alias("page_id"),
        F.when(revisit, F.col("there")).otherwise(F.col("bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("header_digest")).otherwise(F.col("digest")).alias("payload_digest"),
        "record_type",
        F.when(revisit, page_of(F.col("refers_to_id"))).alias("refers_to"),
    )


_FIVE = "CAST('0x' || substr(h, {at}, 5) AS BIGINT)"
_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((({_FIVE.format(at=5 * k + 1)} >> {s}) & 31) + 1 AS BIGINT), 1)" for k in range(8) for s in (15, 10, 5, 0))

ORACLE = {
    "op1_warc": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS x, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY x) AS keep_id FROM p)
SELECT page_id, strlen(x) AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id = keep_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> keep_id THEN keep_id END AS refers_to
FROM g
""",
}
