"""WARC archives: segmented, chunk-framed records written as files and put together again.

A record longer than a segment is cut into continuation records; the reader groups them
by the origin's identifier, orders them by segment number, checks the total length and
takes the chunked transfer framing off.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerline.session import materialized

CRLF = "\r\n"
#: Fixed values of the format.
VERSION = "WARC/1.1"
IDENTICAL_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32_DIGITS = ("0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
#: Bytes of a segment and of a transfer chunk; records of a file. A record is one segment at most, so a file has about 32 MB at most.
SEGMENT_BYTES, CHUNK_BYTES, FILE_RECORDS = 64 << 10, 16 << 10, 512

RECORD = "record_id string, record_type string, uri string, payload_digest string, refers_to string, origin_id string, segment int, total_length long, block binary"
WHOLE = "record_id string, record_type string, uri string, payload_digest string, refers_to string, payload binary, payload_bytes long, problem string"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: 40 bits at a time, as 8 digits of base 32."""
    digits = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digits, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), *BASE32_DIGITS)


def to_records(pages: DataFrame, least_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """One row per WARC record (column `record`, binary) for pages (page_id, url, html).

    Pages with equal payloads of at least `least_bytes` bytes revisit the one with the
    smallest page_id. Null html is an empty payload; rows may repeat, as every row gets
    an identifier of its own from its page_id and its place in the input.
    """
    rows = pages.select("page_id", F.col("url"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", base32_sha1(F.col("payload"))).withColumn(
        "record_id", F.format_string("urn:page:%s:%d", F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.monotonically_increasing_id()))
    # Only payloads that occur again: the smaller this is, the less the payloads have to move for it.
    firsts = rows.filter(F.length("payload") >= least_bytes).groupBy("digest").agg(
        F.min(F.struct(F.col("page_id").isNull(), "page_id", "record_id")).alias("first"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    # Written, so that its size is known before the payloads would be shuffled to meet it.
    firsts = materialized(firsts.select(F.col("digest").alias("_digest"), F.col("first.record_id").alias("first_id")), "firsts")
    told = rows.join(firsts, F.col("digest") == F.col("_digest"), "left")
    revisit = F.coalesce((F.length("payload") >= least_bytes) & (F.col("first_id") != F.col("record_id")), F.lit(False))
    size = F.length("payload")
    # Pieces are joined as strings, which keeps their bytes and takes time in proportion.
    chunks = F.expr(f"""CASE WHEN length(payload) = 0 THEN cast('' AS binary) ELSE cast(array_join(transform(sequence(0, cast((length(payload) - 1) div {chunk_bytes} AS int)),
        i -> concat(lower(hex(least({chunk_bytes}, length(payload) - i * {chunk_bytes}))), '\r\n', cast(substring(payload, i * {chunk_bytes} + 1, {chunk_bytes}) AS string), '\r\n')), '') AS binary) END""")
    head = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}"
    block = F.when(F.col("revisit"), F.lit((head + CRLF).encode())).otherwise(
        F.concat(F.lit((head + f"Transfer-Encoding: chunked{CRLF}{CRLF}").encode()), F.col("chunks"), F.lit(f"0{CRLF}{CRLF}".encode())))
    framed = told.withColumn("revisit", revisit).withColumn("chunks", chunks).withColumn("block", block)
    cut = framed.withColumn("n_segments", F.greatest(F.lit(1), F.ceil(F.length("block") / segment_bytes)).cast("int")).select(
        "record_id", "url", "digest", "first_id", "revisit", size.alias("payload_bytes"), F.length("block").alias("total"), "n_segments",
        F.posexplode(F.expr(f"transform(sequence(0, n_segments - 1), i -> substring(block, i * {segment_bytes} + 1, {segment_bytes}))")).alias("k", "part"))
    uri = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    line = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit(CRLF))
    some = lambda when, text: F.when(when, text).otherwise(F.lit(""))
    first, last, many = F.col("k") == 0, F.col("k") == F.col("n_segments") - 1, F.col("n_segments") > 1
    header = F.concat(
        F.lit(f"{VERSION}{CRLF}"),
        line("WARC-Type", F.when(~first, "continuation").when(F.col("revisit"), "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit("<"), F.col("record_id"), some(~first, F.concat(F.lit("/"), F.col("k") + 1)), F.lit(">"))),
        line("WARC-Date", F.lit(date)),
        some(first & F.col("url").isNotNull(), F.coalesce(line("WARC-Target-URI", uri), F.lit(""))),
        some(first, F.concat(line("Content-Type", F.lit("application/http; msgtype=response")), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))))),
        some(first & F.col("revisit"), F.coalesce(F.concat(line("WARC-Profile", F.lit(IDENTICAL_PAYLOAD)), line("WARC-Refers-To", F.concat(F.lit("<"), F.col("first_id"), F.lit(">")))), F.lit(""))),
        some(many, line("WARC-Segment-Number", (F.col("k") + 1).cast("string"))),
        some(~first, line("WARC-Segment-Origin-ID", F.concat(F.lit("<"), F.col("record_id"), F.lit(">")))),
        some(many & last, line("WARC-Segment-Total-Length", F.col("total").cast("string"))),
        line("Content-Length", F.length("part").cast("string")), F.lit(CRLF))
    return cut.select(F.concat(header.cast("binary"), F.col("part")).alias("record"))


def write_archives(records: DataFrame, path: str, file_records: int = FILE_RECORDS) -> None:
    """Write records to files through Spark's own writer; its line end is the format's record end."""
    records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", CRLF * 2).option("maxRecordsPerFile", file_records).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives under a path, continuation records among them, as RECORD."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for row in records_in(memoryview(content.as_buffer())):
                    rows.append(row)
                    held += len(row["block"])
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=_RECORD)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_RECORD)

    return files.mapInArrow(parsed, RECORD)


_RECORD = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("uri", pa.string()), ("payload_digest", pa.string()), ("refers_to", pa.string()),
                     ("origin_id", pa.string()), ("segment", pa.int32()), ("total_length", pa.int64()), ("block", pa.binary())])
_WHOLE = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("uri", pa.string()), ("payload_digest", pa.string()), ("refers_to", pa.string()),
                    ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("problem", pa.string())])


def records_in(content: memoryview) -> Iterator[dict]:
    """The records of one archive, in order; a damaged archive raises ValueError."""
    data, at = bytes(content), 0
    while at < len(data):
        if not data.startswith(b"WARC/1.", at):
            raise ValueError(f"no record begins at byte {at}")
        end = data.find(b"\r\n\r\n", at)
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in data[at:end].decode("utf-8", "replace").split(CRLF)[1:])}
        if not fields.get("content-length", "").isdigit():
            raise ValueError(f"the record at byte {at} tells no length")
        length = int(fields["content-length"])
        if end < 0 or end + 4 + length > len(data):
            raise ValueError(f"the record at byte {at} is cut short")
        number = lambda name: int(fields[name]) if name in fields else None
        bare = lambda name: fields[name].strip("<>") if name in fields else None
        yield {"record_id": bare("warc-record-id"), "record_type": fields.get("warc-type"), "uri": fields.get("warc-target-uri"),
               "payload_digest": fields.get("warc-payload-digest", "").partition(":")[2] or None, "refers_to": bare("warc-refers-to"),
               "origin_id": bare("warc-segment-origin-id"), "segment": number("warc-segment-number"), "total_length": number("warc-segment-total-length"),
               "block": data[end + 4:end + 4 + length]}
        at = end + 8 + length


def unchunked(body: bytes) -> bytes:
    """Take chunked transfer framing off; a broken frame raises ValueError."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("a chunk without a size")
        size = int(body[at:end].split(b";")[0], 16)
        if size == 0:
            return b"".join(out)
        if body[end + 2 + size:end + 4 + size] != b"\r\n":
            raise ValueError("a chunk without an end")
        out.append(body[end + 2:end + 2 + size])
        at = end + 4 + size


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP response block."""
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        raise ValueError("no end of the HTTP header")
    return unchunked(body) if re.search(rb"(?im)^transfer-encoding:\s*chunked", head) else body


def put_together(records: DataFrame) -> DataFrame:
    """Whole records (WHOLE) from records and their continuations.

    Records that came in one piece are not shuffled. The others are grouped by origin.
    `problem` tells of missing or repeated segments, a wrong total length, broken framing
    or a wrong digest; such a record keeps null payload and length.
    """
    single = records.filter(F.col("segment").isNull()).select(
        "record_id", "record_type", "uri", "payload_digest", "refers_to", F.lit(None).cast("long").alias("total_length"),
        F.array(F.struct(F.lit(1).alias("segment"), "block")).alias("parts"))
    parts = records.filter(F.col("segment").isNotNull()).withColumn("origin", F.coalesce("origin_id", "record_id"))
    lead = lambda c: F.max(F.when(F.col("origin_id").isNull(), F.col(c))).alias(c)
    grouped = parts.groupBy("origin").agg(
        lead("record_type"), lead("uri"), lead("payload_digest"), lead("refers_to"), F.max("total_length").alias("total_length"),
        F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("parts"))
    joined = grouped.select(F.col("origin").alias("record_id"), "record_type", "uri", "payload_digest", "refers_to", "total_length", "parts")

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                yield pa.RecordBatch.from_pylist([whole(row) for row in batch.slice(k, 256).to_pylist()], schema=_WHOLE)

    return single.unionByName(joined).mapInArrow(decoded, WHOLE)


def whole(row: dict) -> dict:
    """One record from its ordered parts, with what is wrong with it."""
    parts, total = row.pop("parts"), row.pop("total_length")
    block, problem, payload = b"".join(p["block"] for p in parts), None, None
    if [p["segment"] for p in parts] != list(range(1, len(parts) + 1)):
        problem = "segments"
    elif row["record_type"] is None or len(parts) > 1 and total is None:
        problem = "unfinished"
    elif total is not None and total != len(block):
        problem = "length"
    elif row["record_type"] == "response":
        try:
            payload = payload_of(block)
        except ValueError:
            problem = "framing"
        else:
            if row["payload_digest"] and base64.b32encode(hashlib.sha1(payload).digest()).decode() != row["payload_digest"]:
                problem, payload = "digest", None
    return row | {"payload": payload, "payload_bytes": None if payload is None else len(payload), "problem": problem}


def resolved(records: DataFrame) -> DataFrame:
    """Revisits with the length of the payload they refer to; `records` is a written table of WHOLE rows."""
    originals = records.filter("record_type = 'response'").select(F.col("record_id").alias("_id"), F.col("payload_bytes").alias("_bytes"))
    revisits = records.filter("record_type = 'revisit'").join(originals, F.col("refers_to") == F.col("_id"), "left")
    return records.filter("record_type = 'response'").unionByName(
        revisits.withColumn("payload_bytes", F.col("_bytes")).withColumn("problem", F.coalesce("problem", F.when(F.col("_id").isNull(), "unresolved"))).drop("_id", "_bytes"))
