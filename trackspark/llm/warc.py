"""WARC archives of pages, and their reading: continuation records are put together again.

Writing.  Each page becomes a ``response`` record: an HTTP message whose payload, the page in UTF-8, goes in
chunked transfer framing.  A block of over ``SEGMENT_BYTES`` is cut into a first record and ``continuation``
records, which may lie in other archives.  Of pages with equal payloads (SHA-256) one is the response, that
with the largest page_id (of those, the largest url); the others are ``revisit`` records that refer to it.  Archives are gzip files of
about ``ARCHIVE_BYTES`` of records, one gzip member each, that Spark's text writer puts on shared storage: its line separator is the end of a record.

Reading.  Archives are parsed by their Content-Length fields, one at a time.  Records that are whole are
decoded where they are; segments are grouped by the identifier of their origin, put in the order of their
numbers, and their total length is verified before the chunked framing is decoded.  A task holds one
archive, or the segments of one record.

Cases: null html is an empty payload; a null page_id has no field in the record and counts as the smallest; equal rows stay
separate records, of which one is the response; an empty table gives an empty folder, which reads as no
records.  Damage becomes a text in ``error`` (no exception): segments that are missing, repeated or without a
total, lengths that differ, framing or digests that are wrong, archives that break off.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import itertools
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SEGMENT_BYTES = 1 << 16
ARCHIVE_BYTES = 32 << 20
CHUNK_BYTES = 1 << 13
END = b"\r\n\r\n"
VERSION = b"WARC/1.1"
GZIP = b"\x1f\x8b"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked" + END
#: What a header may hold as it is; everything else goes percent-encoded.
URI_SAFE = "".join(map(chr, range(0x21, 0x7F)))


# --- bytes ----------------------------------------------------------------------------------------


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = []
    for at in range(0, len(payload), size):
        piece = payload[at : at + size]
        parts += [b"%x\r\n" % len(piece), piece, b"\r\n"]
    return b"".join([*parts, b"0" + END])


def unchunked(data: bytes) -> bytes:
    """The payload of a chunked body; extensions of chunks and trailing fields are passed over."""
    at, parts = 0, []
    while True:
        line = data.find(b"\r\n", at)
        if line < 0:
            raise ValueError("chunked body breaks off")
        digits = data[at:line].split(b";")[0].strip()
        if not digits or digits.strip(b"0123456789abcdefABCDEF"):
            raise ValueError("chunk without a size")
        size, at = int(digits, 16), line + 2
        if not size:
            break
        if data[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk of another size")
        parts.append(data[at : at + size])
        at += size + 2
    while line := data.find(b"\r\n", at) - at:  # trailing fields, up to an empty line
        if line < 0:
            raise ValueError("chunked body breaks off")
        at += line + 2
    if at + 2 != len(data):
        raise ValueError("bytes after the chunked body")
    return b"".join(parts)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return VERSION + b"\r\n" + head.encode() + b"Content-Length: %d" % len(block) + END + block + END


def records_of(archive: bytes | memoryview) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields with lower-case names, block) of each record; ``{"error": text}`` and an end where an archive is damaged."""
    try:
        view, at = gzip.decompress(archive) if bytes(archive[:2]) == GZIP else bytes(archive), 0
    except (OSError, EOFError, zlib.error):
        yield {"error": "damaged gzip file"}, b""
        return
    while at < len(view):
        head = view.find(END, at)
        if head < 0 or not view.startswith(b"WARC/", at):
            yield {"error": f"no record at byte {at}"}, b""
            return
        lines = view[at:head].decode("utf-8", "replace").split("\r\n")[1:]
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        length = fields.get("content-length", "")
        begin = head + len(END)
        end = begin + int(length) if length.isascii() and length.isdigit() else -1
        if end < begin or view[end : end + len(END)] != END:
            yield fields | {"error": f"record at byte {at} has another length"}, b""
            return
        yield fields, view[begin:end]
        at = end + len(END)


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP response, without transfer framing."""
    head, found, body = block.partition(END)
    if not found:
        raise ValueError("no HTTP header")
    fields = {k.strip().lower(): v.strip().lower() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
    return unchunked(body) if fields.get(b"transfer-encoding") == b"chunked" else body


def joined(segments: list[tuple[int, int | None, bytes]]) -> bytes:
    """The block of a record from its (number, total length, piece), which are sorted by number."""
    numbers = [s[0] for s in segments]
    if numbers != list(range(1, len(numbers) + 1)):
        raise ValueError(f"segments {','.join(map(str, numbers[:20]))}")
    totals = {s[1] for s in segments if s[1] is not None}
    block = b"".join(s[2] for s in segments)
    if totals != {len(block)}:
        raise ValueError(f"{len(block)} bytes of {','.join(map(str, sorted(totals))) or 'an unknown total'}")
    return block


# --- writing --------------------------------------------------------------------------------------


def page_records(batch: str, date: str, segment_bytes: int, row: tuple) -> Iterator[bytes]:
    """The records of a page: (page_id as text, url, SHA-256, SHA-1, place among equal rows, payload; none for revisits)."""
    name = lambda *x: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, repr((batch, *x)))}>"
    page, url, digest, sha1, place, payload = row
    shared = [("WARC-Date", date), *([("WARC-Target-URI", quote(url, safe=URI_SAFE))] if url else [])]
    if page is not None:
        shared.append(("X-Page-Id", quote(page, safe="")))
    shared += [("WARC-Payload-Digest", f"sha1:{base64.b32encode(bytes.fromhex(sha1)).decode()}"), ("Content-Type", "application/http; msgtype=response")]
    if payload is None:
        own = name(digest, page, url, place)
        yield record([("WARC-Type", "revisit"), ("WARC-Record-ID", own), ("WARC-Profile", REVISIT), ("WARC-Refers-To", name(digest)), *shared], HTTP)
        return
    own, block = name(digest), HTTP + chunked(payload)
    if len(block) <= segment_bytes:
        yield record([("WARC-Type", "response"), ("WARC-Record-ID", own), *shared], block)
        return
    yield record([("WARC-Type", "response"), ("WARC-Record-ID", own), ("WARC-Segment-Number", "1"), *shared], block[:segment_bytes])
    for k, at in enumerate(range(segment_bytes, len(block), segment_bytes), 2):
        total = [("WARC-Segment-Total-Length", str(len(block)))] if at + segment_bytes >= len(block) else []
        number = [("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", str(k)), *total]
        yield record([("WARC-Type", "continuation"), ("WARC-Record-ID", name(digest, k)), shared[0], *number], block[at : at + segment_bytes])


def marked(pages: DataFrame) -> DataFrame:
    """page, url, digest, sha1, place, payload of the records to write; revisits have no payload.

    A payload moves once, after equal ones of a task have become one; rows that repeat it move without it."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    own = F.struct("page_id", "url")
    responses = rows.groupBy("digest").agg(F.max(own).alias("lead"), F.first("payload").alias("payload"))
    responses = responses.select(F.col("lead.page_id").cast("string").alias("page"), "lead.url", "digest", F.sha1("payload").alias("sha1"), F.lit(1).alias("place"), "payload")
    equal = rows.groupBy("digest", "page_id", "url").agg(F.count(F.lit(1)).alias("n"), F.first(F.sha1("payload")).alias("sha1"))
    leads = equal.groupBy("digest").agg(F.max(own).alias("lead"), F.sum("n").alias("rows")).where("rows > 1").select("digest", "lead")
    more = F.col("n") - F.when(own.eqNullSafe(F.col("lead")), 1).otherwise(0)
    again = equal.join(leads, "digest").withColumn("more", more).where("more > 0").withColumn("place", F.explode(F.sequence(F.lit(1), F.col("more").cast("int"))))
    return responses.unionByName(again.select(F.col("page_id").cast("string").alias("page"), "url", "digest", "sha1", "place", F.lit(None).cast("binary").alias("payload")))


def write(pages: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES, archive_bytes: int = ARCHIVE_BYTES, date: str = "2000-01-01T00:00:00Z", codec: str = "gzip") -> None:
    """Write the archives of ``pages`` (page_id, url, html) into a new folder, each a gzip file (``codec``: none, a plain one)."""
    batch = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def archives() -> Iterator[tuple[bytes]]:
            parts, size = [], 0
            for row in common.rows_in(batches):
                for r in page_records(batch, date, segment_bytes, row):
                    parts.append(r)
                    size += len(r)
                    if size >= archive_bytes:
                        yield (b"".join(parts)[: -len(END)],)
                        parts, size = [], 0
            if parts:
                yield (b"".join(parts)[: -len(END)],)

        yield from common.batches_out(archives(), [("archive", pa.binary())], 1)

    files = marked(pages).mapInArrow(run, "archive binary").select(F.col("archive").cast("string"))
    files.write.option("lineSep", END.decode()).option("maxRecordsPerFile", 1).option("compression", codec).text(path)


# --- reading --------------------------------------------------------------------------------------

_FIELDS = [
    ("record_id", pa.string()), ("kind", pa.string()), ("page", pa.string()), ("url", pa.string()), ("refers", pa.string()), ("digest", pa.string()), ("origin", pa.string()),
    ("segment", pa.int32()), ("total", pa.int64()), ("block", pa.binary()), ("n_segments", pa.int32()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("error", pa.string()),
]
_DDL = "record_id string, kind string, page string, url string, refers string, digest string, origin string, segment int, total long, block binary, n_segments int, payload_bytes long, payload_digest string, payload binary, error string"


def _whole(block: bytes | None, n: int, digest: str | None, payloads: bool, error: str | None = None) -> tuple:
    """n_segments, payload_bytes, payload_digest, payload, error of a block."""
    try:
        payload = payload_of(block) if error is None else b""
    except ValueError as e:
        error = str(e)
    if error is not None:
        return n, None, None, None, error
    found = base32_sha1(payload)
    return n, len(payload), found, payload if payloads else None, None if digest in (None, f"sha1:{found}") else "payload has another digest"


def _number(text: str | None) -> int | None:
    return int(text) if text and text.isascii() and text.isdigit() else None


def _parsed(archive: bytes, payloads: bool) -> Iterator[tuple]:
    for f, block in records_of(archive):
        kind, own, number = f.get("warc-type"), f.get("warc-record-id"), _number(f.get("warc-segment-number"))
        page, digest, error = f.get("x-page-id"), f.get("warc-payload-digest"), f.get("error")
        head = (own, kind, None if page is None else unquote(page), f.get("warc-target-uri"), f.get("warc-refers-to"), digest)
        if error is not None or kind not in ("response", "revisit", "continuation"):
            if error is not None:
                yield *head, None, None, None, None, 0, None, None, None, error
        elif kind == "revisit":
            yield *head, None, None, None, None, 1, None, None, None, None
        elif number is None and kind == "response":
            yield *head, None, None, None, None, *_whole(block, 1, digest, payloads)
        else:
            origin = f.get("warc-segment-origin-id") if kind == "continuation" else own
            yield *head, origin, number or 0, _number(f.get("warc-segment-total-length")), block, 0, None, None, None, None


def _assembled(rows: Iterator[tuple], payloads: bool) -> Iterator[tuple]:
    """One row per origin, from segments sorted by origin and number."""
    for origin, group in itertools.groupby(rows, key=lambda r: r[6]):
        segments = list(group)
        head = next((r for r in segments if r[1] == "response"), None)
        digest, block, error = head and head[5], None, None if head else "no first segment"
        try:
            block = joined([r[7:10] for r in segments]) if head else None
        except ValueError as e:
            error = str(e)
        yield *((head or (origin, "response", None, None, None, None))[:6]), None, None, None, None, *_whole(block, len(segments), digest, payloads, error)


def read(spark: SparkSession, path: str, payloads: bool = True, work: common.Workspace | None = None) -> DataFrame:
    """record_id, kind, page, url, refers, n_segments, payload_bytes, payload_digest, payload, error of the records of a folder of archives.

    ``page`` is the page's id as text; revisits have no payload of their own.  Without ``payloads`` only their sizes and digests come.
    Parsed records are written once: into ``work``, where it is given, so that they go with it."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from common.batches_out((r for (a,) in common.rows_in(batches) for r in _parsed(a, payloads)), _FIELDS, 200)

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from common.batches_out(_assembled(common.rows_in(batches), payloads), _FIELDS, 20)

    parsed = spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, _DDL)
    found = work.write(parsed, "parsed") if work else common.materialise(parsed, "warc-parsed")
    segments = found.where("origin is not null").repartition("origin").sortWithinPartitions("origin", "segment")
    out = found.where("origin is null").unionByName(segments.mapInArrow(assemble, _DDL))
    return out.select("record_id", "kind", "page", "url", "refers", "n_segments", "payload_bytes", "payload_digest", "payload", "error")


def resolved(records: DataFrame) -> DataFrame:
    """page, record_type, refers_to (page), payload_bytes, payload_digest, error: revisits get what their response has."""
    own = records.where("kind = 'response'")
    told = own.select(F.col("record_id").alias("refers"), F.col("page").alias("refers_to"), *(F.col(c).alias(f"_op_{c}") for c in ("payload_bytes", "payload_digest", "error")))
    wanted = records.where("kind = 'revisit'").select("page", "refers")
    again = wanted.join(told, "refers", "left").select("page", F.lit("revisit").alias("record_type"), "refers_to", F.col("_op_payload_bytes").alias("payload_bytes"), F.col("_op_payload_digest").alias("payload_digest"), F.when(F.col("refers_to").isNull() & F.col("_op_payload_bytes").isNull(), F.coalesce("_op_error", F.lit("no response"))).otherwise(F.col("_op_error")).alias("error"))
    first = own.select("page", F.lit("response").alias("record_type"), F.lit(None).cast("string").alias("refers_to"), "payload_bytes", "payload_digest", "error")
    return first.unionByName(again)


def report(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each page, as read back from its archives.

    It fails if any record is not read back whole."""
    kind = pages.schema["page_id"].dataType
    with common.Workspace(pages.sparkSession, "warc") as work:
        write(pages, f"{work.path}/archives")
        records = work.write(read(pages.sparkSession, f"{work.path}/archives", payloads=False, work=work), "records")
        sound = F.when(F.col("error").isNull(), F.col("payload_bytes")).otherwise(F.raise_error(F.concat_ws(" ", F.lit("record not read back:"), "page", "error")).cast("long"))
        out = resolved(records).withColumn("payload_bytes", sound)
        return common.materialise(out.select(F.col("page").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to")), "warc-report")


#: The same rows; base 32 takes 20 bits, five hexadecimal digits, at a time.
SQL = """with p as (select page_id, encode(coalesce(html, '')) as b from pages), r as (select page_id, octet_length(b) as n, sha1(b) as h,
 row_number() over (partition by b order by page_id desc nulls last) as place, first_value(page_id) over (partition by b order by page_id desc nulls last) as lead from p)
select page_id, n as payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 1 + 5 * (i // 4), 5))::bigint >> (15 - 5 * (i % 4))) & 31)::int, 1)), '') as payload_digest,
 case when place=1 then 'response' else 'revisit' end as record_type, case when place>1 then lead end as refers_to from r"""
