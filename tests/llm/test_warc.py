import base64
import collections
import gzip
import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trackspark.llm import common, warc

PAGES = "page_id long, url string, html string, rid long, refers string, payload string, digest string"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "r", "p", "d") for r in rows], PAGES)


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=3000), st.integers(1, 700))
def test_chunked_framing_round_trip(data, size):
    assert warc.unchunked(warc.chunked(data, size)) == data


def test_chunked_framing_with_extensions_trailers_and_damage():
    assert warc.unchunked(b"3;name=v\r\nabc\r\n02 \r\nde\r\n0\r\nX-Sum: 1\r\n\r\n") == b"abcde"
    for bad in (b"", b"3\r\nabc", b"3\r\nabcd\r\n0\r\n\r\n", b"\r\nabc\r\n0\r\n\r\n", b"-1\r\na\r\n0\r\n\r\n", b"0\r\n", b"0\r\n\r\nmore", b"zz\r\n"):
        with pytest.raises(ValueError):
            warc.unchunked(bad)


def test_records_by_length_not_by_separators():
    """Blocks that look like records, and archives that break off."""
    inner = warc.record([("WARC-Type", "response")], b"x")
    data = warc.record([("A", "1: 2")], inner) + warc.record([("B", "")], b"")
    assert [(f.get("a"), b) for f, b in warc.records_of(data)] == [("1: 2", inner), (None, b"")]
    assert "error" in list(warc.records_of(data[:-3]))[-1][0] and "error" in next(warc.records_of(b"HTTP/1.1 200 OK\r\n\r\n"))[0]
    assert "error" in next(warc.records_of(b"WARC/1.1\r\nContent-Length: -4\r\n\r\n"))[0] and not list(warc.records_of(b""))


def plain(rows):
    groups = collections.defaultdict(list)
    for page_id, _, html in rows:
        groups[html or ""].append(page_id)
    out = []
    for text, ids in groups.items():
        data = text.encode()
        lead = max(ids, key=lambda i: (i is not None, i or 0))
        told = (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        ids.remove(lead)
        out += [(lead, *told, "response", None), *((i, *told, "revisit", lead) for i in ids)]
    return collections.Counter(out)


ROWS = [
    (1, "http://a.example/x y\r\nInjected: 1", "<p>é</p>"), (2, None, "<p>é</p>"), (2, None, "<p>é</p>"), (3, "http://b.example", None), (4, "", ""), (None, "u", "alone"), (None, None, ""),
    (5, "u", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"), (6, "http://a.example/é", "long \r\n\r\n" * 40_000), (7, "u", "long \r\n\r\n" * 40_000), (-8, "u", "\U0001f600" * 50_000),
]


def result(df):
    return collections.Counter(tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in df.collect())


def test_report_against_brute_force(spark):
    assert result(warc.report(table(spark, ROWS))) == plain(ROWS)
    hot = [(i, "u", "same") for i in range(300)] + [(i, "u", f"own {i}") for i in range(300)] + [(7, "u", "same")] * 100
    assert result(warc.report(table(spark, hot))) == plain(hot)
    assert warc.report(table(spark, [])).count() == 0


def test_gzip_files(spark):
    path = folder(spark)
    warc.write(table(spark, ROWS), path)
    files = [bytes(f.content) for f in spark.read.format("binaryFile").load(path).collect()]
    assert all(f[:2] == warc.GZIP for f in files) and sum(1 for f in files for _ in warc.records_of(f)) >= len(ROWS)
    assert "error" in next(warc.records_of(files[0][:-20]))[0]
    members = b"".join(gzip.compress(warc.record([("A", str(k))], b"x")) for k in range(3))
    assert [f["a"] for f, _ in warc.records_of(members)] == ["0", "1", "2"]


def test_string_ids(spark):
    rows = [("a:b\r\nc", "u", "x"), ("z", "u", "x"), ("100%", "u", "y")]
    out = warc.report(spark.createDataFrame(rows, "page_id string, url string, html string"))
    assert {(r.page_id, r.refers_to) for r in out.collect()} == {("a:b\r\nc", "z"), ("z", None), ("100%", None)}


def folder(spark):
    return common.scratch(spark, "test-warc")


@pytest.fixture
def archives(spark):
    """Archives of short segments and many files."""
    path = folder(spark)
    warc.write(table(spark, ROWS).repartition(3), path, segment_bytes=1000, archive_bytes=20_000, codec="none")
    return path


def test_payloads_come_back_from_many_segments_and_archives(spark, archives):
    files = spark.read.format("binaryFile").load(archives)
    assert files.count() > 20 and files.where(F.expr("substring(content, 1, 8) = binary('WARC/1.1')")).count() == files.count()
    rows = warc.read(spark, archives).collect()
    assert len(rows) == len(ROWS) and all(r.error is None for r in rows)
    texts = {r.page: bytes(r.payload).decode() for r in rows if r.kind == "response" and r.page}
    assert texts["7"] == "long \r\n\r\n" * 40_000 and texts["-8"] == "\U0001f600" * 50_000 and texts["5"].startswith("WARC/1.1")
    assert max(r.n_segments for r in rows) > 300 and {r.url for r in rows} >= {"http://a.example/x%20y%0D%0AInjected:%201", "http://a.example/%C3%A9"}


def rewritten(spark, archives, change):
    """The archives' records, as ``change`` gives them back, in one archive per record."""
    records = [r for f in spark.read.format("binaryFile").load(archives).collect() for r in warc.records_of(bytes(f.content))]
    path = folder(spark)
    parts = [warc.record([(k, v) for k, v in f.items() if k != "content-length"], b)[: -len(warc.END)] for f, b in change(records)]
    spark.createDataFrame([(bytearray(p),) for p in parts], "a binary").select(F.col("a").cast("string")).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", 1).text(path)
    return {r.page or r.record_id: r for r in warc.read(spark, path).collect()}


def of_page(records, page):
    own = next(f["warc-record-id"] for f, _ in records if f.get("x-page-id") == page)
    return lambda f: own in (f.get("warc-record-id"), f.get("warc-segment-origin-id"))


def test_damaged_segments_are_told(spark, archives):
    def harm(records):
        seven, eight = of_page(records, "7"), of_page(records, "-8")
        for f, b in records:
            n = f.get("warc-segment-number")
            if seven(f) and n == "5":
                continue  # a segment is lost
            if eight(f) and "warc-segment-total-length" in f:
                f = f | {"warc-segment-total-length": "17"}
            if f.get("x-page-id") == "5":
                b = b.replace(b"abc", b"abd")
            yield f, b

    rows = rewritten(spark, archives, harm)
    assert "segments 1,2,3,4,6" in rows["7"].error and "of 17" in rows["-8"].error and rows["5"].error == "payload has another digest" and rows["1"].error is None

    def twice(records):
        yield from ((f, b) for f, b in records if f.get("warc-segment-number") != "1" or not of_page(records, "7")(f))
        yield from ((f, b) for f, b in records if of_page(records, "-8")(f) and f.get("warc-segment-number") == "2")

    rows = rewritten(spark, archives, twice)
    assert "segments 1,2,2,3" in rows["-8"].error and sum(r.error == "no first segment" for r in rows.values()) == 1


def test_revisits_without_their_response(spark, archives):
    def lose(records):
        return ((f, b) for f, b in records if f.get("x-page-id") != "7" and not of_page(records, "7")(f))

    rewritten_rows = rewritten(spark, archives, lose)
    out = {r.page: r for r in warc.resolved(spark.createDataFrame([r.asDict() for r in rewritten_rows.values()], warc.read(spark, archives).schema)).collect()}
    assert out["6"].error == "no response" and out["6"].payload_bytes is None and out["1"].payload_bytes == 9
