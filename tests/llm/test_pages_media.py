import hashlib
import math
import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from trackspark.llm import html, media

from .conftest import rows_of

ARTICLE = "<article><h1>Head &amp; line</h1><p><b>One.<br><p>Two\n  words &eacute;&#33;</p><script>var t='</p>';</script></article>"
TEXT = "Head & line\nOne.\nTwo words é!"


def page(body, head="<title>t</title><style>p{}</style>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


NAV = "<nav><ul><li><a href='/'>Home</a></li></ul></nav><header>Site</header><div class='ad'>Buy!</div><!-- <p>no</p> -->"
AFTER = "<aside>More</aside><div id='comments'><p>first!</p></div><form><label>Mail</label></form><footer>&copy; us</footer>"
CASES = {
    "plain": (page(ARTICLE), TEXT),
    "all around": (page(NAV + ARTICLE + AFTER), TEXT),
    "inside": (page("<article><p>a</p><div class='cookie-notice'>x</div><aside>y</aside><ul class='share'><li>z</ul><p>b</p><section class='comments'><p>c</p></section></article>"), "a\nb"),
    "main role": (page(NAV + "<div role='main'><p>m</p></div><p>beside</p>" + AFTER), "m"),
    "none marked": (page(NAV + "<div><p>x</p>y</div>" + AFTER), "x\ny"),
    "lists and cells": (page("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table><pre>e  f</pre></article>"), "a\nb\nc\nd\ne f"),
    "words within names": ("<body class='has-sidebar'><article class='no-ad'><p>real story</p></article><div class='ad-box'>Buy</div>", "real story"),
    "names of headings and lists": ("<body class='single-post'><h1 class='post-title'>T</h1><div class='content'>body</div><ul><li class='post'>teaser</ul>", "T\nbody\nteaser"),
    "broken": (page("<article><p>a <i>b</p><p>c</i> d</article"), "a b\nc d"),
    "names for and against, alone": (page(NAV + "<div class='post share'><p>article body</p></div>" + AFTER), "article body"),
    "names for and against, in one word": (page("<div class='content-widget-list'><p>the article</p></div>"), "the article"),
    "names for and against, in an article": (page("<article><div class='post share'><p>body</p></div></article>"), "body"),
    "names for and against, beside an article": (page(ARTICLE + "<div class='content-sidebar'>links</div>"), TEXT),
    "names only against": (page("<div class='cookie-notice'>x</div><div class='widget-list'>y</div>"), ""),
    "hidden": (page("<div hidden=''><p>x</p></div><div hidden><p>y</p></div><div hidden='until-found'>z</div><div class='not hidden'><p>seen</p></div>"), "seen"),
    "empty": ("", ""), "null": (None, ""), "text only": ("just text", "just text"), "long": (page("<article>" + "<p>w</p>" * 5000 + "</article>"), "\n".join(["w"] * 5000)),
}


@pytest.mark.parametrize("case", CASES)
def test_text_of_a_page(case):
    source, want = CASES[case]
    assert html.text_of(html.Page(source)) == want


def test_style_tree_removes_repeated_unmarked_branches(spark):
    """A banner without telling markup, the same on every page of a host, goes; other hosts and few pages keep theirs."""
    rows = [(i, "http://a.example/x", page(f"<div class='top'>Same line</div><div class='body'><p>story {i} one</p><p>story {i} two</p></div>")) for i in range(8)]
    rows += [(20, "http://b.example/x", page("<div class='top'>Same line</div>")), (21, None, page("<p>null host</p>")), (22, "odd", None)]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, host string")
    want = [(i, f"story {i} one\nstory {i} two") for i in range(8)] + [(20, "Same line"), (21, "null host"), (22, "")]
    assert rows_of(html.report(pages), "page_id", "text") == sorted(want, key=repr)
    whole = html.BROADCAST_PATHS
    try:
        html.BROADCAST_PATHS = 0
        assert rows_of(html.report(pages), "page_id", "text") == sorted(want, key=repr)
    finally:
        html.BROADCAST_PATHS = whole
    assert html.report(pages.limit(0)).count() == 0


def test_tree_decides_beside_and_inside_articles(spark):
    """Beside an article what differs stays and what repeats goes; inside one a repeated branch goes; copies keep their text."""
    one = lambda i: f"<div class='lead'>Lead {i}</div><div class='top'>Same line</div><article><p>story {i}</p><p>more {i}</p><div class='end'>All rights</div></article><nav>go {i}</nav>"
    rows = [(i, "http://a.example/x", page(one(i))) for i in range(40)] + [(100 + i, "http://c.example/", page("<article><p>copied</p></article>")) for i in range(30)]
    rows += rows[:1]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = [(i, f"Lead {i}\nstory {i}\nmore {i}") for i in [*range(40), 0]] + [(100 + i, "copied") for i in range(30)]
    assert rows_of(html.report(pages), "page_id", "text") == sorted(want, key=repr)


def test_tree_decides_branches_of_doubtful_names(spark):
    """Names for and against a branch: beside other text what differs from page to page stays, what repeats goes."""
    one = lambda i: f"<div><p>story {i}</p></div><div class='content-widget'><p>part {i}</p></div><div class='post share'>Same line</div>"
    pages = spark.createDataFrame([(i, "http://a.example/x", page(one(i))) for i in range(40)], "page_id long, url string, html string")
    assert rows_of(html.report(pages), "page_id", "text") == sorted(((i, f"story {i}\npart {i}") for i in range(40)), key=repr)
    assert {html.text_of(html.Page(one(i))) for i in range(3)} == {f"story {i}" for i in range(3)}, "without the tree both go"


def test_texts_of_the_given_pages_with_and_without_the_tree(spark):
    """On the pages at hand tags tell the article, so the tree may remove only what lies outside of it: texts are the articles."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in html.extract(pages).collect()}
    assert len(got) > 200 and got == {r.page_id: html.text_of(html.Page(r.html)) for r in pages.collect()}


def plain_tree(rows):
    """Importance of every branch, straight from its definition."""
    hosts = {}
    for url, source in rows:
        hosts.setdefault(html.host_of(url), []).append(html.Page(source))
    out = {}
    for host, pages in hosts.items():
        nodes = {}
        for p in pages:
            shown, told = {k: {",".join(v)} for k, v in p.children.items()}, {}
            for path, _, text in p.blocks:
                told.setdefault(path, set()).add(text)
            for path in {*shown, *told}:
                n = nodes.setdefault(path, [0, [], []])
                n[0] += 1
                n[1] += shown.get(path, ())
                n[2] += told.get(path, ())
        own = {}
        for path, (m, shown, told) in nodes.items():
            value = 0.5
            if m > 1 and shown:
                share = [shown.count(x) / len(shown) for x in set(shown)]
                value = 0.5 - 0.5 * sum(x * math.log(x) for x in share) / math.log(m)
            if m > 1 and told:
                value = 1 - sum(math.log(told.count(x)) for x in told) / len(told) / math.log(m)
            own[path] = 0.5 + (min(1, max(0, value)) - 0.5) * (1 - 1 / m) ** 2
        for path in {"/".join(k.split("/")[:i]) for k in own for i in range(1, len(k.split("/")) + 1)}:
            below = [(nodes[k][0] * html.DECAY ** (len(k.split("/")) - len(path.split("/"))), own[k]) for k in own if k == path or k.startswith(path + "/")]
            out[host, path] = sum(w * x for w, x in below) / sum(w for w, _ in below)
    return out


def test_style_tree_against_its_definition(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = [(r.url, r.html) for r in pages.collect()] + [("http://x.example", page(f"<div><p>{i // 2}</p>{'<p>x</p>' * (i % 3)}</div><p>same</p>")) for i in range(6)]
    got = {(r.host, r.path): r.importance for r in html.style_tree(spark.createDataFrame(rows, "url string, html string")).collect()}
    assert got == pytest.approx(plain_tree(rows)) and len(got) > 50
    removed = html.removed_branches(html.style_tree(pages))
    assert removed.count() > 0, "the tree removes branches from the pages at hand"


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=9000))
def test_media_round_trip(data):
    payload = media.padded(data)
    stored = media.wrap(payload)
    (track,) = media.read_tracks(stored)
    assert media.payload_of(stored, track) == payload and len(payload) % 192 == 0 and payload
    keys = track.keyframes()
    assert len(keys) == -(-len(track.sizes) // media.GOP) and stored[keys[0][0] : keys[0][0] + 192] == payload[:192]


def test_media_walks_long_and_open_boxes_and_reports_damage():
    stored = media.wrap(b"x" * 384)
    long_box = struct.pack(">I4sQ", 1, b"free", 20) + b"abcd"
    assert [p for p, _, _ in media.walk(long_box + struct.pack(">I4s", 0, b"mdat") + b"zz")] == ["/free", "/mdat"]
    assert media.describe(None) == (None,) * 6
    for bad in (b"", b"\0\0\0\x05abcd", stored[:200], b"\0\0\0\x10moov\0\0\0\x40trak", stored[:-10][:50]):
        assert media.describe(bad)[5]


def test_media_fragments_and_several_tracks():
    """Sound comes first, video second; both go on in fragments, whose runs state sizes, ticks and keyframes in several ways."""
    b, f, i = media.box, media.full, lambda *x: struct.pack(f">{len(x)}I", *x)

    def track(number, kind, codec, scale):
        table = b("stbl", f("stsd", i(1), b(codec, b"\0" * 8)), f("stts", i(0)), f("stsc", i(0)), f("stsz", i(0, 0)), f("stco", i(0)))
        head = f("tkhd", i(0, 0, number, 0, 0), b"\0" * 8, b"\0" * 8, media.UNITY, i(0, 0))
        return b("trak", head, b("mdia", f("mdhd", i(0, 0, scale, 0), b"\0" * 4), f("hdlr", b"\0" * 4, kind, b"\0" * 12), b("minf", table)))

    trex = b("mvex", f("trex", i(1, 1, 10, 5, 0)), f("trex", i(2, 1, 1, 100, media.NO_KEY)))
    start = b("ftyp", b"isom") + b("moov", track(1, b"soun", "mp4a", 100), track(2, b"vide", "avc1", 10), trex)
    runs = (
        b("traf", f("tfhd", i(1)), f("trun", i(2, 1000), flags=1)),
        b("traf", f("tfhd", i(2, 3), flags=media.TICKS), f("trun", i(3, 2000, 0), flags=media.RUN_OFFSET | media.RUN_FIRST), f("trun", i(2, 7, 0, 9, media.NO_KEY), flags=media.RUN_SIZE | media.RUN_FLAGS)),
    )
    data = start + b("moof", f("mfhd", i(1)), *runs) + b("mdat", b"x" * 9)
    at = len(start)
    codec, seconds, n, keys, tracks, error = media.describe(data)
    assert (codec, n, error) == ("avc1", 5, None) and seconds == pytest.approx(15 / 10)
    assert keys == [{"offset": at + 2000, "size": 100}, {"offset": at + 2300, "size": 7}]
    assert [(t["kind"], t["codec"], t["n_samples"]) for t in tracks] == [("soun", "mp4a", 2), ("vide", "avc1", 5)]
    assert tracks[0]["duration_s"] == pytest.approx(20 / 100) and tracks[0]["keyframes"] == [{"offset": at + 1000, "size": 5}, {"offset": at + 1005, "size": 5}]
    assert media.describe(start + b("moof", b("traf", f("tfhd", i(9)))))[5]


def test_media_report_and_parse(spark, docs):
    rows = [(1, "é" * 500), (2, None), (3, ""), (4, "a" * 192), (4, "a" * 192), (5, "long " * 30_000)]
    got = {r.doc_id: r for r in media.report(docs(*rows)).collect()}
    for i, t in rows:
        p = (t or "").encode()
        p += b" " * ((192 - len(p)) if len(p) < 192 else -len(p) % 192)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
    assert media.report(docs(*rows)).count() == 6 and media.report(docs().limit(0)).count() == 0
    parsed = media.parse(media.wrapped(docs(*rows)).withColumnRenamed("n_bytes", "error")).where("doc_id = 1").first()
    assert parsed.codec == "raw " and parsed.error is None and parsed.n_samples == 6 and parsed.duration_s == pytest.approx(6 / 25) and len(parsed.keyframes) == 1
    none = spark.createDataFrame([(None,), (bytearray(b"junk"),)], "media binary")
    assert sorted(r.error is None for r in media.parse(none).collect()) == [False, True]
