import base64
import gzip
import hashlib

import pytest

from pagelattice.llm import html_text, warc
from tests.llm.helpers import frame

PAGES = "page_id long, url string, html string"


def test_round_trip(spark):
    rows = [
        (1, "http://a/ x", None), (2, None, ""), (3, "http://c/", "A\r\n"), (4, "http://d/", "\r\n\r\n"), (5, "http://e/", "A\r\n\r\n\r\n\r\r\n\r\nWARC/1.0\r\nContent-Length: 3\r\n\r\n"),
        (None, "http://f/", "A\r\n"), (7, "http://g/", "A\r\n"), (7, "http://g/", "A\r\n"), (8, "http://h/", "é" * 70_000), (10, "u", warc.SEPARATOR.decode("latin-1") * 3),
    ]
    out = warc.round_trip(frame(spark, rows, PAGES)).collect()
    assert len(out) == len(rows)
    for r in out:
        if r.page_id is None:
            assert r.record_type == "response"
            continue
        html = (next(h for i, _, h in rows if i == r.page_id) or "").encode()
        largest = max(i for i, _, h in rows if i is not None and (h or "").encode() == html)
        assert r.payload_bytes == len(html)
        assert r.payload_digest == base64.b32encode(hashlib.sha1(html).digest()).decode()
        assert (r.record_type, r.refers_to) == (("response", None) if r.page_id == largest else ("revisit", largest))
        assert r.payload is None if r.record_type == "revisit" else bytes(r.payload) == html
    assert warc.round_trip(frame(spark, [], PAGES)).count() == 0


def test_rows_that_share_an_id(spark):
    """A page's second text is no revisit of what the first one equals."""
    df = frame(spark, [(5, "u", "AAA"), (5, "u", "BBB"), (9, "u", "AAA"), (9, "u", "AAA"), (4, "u", "BBB"), (3, None, "BBB")], PAGES).selectExpr("*", "1 AS refers_to", "'x' AS digest", "2 AS length", "'y' AS value")
    rows = warc.round_trip(df).collect()
    found = sorted((r.page_id, r.record_type, r.refers_to, bytes(r.payload or b"").decode()) for r in rows)
    assert found == [(3, "revisit", 5, ""), (4, "revisit", 5, ""), (5, "response", None, "BBB"), (5, "revisit", 9, ""), (9, "response", None, "AAA"), (9, "response", None, "AAA")]
    ids = {(r.page_id, r.payload_digest): r.record_id for r in rows}
    assert len(set(ids.values())) == 5


def test_arc_files_with_any_bytes(spark, tmp_path):
    """Two versions in one gzip file, a plain file, bodies that are not UTF-8; the archives unpack to a WARC stream."""
    bodies = [b"\x89PNG\r\n\x1a\n\x00\xff", bytes(range(256)) * 40, warc.SEPARATOR * 5, b"", "é".encode("latin-1")]
    parts = [warc.arc_version_block(1, "a.arc"), warc.arc_record(1, "http://a/", "20010203040506", "image/png", bodies[0], "a"), warc.arc_record(1, "http://b/", "2001", "x/y", bodies[1], "a")]
    parts += [warc.arc_version_block(2, "b.arc"), warc.arc_record(2, "http://c/", "20010203040506", "x/y", bodies[2], "b"), warc.arc_record(2, "http://d/", "20010203040506", "x/y", bodies[3], "b")]
    folder = tmp_path / "arcs"
    folder.mkdir()
    (folder / "one.arc.gz").write_bytes(b"".join(gzip.compress(p) for p in parts))
    (folder / "two.arc").write_bytes(warc.arc_version_block(1, "c") + warc.arc_record(1, "http://e/", "20010203040506", "text/html", bodies[4], "c"))
    records = warc.read_arcs(spark, str(folder))
    assert sorted((r.url, bytes(r.body)) for r in records.collect()) == [(f"http://{c}/", b) for c, b in zip("abcde", bodies, strict=True)]
    warc.write_archives(warc.arc_to_warc(records), f"{tmp_path}/warcs")
    for found in (warc.read_archives(spark, f"{tmp_path}/warcs"), warc.read_warcs(spark, f"{tmp_path}/warcs")):
        assert sorted((r.url, bytes(r.payload)) for r in found.collect()) == [(f"http://{c}/", b) for c, b in zip("abcde", bodies, strict=True)]
    kinds = []
    for file in (tmp_path / "warcs").glob("part-*"):
        kinds.append([f["warc-type"] for f, _ in warc.parse_warc([gzip.decompress(file.read_bytes())])])
    assert all(k[0] == "warcinfo" and set(k[1:]) == {"response"} for k in kinds) and sum(map(len, kinds)) == 5 + len(kinds)


def test_broken_gzip_is_an_error():
    assert b"".join(warc.unpacked([gzip.compress(b"ab")[:7], gzip.compress(b"ab")[7:] + gzip.compress(b"c")])) == b"abc"
    assert b"".join(warc.unpacked([b"a", b"b"])) == b"ab"
    with pytest.raises(ValueError):
        list(warc.unpacked([gzip.compress(b"abcdefgh")[:-3]]))


def test_min_revisit(spark):
    out = warc.round_trip(frame(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], PAGES), min_revisit=3).collect()
    assert {r.page_id: r.refers_to for r in out} == {1: None, 2: None, 3: 4, 4: None}


@pytest.mark.parametrize("size", [1, 7, 10_000])
def test_arc_versions_in_one_stream(size):
    body = "x y 9\nhttp://fake 0 0 0 3\n".encode()
    data = warc.arc_version_block(1, "one.arc") + warc.arc_record(1, "http://a/b c", "20010203", "text/html", body, "one.arc") + warc.arc_record(1, "http://b/", "20010203040506", "text/plain", b"", "one.arc")
    data += warc.arc_version_block(2, "two.arc") + warc.arc_record(2, "http://c/", "20020101000000", "image/png", b"\x00\xff\n", "two.arc", offset=77)
    found = list(warc.parse_arc(data[k : k + size] for k in range(0, len(data), size)))
    assert [(r["version"], r["url"], r["body"]) for r in found] == [(1, "http://a/b%20c", body), (1, "http://b/", b""), (2, "http://c/", b"\x00\xff\n")]
    assert found[2]["offset"] == "77" and found[2]["filename"] == "two.arc"
    assert warc.warc_date("20010203") == "2001-02-03T00:00:00Z"


def test_broken_arc_is_an_error():
    with pytest.raises(ValueError):
        list(warc.parse_arc([warc.arc_version_block(1, "a"), b"http://a 1 2 3 100\nshort"]))
    with pytest.raises(ValueError):
        list(warc.parse_arc([warc.arc_version_block(2, "a"), b"http://a 0.0.0.0 2001 text/html 1\nx\n"]))


def test_main_text_of_page_layouts():
    page = """<html><head><title>t</title><style>p{}</style><script>var t="</p>";</script></head><body><header><a href=/>Site</a> slogan</header>
      <nav><ul><li><a href="/a">A</a></li></ul></nav><!-- <p>no</p> --><div class="ad">Buy now, buy a lot, buy it all today.</div>
      <article><h1>Head &amp; line</h1><p><b>First   para<br>of text.<br><p>Second &lt;one&gt; &eacute;.</p><p>Hi.</p><div class="comments"><p>Nice post of mine here, long long.</p></div></article>
      <div id="cookie-notice">We use cookies, click here to accept them all.</div><footer>&copy; all</footer></body></html>"""
    assert html_text.main_text(page) == "Head & line\n\nFirst para of text.\n\nSecond <one> é.\n\nHi."
    plain = '<div class="menu"><a>one</a><a>two</a></div><div class="content"><h1>T</h1><p>Some words of an article, enough of them.<p>More <i>words</i> here.</div><aside>Side side side side side.</aside>'
    assert html_text.main_text(plain) == "T\n\nSome words of an article, enough of them.\n\nMore words here."
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<script>x</script>") == ""
    assert html_text.main_text("<p>unclosed 'quote\" <a href=\"x>y</a>") != None  # noqa: E711


def test_main_text_of_pages_without_article():
    menu = '<div id="x"><ul><li><a href=/1>One of it</a></li><li><a href=/2>Two of it</a></li><li><a href=/3>Three of it</a></li></ul></div>'
    parts = "<h1>T</h1><p>A a a</p><ul><li>x</li><li>y</li></ul><div><div><p>nested and the longest of all</p></div></div><table><tr><td>c</td><td>d</td></tr></table><div class=ad>Buy this now</div><p>B</p><p><a href=/r>The report</a></p><section><p>C</p></section><p>D</p>"
    want = "T|A a a|x|y|nested and the longest of all|c d|B|The report|C|D".replace("|", "\n\n")
    for page in (f"<div id=content>{parts}</div>", f"<body>{menu}<div id=content>{parts}</div>{menu}</body>", f"<body><div><div>{menu}</div><div>{parts}</div></div></body>", f"<html><body>{parts}</body></html>"):
        assert html_text.main_text(page) == want
    assert html_text.main_text("<body><div><p>A</p></div><div class=ad>ad</div><div><p>B b b b</p></div></body>") == "A\n\nB b b b"
    assert html_text.main_text(f"<body><div>Slogan</div>{menu}<div><p>Text of the page.</p></div></body>") == "Text of the page."


def test_windows_decide():
    """Text in sibling sections is one run; short runs beyond links go; links between text of one section stay."""
    words = [f"Paragraph {k} of the article, with some words in it." for k in range(6)]
    whole = "\n\n".join(words)
    assert html_text.main_text("".join(f"<div><p>{w}</p></div>" for w in words)) == whole
    mixed = "<div id=c><p>{}</p><p>{}</p><ul><li>{}</li></ul><p>{}</p><table><tr><td>{}</td></tr></table><p>{}</p></div>".format(*words)
    assert html_text.main_text(mixed) == html_text.main_text(f"<main>{mixed}</main>") == html_text.main_text(f"<article>{mixed}</article>") == whole
    links = "".join(f"<li><a href=/{k}>Chapter {k}</a></li>" for k in range(4))
    short = f"<div id=c><p>{words[0]}</p><ul>{links}</ul><p>Hi.</p></div><div><ul>{links}</ul></div><div><p>Slogan</p></div>"
    assert html_text.main_text(short) == "\n\n".join([words[0], *(f"Chapter {k}" for k in range(4)), "Hi."])
    far = f"<div><p>{whole}</p></div><div><ul>{links}</ul></div><div><p>{' '.join(words[:3])}</p></div>"
    assert html_text.main_text(far) == " ".join(words) + "\n\n" + " ".join(words[:3])
    assert html_text.main_text(f"<div>Beside it</div><article><p>{words[0]}</p></article><div>Below it</div>") == words[0]


def test_time_grows_with_the_page():
    import time

    def seconds(page):
        began = time.perf_counter()
        html_text.main_text(page)
        return time.perf_counter() - began

    for piece in ("<b>x</i>", "<div>x</p>", "<p><b>x", "<b><p>x</p>", "<span><li>x", "<a href='x><i>y"):
        small, large = min(seconds(piece * 2_000) for _ in range(3)), seconds(piece * 40_000)
        assert large < 60 * small + 0.2


def test_names_of_wrappers():
    body = "<h1>T</h1><p>Some words of an article.</p>"
    side = '<div class="sidebar-left">Side</div><div class="related-posts"><article>Teaser</article></div><div id="siteFooter"></div><div class="site-footer">Foot</div>'
    want = "T\n\nSome words of an article."
    for name in ("layout with-sidebar", "post no-comments", "page-nav-open", "overlay", "widget"):
        for inner in (body, f"<article>{body}</article>"):
            assert html_text.main_text(f'<body><div class="{name}">{inner}{side}</div></body>') == want
            assert html_text.main_text(f'<body><div id="{name}">{inner}</div>{side}</body>') == want
    assert html_text.main_text(f'<article class="no-comments">{body}</article>{side}') == want
    assert html_text.main_text(f'<div class="ad"><main>{body}</main></div>') == want
    assert html_text.main_text(f'<div class="modal"><div class="overlay">{body}<div class="comments">Nice</div></div></div>{side}') == want
    long = "<p>Very long talk of other people.</p>" * 20
    for name in ("comments", "comment-list", "ad", "cookie-notice", "cookieNotice"):
        assert html_text.main_text(f'<div id=content>{body}</div><div class="{name}">{long}</div>') == want
        assert html_text.main_text(f'<article>{body}</article><div class="{name}"><article>{long}</article></div>') == want


def test_extract_awkward(spark):
    df = frame(spark, [(1, None, None), (2, "u", ""), (None, "u", "<p>x y z</p>"), (3, "u", "<article>" + "<p>w w</p>" * 5000), (3, "u", "<p>a</p>")], PAGES)
    rows = {(r.page_id, r.n_chars) for r in html_text.extract(df).collect()}
    assert rows == {(1, 0), (2, 0), (None, 5), (3, 5000 * 3 + 4999 * 2), (3, 1)}
    assert html_text.extract(df.limit(0)).count() == 0
