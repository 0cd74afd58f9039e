import gzip

import pytest

from pagelattice.llm import warc

HEAD = b"HTTP/1.0 404 Not Found\nServer: old\nContent-Length: 999\n\n"
PAGE = "<p>gone é</p>\n\nHTTP/1.1 200 OK\n\nno head".encode()


def line(version, url, kind=b"text/html; charset=x", date=b"20010203040506", length=None, body=b"", code=b"404"):
    tail = b"" if version == 1 else b" " + code + b" - - 0 old file.arc"
    return b"%s 192.0.2.7 %s %s%s %d\n" % (url, date, kind, tail, len(body) if length is None else length) + body + b"\n"


def archive(version, *records):
    return warc.arc_version_block(version, "old.arc") + b"".join(records)


@pytest.mark.parametrize("version", [1, 2])
@pytest.mark.parametrize("size", [1, 13, 1 << 20])
def test_heads_blanks_and_broken_records(version, size):
    body = HEAD + PAGE
    data = archive(
        version, line(version, b"http://a/with blank and 1.2.3.4 x", body=body), line(version, b"http://b/", length=10**9, body=b"short"), line(version, b"http://c/", body=b"plain body"),
        b"no header at all\nnor this\n", line(version, b"http://d/", date=b"20019999999999", body=b"x"), line(version, b"http://e/", length=3, body=b"too long a body"), line(version, b"dns:f.example", kind=b"text/dns", body=b"answer"),
    )
    found = list(warc.parse_arc((data[k : k + size] for k in range(0, len(data), size)), strict=False))
    assert [(r["url"], r["status"]) for r in found] == [
        ("http://a/with blank and 1.2.3.4 x", "ok"), ("http://b/", "bad length"), ("http://c/", "ok"), ("no header at all", "bad header"), ("http://d/", "bad date"), ("http://e/", "bad length"), ("dns:f.example", "ok"),
    ]
    assert (found[0]["http"], found[0]["body"], found[0]["type"]) == (HEAD, PAGE, "text/html; charset=x")
    assert (found[2]["http"], found[2]["body"]) == (None, b"plain body")
    with pytest.raises(ValueError):
        list(warc.parse_arc([data]))


def test_files_to_archives_and_back(spark, tmp_path):
    """Both versions, plain and packed: payload digests are those of the bare bodies, and a bad record costs only itself."""
    for version, name in ((1, "one.arc"), (2, "two.arc.gz")):
        data = archive(version, line(version, b"http://a%d/x y" % version, body=HEAD + PAGE), line(version, b"http://bad/", length=77, body=b"zz"), line(version, b"http://plain%d/" % version, body=b"no head", code=b"302"), line(version, b"ftp://f%d/" % version, body=b"file"))
        (tmp_path / name).write_bytes(gzip.compress(data) if name.endswith("gz") else data)
    records = warc.read_arcs(spark, str(tmp_path))
    assert {(r.version, r.status): r.records for r in warc.status_counts(records).collect()} == {(v, s): n for v in (1, 2) for s, n in (("ok", 3), ("bad length", 1))}
    out = str(tmp_path / "out")
    warc.write_archives(warc.arc_to_warc(records), out)
    rows = {r.url: r for r in warc.read_archives(spark, out).collect()}
    assert len(rows) == 6
    for version in (1, 2):
        first, plain, file = (rows[u % version] for u in ("http://a%d/x%%20y", "http://plain%d/", "ftp://f%d/"))
        assert (bytes(first.payload), first.payload_digest, first.payload_bytes) == (PAGE, warc.sha1_base32(PAGE), len(PAGE))
        assert (plain.record_type, bytes(plain.payload)) == ("response", b"no head")
        assert (file.record_type, bytes(file.payload), file.payload_digest) == ("resource", b"file", warc.sha1_base32(b"file"))
    made = {r.url: warc.warc_record(r.asDict() | {"page_id": None}, None) for r in records.where("status = 'ok'").collect()}
    assert HEAD + PAGE in made["http://a1/x y"] and b"HTTP/1.1 302 Found\r\n" in made["http://plain2/"] and b"HTTP/" not in made["ftp://f1/"]


def test_pages_that_look_like_heads(spark):
    html = "HTTP/1.1 500 no\r\n\r\n<p>x</p>"
    pages = spark.createDataFrame([(1, "http://a", html), (2, "http://b", html), (3, None, None)], "page_id long, url string, html string")
    rows = {r.page_id: r for r in warc.round_trip(pages).collect()}
    digest = warc.sha1_base32(html.encode())
    assert [(rows[k].record_type, rows[k].refers_to, rows[k].payload_digest, rows[k].payload_bytes) for k in (1, 2)] == [("revisit", 2, digest, len(html)), ("response", None, digest, len(html))]
    assert rows[3].payload_bytes == 0
