import base64
import gzip
import hashlib
import re
import zlib
from html.parser import HTMLParser
from urllib.parse import unquote

import pytest
import zstandard

from strayline.llm import queries, warc


class Plain(HTMLParser):
    """The text by Python's own parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.raw = [], 0

    def handle_starttag(self, tag, attrs):
        self.raw += tag in ("script", "style", "template", "noscript")
        if tag in warc.LINES:
            self.parts.append("\x00")

    def handle_startendtag(self, tag, attrs):
        if tag in warc.LINES:
            self.parts.append("\x00")

    def handle_endtag(self, tag):
        self.raw -= tag in ("script", "style", "template", "noscript")
        if tag in warc.LINES:
            self.parts.append("\x00")

    def handle_data(self, data):
        if not self.raw:
            self.parts.append(data)


def brute_text(source):
    p = Plain()
    p.feed(source)
    p.close()
    lines = [re.sub(r"[ \t\n\r\f\v]+", " ", x).strip(" ") for x in "".join(p.parts).split("\x00")]
    return "\n".join(x for x in lines if x)


def test_texts_of_all_pages(spark, sf_dir):
    found = queries.op2_warc_derivatives(spark, sf_dir).toPandas()
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").toPandas().set_index("page_id")
    assert len(found) == 2 * len(pages)
    for _, r in found.iterrows():
        source, block = pages["html"][r["page_id"]], r["block"].encode()
        sha1 = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
        assert r["source_payload_digest"] == sha1(source.encode()) and r["block_digest"] == sha1(block) and r["content_length"] == len(block)
        assert r["refers_to"] == warc.record_id("response", str(r["page_id"]), pages["url"][r["page_id"]])
        assert r["target_uri"] == pages["url"][r["page_id"]]
        if r["record_type"] == "conversion":
            assert r["block"] == brute_text(source)
        else:
            assert r["n_links"] == len(re.findall(r"<a href", source)) == r["block"].count("outlink: ")
            assert f"source-payload-digest: {r['source_payload_digest']}" in r["block"]
    assert found["record_id"].is_unique


@pytest.mark.parametrize(
    "source,text",
    [
        ("", ""), ("a < b", "a < b"), ("<p>a<p>b", "a\nb"), ("x<!-- <p> -->y", "xy"), ("<script>var a='<p>';</script>z", "z"), ("<p title='a>b'>c</p>", "c"),
        ("a&amp;b &lt;p&gt; &eacute;&#233;&#x41;&nbsp;c", "a&b <p> éAé\xa0c".replace("éAé", "ééA")), ("<style>p{}", ""), ("a<br>b<br/>c", "a\nb\nc"), ("<b>un</b>closed <i", "unclosed <i"),
        ("  a \n b  ", "a b"), ("<P>UP</P>", "UP"), ("<a href=x>l</a>", "l"), ("<![CDATA[x]]>y", "y"), ("plain", "plain"),
    ],
)
def test_odd_pages(source, text):
    assert warc.page(source, "")[0] == text


def test_links_are_joined_and_named():
    source = '<html lang="de"><head><title> A &amp; B </title><base href="/d/"></head><a href="x?a=1&amp;b=2">q</a><img src=\'i.png\'><a>no</a><link href=s.css><a href="http://[bad">z</a>'
    _, title, language, links = warc.page(source, "https://h.example/p/q")
    assert (title, language) == ("A & B", "de")
    assert links == [("https://h.example/d/x?a=1&b=2", "a"), ("https://h.example/d/i.png", "img"), ("https://h.example/d/s.css", "link"), ("http://[bad", "a")]


def test_long_hostile_pages_take_linear_time():
    for source in ("<a " * 30_000, '<a "' * 20_000, "<!--" * 30_000, "<" * 60_000, "<a href='" + "x" * 100_000):
        warc.page(source, "")


def test_files_there_and_back(spark, tmp_path, sf_dir):
    rows = warc.responses(spark.read.parquet(f"{sf_dir}/pages.parquet")).limit(5)
    derived = warc.derivatives(rows)
    members = {r.record_id: r.member for r in warc.member(derived).collect()}
    data = b"".join(bytes(m) for m in members.values())
    records = list(warc.parse(data))
    assert len(records) == 10
    blocks = {r.record_id: r for r in derived.collect()}
    for head, block in records:
        own = blocks[head["warc-record-id"]]
        assert block.decode() == own.block and head["warc-refers-to"] == own.refers_to and head["warc-type"] == own.record_type
        assert head["warc-source-payload-digest"] == own.source_payload_digest and unquote(head["warc-source-headers"]) == own.source_headers
    http = b"HTTP/1.1 200 OK\r\nServer: t\r\n\r\n<p>hi</p>"
    one = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:1>\r\nWARC-Target-URI: http://a/\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nContent-Length: %d\r\n\r\n" % len(http) + http + b"\r\n\r\n"
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 2\r\n\r\nok\r\n\r\n"
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(info) + gzip.compress(one))
    (tmp_path / "b.warc").write_bytes(info + one)
    read = warc.read(spark, str(tmp_path))
    assert read.count() == 2
    found = warc.derivatives(read).filter("record_type = 'conversion'").collect()
    assert [r.block for r in found] == ["hi", "hi"]
    assert all("Server: t" in r.source_headers and r.refers_to == "<urn:uuid:1>" and r.date == "2020-01-01T00:00:00Z" for r in found)


def chunked(body):
    return b"".join(b"%x;x=1\r\n" % len(body[i : i + 7]) + body[i : i + 7] + b"\r\n" for i in range(0, len(body), 7)) + b"0\r\n\r\n"


@pytest.mark.parametrize(
    "headers,body",
    [
        ("Content-Type: text/html; charset=ISO-8859-1", "<p>caf\xe9</p>".encode("latin-1")),
        ("Content-Type: text/html", "<meta name=x><meta charset='windows-1252'><p>caf\xe9</p>".encode("cp1252")),
        ("Content-Type: text/html; charset=nonsense", "<p>café</p>".encode()),
        ("Content-Type: text/html", "<p>café</p>".encode("utf-16")),
        ("Content-Encoding: gzip", gzip.compress("<p>café</p>".encode())),
        ("content-encoding: deflate", zlib.compress("<p>café</p>".encode())),
        ("Content-Encoding: deflate", zlib.compress("<p>café</p>".encode())[2:-4]),
        ("Content-Encoding: zstd", zstandard.ZstdCompressor().compress("<p>café</p>".encode())),
        ("Content-Encoding: gzip", "<p>café</p>".encode()),
        ("Transfer-Encoding: chunked", chunked("<p>café</p>".encode())),
        ("Transfer-Encoding: chunked\r\nContent-Encoding: gzip", chunked(gzip.compress("<p>café</p>".encode()))),
        ("Transfer-Encoding: chunked", "<p>café</p>".encode()),
    ],
)
def test_encoded_responses(spark, tmp_path, headers, body):
    http = b"HTTP/1.1 200 OK\r\n" + headers.encode() + b"\r\n\r\n" + body
    (tmp_path / "a.warc").write_bytes(b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:1>\r\nContent-Length: %d\r\n\r\n" % len(http) + http + b"\r\n\r\n")
    found = {r.record_type: r for r in warc.derivatives(warc.read(spark, str(tmp_path))).collect()}
    assert found["conversion"].block == "café"
    assert headers.splitlines()[0] in found["metadata"].source_headers


def test_cut_off_chunks_give_what_is_there():
    whole = chunked(b"<p>some words</p>")
    assert warc.unchunked(whole[:-9]) == b"<p>some words</p>"[: len(warc.unchunked(whole[:-9]))] != b""
    assert warc.unchunked(b"") == b"" and warc.unchunked(b"zz\r\n") == b"zz\r\n"


def test_records_come_in_bounded_batches(spark, tmp_path, monkeypatch):
    http = b"HTTP/1.1 200 OK\r\n\r\n<p>" + b"x" * 1000 + b"</p>"
    one = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\n" % len(http) + http + b"\r\n\r\n"
    bad = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: many\r\n\r\n\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(one * 30 + bad + one)
    monkeypatch.setattr(warc, "HELD_BYTES", 5000)
    assert warc.read(spark, str(tmp_path)).count() == 32


def test_null_pages(spark):
    pages = spark.createDataFrame([(1, None, None, "x"), (None, "u", "<p>a", None), (1, None, None, "x")], "page_id long, url string, html string, record_id string")
    found = warc.derivatives(warc.responses(pages), carry=("page_id",)).toPandas()
    assert len(found) == 6
    assert found[found["page_id"].isna()].set_index("record_type")["block"]["conversion"] == "a"
    assert warc.derivatives(warc.responses(pages.limit(0))).count() == 0
