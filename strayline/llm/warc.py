"""WARC derivatives: metadata and plain-text conversion records of responses.

A response becomes two records that name it in WARC-Refers-To: ``metadata``
(application/warc-fields: title, language, outlinks and the source's headers and
digests) and ``conversion`` (text/plain). Each carries the source's target URI and
date, its own block digest, and the payload digest of the response. Record ids are
name-based, so a rerun writes the same ones. On file the response's digest and headers
are in fields of their own, the latter with percent signs and line ends as percent codes.

A payload is the response's body without chunks of a transfer encoding. For its text
content encodings are undone (gzip, deflate, zstd) and characters are decoded as the headers, a byte
order mark or a meta element say, or else as UTF-8. What isn't as its headers say is taken as it stands.

``responses`` makes response records of a table of pages, ``read`` takes them from WARC
files, and ``member`` gives each record as a gzip member: members put one after another
are a WARC file.

Null pages count as empty: both records are made and the text is empty. A null URL
is an empty target URI, and links are then kept as they stand. Tags, comments, scripts
and styles give no text; a tag without its end is text. An empty table gives an empty
result; rows that repeat give records that repeat.
"""

from __future__ import annotations

import base64
import codecs
import gzip
import hashlib
import html
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches

#: Records that read holds at once.
HELD_BYTES = 8 << 20
DATE = "2024-01-01T00:00:00Z"
RECORD = "record_id string, target_uri string, date string, http_headers string, payload binary, payload_digest string"
DERIVED = (
    "record_type string, record_id string, refers_to string, target_uri string, date string, content_type string, content_length long, "
    "block_digest string, source_payload_digest string, source_headers string, n_links int, block string"
)

_attributes = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""
TAG = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|template|noscript)\b{_attributes}>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<end>/?)(?P<name>[a-z][^\s/>]*)(?P<rest>{_attributes})>|<[!?/][^>]*>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
SPACE = re.compile(r"[ \t\n\r\f\v]+")
#: Elements that end a line.
LINES = frozenset(
    "address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol option p pre section table td th title tr ul".split()
)
LINKS = {"a": "href", "area": "href", "link": "href", "img": "src", "iframe": "src", "frame": "src", "embed": "src", "source": "src", "form": "action"}


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*names: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(0).join(names))}>"


def attributes(rest: str) -> dict[str, str]:
    """The first value of each attribute, by lower-cased name."""
    out: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(rest):
        out.setdefault(name.lower(), html.unescape(a or b or c))
    return out


def fields_of(headers: str) -> dict[str, str]:
    """Fields of a message's headers by lower-cased name; the values of one that comes again are joined by commas."""
    out: dict[str, str] = {}
    for line in headers.splitlines()[1:]:
        name, colon, value = line.partition(":")
        name = name.strip().lower()
        if colon:
            out[name] = f"{out[name]}, {value.strip()}" if name in out else value.strip()
    return out


def unchunked(body: bytes) -> bytes:
    """The body without its chunks' sizes; as it stands if it isn't in chunks."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9a-fA-F]{1,8}", size):
            return body
        n = int(size, 16)
        if not n:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + n])
        at = end + 2 + n
        if body[at : at + 2] != b"\r\n":
            # A body that was cut off ends inside a chunk or after one.
            return b"".join(out) if at >= len(body) else body
        at += 2


def _inflated(body: bytes, *windows: int) -> bytes:
    for bits in windows:
        try:
            stream = zlib.decompressobj(bits)
            return stream.decompress(body) + stream.flush()
        except zlib.error:
            pass
    return body


def _unzstd(body: bytes) -> bytes:
    try:
        return zstandard.ZstdDecompressor().decompressobj().decompress(body)
    except zstandard.ZstdError:
        return body


CODINGS = {"gzip": lambda b: _inflated(b, 31), "x-gzip": lambda b: _inflated(b, 31), "deflate": lambda b: _inflated(b, 15, -15), "zstd": _unzstd}
CHARSET = re.compile(r"""charset\s*=\s*["']?\s*([\w.:-]+)""", re.I)
META = re.compile(rb"<meta\b[^>]*>", re.I)
MARKS = ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16"))


def decoded(data: bytes, headers: str) -> str:
    """The characters of a payload."""
    fields = fields_of(headers)
    for name in reversed(fields.get("content-encoding", "").lower().split(",")):
        data = CODINGS.get(name.strip(), bytes)(data)
    found = CHARSET.search(fields.get("content-type", ""))
    charset = next((name for mark, name in MARKS if data.startswith(mark)), None) or (found and found[1])
    if not charset:
        named = (CHARSET.search(tag.decode("latin-1")) for tag in META.findall(data[:2048]))
        charset = next((m[1] for m in named if m), None)
    try:
        return data.decode(charset or "utf-8", errors="replace")
    except LookupError:
        return data.decode(errors="replace")


def page(source: str, base: str) -> tuple[str, str, str, list[tuple[str, str]]]:
    """(text, title, language, links) of a page; links are (URL, element)."""
    pieces: list[str] = []
    title, language, links, in_title, at = [], "", [], False, 0
    for m in TAG.finditer(source):
        if m.start() > at:
            piece = source[at : m.start()]
            pieces.append(piece)
            if in_title:
                title.append(piece)
        at = m.end()
        name = m["name"]
        if not name:
            continue
        name = name.lower()
        if name in LINES:
            pieces.append("\x00")
        if name == "title":
            in_title = not m["end"]
        elif not m["end"] and m["rest"]:
            if name in LINKS:
                if target := attributes(m["rest"]).get(LINKS[name], "").strip():
                    links.append((target, name))
            elif name == "base" and (target := attributes(m["rest"]).get("href", "").strip()):
                base = _join(base, target)
            elif name == "html":
                language = attributes(m["rest"]).get("lang", "")
    pieces.append(source[at:])
    # Spaces of the source are collapsed before references stand for characters of their own.
    whole = "".join(pieces)
    lines = [html.unescape(SPACE.sub(" ", x).strip(" ")) for x in whole.split("\x00")]
    name = html.unescape(SPACE.sub(" ", "".join(title)).strip(" "))
    return "\n".join([x for x in lines if x]), name, language, [(_join(base, t), n) for t, n in links]


def _join(base: str, target: str) -> str:
    try:
        return urljoin(base, target)
    except ValueError:
        return target


def derive(source: dict) -> list[dict]:
    """The two derived records of a response record."""
    data = source["payload"] or b""
    text, title, language, links = page(decoded(data, source["http_headers"] or ""), source["target_uri"] or "")
    common = {
        "refers_to": source["record_id"],
        "target_uri": source["target_uri"] or "",
        "date": source["date"] or DATE,
        "source_payload_digest": source["payload_digest"] or digest(data),
        "source_headers": source["http_headers"] or "",
        "n_links": len(links),
    }
    clean = lambda x: SPACE.sub(" ", x).strip()
    fields = [("title", title), ("language", language), ("source-payload-digest", common["source_payload_digest"])]
    fields += [("source-header", h) for h in common["source_headers"].splitlines() if h.strip()]
    fields += [("outlink", f"{clean(u)} {n}") for u, n in links]
    block = "".join(f"{k}: {clean(v)}\r\n" for k, v in fields)
    out = []
    for kind, content, body in (("metadata", "application/warc-fields", block), ("conversion", "text/plain; charset=utf-8", text)):
        raw = body.encode(errors="replace")
        out.append(common | {"record_type": kind, "record_id": record_id(kind, source["record_id"] or ""), "content_type": content, "content_length": len(raw), "block_digest": digest(raw), "block": raw.decode()})
    return out


def responses(pages: DataFrame, id: str = "page_id", url: str = "url", source: str = "html", date: str = DATE) -> DataFrame:
    """Response records of pages, with the page's id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["record_id", "target_uri", "date", "http_headers", "payload", "payload_digest"]
        for batch in batches:
            rows = []
            for i, u, h in zip(*(c.to_pylist() for c in batch.columns)):
                data = (h or "").encode()
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(data)}\r\n"
                rows.append((record_id("response", str(i), u or ""), u or "", date, head, data, digest(data)))
            columns = list(zip(*rows)) or [()] * 6
            kinds = [pa.string()] * 4 + [pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds)]], ["page_id", *names])

    small_batches(pages.sparkSession)
    rows = pages.select(F.col(id).alias("page_id"), F.col(url), F.col(source))
    return rows.mapInArrow(run, f"page_id {rows.schema['page_id'].dataType.simpleString()}, {RECORD}")


def derivatives(records: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Two rows for each response record: the columns in carry, and those of DERIVED."""
    fields = ["record_id", "target_uri", "date", "http_headers", "payload", "payload_digest"]
    names = [x.split()[0] for x in DERIVED.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    types = [kinds[x.split()[1]] for x in DERIVED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(fields)
            made = [d for row in zip(*(c.to_pylist() for c in batch.columns[:n])) for d in derive(dict(zip(fields, row)))]
            twice = pa.array([i for i in range(len(batch)) for _ in range(2)], pa.int64())
            kept = [c.take(twice) for c in batch.columns[n:]]
            yield pa.RecordBatch.from_arrays([*kept, *[pa.array([d[c] for d in made], t) for c, t in zip(names, types)]], [*batch.schema.names[n:], *names])

    small_batches(records.sparkSession)
    rows = records.select(*fields, *carry)
    kept = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in carry)
    return rows.mapInArrow(run, kept + DERIVED)


def coded(headers: str) -> str:
    """Headers in one line, from which urllib.parse.unquote makes them again."""
    return headers.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def serialise(record: dict) -> bytes:
    """A derived record as a gzip member."""
    body = (record["block"] or "").encode()
    head = {
        "WARC-Type": record["record_type"],
        "WARC-Record-ID": record["record_id"],
        "WARC-Refers-To": record["refers_to"],
        "WARC-Target-URI": record["target_uri"],
        "WARC-Date": record["date"],
        "WARC-Block-Digest": record["block_digest"],
        "WARC-Source-Payload-Digest": record["source_payload_digest"],
        "WARC-Source-Headers": coded(record["source_headers"] or ""),
        "Content-Type": record["content_type"],
        "Content-Length": str(len(body)),
    }
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return gzip.compress(f"WARC/1.1\r\n{lines}\r\n".encode() + body + b"\r\n\r\n", mtime=0)


def member(derived: DataFrame) -> DataFrame:
    """record_id and member, the record's bytes in a WARC file."""
    names = ["record_type", "record_id", "refers_to", "target_uri", "date", "block_digest", "source_payload_digest", "source_headers", "content_type", "block"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [serialise(r) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(made, pa.binary())], ["record_id", "member"])

    small_batches(derived.sparkSession)
    return derived.select(*names).mapInArrow(run, "record_id string, member binary")


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-cased name, block) of the records in a WARC file, compressed by member or plain."""
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data))
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        head: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode(errors="replace").partition(":")
            head[name.strip().lower()] = value.strip()
        size = head.get("content-length", "")
        yield head, stream.read(int(size) if size.isdecimal() else 0)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Response records of the WARC files at path; a task holds one file at a time, and a few of its records."""
    names, kinds = [x.split()[0] for x in RECORD.split(", ")], [pa.string()] * 4 + [pa.binary(), pa.string()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 6, kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                rows, size = [], 0
                for head, block in parse(data.as_py()):
                    if head.get("warc-type") != "response":
                        continue
                    http, _, body = block.partition(b"\r\n\r\n")
                    http = http.decode("latin-1") + "\r\n"
                    if "chunked" in fields_of(http).get("transfer-encoding", "").lower():
                        body = unchunked(body)
                    rows.append((head.get("warc-record-id"), head.get("warc-target-uri"), head.get("warc-date"), http, body, head.get("warc-payload-digest")))
                    size += len(block)
                    if size >= HELD_BYTES:
                        yield batch_of(rows)
                        rows, size = [], 0
                yield batch_of(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD)
