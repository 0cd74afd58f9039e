"""WARC (4): legacy ARC records to WARC archives and back.

* ``parse_arc`` reads a stream of ARC records: the version block names the header layout (version 1:
  URL, address, date, type, length; version 2 adds result code, checksum, location, offset and file
  name) and the declared length delimits the body. ``read_arcs`` does so for ``.arc`` and ``.arc.gz``
  files, ``pages_to_arc`` renders pages as such records, ``arc_records`` parses them.
  The body of an HTTP capture is the whole response: its head is kept as it is, and the payload and its digest begin after it.
  Records that cannot be read become rows with a status, counted by ``status_counts`` and left out of archives.
* ``arc_to_warc`` synthesises record ids, dates, types and digests. Of records with equal payloads
  the one with the largest page_id is a response; the others are revisits that refer to it and
  carry no payload. Bodies without an HTTP head get one that names code and type, or, where the URL is not of HTTP, are resources.
* ``write_archives`` stores each record as a gzip member of its own, after a warcinfo record at the start of
  each file. Spark's text writer puts a constant separator between rows; here that is a gzip member
  that holds CRLF CRLF, which ends a WARC record. So a file unpacks to a plain WARC stream, it can be
  read from the start of any member, and Spark can split it at separators. Bodies are bytes throughout.
* ``read_archives`` reads such files, ``read_warcs`` WARC files of other writers.

Defined edge cases: a null or empty html is an empty payload (and takes part in revisits when
``min_revisit`` is 0); a null url is written as an empty target; rows with a null page_id are always
responses; rows that repeat a page_id are records of their own, and those with equal payloads are
either all responses or all revisits; an empty table gives no rows; extra columns are ignored.
``read_arcs`` and ``read_warcs`` take one file at a time into a task.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import http.client
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelattice.llm.common import byte_column, cut, hot_join, is_broadcast, shared_dir, slices, small_side

CRLF = b"\r\n"
END = b"\r\n\r\n"
NAMESPACE = uuid.UUID("8c0ad1f6-6f0d-5a7e-9d0c-2f1b8f6c5a11")
#: The header fields of the two ARC versions, in order.
ARC_FIELDS = {
    1: ("url", "ip", "date", "type", "length"),
    2: ("url", "ip", "date", "type", "code", "checksum", "location", "offset", "filename", "length"),
}
CAPTURE_DATE = "20240101000000"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# --- gzip members --------------------------------------------------------------------------------


def member_of(deflated: bytes, data: bytes) -> bytes:
    """A gzip member without name and time."""
    return b"\x1f\x8b\x08\0\0\0\0\0\0\xff" + deflated + zlib.crc32(data).to_bytes(4, "little") + len(data).to_bytes(4, "little")


#: CRLF CRLF as a stored block, the same bytes whatever the compression library.
SEPARATOR = member_of(b"\x01\x04\x00\xfb\xff" + END, END)


def gzip_member(data: bytes) -> bytes:
    """``data`` as one member that does not hold the separator's bytes."""
    for level, kind in ((6, zlib.Z_DEFAULT_STRATEGY), (6, zlib.Z_HUFFMAN_ONLY), (6, zlib.Z_FIXED)):
        packer = zlib.compressobj(level, zlib.DEFLATED, -15, 8, kind)
        made = member_of(packer.compress(data) + packer.flush(), data)
        if SEPARATOR not in made:
            return made
    raise ValueError("a record cannot be told from the separator")


def unpacked(pieces: Iterable[bytes]) -> Iterator[bytes]:
    """The bytes of gzip members one after the other; a stream that is not gzip comes as it is."""
    unpacker, plain, start = None, False, b""
    for piece in pieces:
        if unpacker is None and not plain:
            piece = start + piece
            if len(piece) < 2:
                start = piece
                continue
            plain = piece[:2] != b"\x1f\x8b"
        if plain:
            yield piece
            continue
        while piece:
            unpacker = unpacker or zlib.decompressobj(31)
            yield unpacker.decompress(piece)
            piece = unpacker.unused_data
            if unpacker.eof:
                unpacker = None
                piece = piece.lstrip(b"\0")  # padding between members
                if len(piece) == 1:
                    start, piece = piece, b""
                else:
                    start = b""
            else:
                break
    if unpacker is not None:
        raise ValueError("the archive ends inside a gzip member")
    if plain is False and start:
        yield start


# --- ARC -----------------------------------------------------------------------------------------


def arc_version_block(version: int, name: str) -> bytes:
    """The record that opens an ARC file and states its version and field names."""
    fields = " ".join({"url": "URL", "ip": "IP-address", "date": "Archive-date", "type": "Content-type", "code": "Result-code", "checksum": "Checksum", "location": "Location", "offset": "Offset", "filename": "Filename", "length": "Archive-length"}[f] for f in ARC_FIELDS[version])
    body = f"{version} 0 archive\n{fields}\n".encode()
    tail = "" if version == 1 else f" 200 - - 0 {name}"
    return f"filedesc://{name} 0.0.0.0 {CAPTURE_DATE} text/plain{tail} {len(body)}\n".encode() + body + b"\n"


def arc_record(version: int, url: str, date: str, kind: str, body: bytes, name: str, offset: int = 0) -> bytes:
    """One ARC record: header line, body, newline. Blanks in the URL are percent-encoded."""
    clean = re.sub(r"\s", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url) or "-"
    tail = "" if version == 1 else f" 200 - - {offset} {name}"
    return f"{clean} 0.0.0.0 {date} {kind}{tail} {len(body)}\n".encode() + body + b"\n"


class Stream:
    """Lines and byte counts of a stream that comes in pieces."""

    def __init__(self, pieces: Iterable[bytes]):
        self.pieces, self.held, self.at = iter(pieces), bytearray(), 0

    def more(self) -> bool:
        found = next(self.pieces, None)
        if found is None:
            return False
        if self.at:
            del self.held[: self.at]
            self.at = 0
        self.held += found
        return True

    def line(self, strict: bool = True) -> bytes | None:
        """The next line that is not empty, without its end; None at the end of the stream."""
        while True:
            seen = len(self.held) - self.at
            end = self.held.find(b"\n", self.at)
            while end < 0:
                if not self.more():
                    rest = bytes(self.held[self.at :])
                    if strict and rest.strip():
                        raise ValueError("the stream ends in a header")
                    self.at = len(self.held)
                    return rest or None
                end = self.held.find(b"\n", self.at + seen)
                seen = len(self.held) - self.at
            found = bytes(self.held[self.at : end]).rstrip(b"\r")
            self.at = end + 1
            if found:
                return found

    def header(self) -> bytes:
        """The next line, empty or not, without its end."""
        while (end := self.held.find(b"\n", self.at)) < 0:
            if not self.more():
                raise ValueError("the stream ends in a header")
        found = bytes(self.held[self.at : end]).rstrip(b"\r")
        self.at = end + 1
        return found

    def body(self, n: int, strict: bool) -> bytes | None:
        """The next n bytes if the stream or their line ends there; else ValueError or None, and the stream stays where it is."""
        while len(self.held) - self.at <= n and self.more():
            pass
        end = self.at + n
        if len(self.held) < end or (len(self.held) > end and self.held[end] not in b"\r\n"):
            if strict:
                raise ValueError("a body does not end where declared")
            return None
        found = bytes(self.held[self.at : end])
        self.at = end
        return found

    def take(self, n: int) -> bytes:
        while len(self.held) - self.at < n:
            if not self.more():
                raise ValueError("a body is shorter than declared")
        found = bytes(self.held[self.at : self.at + n])
        self.at += n
        return found


_IP, _DAY = rb"(\d{1,3}(?:\.\d{1,3}){3}|[0-9A-Fa-f]*:[0-9A-Fa-f:.]*|-)", rb"(\d{4,17})"
#: Headers read from both ends: URLs and types may hold blanks, the fields between them cannot.
ARC_HEADERS = {
    1: re.compile(rb"(.*?) " + _IP + rb" " + _DAY + rb" (.*) (\d{1,18})"),
    2: re.compile(rb"(.*?) " + _IP + rb" " + _DAY + rb" (.*) (\d{1,3}|-) (\S+) (\S+) (\d+|-) (.*) (\d{1,18})"),
}
OK, BAD_HEADER, BAD_LENGTH, BAD_DATE = "ok", "bad header", "bad length", "bad date"


def split_http(body: bytes) -> tuple[bytes | None, bytes]:
    """The head of an HTTP response with its blank line, and what follows it; None and the whole body where there is none."""
    if re.match(rb"HTTP/\d(?:\.\d)? \d{3}", body):
        end = re.search(rb"\r?\n\r?\n", body)
        if end:
            return body[: end.end()], body[end.end() :]
    return None, body


def arc_header(line: bytes, version: int | None) -> dict | None:
    """The fields of a header line; None if it is none."""
    whole = ARC_HEADERS[version].fullmatch(line) if version in ARC_HEADERS else None
    return whole and dict(zip(ARC_FIELDS[version], (g.decode("utf-8", "replace") for g in whole.groups()), strict=True))


def parse_arc(data: Iterable[bytes], strict: bool = True) -> Iterator[dict]:
    """Records of an ARC byte stream, given in chunks: header fields by the version in force, ``http`` (the head of an HTTP response,
    where the body has one), ``body`` (what follows it) and ``status``.

    A version block may come at any record boundary. A header that cannot be read, a length that no record boundary follows or
    a date that is none ends a ``strict`` stream with ValueError. Otherwise it gives a row with that status and no body, and
    reading goes on at the next line that is a header.
    """
    stream, version, lost = Stream(data), None, False
    while (line := stream.line(strict)) is not None:
        opening = re.fullmatch(rb"filedesc://.* (\d{1,18})", line)
        fields = None if opening else arc_header(line, version)
        if opening is None and fields is None:
            if strict:
                raise ValueError(f"not an ARC version {version} header: {line[:200]!r}")
            if not lost:
                yield {"version": version, "url": line[:200].decode("utf-8", "replace"), "http": None, "body": None, "status": BAD_HEADER}
            lost = True  # one row for all lines up to the next header
            continue
        body = stream.body(int(opening[1] if opening else fields["length"]), strict)
        lost = body is None
        if opening:
            version = int(found[0]) if body and (found := re.match(rb"\d+", body)) else version
            continue
        if body is None:
            yield fields | {"version": version, "http": None, "body": None, "status": BAD_LENGTH}
            continue
        try:
            warc_date(fields["date"])
        except ValueError:
            if strict:
                raise
            yield fields | {"version": version, "http": None, "body": None, "status": BAD_DATE}
            continue
        head, payload = split_http(body)
        yield fields | {"version": version, "http": head, "body": payload, "status": OK}


RECORD_SCHEMA = "page_id long, url string, ip string, date string, type string, code string, version int, status string, length long, digest string, http binary, body binary"
RECORD_TYPES = [pa.int64(), *[pa.string()] * 5, pa.int32(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.binary()]
RECORD_NAMES = [field.split(" ")[0] for field in RECORD_SCHEMA.split(", ")]


def record_batches(found: Iterable[tuple[int | None, dict]], rows: int = 500, held: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    """(page_id, ARC record) as batches of bounded size."""
    out, size = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), RECORD_TYPES, strict=True)], RECORD_NAMES)

    for page_id, arc in found:
        body = arc["body"]
        known = (None, None) if body is None else (len(body), sha1_base32(body))
        out.append((page_id, *(arc.get(k) for k in ("url", "ip", "date", "type", "code", "version", "status")), *known, arc["http"], body))
        size += len(body or b"") + len(arc["http"] or b"")
        if len(out) >= rows or size > held:
            yield batch()
            out, size = [], 0
    if out:
        yield batch()


def http_head(code: str, kind: str, length: int) -> bytes:
    """The head of an HTTP response, for bodies that have none."""
    return f"HTTP/1.1 {code} {http.client.responses.get(int(code), 'Unknown')}\r\nContent-Type: {kind}\r\nContent-Length: {length}\r\n\r\n".encode()


def pages_to_arc(pages: DataFrame) -> DataFrame:
    """page_id, url, arc (a version block and one record; odd ids as version 1, even as version 2)."""

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for page, url, html in zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), byte_column(batch, "html"), strict=True):
                version = 1 if (page or 0) % 2 else 2
                name = f"pages-v{version}.arc"
                out.append(arc_version_block(version, name) + arc_record(version, url or "", CAPTURE_DATE, "text/html", http_head("200", "text/html; charset=utf-8", len(html)) + html, name))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.binary())], ["page_id", "url", "arc"])

    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return base.mapInArrow(render, "page_id long, url string, arc binary")


def arc_records(arcs: DataFrame) -> DataFrame:
    """The records of (page_id, arc): a row for each, with its row's page_id, length and payload digest."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            blobs = zip(batch.column("page_id").to_pylist(), batch.column("arc").to_pylist(), strict=True)
            yield from record_batches((page_id, arc) for page_id, blob in blobs for arc in parse_arc(unpacked([blob or b""]), strict=False))

    return arcs.select("page_id", "arc").mapInArrow(scan, RECORD_SCHEMA)


def read_arcs(spark: SparkSession, path: str) -> DataFrame:
    """The records of ``.arc`` and ``.arc.gz`` files; page_id is null, as the format has none."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            for blob in batch.column("content").to_pylist():
                pieces = (blob[k : k + (1 << 20)] for k in range(0, len(blob), 1 << 20))  # noqa: B023
                yield from record_batches((None, arc) for arc in parse_arc(unpacked(pieces), strict=False))

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(scan, RECORD_SCHEMA)


def status_counts(records: DataFrame) -> DataFrame:
    """(version, status, records): how many records could be read, and why others could not."""
    return records.groupBy("version", "status").agg(F.count(F.lit(1)).alias("records"))


# --- ARC to WARC ---------------------------------------------------------------------------------


def record_id(page_id: int | None, digest: str, url: str = "") -> str:
    """A name-based UUID of page and payload, or of URL and payload where the page has no id."""
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{url if page_id is None else page_id} {digest}')}>"


def warc_date(arc_date: str) -> str:
    """14-digit ARC date (shorter ones are padded) as an ISO time."""
    padded = arc_date + "00000101000000"[len(arc_date) :]
    return datetime.datetime.strptime(padded, "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")


def warc_head(fields: list[tuple[str, object]], length: int) -> bytes:
    return "\r\n".join(["WARC/1.0", *(f"{k}: {v}" for k, v in fields), f"Content-Length: {length}", "", ""]).encode()


def warcinfo(run: str, number: int) -> bytes:
    """The record that opens an archive file, without its closing CRLF CRLF."""
    block = b"software: pagelattice\r\nformat: WARC File Format 1.0\r\ndescription: converted from ARC\r\n"
    name = f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{run} {number}')}>"
    return warc_head([("WARC-Type", "warcinfo"), ("WARC-Record-ID", name), ("WARC-Date", warc_date(CAPTURE_DATE)), ("Content-Type", "application/warc-fields")], len(block)) + block


def warc_record(arc: dict, refers_to: int | None) -> bytes:
    """A WARC record without its closing CRLF CRLF: response, or revisit of ``refers_to``."""
    page_id, payload, digest = arc["page_id"], arc["body"], arc["digest"]
    url = re.sub(r"\s", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), arc["url"])
    head = arc["http"]
    plain = head is None and not re.match(r"(?i)https?:|-?$", url)  # of ftp, dns and the like
    if head is None and not plain:
        code = arc["code"] if arc["code"] and arc["code"].isdigit() and int(arc["code"]) else "200"
        head = http_head(code, arc["type"], arc["length"])
    head = head or b""
    block = head if refers_to is not None else head + payload
    kind = "revisit" if refers_to is not None else "resource" if plain else "response"
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", record_id(page_id, digest, arc["url"])),
        ("WARC-Date", warc_date(arc["date"])),
        ("WARC-Target-URI", url),
        ("WARC-IP-Address", arc["ip"]),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"),
        ("WARC-Source-Format", f"ARC/{arc['version']}"),
        ("X-Payload-Length", arc["length"]),
    ]
    if page_id is not None:
        fields.append(("X-Page-ID", page_id))
    if refers_to is not None:
        fields += [("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Page-ID", refers_to), ("WARC-Profile", "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")]
    return warc_head([*fields, ("Content-Type", arc["type"] if plain else "application/http; msgtype=response")], len(block)) + block


def arc_to_warc(records: DataFrame, min_revisit: int = 0) -> DataFrame:
    """One WARC record (binary ``value``, a gzip member) for each ARC record, after a warcinfo for each partition."""
    parsed = cut(records.where(F.col("status") == OK), "arc_records")
    digests = parsed.where((F.col("length") >= min_revisit) & F.col("page_id").isNotNull()).select("page_id", "digest", "length")
    firsts = digests.groupBy("digest", "length").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("least")).where("refers_to > least").drop("least")
    repeats = hot_join(digests, firsts, ["digest", "length"], ["page_id"]).where("page_id < refers_to").distinct()
    repeats = cut(repeats, "revisits")
    # A page and a hash of its digest tell a revisit; without its body it is a narrow row.
    marks = small_side(repeats.select("page_id", F.xxhash64("digest").alias("mark")), "revisit_marks")
    if is_broadcast(marks):
        revisits = parsed.drop("body").join(repeats, ["page_id", "digest", "length"]).withColumn("body", F.lit(None).cast("binary"))
        responses = parsed.withColumn("mark", F.xxhash64("digest")).join(marks, ["page_id", "mark"], "left_anti").drop("mark")
        joined = responses.withColumn("refers_to", F.lit(None).cast("long")).unionByName(revisits)
    else:
        joined = parsed.join(repeats, ["page_id", "digest", "length"], "left")
    joined = joined.withColumn("number", F.spark_partition_id())
    run = uuid.uuid4().hex  # so that archives of different runs open with different records

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = False
        for batch in slices(batches):
            made = [gzip_member(warc_record(arc, arc["refers_to"])) for arc in batch.to_pylist()]
            if made and not opened:
                opened, made = True, [gzip_member(warcinfo(run, batch.column("number")[0].as_py())), *made]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["value"])

    return joined.mapInArrow(convert, "value binary")


# --- archives ------------------------------------------------------------------------------------


def text_options(target):
    """Raw bytes as rows: Latin-1 names the separator's bytes one by one; rows are neither decoded nor encoded."""
    return target.option("encoding", "ISO-8859-1").option("lineSep", SEPARATOR.decode("latin-1"))


def write_archives(records: DataFrame, path: str) -> None:
    """WARC files of gzip members: one for each partition."""
    text_options(records.select(F.col("value").cast("string").alias("value")).write).text(path)


def parse_warc(pieces: Iterable[bytes]) -> Iterator[tuple[dict, bytes]]:
    """Headers (lower-case names) and block of each record of a byte stream, given in pieces."""
    stream = Stream(pieces)
    while (line := stream.line()) is not None:
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:80]!r}")
        fields = {}
        while (line := stream.header()) != b"":
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        block = stream.take(int(fields["content-length"]))
        if stream.take(4) != END:
            raise ValueError("a WARC record does not end where it declares")
        yield fields, block


ARCHIVE_SCHEMA = "page_id long, url string, record_id string, warc_date string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
ARCHIVE_TYPES = [pa.int64(), *[pa.string()] * 4, pa.int64(), pa.int64(), pa.string(), pa.binary()]


def archive_row(fields: dict, block: bytes) -> tuple | None:
    """A response's or revisit's row; None for other types.

    The payload's digest and length are computed from the bytes of a response and checked against its
    header where it has one; a revisit's come from its headers.
    """
    kind = fields["warc-type"]
    if kind not in ("response", "revisit", "resource"):
        return None
    head, payload = (b"", block) if kind == "resource" else split_http(block)
    declared = fields.get("x-payload-length") or next((x.partition(b":")[2].strip().decode("latin-1") for x in (head or b"").splitlines() if x.lower().startswith(b"content-length:")), "")
    declared = int(declared) if declared.isdigit() else None
    digest = fields.get("warc-payload-digest", "")
    digest = digest.removeprefix("sha1:") if digest.startswith("sha1:") else ""
    if kind != "revisit":
        found = sha1_base32(payload)
        if digest and found != digest:
            raise ValueError(f"payload of {fields['warc-record-id']} is damaged: {found}")
        declared, digest = len(payload), found
    number = lambda name: int(fields[name]) if name in fields else None
    shown = (fields.get("warc-target-uri"), fields["warc-record-id"], fields["warc-date"], kind)
    return (number("x-page-id"), *shown, number("x-refers-to-page-id"), declared, digest or None, payload if kind != "revisit" else None)


def archive_batches(rows: Iterable[tuple | None], most: int = 500, held: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    out, size = [], 0
    names = [field.split(" ")[0] for field in ARCHIVE_SCHEMA.split(", ")]
    make = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), ARCHIVE_TYPES, strict=True)], names)
    for row in rows:
        if row is not None:
            out.append(row)
            size += len(row[-1] or b"")
        if len(out) >= most or size > held:
            yield make()
            out, size = [], 0
    if out:
        yield make()


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, record_id, warc_date, record_type, refers_to, payload_bytes, payload_digest, payload (null
    for revisits) of what ``write_archives`` wrote: a row of text is a gzip member is a record."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members = (x for batch in slices(batches) for x in batch.column("value").to_pylist())
        yield from archive_batches(archive_row(*record) for x in members for record in parse_warc([*unpacked([x]), END]))

    lines = text_options(spark.read).schema("value string").text(path).select(F.col("value").cast("binary").alias("value"))
    return lines.mapInArrow(scan, ARCHIVE_SCHEMA)


def read_warcs(spark: SparkSession, path: str) -> DataFrame:
    """The same columns from ``.warc`` and ``.warc.gz`` files of any writer; page_id and refers_to are null unless marked."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            for blob in batch.column("content").to_pylist():
                pieces = (blob[k : k + (1 << 20)] for k in range(0, len(blob), 1 << 20))  # noqa: B023
                yield from archive_batches(archive_row(*record) for record in parse_warc(unpacked(pieces)))

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(scan, ARCHIVE_SCHEMA)


def round_trip(pages: DataFrame, min_revisit: int = 0) -> DataFrame:
    """Pages as ARC records, written as WARC archives to the shared folder and read back."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(arc_to_warc(arc_records(pages_to_arc(pages)), min_revisit), path)
    return read_archives(spark, path)


_NIBBLE = "(instr('0123456789abcdef', substr(hex, 5 * i // 4 + {}, 1)) - 1)"

ORACLE = f"""
WITH hashed AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
latest AS (SELECT html, max(page_id) AS last FROM hashed GROUP BY html)
SELECT page_id, strlen(h.html) AS payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + (((16 * {_NIBBLE.format(1)} + {_NIBBLE.format(2)}) >> (3 - 5 * i % 4)) & 31) AS BIGINT), 1) FOR i IN range(32)], '') AS payload_digest,
       CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < last THEN last END AS refers_to
FROM hashed h JOIN latest l ON h.html = l.html
"""
