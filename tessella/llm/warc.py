"""WARC derivatives: metadata and plain-text conversion records of responses (operator 1)."""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urljoin

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: The date and HTTP headers of responses that are made from a table of pages, which has none.
PAGE_DATE, PAGE_HEADERS = "2024-01-01T00:00:00Z", "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8"
RESPONSE = "page_id long, record_id string, target_uri string, date string, http_headers string, payload binary"
#: What WARC files give besides: the digests that the record states, and why a place in a file could not be read (all else null there).
STATED = "payload_digest string, block_digest string, failure string"
#: Bytes that a member is inflated by, and payload bytes and rows of a frame at most (one row at least).
PIECE, FRAME_BYTES, FRAME_ROWS = 1 << 16, 16 << 20, 1000
DERIVED = (
    "page_id long, record_type string, record_id string, refers_to string, target_uri string, date string, content_type string, "
    "source_headers string, source_digest string, block_digest string, content_length long, content string"
)
# Elements of HTML whose content isn't text, and those that end a line.
_UNSEEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|title)\b[^<>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_LINE = re.compile(r"</?(?:address|article|aside|blockquote|body|br|caption|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|option|p|pre|section|table|tbody|td|tfoot|th|thead|tr|ul)\b[^<>]*>", re.I)
_TAG = re.compile(r"<[a-zA-Z/!?][^<>]*>")
_TITLE = re.compile(r"<title\b[^<>]*>(.*?)(?:</title\s*>|\Z)", re.S | re.I)
_LANG = re.compile(r"<html\b[^<>]*?\blang\s*=\s*[\"']?([\w-]+)", re.I)
_LINK = re.compile(r"<a\b[^<>]*?\bhref\s*=\s*(?:\"([^\"<>]*)\"|'([^'<>]*)'|([^\s<>\"']+))", re.I)
_CHUNK = re.compile(rb"([0-9a-fA-F]{1,8})[ \t]*(?:;[^\r\n]*)?\r?\n")
_PADDING, _START = re.compile(rb"[\s\0]*"), re.compile(rb"WARC/\d+\.\d+[ \t]*\r?\n[\w-]+[ \t]*:")
_RESUME = re.compile(rb"\x1f\x8b\x08|" + _START.pattern)
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w.:-]+)", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_uuid(*parts: str) -> str:
    """An identifier that the parts fix, so that reruns name the same records."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(31).join(parts))}>"


def plain_text(source: str) -> str:
    """Visible text of HTML: block elements end lines, runs of white space shrink to one space or line end."""
    text = html.unescape(_TAG.sub("", _LINE.sub("\n", _UNSEEN.sub(" ", source))))
    lines = (re.sub(r"\s+", " ", line).strip() for line in text.split("\n"))
    return "\n".join(line for line in lines if line)


def outlinks(source: str, base: str) -> list[str]:
    """Absolute targets of a page's links, each once, in order; one that can't be resolved stays as it is."""
    found = {}
    for m in _LINK.finditer(_UNSEEN.sub(" ", source)):
        href = html.unescape(m[1] or m[2] or m[3] or "").strip()
        try:
            href = urljoin(base, href)
        except ValueError:
            pass
        if href:
            found[re.sub(r"\s", "%20", href)] = None
    return list(found)


def decoded(payload: bytes, headers: str) -> str:
    """A payload's text by the charset of its headers or of its first kilobyte, else UTF-8; bad bytes become U+FFFD."""
    m = _CHARSET.search(headers) or _CHARSET.search(payload[:1024].decode("latin-1"))
    try:
        return payload.decode(m[1] if m else "utf-8", "replace")
    except LookupError:
        return payload.decode("utf-8", "replace")


def unchunked(body: bytes) -> bytes:
    """A chunked body joined; as it is if it isn't chunked after all, as where the crawler has joined it."""
    out, pos = [], 0
    while m := _CHUNK.match(body, pos):
        size = int(m[1], 16)
        out.append(body[m.end() : m.end() + size])
        pos = m.end() + size
        if not size or pos >= len(body):  # the end, or cut off
            return b"".join(out)
        pos += 2 if body[pos : pos + 2] == b"\r\n" else body[pos : pos + 1] == b"\n"
    return body


def _inflated(data: bytes, bits: int) -> bytes:
    """What can be inflated of data that may be cut off or damaged."""
    out = []
    while data:
        inflate = zlib.decompressobj(bits)
        try:
            for i in range(0, len(data), PIECE):
                out.append(inflate.decompress(data[i : i + PIECE]))
                if inflate.eof:
                    break
        except zlib.error:
            break
        rest = inflate.unused_data + data[i + PIECE :]
        data = rest if inflate.eof and rest[:2] == b"\x1f\x8b" else b""
    return b"".join(out)


def entity(payload: bytes, headers: str) -> tuple[bytes, str | None]:
    """A payload without its transfer and content encodings, and the name of the encoding that can't be undone, if any (the rest is then empty)."""
    fields = [(k.strip().lower(), v.strip().lower()) for k, _, v in (line.partition(":") for line in headers.splitlines()[1:])]
    codings = [c.strip() for name in ("content-encoding", "transfer-encoding") for k, v in fields if k == name for c in v.split(",") if c.strip()]
    for coding in reversed(codings):
        if coding == "chunked":
            payload = unchunked(payload)
        elif coding in ("gzip", "x-gzip"):
            payload = _inflated(payload, 31) if payload[:2] == b"\x1f\x8b" else payload
        elif coding == "deflate":
            payload = _inflated(payload, 15) or _inflated(payload, -15) or payload
        elif coding == "zstd":
            try:
                payload = zstandard.ZstdDecompressor().decompressobj().decompress(payload) if payload[:4] == b"\x28\xb5\x2f\xfd" else payload
            except zstandard.ZstdError:
                return b"", coding
        elif coding != "identity":
            return b"", coding
    return payload, None


def derive(page_id, record_id: str, uri: str | None, date: str, headers: str, payload: bytes, stated: str | None = None, block_digest: str | None = None) -> list[tuple]:
    """The metadata and the conversion record of a response (rows of DERIVED)."""
    body, unknown = entity(payload, headers)
    source, own = decoded(body, headers), digest(payload)
    title, lang = _TITLE.search(source), _LANG.search(source)
    text = plain_text(source)
    meta = [f"conversion: {record_uuid('conversion', record_id, own)}", f"payload-length: {len(payload)}", f"text-length: {len(text)}"]
    meta += [f"source-block-digest: {block_digest}"] if block_digest else []
    meta += [f"not-decoded: {unknown}"] if unknown else []
    if title:
        meta.append(f"title: {re.sub(r'\s+', ' ', html.unescape(title[1])).strip()}")
    if lang:
        meta.append(f"language: {lang[1]}")
    meta += [f"http-{line}" for line in headers.split("\r\n")[1:] if line] + [f"outlink: {x}" for x in outlinks(source, uri or "")]
    out = []
    for kind, content_type, content in (("metadata", "application/warc-fields", "\r\n".join(meta) + "\r\n"), ("conversion", "text/plain; charset=utf-8", text)):
        data = content.encode("utf-8", "replace")
        out.append((page_id, kind, record_uuid(kind, record_id, own), record_id, uri, date, content_type, headers, stated or own, digest(data), len(data), data.decode()))
    return out


def page_responses(pages: DataFrame) -> DataFrame:
    """Response records (RESPONSE) of a table of pages (page_id, url, html). Null html is an empty payload."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            payload = [x.encode() for x in batch["html"]]
            ids = [record_uuid("response", str(i), u or "", digest(p)) for i, u, p in zip(batch["page_id"].astype(object), batch["url"], payload)]
            yield pd.DataFrame({"page_id": batch["page_id"], "record_id": ids, "target_uri": batch["url"], "date": PAGE_DATE, "http_headers": PAGE_HEADERS, "payload": payload})

    # The id is text on the way, so that a null doesn't turn whole numbers into floating ones.
    source = pages.select(F.col("page_id").cast("string").alias("page_id"), F.col("url"), text_of("html").alias("html"))
    rows = source.mapInPandas(run, RESPONSE.replace("page_id long", "page_id string"))
    return rows.withColumn("page_id", F.col("page_id").cast("long"))


def derivatives(responses: DataFrame) -> DataFrame:
    """Two rows (DERIVED) for each response (RESPONSE): its metadata and its conversion record.

    refers_to is the response's record id, source_headers its HTTP headers and source_digest the digest that it states for its payload, else
    the payload's SHA-1 as it is stored; the metadata record names the conversion record and the stated block digest. Text is made of
    the payload without its transfer and content encodings. A failure of read_responses stays one row of record_type failure. Ids are fixed by content, so reruns agree and repeated responses give
    repeated rows. Null payloads and headers count as empty, a null target stays null; an empty table gives no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in DERIVED.split(", ")]
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                if r.failure is not None:
                    rows.append((r.page_id, "failure", *[None] * 8, 0, r.failure))
                else:
                    rows += derive(r.page_id, r.record_id or "", r.target_uri, r.date, r.http_headers or "", bytes(r.payload or b""), r.payload_digest, r.block_digest)
            yield pd.DataFrame(rows, columns=names)

    stated = [c.split()[0] for c in STATED.split(", ")]
    names = [c.split()[0] for c in RESPONSE.split(", ")]
    source = responses.select(F.col("page_id").cast("string").alias("page_id"), *names[1:], *[F.col(c) if c in responses.columns else F.lit(None).cast("string").alias(c) for c in stated])
    return source.mapInPandas(run, DERIVED.replace("page_id long", "page_id string")).withColumn("page_id", F.col("page_id").cast("long"))


def record_bytes(kind: str, record_id: str, fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    """One WARC 1.0 record as a gzip member; members in any order make up a .warc.gz file."""
    head = [("WARC-Type", kind), ("WARC-Record-ID", record_id), *fields, ("WARC-Block-Digest", digest(block)), ("Content-Length", str(len(block)))]
    raw = "WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head if v is not None) + "\r\n"
    return gzip.compress(raw.encode() + block + b"\r\n\r\n", mtime=0)


def warc_members(derived: DataFrame) -> DataFrame:
    """(page_id, record_id, member: binary) for each derived record; failures have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            members = [
                record_bytes(r.record_type, r.record_id, [("WARC-Refers-To", r.refers_to), ("WARC-Target-URI", r.target_uri), ("WARC-Date", r.date), ("WARC-Source-Payload-Digest", r.source_digest), ("Content-Type", r.content_type)], r.content.encode())
                for r in batch.itertuples(index=False)
            ]
            yield pd.DataFrame({"page_id": batch["page_id"], "record_id": batch["record_id"], "member": members})

    source = derived.where("record_type <> 'failure'").withColumn("page_id", F.col("page_id").cast("string"))
    return source.mapInPandas(run, "page_id string, record_id string, member binary").withColumn("page_id", F.col("page_id").cast("long"))


class _Member(io.RawIOBase):
    """A gzip member that starts at a place of a file, inflated piece by piece; ``end`` is where the next begins, once it is read."""

    def __init__(self, data: bytes, start: int):
        self.data, self.next, self.inflate, self.end = memoryview(data), start, zlib.decompressobj(31), None

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while self.end is None:
            given = self.inflate.unconsumed_tail
            if not given:
                given = self.data[self.next : self.next + PIECE]
                self.next += len(given)
                if not given:
                    raise EOFError("gzip member is cut off")
            out = self.inflate.decompress(given, len(into))
            if self.inflate.eof:
                self.end = self.next - len(self.inflate.unused_data)
            if out:
                into[: len(out)] = out
                return len(out)
        return 0


def _record(stream) -> tuple[dict[str, str], bytes] | None:
    """The next record of a stream, None at its end; ValueError if there is something else."""
    while (line := stream.readline()) and not line.strip(b"\0 \t\r\n"):
        pass
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError("no record begins here")
    fields = {}
    while (line := stream.readline().strip()) and b":" in line:
        key, _, value = line.decode("utf-8", "replace").partition(":")
        fields[key.strip().lower()] = value.strip()
    size = fields.get("content-length", "")
    if not (size.isascii() and size.isdigit()):
        raise ValueError("record without Content-Length")
    block = stream.read(int(size))
    if len(block) < int(size):
        raise ValueError("record is cut off")
    return fields, block


def _resume(data: bytes, start: int) -> int:
    """The next place after ``start`` where a record begins, plain or as a gzip member; the file's end if there is none.

    After a damaged member only members are sought: it may hold the beginning of a record uncompressed.
    """
    zipped = data[start : start + 2] == b"\x1f\x8b"
    for m in _RESUME.finditer(data, start + 1):
        if m[0][:1] == b"W":
            if zipped:
                continue
            return m.start()
        try:
            if zlib.decompressobj(31).decompress(data[m.start() : m.start() + 4096], 256).lstrip(b"\0 \t\r\n").startswith(b"WARC/"):
                return m.start()
        except zlib.error:
            pass
    return len(data)


def parse_parts(data: bytes) -> Iterator[tuple[dict[str, str], bytes] | str]:
    """The records of a WARC file, gzipped by member or plain, and for each place that can't be read the reason, from where the next record is sought."""
    pos = 0
    while (pos := _PADDING.match(data, pos).end()) < len(data):
        try:
            if data[pos : pos + 2] == b"\x1f\x8b":
                member = _Member(data, pos)
                stream, held = io.BufferedReader(member, PIECE), None
                while True:
                    try:
                        found = _record(stream)
                        if held is not None:  # a record counts once what follows is sound: at a member's end its checksum is
                            yield held
                        if (held := found) is None:
                            break
                    except ValueError as e:  # the member may go on with other records
                        yield f"offset {pos}: {e}"
                        while (line := stream.peek(5)[:5]) and line != b"WARC/":
                            stream.readline()
                pos = member.end
            else:
                stream = io.BytesIO(data)
                stream.seek(pos)
                found, end = _record(stream), stream.tell()
                if data[end : end + 1] not in (b"", b"\r", b"\n", b"\0", b"\x1f", b"W"):
                    raise ValueError("Content-Length does not end at a record's end")
                yield found
                pos = end
        except (ValueError, EOFError, zlib.error) as e:
            yield f"offset {pos}: {e}"
            pos = _resume(data, pos)


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of the records of a WARC file that can be read."""
    return (part for part in parse_parts(data) if not isinstance(part, str))


def read_responses(files: DataFrame) -> DataFrame:
    """Response records (RESPONSE and STATED, page_id null) of WARC files in rows of Spark's ``binaryFile`` source (column content; path, if there, is named in failures).

    A place that can't be read gives a row with failure alone, and reading goes on at the next record.
    """
    names = [c.split()[0] for c in f"{RESPONSE}, {STATED}".split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                rows, held = [], 0
                for part in parse_parts(bytes(content or b"")):
                    if isinstance(part, str):
                        rows.append((*[None] * 8, f"{path}, {part}" if path else part))
                    elif part[0].get("warc-type", "").lower() == "response":
                        fields, block = part
                        head, _, payload = block.partition(b"\r\n\r\n")
                        stated = (fields.get("warc-record-id"), fields.get("warc-target-uri"), fields.get("warc-date"))
                        rows.append((None, *stated, head.decode("latin-1"), payload, fields.get("warc-payload-digest"), fields.get("warc-block-digest"), None))
                        held += len(payload)
                    if held >= FRAME_BYTES or len(rows) >= FRAME_ROWS:
                        yield pd.DataFrame(rows, columns=names)
                        rows, held = [], 0
                yield pd.DataFrame(rows, columns=names)

    source = files.select(F.col("path") if "path" in files.columns else F.lit(None).cast("string").alias("path"), "content")
    return source.mapInPandas(run, f"{RESPONSE}, {STATED}".replace("page_id long", "page_id string")).withColumn("page_id", F.col("page_id").cast("long"))
