"""WARC archives: a distributed writer, and a reader that salvages what a damaged file still holds.

The writer makes one gzip member for each record, packs members into rows of a bounded size and lets
Spark's text sink write them, with an empty gzip member as the separator between rows: each part
file is a sequence of gzip members, as the format asks for, and the sink's commit protocol covers
lost executors. The reader takes each file as bytes and checks every member and record, digests
included. After a failed check it looks for the next position at which a member, or in plain files
and within a member's content a version line, starts a valid record, goes on there, and logs the gap
as quarantined. Of a member that ends early or fails its checksum, the records that come out whole
before the damage are kept.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .scratch import Scratch

VERSION = b"WARC/1.1"
#: Equal payloads of so many bytes or more are stored once.
REVISIT_BYTES = 1000
#: Bytes of members in a row of the sink, and rows of a part file: a file holds at most so many bytes, or so many larger records.
ROW_BYTES, FILE_ROWS = 4 << 20, 8
#: Rows (of a few dozen bytes) of a table that is broadcast at most; its size is counted first.
SENT = 50_000
#: A whole gzip member without content.
SEPARATOR = bytes.fromhex("1f8b08000000000000030300000000000000") + b"\0\0"
_MAGIC = b"\x1f\x8b\x08"
_VERSION_LINE = re.compile(rb"WARC/[0-9]+\.[0-9]+")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def pack(version: bytes, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A WARC record: version line, named fields, block, and the two line ends after it."""
    lines = [version, *(f"{k}: {v}".encode() for k, v in headers), f"Content-Length: {len(block)}".encode()]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def zipped(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _line_safe(value) -> str:
    return "" if value is None else "".join(" " if c in "\r\n" else c for c in value)


def _record(pid, url, html, digest, first) -> bytes:
    body = (html or "").encode()
    again = first is not None and first != pid
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    headers = [
        ("WARC-Type", "revisit" if again else "response"),
        ("WARC-Record-ID", f"<urn:page:{'' if pid is None else pid}>"),
        ("WARC-Target-URI", _line_safe(url)),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http;msgtype=response"),
    ]
    if again:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{first}>")]
    return zipped(pack(VERSION, headers, http + (b"" if again else body)))


def _members(batches):
    """Pages to rows of gzip members: a row is full at ROW_BYTES."""
    held, size = [], 0
    for batch in batches:
        for row in zip(*(column.to_pylist() for column in batch.columns)):
            held.append(_record(*row))
            size += len(held[-1])
            if size >= ROW_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["members"])
                held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["members"])


def write_pages(spark: SparkSession, pages: DataFrame, path: str) -> None:
    """Writes a record for each row of ``pages`` (page_id, url, html) to gzip WARC files under ``path``.

    The payload is the html in UTF-8; null counts as empty. Of rows with equal payloads of
    REVISIT_BYTES or more the one with the largest page_id is a response and the others revisit
    it; repeated rows of one page_id are alike. Rows with a null page_id are responses. Payloads of
    any length that fits a row are written whole. Other columns are not read; an empty table gives
    an archive without records.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.encode("html", "utf-8")))
    # Digests are grouped and joined without their pages; a page then meets its answer by its own id.
    large = rows.filter((F.octet_length("html") >= REVISIT_BYTES) & F.col("page_id").isNotNull()).select("page_id", "digest").distinct()
    again = large.groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("k")).filter("k > 1").select("digest", "first")
    answers = Scratch(spark, "warc").cut(large.join(again, "digest").select("page_id", "digest", "first"), "answers")
    if answers.count() <= SENT:  # else the pages are shuffled by their ids
        answers = F.broadcast(answers)
    met = rows.join(answers, ["page_id", "digest"], "left").select("page_id", "url", "html", "digest", "first")
    out = met.mapInArrow(_members, "members binary").select(F.col("members").cast("string").alias("value")).write.option("maxRecordsPerFile", FILE_ROWS)
    out.option("encoding", "ISO-8859-1").option("lineSep", SEPARATOR.decode("latin-1")).text(path)


def _member(data: bytes, at: int):
    """(content, end) of the gzip member at ``at``; end is None where it breaks off or a check fails, with what came out before."""
    z, out, to = zlib.decompressobj(31), [], at
    try:
        while not z.eof and to < len(data):
            out.append(z.decompress(data[to : to + 16384]))
            to += 16384
    except zlib.error:
        # The last piece in smaller steps, for what it gives before the fault.
        z, out, to = zlib.decompressobj(31), [], at
        try:
            while to < len(data):
                out.append(z.decompress(data[to : to + 256]))
                to += 256
        except zlib.error:
            return b"".join(out), None
    return b"".join(out), min(to, len(data)) - len(z.unused_data) if z.eof else None


class _Marks:
    """The next place of a pattern from a position on, for positions that only grow: the bytes are searched once."""

    def __init__(self, data: bytes, pattern: bytes):
        self.data, self.pattern, self.found = data, pattern, -1

    def after(self, at: int) -> int:
        if self.found < at:
            where = self.data.find(self.pattern, at)
            self.found = where if where >= 0 else len(self.data)
        return self.found


def _digest_holds(declared: str | None, content: bytes) -> bool:
    """Whether a digest field agrees with the content; a missing one and unknown algorithms do."""
    name, _, value = (declared or "").partition(":")
    name = name.strip().lower().replace("-", "")
    if name not in ("md5", "sha1", "sha256", "sha512") or not value.strip():
        return True
    raw = hashlib.new(name, content).digest()
    return value.strip().lower() == raw.hex() or value.strip().upper().rstrip("=") == base64.b32encode(raw).decode().rstrip("=")


def parse(data: bytes, at: int = 0):
    """(headers, block start, block end, record end) of the WARC record at ``at``; None if a check fails.

    A block digest is held against the block and, but for revisits, a payload digest against the
    body of an HTTP message or the block of any other record. Header lines are read one by one, up
    to the first that is none.
    """
    to = data.find(b"\r\n", at)
    if to < 0 or not _VERSION_LINE.fullmatch(data[at : min(to, at + 20)]):
        return None
    fields = {}
    while True:
        line_end = data.find(b"\r\n", to + 2)
        if line_end < 0:
            return None
        if line_end == to + 2:
            break
        name, colon, value = data[to + 2 : line_end].partition(b":")
        if not colon:
            return None
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
        to = line_end
    end = to
    size = fields.get("content-length", "")
    if not size.isascii() or not size.isdigit():
        return None
    start, stop = end + 4, end + 4 + int(size)
    if data[stop : stop + 4] != b"\r\n\r\n":
        return None
    block = data[start:stop]
    if not _digest_holds(fields.get("warc-block-digest"), block):
        return None
    payload = _http(block)[0] if fields.get("content-type", "").lower().startswith("application/http") else block
    if fields.get("warc-type") != "revisit" and not _digest_holds(fields.get("warc-payload-digest"), payload):
        return None
    return fields, start, stop, stop + 4


def _records(data: bytes):
    """Yields ("record", start, end, headers, block) and ("gap", start, end, "", b"") over the version lines of plain bytes."""
    at, bad = 0, None
    lines = _Marks(data, b"WARC/")
    while at < len(data):
        rec = parse(data, at)
        if rec is None:
            bad = at if bad is None else bad
            at = lines.after(at + 1)
            continue
        if bad is not None:
            yield "gap", bad, at, "", b""
            bad = None
        yield "record", at, rec[3], rec[0], data[rec[1] : rec[2]]
        at = rec[3]
    if bad is not None:
        yield "gap", bad, len(data), "", b""


def salvage(data: bytes):
    """Yields ("record", start, end, headers, block) and ("gap", start, end, reason, b"") over the bytes of an archive, as ``located`` does."""
    for *row, _ in located(data):
        yield tuple(row)


def located(data: bytes):
    """Yields ("record", start, end, headers, block, inner) and ("gap", start, end, reason, b"", inner) over the bytes of an archive, gzip or plain, mixed or damaged.

    ``inner`` is (start, end) within the content of the member from ``start`` on, or None in plain
    parts and for gaps outside of members. Gaps with no inner part don't overlap; a member that breaks
    off may give records from within the gap that it is logged as.
    """
    at, bad, reason = 0, None, ""
    members, lines = _Marks(data, _MAGIC), _Marks(data, b"WARC/")
    while at < len(data):
        found, end, fault = [], None, "no member or version line"
        if data.startswith(_MAGIC, at):
            content, end = _member(data, at)
            found, fault = list(_records(content)), "damaged member"
            if end is None:  # what came out whole before the damage; the rest is the gap's
                for kind, a, b, headers, block in found:
                    if kind == "record":
                        yield kind, at, at, headers, block, (a, b)
        elif data.startswith(b"WARC/", at):
            rec = parse(data, at)
            fault = "damaged record"
            if rec is not None:
                end = rec[3]
        if end is None:
            if bad is None:
                bad, reason = at, fault
            at = min(members.after(at + 1), lines.after(at + 1))
            continue
        if bad is not None:
            yield "gap", bad, at, reason, b"", None
            bad = None
        if data.startswith(_MAGIC, at):
            for kind, a, b, headers, block in found:
                yield kind, at, end, headers if kind == "record" else "damaged record in a member", block, (a, b)
        else:
            yield "record", at, end, rec[0], data[rec[1] : rec[2]], None
        at = end
    if bad is not None:
        yield "gap", bad, len(data), reason, b"", None


def _http(block: bytes):
    """(payload, length that the HTTP header names) of an HTTP message."""
    head, _, body = block.partition(b"\r\n\r\n")
    for line in head.split(b"\r\n"):
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length" and value.strip().isdigit():
            return body, int(value)
    return body, None


_READ = "file string, kind string, start long, end long, inner_start long, inner_end long, record_id string, record_type string, uri string, refers_to string, digest string, payload binary, payload_bytes long, reason string"
_FIELDS = ("warc-record-id", "warc-type", "warc-target-uri", "warc-refers-to", "warc-payload-digest")


def _salvaged(batches):
    for batch in batches:
        for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            rows, held = [], 0
            for kind, start, end, headers, block, inner in located(content.as_py()):
                place = (name, kind, start, end, *(inner or (None, None)))
                if kind == "gap":
                    rows.append((*place, *[None] * 7, headers))
                else:
                    payload, size = _http(block)
                    again = headers.get("warc-type") == "revisit"
                    rows.append((*place, *(headers.get(f) for f in _FIELDS), None if again else payload, size if again else len(payload), None))
                    held += len(block)
                if held > 1 << 22:
                    yield _table(rows)
                    rows, held = [], 0
            yield _table(rows)


def _table(rows):
    kinds = [pa.string(), pa.string(), *[pa.int64()] * 4, *[pa.string()] * 5, pa.binary(), pa.int64(), pa.string()]
    names = [x.split()[0] for x in _READ.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records and quarantined gaps (``kind``) of the archives under ``path``, with byte offsets in their files.

    ``inner_start`` and ``inner_end`` are offsets in the content of the member that stands at
    start. For a revisit ``payload`` is null and payload_bytes the length that its HTTP header names. A
    gap covers bytes that are no part of a valid record; empty files have no rows.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_salvaged, _READ)


def quarantined(spark: SparkSession, path: str) -> DataFrame:
    """The log of the gaps in the archives under ``path``: (file, start, end, inner_start, inner_end, reason)."""
    return read_archives(spark, path).filter("kind = 'gap'").select("file", "start", "end", "inner_start", "inner_end", "reason")


def page_records(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Writes ``pages`` and reads the archives back: (page_id, payload_bytes, payload_digest, record_type, refers_to).

    The digest of a response is computed from the bytes read; a revisit's is the one it declares.
    Null html is an empty payload; repeated rows come back as often as they are given; of equal
    payloads under three or more ids, the largest id is the response of all. ``quarantined`` gives
    the gaps of an archive; one just written has none.
    """
    path = Scratch(spark, "warc").path("archive")
    write_pages(spark, pages, path)
    got = read_archives(spark, path).filter("kind = 'record'")
    number = lambda c: F.regexp_extract(c, "urn:page:(-?[0-9]+)", 1).try_cast("long")
    digest = F.when(F.col("payload").isNull(), F.regexp_replace("digest", "^sha1:", "")).otherwise(F.sha1("payload"))
    return got.select(number(F.col("record_id")).alias("page_id"), "payload_bytes", digest.alias("payload_digest"), "record_type", number(F.col("refers_to")).alias("refers_to"))


OP10_SQL = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to
FROM m
"""
