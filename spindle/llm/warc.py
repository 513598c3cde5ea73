"""WARC derivatives: each response record gives a metadata record and a plain-text conversion record that refer to it.

The derivatives keep the response's target URI, date and digests, name it in WARC-Refers-To, and carry its HTTP status
and headers; their own ids are name-based, so a second run gives the same records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, tidy
from .extraction import lines

CRLF = b"\r\n"
#: Bytes that are unpacked at once.
STEP = 1 << 16


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def write(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record, uncompressed."""
    head = ["WARC/1.1", *(f"{k}: {' '.join(v.split())}" for k, v in headers), f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + CRLF * 2 + block + CRLF * 2


def fields(data: bytes) -> list[tuple[str, str]]:
    """Header lines, in order, folded lines joined."""
    out: list[tuple[str, str]] = []
    for line in data.decode("utf-8", "replace").splitlines():
        if line[:1] in " \t" and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}")
        elif ":" in line:
            k, v = line.split(":", 1)
            out.append((k.strip(), v.strip()))
    return out


def get(headers: list[tuple[str, str]], name: str) -> str | None:
    return next((v for k, v in headers if k.lower() == name.lower()), None)


def read(data: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """(headers, block) of each record of a file, gzip members or plain; stops where the file is cut or broken. Members
    are unpacked one at a time."""
    at = 0
    while data[at : at + 2] == b"\x1f\x8b":
        member, plain = zlib.decompressobj(31), []
        try:
            while at < len(data) and not member.eof:
                plain.append(member.decompress(data[at : at + STEP]))
                at += min(STEP, len(data) - at) - len(member.unused_data)
        except zlib.error:
            return
        yield from read(b"".join(plain))
    while True:
        while data[at : at + 2] == CRLF:
            at += 2
        end = data.find(CRLF * 2, at)
        if not data.startswith(b"WARC/", at) or end < 0:
            return
        headers = fields(data[data.find(CRLF, at) : end])
        try:
            size = int(get(headers, "content-length") or "")
        except ValueError:
            return
        block = data[end + 4 : end + 4 + size]
        if size < 0 or len(block) < size:
            return
        yield headers, block
        at = end + 4 + size


def http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers and body of an HTTP response, chunks and gzip undone."""
    head, _, body = block.partition(CRLF * 2)
    status, _, rest = head.partition(CRLF)
    headers = fields(rest)
    if (get(headers, "transfer-encoding") or "").lower() == "chunked":
        plain, at = [], 0
        while (end := body.find(CRLF, at)) >= 0:
            try:
                n = int(body[at:end].split(b";")[0], 16)
            except ValueError:
                break
            if not n:
                break
            plain.append(body[end + 2 : end + 2 + n])
            at = end + 4 + n
        body = b"".join(plain)
    if (get(headers, "content-encoding") or "").lower() in ("gzip", "x-gzip"):
        try:
            body = gzip.decompress(body)
        except (OSError, EOFError, zlib.error):
            body = b""
    return status.decode("latin-1"), headers, body


def plain_text(headers: list[tuple[str, str]], body: bytes) -> str | None:
    """Visible text of an HTML body, the body itself of other text, None of anything else."""
    kind = (get(headers, "content-type") or "text/html").lower()
    if not (kind.startswith("text/") or "html" in kind or "xml" in kind):
        return None
    named = re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", kind) or re.search(rb"<meta[^>]+charset\s*=\s*[\"']?([\w.:-]+)", body[:2048], re.I)
    name = named[1] if named and isinstance(named[1], str) else named[1].decode("ascii", "replace") if named else "utf-8"
    try:
        text = body.decode(name, "replace")
    except LookupError:
        text = body.decode("utf-8", "replace")
    return "\n".join(s for _, s in lines(text)) if "html" in kind or "xml" in kind else text


DERIVED = [("key", "long"), ("kind", "string"), ("record_id", "string"), ("refers_to", "string"), ("target_uri", "string"), ("date", "string"), ("source_payload_digest", "string"), ("source_block_digest", "string"), ("payload_digest", "string"), ("text", "string"), ("record", "binary")]
_ARROW = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
SCHEMA = pa.schema([(k, _ARROW[v]) for k, v in DERIVED])


def derive_one(key: int | None, headers: list[tuple[str, str]], block: bytes) -> list[tuple]:
    """The two derivatives of a response record; none of a record of another type, or of a response without an id."""
    source = get(headers, "warc-record-id")
    if (get(headers, "warc-type") or "").lower() != "response" or not source:
        return []
    status, source_headers, body = http(block)
    uri, date = get(headers, "warc-target-uri") or "", get(headers, "warc-date") or ""
    payload, whole = get(headers, "warc-payload-digest") or digest(body), get(headers, "warc-block-digest") or digest(block)
    out, ids = [], {kind: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{source} {kind}')}>" for kind in ("metadata", "conversion")}
    text = plain_text(source_headers, body)
    told = [("http-status", status), *((f"http-header-{k.lower()}", v) for k, v in source_headers), ("source-payload-digest", payload), ("source-block-digest", whole), ("source-content-length", str(len(block)))]
    if text is not None:
        told.append(("conversion-record", ids["conversion"]))
    parts = [("metadata", "application/warc-fields", "".join(f"{k}: {v}\r\n" for k, v in told).encode(), None)]
    if text is not None:
        parts.append(("conversion", "text/plain; charset=utf-8", text.encode("utf-8", "replace"), text))
    for kind, content, data, shown in parts:
        mine = digest(data)
        linked = [("WARC-Type", kind), ("WARC-Record-ID", ids[kind]), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Refers-To", source), ("WARC-Refers-To-Target-URI", uri), ("WARC-Refers-To-Date", date)]
        if kind == "metadata":
            linked += [("WARC-Concurrent-To", source)]
        record = write([*linked, ("WARC-Block-Digest", mine), ("WARC-Payload-Digest", mine), ("Content-Type", content)], data)
        out.append((key, kind, ids[kind], source, uri, date, payload, whole, mine, shown, record))
    return out


def deriver(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    held = 0
    for b in batches:
        for key, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            for headers, block in read(data or b""):
                new = derive_one(key, headers, block)
                out += new
                held += sum(len(r[-1]) for r in new)
                if held > 1 << 23:
                    yield batch(SCHEMA, list(zip(*out, strict=True)))
                    out, held = [], 0
    if out:
        yield batch(SCHEMA, list(zip(*out, strict=True)))


def derivatives(records: DataFrame, key_col: str = "key", record_col: str = "record") -> DataFrame:
    """The derivatives of all response records in a binary column, whose rows are one record or a whole file each.

    key is that of the row, null where it is null. Nulls and broken data give nothing beyond their whole records; rows
    that repeat a record repeat its derivatives, with the same ids. A response that isn't text has a metadata record
    only; very long ones are one record like others. Other columns are ignored. Empty tables give none.
    """
    src = records.select(F.col(key_col).cast("long").alias("key"), F.col(record_col).alias("record"))
    return src.mapInArrow(tidy(deriver), ", ".join(f"{k} {v}" for k, v in DERIVED))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """WARC files, gzip or plain, as rows (key, record) for derivatives(); a file of at most 2 GB a row. An empty folder
    gives none."""
    return spark.read.format("binaryFile").load(path).select(F.xxhash64("path").alias("key"), F.col("content").alias("record"))


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(key, record): a page of each row as a response record, its id made from page id and url. Nulls are empty; rows that
    repeat a page repeat its record; other columns are ignored; empty tables give none."""
    schema = pa.schema([("key", pa.int64()), ("record", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for i, url, page in zip(*(c.to_pylist() for c in b.columns), strict=True):
                body = (page or "").encode("utf-8", "replace")
                block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body) + body
                name = uuid.uuid5(uuid.NAMESPACE_URL, f"{i} {url or ''}")
                made.append(write([("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:uuid:{name}>"), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Target-URI", url or ""), ("WARC-Payload-Digest", digest(body)), ("WARC-Block-Digest", digest(block)), ("Content-Type", "application/http; msgtype=response")], block))
            yield batch(schema, [b.column(0), made])

    src = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return src.mapInArrow(tidy(run), "key long, record binary")
