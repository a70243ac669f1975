"""WARC archives: a writer with revisit records, and a sequential reader.

One gzip member holds one record.  ``write_archives`` gives rows (archive, content): complete
.warc.gz files of bounded size as binary columns, which Spark stores wherever it can write.
``read_archives`` decompresses members incrementally, frames records by Content-Length and
verifies block and payload digests; a digest that doesn't match fails the job.

Null html is an empty payload, null page ids and urls are written as absent.  Of equal
payloads of at least ``least`` bytes, rows with the smallest page id are responses (all of
them, if rows repeat) and the rest revisits; smaller payloads are responses.  A row that repeats
page and payload is written again under the same record id.  Payloads of any length are one
record; other columns are not read.  An empty table gives no archive.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ARCHIVE_BYTES = 8 << 20


def digest(raw: bytes) -> str:
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def member(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as one gzip member."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + f"Content-Length: {len(block)}\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(head.encode()) + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def members(content: bytes, step: int = 1 << 16) -> Iterator[bytes]:
    """Records of an archive, each decompressed step by step."""
    at = 0
    while at < len(content):
        z, out = zlib.decompressobj(31), []
        while not z.eof:
            if at >= len(content):
                raise ValueError("the archive ends inside a record")
            out.append(z.decompress(content[at : at + step]))
            at += step
        at = min(at, len(content)) - len(z.unused_data)
        yield b"".join(out)


def record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block, framed by Content-Length."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines)
    size = int(fields["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("the block's length differs from Content-Length")
    return fields, rest[:size]


def page_name(page: str | None) -> str:
    return "urn:page:none" if page is None else f"urn:page:{page}"


def record_id(name: str, payload: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name} {payload}')}>"


def with_first(pages: DataFrame, least: int) -> DataFrame:
    """page_id, url, html, and first_id of revisits: the smallest page id with the same payload."""
    keyed = pages.select("page_id", "url", "html", F.sha1(F.coalesce("html", F.lit(""))).alias("sha1_hex"))
    repeated = (
        keyed.filter(F.octet_length(F.coalesce("html", F.lit(""))) >= least)
        .groupBy("sha1_hex").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
        .filter("n > 1").drop("n")
    )
    found = keyed.join(repeated, "sha1_hex", "left")
    revisit = F.col("first_id").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") != F.col("first_id")))
    # ids as strings, for pandas would make doubles of whole numbers beside a null
    return found.select(F.col("page_id").cast("string"), "url", "html", F.when(revisit, F.col("first_id").cast("string")).alias("first_id"))


def write_archives(pages: DataFrame, least: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """archive (name), content (binary) of a .warc.gz file; records of a file come from one task."""

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, size = [], 0
        for pdf in frames:
            for page, url, html, first in zip(*(pdf[c].tolist() for c in ("page_id", "url", "html", "first_id")), strict=True):
                raw = html.encode() if html else b""
                payload, revisit = digest(raw), first is not None
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(raw)}\r\n\r\n".encode()
                block = http if revisit else http + raw
                name = page_name(page)
                fields = [
                    ("WARC-Type", "revisit" if revisit else "response"),
                    ("WARC-Record-ID", record_id(name, payload)),
                    ("WARC-Page-ID", name),
                    ("WARC-Date", date),
                    ("WARC-Target-URI", "".join(url.split()) if url else "about:blank"),
                    ("Content-Type", "application/http; msgtype=response"),
                    ("WARC-Block-Digest", f"sha1:{digest(block)}"),
                    ("WARC-Payload-Digest", f"sha1:{payload}"),
                ]
                if revisit:
                    fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(page_name(first), payload)), ("WARC-Refers-To-Page-ID", page_name(first))]
                out.append(member(fields, block))
                size += len(out[-1])
                if size >= ARCHIVE_BYTES:
                    yield file(out)
                    out, size = [], 0
        if out:
            yield file(out)

    def file(out: list[bytes]) -> pd.DataFrame:
        content = b"".join(out)
        return pd.DataFrame({"archive": [f"pages-{hashlib.sha1(content).hexdigest()[:16]}.warc.gz"], "content": [content]})

    return with_first(pages, least).mapInPandas(write, "archive string, content binary")


def read_archives(archives: DataFrame) -> DataFrame:
    """A row per record; payload is null in revisits, whose length is that of the HTTP header they keep."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for content in pdf["content"].tolist():
                out = []
                for raw in members(content):
                    fields, block = record(raw)
                    if fields["WARC-Block-Digest"] != f"sha1:{digest(block)}":
                        raise ValueError("a block differs from its digest")
                    http, _, payload = block.partition(b"\r\n\r\n")
                    length = int(http.decode().rpartition("Content-Length: ")[2])
                    kind, named = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and (length != len(payload) or named != digest(payload)):
                        raise ValueError("a payload differs from its length or digest")
                    page = fields["WARC-Page-ID"].rpartition(":")[2]
                    first = fields.get("WARC-Refers-To-Page-ID", "").rpartition(":")[2]
                    out.append((None if page == "none" else page, fields["WARC-Target-URI"], length, named, kind, first or None, payload.decode() if kind == "response" else None))
                yield pd.DataFrame(out, columns=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

    return archives.select("content").mapInPandas(read, "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload string")
