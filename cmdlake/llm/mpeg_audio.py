"""MPEG audio columns: frames that carry a payload, and a resynchronising frame reader.

``encode_media`` stores bytes in MPEG-1 layer III frames (48 kHz, mono, checksummed) behind an
ID3v2 tag and a Xing frame with seek table; 192-byte units go three, two or one to a frame, so
the stream has a variable bit rate.  ``read_media`` parses any such column: it skips tags,
searches for the next valid header after damage, reads the variable-bitrate table (Xing, Info
or VBRI) with its seek places, verifies layer III checksums, and gives exact durations and frame
offsets of MPEG-1, 2 and 2.5 in all three layers.

Null payloads count as empty; a payload is padded with spaces to a positive multiple of 192.
Media that hold no frame give zero frames and an empty payload.  Very long texts are one stream;
repeated rows are stored each, with equal values; null ids are carried through; other columns
are not read.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT, SIDE = 192, 17
#: Fixed values of the format: kbit/s by index, for (MPEG-1, layer) and for later versions; Hz of MPEG-1 by index.
BITRATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = (44100, 48000, 32000)
SAMPLES = 1152
#: Units in a frame -> bit rate index whose 48 kHz frame holds them.
INDEX_OF_UNITS = {1: 6, 2: 10, 3: 12}


def _crc_table() -> list[int]:
    table = []
    for byte in range(256):
        crc = byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
        table.append(crc)
    return table


_TABLE = _crc_table()


@lru_cache(maxsize=4096)
def frame_crc(covered: bytes) -> int:
    """CRC-16 over the header's last two bytes and the side information."""
    crc = 0xFFFF
    for byte in covered:
        crc = crc << 8 & 0xFFFF ^ _TABLE[crc >> 8 ^ byte]
    return crc


@lru_cache(maxsize=4096)
def header(raw: bytes) -> tuple[int, int, bool, int, int] | None:
    """(frame bytes, Hz, has a checksum of layer III, bytes of side information, samples) of a frame header, or None."""
    if len(raw) < 4 or raw[0] != 0xFF or raw[1] & 0xE0 != 0xE0:
        return None
    version, layer = raw[1] >> 3 & 3, 4 - (raw[1] >> 1 & 3)
    index, rate, padding = raw[2] >> 4, raw[2] >> 2 & 3, raw[2] >> 1 & 1
    if version == 1 or layer == 4 or index in (0, 15) or rate == 3:
        return None
    one, mono = version == 3, raw[3] >> 6 == 3
    hz = RATES[rate] // {3: 1, 2: 2, 0: 4}[version]
    samples = 384 if layer == 1 else 576 if layer == 3 and not one else SAMPLES
    bits = 1000 * BITRATES[one, layer][index]
    size = (12 * bits // hz + padding) * 4 if layer == 1 else samples // 8 * bits // hz + padding
    side = 0 if layer < 3 else (17 if mono else 32) if one else (9 if mono else 17)
    return size, hz, layer == 3 and not raw[1] & 1, side, samples


def _frame(units: int, data: bytes) -> bytes:
    head = bytes((0xFF, 0xFA, INDEX_OF_UNITS[units] << 4 | 1 << 2, 3 << 6))
    size = header(head)[0]
    return (head + struct.pack(">H", frame_crc(head[2:] + bytes(SIDE))) + bytes(SIDE) + data).ljust(size, b"\0")


def encode(payload: bytes, n_bytes: int) -> bytes:
    """A tagged stream of the padded payload."""
    units, frames, at = len(payload) // UNIT, [], 0
    while units:
        n = min(units, 3)
        frames.append(_frame(n, payload[at : at + n * UNIT]))
        at, units = at + n * UNIT, units - n
    total = sum(map(len, frames))
    text = b"\0n_bytes\0" + str(n_bytes).encode()
    tag = b"TXXX" + struct.pack(">IH", len(text), 0) + text
    size = bytes(len(tag) >> s & 0x7F for s in (21, 14, 7, 0))
    xing_head = bytes((0xFF, 0xFB, INDEX_OF_UNITS[1] << 4 | 1 << 2, 3 << 6))
    length = header(xing_head)[0]
    ends, at = [], length
    for f in frames:
        ends.append(at)
        at += len(f)
    toc = bytes(min(255, 256 * ends[i * len(ends) // 100] // at) for i in range(100))
    xing = b"Xing" + struct.pack(">III", 7, len(frames), total + length) + toc
    return b"ID3\3\0\0" + size + tag + (xing_head + bytes(SIDE) + xing).ljust(length, b"\0") + b"".join(frames)


def tag_frames(body: bytes, safe: bool) -> dict[str, bytes]:
    """Frames of an ID3v2 tag; sizes of version 4 have seven bits a byte."""
    found, k = {}, 0
    while k + 10 <= len(body) and body[k]:
        raw = body[k + 4 : k + 8]
        n = sum(b << 7 * (3 - i) for i, b in enumerate(raw)) if safe else int.from_bytes(raw)
        found[body[k : k + 4].decode("latin-1")] = body[k + 10 : k + 10 + n]
        k += 10 + n
    return found


def rate_table(frame: bytes, at: int) -> dict | None:
    """What a frame's Xing, Info or VBRI table says: frames, bytes and the places of equal parts of the time."""
    if frame[at : at + 4] in (b"Xing", b"Info"):
        flags, k, table = int.from_bytes(frame[at + 4 : at + 8]), at + 8, {}
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                table[name] = int.from_bytes(frame[k : k + 4])
                k += 4
        if flags & 4:
            table["seek"] = [x * table.get("bytes", 0) // 256 for x in frame[k : k + 100]]
        return table
    if frame[36:40] == b"VBRI":
        size, frames = int.from_bytes(frame[46:50]), int.from_bytes(frame[50:54])
        entries, scale, width = (int.from_bytes(frame[k : k + 2]) for k in (54, 56, 58))
        places, total = [], 0
        for i in range(min(entries, (len(frame) - 62) // max(1, width))):
            places.append(total)
            total += scale * int.from_bytes(frame[62 + i * width : 62 + (i + 1) * width])
        return {"frames": frames, "bytes": size, "seek": places}
    return None


def parse(media: bytes) -> dict:
    """Frames of a stream: exact samples, offsets, checksum failures, resynchronisations, tags and payload.

    The 128 bytes of a closing tag count as one only where a frame ends before them, so that a
    payload that holds its sign stays whole.
    """
    at, end, tags = 0, len(media), {}
    while media[at : at + 3] == b"ID3" and at + 10 <= end:
        size = 0
        for b in media[at + 6 : at + 10]:
            size = size << 7 | b & 0x7F
        tags |= tag_frames(media[at + 10 : at + 10 + size], media[at + 3] >= 4)
        at += 10 + size
    closing = lambda k: k + 128 == end and media[k : k + 3] == b"TAG"
    offsets, parts, bad, lost, rate, table, samples, base = [], [], 0, 0, 0, None, 0, 0
    while at + 4 <= end and not closing(at):
        found = header(media[at : at + 4])
        after = at + found[0] if found else 0
        if found is None or after > end or not (after + 4 > end or closing(after) or header(media[after : after + 4])):
            lost += 1
            at = media.find(b"\xff", at + 1, end)
            if at < 0:
                break
            continue
        size, hz, checked, side, n = found
        data = at + 4 + 2 * (not media[at + 1] & 1) + side
        seen = rate_table(media[at:after], data - at) if not offsets and table is None else None
        if seen is not None:
            table, base = seen, at
        else:
            if checked and frame_crc(media[at + 2 : at + 4] + media[at + 6 : data]) != int.from_bytes(media[at + 4 : at + 6]):
                bad += 1
            offsets.append(at)
            rate = hz
            samples += n
            parts.append(media[data : data + (size - (data - at)) // UNIT * UNIT])
        at = after
    drift = 0  # how far, at most, the table's seek places lie from the frames of their times
    if table and table.get("seek") and offsets:
        places = table["seek"]
        drift = max(abs(base + x - offsets[min(len(offsets) - 1, i * len(offsets) // len(places))]) for i, x in enumerate(places))
    name, _, value = tags.get("TXXX", b"")[1:].partition(b"\0")
    return {"n_bytes": int(value) if name == b"n_bytes" and value.isdigit() else None, "rate": rate, "samples": samples, "offsets": offsets, "bad_frames": bad, "resyncs": lost, "table": table, "seek_drift": drift, "payload": b"".join(parts)}


def encode_media(docs: DataFrame) -> DataFrame:
    """doc_id and media, the stored form of each whole text."""
    kind = docs.schema["doc_id"].dataType

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for a in range(0, len(pdf), 256):
                part, out = pdf.iloc[a : a + 256], []
                for text in part["text"].tolist():
                    raw = text.encode() if text else b""
                    out.append(encode(raw + b" " * (-len(raw) % UNIT or UNIT * (not raw)), len(raw)))
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "media": out})

    # as strings, for pandas would make doubles of whole numbers beside a null
    done = docs.select(F.col("doc_id").cast("string"), "text").mapInPandas(run, "doc_id string, media binary")
    return done.withColumn("doc_id", F.col("doc_id").cast(kind))


def read_media(media: DataFrame, seek_every: int = 64) -> DataFrame:
    """Features of a media column: digests, duration, seek offsets of every so many frames, damage counts."""
    kind = media.schema["doc_id"].dataType
    schema = "doc_id string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, duration_s double, seek_offsets array<long>, bad_frames int, resyncs int"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for key, m in zip(pdf["doc_id"].tolist(), pdf["media"].tolist(), strict=True):
                m = m or b""
                x = parse(m)
                p, seek = x["payload"], x["offsets"][::seek_every]
                table = x["table"] or {}
                what = f"samples={x['samples']};rate={x['rate']};frames={len(x['offsets'])};table_frames={table.get('frames', -1)};table_bytes={table.get('bytes', -1)};bad={x['bad_frames']};resync={x['resyncs']};seek_drift={x['seek_drift']};seek={','.join(map(str, seek))}"
                out.append((key, x["n_bytes"], len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(m), hashlib.sha256(m).hexdigest(), what, x["samples"] / x["rate"] if x["rate"] else 0.0, seek, x["bad_frames"], x["resyncs"]))
            yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in schema.split(", ")])

    done = media.select(F.col("doc_id").cast("string"), "media").mapInPandas(run, schema)
    return done.withColumn("doc_id", F.col("doc_id").cast(kind))
