"""MPEG audio columns: build and read Layer III streams that carry a payload losslessly.

A payload is stored in the ancillary part of MPEG-1 Layer III frames: the side information announces no main data, so a
decoder plays silence, and every remaining byte of a frame is payload. A stream is an ID3v2.3 tag, a frame with a
variable-bitrate table, and frames with checksums; the last frame takes the lowest bitrate that holds the rest.

The reader resynchronises on frame headers, parses the tags and the table, verifies each frame's CRC-16, the table and the
payload's CRC-32, and gives exact durations and the byte offset of every frame.

Defined results: a null text is stored as an empty one; a payload is padded with zero bytes to a positive multiple of 64.
Rows are independent; equal texts give equal media. Bytes that are no stream give a row with no frames.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolex.llm.common import id_type, map_texts, texts

BLOCK = 64
# Fixed values of the MPEG audio standard: kbit/s by bitrate index 1 to 14, Hz by sampling-rate index.
KBPS = {
    (1, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
HZ = {1: (44100, 48000, 32000), 2: (22050, 24000, 16000), 2.5: (11025, 12000, 8000)}
SAMPLES = {(1, 1): 384, (1, 2): 1152, (1, 3): 1152, (2, 1): 384, (2, 2): 1152, (2, 3): 576}

RATE, SIDE, HEAD = 32000, 17, 23  # mono at 32 kHz; bytes of side information; header, checksum and side information
ROOM = [k * 9 // 2 - HEAD for k in KBPS[1, 3]]  # payload bytes of a frame, by bitrate index less 1
XING = 120


@lru_cache(maxsize=4096)
def crc16(data: bytes) -> int:
    """CRC-16 of the standard: polynomial 0x8005, start 0xFFFF, most significant bit first."""
    crc = 0xFFFF
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005) & 0xFFFF if crc & 0x8000 else crc << 1
    return crc


@lru_cache(maxsize=64)
def frame_head(index: int) -> bytes:
    """Header, checksum and silent side information of a frame with this bitrate index."""
    tail = bytes((index << 4 | 2 << 2, 0xC4))  # 32 kHz; one channel, original
    side = bytes(SIDE)
    return b"\xff\xfa" + tail + struct.pack(">H", crc16(tail + side)) + side


def syncsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def payload_of(text: str | None) -> tuple[bytes, int]:
    """The UTF-8 bytes padded to a positive multiple of 64, and their number before that."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % BLOCK if raw else BLOCK), len(raw)


def encode(payload: bytes) -> bytes:
    """A stream that carries the payload."""
    most, frames = ROOM[-1], []
    for at in range(0, len(payload), most):
        part = payload[at : at + most]
        index = 14 if len(part) == most else next(k for k, room in enumerate(ROOM, 1) if room >= len(part))
        frames.append(frame_head(index) + part + bytes(ROOM[index - 1] - len(part)))
    info = b"\x00payload_bytes\x00%d" % len(payload), b"\x00payload_crc32\x00%d" % zlib.crc32(payload)
    body = b"".join(b"TXXX" + struct.pack(">IH", len(x), 0) + x for x in info)
    tag = b"ID3\x03\x00\x00" + syncsafe(len(body)) + body
    first = frame_head(1)
    ends, total = [], len(first) + ROOM[0]
    for x in frames:
        ends.append(total)
        total += len(x)
    toc = bytes(min(255, 256 * ends[k * len(frames) // 100] // total) for k in range(100))
    table = b"Xing" + struct.pack(">III", 15, len(frames), total) + toc + struct.pack(">I", 100)
    return b"".join([tag, first, table, bytes(ROOM[0] - XING), *frames])


def header(data: bytes, at: int) -> tuple[int, int, int, bool, int, float, int] | None:
    """Frame length, samples, Hz, protected, side bytes, version and layer, if a valid header begins here."""
    if at + 4 > len(data) or data[at] != 0xFF or data[at + 1] & 0xE0 != 0xE0:
        return None
    b1, b2, b3 = data[at + 1 : at + 4]
    version, layer = {3: 1, 2: 2, 0: 2.5}.get(b1 >> 3 & 3), 4 - (b1 >> 1 & 3)
    index, rate = b2 >> 4, b2 >> 2 & 3
    if version is None or layer == 4 or index in (0, 15) or rate == 3:
        return None
    family = 1 if version == 1 else 2
    hz, bits, pad = HZ[version][rate], KBPS[family, layer][index - 1] * 1000, b2 >> 1 & 1
    samples = SAMPLES[family, layer]
    length = (12 * bits // hz + pad) * 4 if layer == 1 else samples // 8 * bits // hz + pad
    mono = b3 >> 6 == 3
    side = 0 if layer != 3 else (17 if mono else 32) if family == 1 else 9 if mono else 17
    return length, samples, hz, not b1 & 1, side, version, layer


def sync(data: bytes, at: int) -> int:
    """The next place at or after `at` with a header that another header, or the end, follows; -1 if there is none."""
    while (at := data.find(b"\xff", at)) >= 0:
        if (h := header(data, at)) and (at + h[0] == len(data) or at + h[0] < len(data) and header(data, at + h[0])):
            return at
        at += 1
    return -1


def parse(data: bytes | None) -> dict:
    """What a stream holds: tags, table, frames, checks, durations, offsets, payload."""
    data = data or b""
    tags: dict[str, str] = {}
    at = 0
    if data[:3] == b"ID3" and len(data) >= 10:
        size = sum((b & 0x7F) << s for b, s in zip(data[6:10], (21, 14, 7, 0), strict=True))
        p, at = 10, 10 + size
        while p + 10 <= at and data[p : p + 4].strip(b"\0"):
            n = int.from_bytes(data[p + 4 : p + 8], "big")
            if data[p : p + 4] == b"TXXX":
                key, _, value = data[p + 11 : p + 10 + n].partition(b"\0")
                tags[key.decode("latin-1")] = value.decode("latin-1")
            p += 10 + n
    out = {"tags": tags, "table": None, "offsets": [], "samples": 0, "hz": 0, "crc_checked": 0, "crc_bad": 0, "resyncs": 0, "skipped": 0, "bitrates": 0}
    parts, lengths = [], set()
    while at < len(data):
        h = header(data, at)
        if not h or at + h[0] > len(data):
            nxt = sync(data, at + 1)
            out["resyncs"] += 1
            out["skipped"] += (nxt if nxt >= 0 else len(data)) - at
            if nxt < 0:
                break
            at = nxt
            continue
        length, samples, hz, protected, side, _, layer = h
        body = at + 4 + 2 * protected + side
        if protected and layer == 3:
            out["crc_checked"] += 1
            out["crc_bad"] += crc16(data[at + 2 : at + 4] + data[at + 6 : at + 6 + side]) != int.from_bytes(data[at + 4 : at + 6], "big")
        if not out["offsets"] and out["table"] is None and data[body : body + 4] in (b"Xing", b"Info"):
            flags, frames, size = struct.unpack(">III", data[body + 4 : body + 16])
            out["table"] = {"frames": frames if flags & 1 else None, "bytes": size if flags & 2 else None, "toc": data[body + 16 : body + 116], "at": at}
        else:
            out["offsets"].append(at)
            out["samples"] += samples
            out["hz"] = hz
            lengths.add(length)
            parts.append(data[body : at + length])
        at += length
    out["bitrates"] = len(lengths)
    raw = b"".join(parts)
    size = int(tags["payload_bytes"]) if tags.get("payload_bytes", "").isdigit() else len(raw)
    out["payload"] = raw[:size]
    out["whole"] = len(raw) >= size and tags.get("payload_crc32") in (None, str(zlib.crc32(out["payload"])))
    t = out["table"]
    out["table_ok"] = bool(t) and t["frames"] == len(out["offsets"]) and t["bytes"] == len(data) - t["at"]
    return out


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and the stored stream, media (binary)."""

    def make():
        def f(rows):
            pairs = [payload_of(t) for t in rows["text"]]
            return {"doc_id": rows["doc_id"], "n_bytes": [n for _, n in pairs], "media": [encode(p) for p, _ in pairs]}

        return f

    return map_texts(texts(docs, id_col, text_col), make, f"doc_id {id_type(docs, id_col)}, n_bytes long, media binary")


READ = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames long, duration_us long, checks_ok boolean, seek_offsets array<long>"


def features(data: bytes | None) -> tuple:
    x = parse(data)
    p, n = x["payload"], len(x["offsets"])
    us = x["samples"] * 1_000_000 // x["hz"] if x["hz"] else 0
    ok = x["table_ok"] and x["whole"] and not x["crc_bad"] and not x["resyncs"]
    said = f"frames={n};samples={x['samples']};hz={x['hz']};us={us};bitrates={x['bitrates']};crc={x['crc_checked'] - x['crc_bad']}/{x['crc_checked']};resyncs={x['resyncs']};table={int(x['table_ok'])};whole={int(x['whole'])};last={x['offsets'][-1] if n else -1}"
    return len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-BLOCK:]), len(data or b""), hashlib.sha256(data or b"").hexdigest(), said, n, us, bool(ok), x["offsets"]


def from_media(media: DataFrame, media_col: str = "media") -> DataFrame:
    """Read the stored streams: doc_id, n_bytes and what the reader finds."""
    names = [x.split()[0] for x in READ.split(", ")]

    def make():
        def f(rows):
            out = zip(*map(features, rows["media"]), strict=True)
            return {"doc_id": rows["doc_id"], "n_bytes": rows["n_bytes"], **dict(zip(names, map(list, out), strict=True))}

        return f

    return map_texts(media.select("doc_id", "n_bytes", F.col(media_col).alias("media")), make, f"doc_id {media.schema['doc_id'].dataType.simpleString()}, n_bytes long, {READ}")
