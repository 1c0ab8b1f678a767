import hashlib
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from chronolex.llm import media_mpeg as mm
from chronolex.llm import registry


@settings(max_examples=200, deadline=None)
@given(st.binary(min_size=1, max_size=6000))
def test_round_trip(payload):
    x = mm.parse(mm.encode(payload))
    # a payload of other data may look like a header; frames are still read one after another
    assert x["payload"] == payload and x["whole"] and x["table_ok"] and not x["crc_bad"] and not x["resyncs"]
    assert x["samples"] == 1152 * len(x["offsets"]) == 1152 * -(-len(payload) // mm.ROOM[-1])


def test_checksum_and_header_fields():
    assert mm.crc16(b"") == 0xFFFF and mm.crc16(b"123456789") == 0xAEE7  # the check value of this CRC
    length, samples, hz, protected, side, version, layer = mm.header(mm.frame_head(14), 0)
    assert (length, samples, hz, protected, side, version, layer) == (1440, 1152, 32000, True, 17, 1, 3)
    assert mm.header(bytes([0xFF, 0xFB, 0x90, 0x00]), 0)[:4] == (417, 1152, 44100, False)
    assert mm.header(b"\xff\xff\xff\xff", 0) is None and mm.header(b"\xff", 0) is None


def test_resynchronises_and_reports_damage():
    media = mm.encode(b"abc" * 2000)
    x = mm.parse(media)
    cut = x["offsets"][2]
    noisy = mm.parse(media[:cut] + b"noise\xff\xfanoise" + media[cut:])
    assert noisy["payload"] == b"abc" * 2000 and noisy["resyncs"] == 1 and noisy["skipped"] == 12 and not noisy["table_ok"]
    hurt = bytearray(media)
    hurt[x["offsets"][1] + 10] ^= 1
    assert mm.parse(bytes(hurt))["crc_bad"] == 1
    lost = mm.parse(media[: x["offsets"][-1]])
    assert not lost["whole"] and not lost["table_ok"]
    assert mm.parse(b"no audio at all")["offsets"] == [] and mm.parse(None)["payload"] == b""


def test_query(spark, sf):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = registry.op2_mpeg(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        padded = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        media = mm.encode(padded)
        assert (r["media_bytes"], r["media_sha256"], r["checks_ok"]) == (len(media), hashlib.sha256(media).hexdigest(), True)
        assert r["duration_us"] == r["n_frames"] * 36_000 and len(r["seek_offsets"]) == r["n_frames"]


def test_odd_rows(odd_docs, no_docs):
    rows = mm.from_media(mm.to_media(odd_docs)).collect()
    assert len(rows) == odd_docs.count() and all(r["checks_ok"] for r in rows)
    by = {r["doc_id"]: r for r in rows}
    assert by[0]["payload_bytes"] == by[1]["payload_bytes"] == 64 and by[0]["media_sha256"] == by[1]["media_sha256"]
    assert mm.from_media(mm.to_media(no_docs)).count() == 0
