"""Sniffing, carving and lossless storage of media, against objects put together by hand."""

import hashlib
import json
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from clipsieve.llm import media
from clipsieve.operators.video import RGB, png

RIFF = b"RIFF" + struct.pack("<I4s4sI", 4 + 8 + 6, b"WEBP", b"VP8 ", 5) + b"abcde\0"
GIF = b"GIF89a" + struct.pack("<HHBBB", 2, 2, 0x80, 0, 0) + bytes(6) + b"\x21\xf9\x04abcd\0" + b"\x2c" + bytes(8) + b"\0" + b"\x02" + b"\x03xyz" + b"\0" + b"\x3b"
JPEG = b"\xff\xd8" + b"\xff\xe0\0\x04ab" + b"\xff\xc0\0\x05abc" + b"\xff\xda\0\x03a" + b"coded\xff\0data\xff\xd3more" + b"\xff\xd9"
AIFF_BODY = b"AIFF" + b"COMM" + struct.pack(">I", 18) + bytes(18) + b"SSND" + struct.pack(">I", 3) + b"abc\0"
AIFF = b"FORM" + struct.pack(">I", len(AIFF_BODY)) + AIFF_BODY
MP4 = struct.pack(">I4s4sI", 16, b"ftyp", b"isom", 0) + struct.pack(">I4sQ", 1, b"mdat", 20) + b"abcd" + struct.pack(">I4s", 12, b"moov") + b"body"
PNG = png(bytes(range(27)), 3, 3, RGB)


def ogg_page(kind, body):
    head = b"OggS\0" + bytes([kind]) + bytes(16) + bytes(4) + b"\x01" + bytes([len(body)]) + body
    crc = 0
    for c in head:
        crc ^= c << 24
        for _ in range(8):
            crc = (crc << 1 ^ (0x04C11DB7 if crc >> 31 else 0)) & 0xFFFFFFFF
    return head[:22] + struct.pack("<I", crc) + head[26:]


OGG = ogg_page(2, b"first") + ogg_page(4, b"last")
SAMPLES = media.padded(bytes(range(256)) * 3 + b"x")
OBJECTS = {"webp": RIFF, "gif": GIF, "jpeg": JPEG, "aiff": AIFF, "mp4": MP4, "png": PNG, "ogg": OGG, "ppm": b"P6 # made\n 2 1\n255\nabcdef"} | {k: media.encode(k, SAMPLES) for k in ("wav", "au", "pgm", "bmp")}


@pytest.mark.parametrize("kind", OBJECTS)
def test_structure_and_length(kind):
    d = OBJECTS[kind]
    assert media.sniff(d) == [media.Media(kind, 0, len(d))]
    assert media.sniff(b"BM P5 RIFF \xff\xd8\xff" + d + b"trailing OggS") == [media.Media(kind, 14, 14 + len(d))]
    # What is cut off isn't there.
    assert media.sniff(d[:-1]) == ([media.Media("ogg", 0, len(OGG) - len(ogg_page(4, b"last")))] if kind == "ogg" else [])


def test_checksums_and_sizes():
    for kind, at in (("png", 30), ("ogg", 30)):
        d = bytearray(OBJECTS[kind])
        d[at] ^= 1
        assert media.sniff(bytes(d)) == []
    for text in ("BM", "P5", "P5 4", "P5\n400 400\n255\n", "RIFF....WAVEfmt ", "GIF89a", "FORM of AIFF", "....ftypisom", ".snd", "P6 #"):
        assert media.sniff(text.encode()) == [] and media.sniff((text * 50).encode()) == []
    assert media.sniff(b"") == []


def test_random_bytes_never_crash():
    rng = random.Random(6)
    magics = list(media.SIGNATURES)
    for _ in range(2_000):
        d = b"".join(rng.choice(magics) if rng.random() < 0.2 else rng.choice((b"\0\0\0\x01", b"WAVE", b"\xff\xd9", b" 1", rng.randbytes(3))) for _ in range(20))
        for m in media.sniff(d, inside=True):
            assert 0 <= m.start < m.end <= len(d)


@pytest.mark.parametrize("kind", media.CARRIERS)
def test_samples(kind):
    for payload in (bytes(64), SAMPLES, media.padded(b"P5\n1 1\n255\nx" + GIF)):
        d = media.encode(kind, payload)
        assert media.decode(kind, d) == payload and media.sniff(d)[0] == (kind, 0, len(d))


def test_columns(spark):
    """Types are corrected and embedded objects carved, those in others too."""
    within = media.encode("wav", media.padded(b"....." + GIF))
    rows = [(1, "image/png", GIF), (2, "audio/wav", b"junk" + PNG + b"junk" + OGG), (3, None, within), (4, "x", b"no media"), (5, "x", None), (1, "image/png", GIF)]
    df = spark.createDataFrame(rows, "id long, declared string, media binary").withColumns({c: F.lit("clash") for c in ("kind", "content")})
    got = {r["id"]: r["found"] for r in media.typed(df).collect()}
    assert got[4] == [] and got[5] is None and [tuple(f) for f in got[1]] == [("gif", 0, len(GIF))] and [tuple(f) for f in got[3]] == [("wav", 0, len(within))]
    carved = media.carve(df.drop("kind", "content"))
    assert sorted((r["id"], r["kind"], r["start"], bytes(r["content"])) for r in carved.collect()) == sorted(
        [(1, "gif", 0, GIF)] * 2 + [(2, "png", 4, PNG), (2, "ogg", 8 + len(PNG), OGG), (3, "wav", 0, within), (3, "gif", 49, GIF)]
    )
    assert media.carve(df.limit(0).drop("kind", "content")).isEmpty() and media.typed(df.limit(0)).isEmpty()


def test_round_trip(spark):
    text = "é" * 40
    rows = [(1, "a"), (1, "a"), (None, None), (2, ""), (3, text), (4, "x" * 64), (5, "y" * 65), (6, "long é " * 200_000), (7, "GIF89a BM P5\n1 1\n255\nx")] + [(100 + k, f"text {k}") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("id", "media", "declared", "n_bytes", "found")}).repartition(3)
    out = media.round_trip(docs).collect()
    assert len(out) == len(rows)
    want = dict(rows)
    for r in out:
        t = (want[r["doc_id"]] or "").encode()
        payload = t + bytes((64 - len(t) % 64) % 64 if t else 64)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(t), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        stored = media.encode(r["media_type"], payload)
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert r["corrected"] == (r["declared"] != r["media_type"]) and json.loads(r["feature"])["samples"] == len(payload)
    assert {r["media_type"] for r in out} == set(media.CARRIERS) and any(r["corrected"] for r in out)
    assert [json.loads(r["feature"])["embedded"] for r in out if r["doc_id"] == 7] == [[["pgm", 10, 12]]]
    assert len({tuple(r) for r in out if r["doc_id"] == 1}) == 1
    assert media.round_trip(docs.limit(0)).isEmpty()
