"""Decoding rules, the lossless container and PNG files."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from clipsieve.functions.scalar import edited_name
from clipsieve.operators import video


def plain_kept(n, fps, max_frames, target):
    interval = fps / target if target is not None and target != fps else 1.0
    due, kept = 0.0, []
    for f in range(n):
        if f >= due:
            kept.append(f)
            due += interval
            if max_frames is not None and len(kept) >= max_frames:
                break
    return kept


def test_kept_frames():
    for n in (0, 1, 7, 100, 433):
        for fps, target in ((29.97, 10.0), (25.0, 15.0), (60.0, 7.0), (10.0, 24.0), (30.0, 30.0), (29.97, None)):
            for most in (None, 1, 12):
                assert video.kept_frames(n, fps, most, target).tolist() == plain_kept(n, fps, most, target)
    assert video.kept_frames(10, 25.0, 4, 5.0, uniform=True).tolist() == [0, 3, 6, 9] and video.kept_frames(3, 25.0, 4, 25.0, uniform=True).tolist() == [0, 1, 2]


@pytest.fixture(scope="module")
def frames(spark):
    rng = np.random.default_rng(1)
    rows = [(v, k, 4, 5, rng.integers(0, 256, 60, dtype=np.uint8).tobytes()) for v in ("a", "b") for k in range(3 if v == "a" else 1)]
    return spark.createDataFrame(rows, "video string, frame_idx long, h int, w int, rgb binary")


def test_clips(spark, frames):
    clips = video.encode_clips(frames, 12.5, chunk=2)
    assert sorted((r["video"], r["chunk"], r["n_frames"]) for r in clips.collect()) == [("a", 0, 2), ("a", 1, 1), ("b", 0, 1)]
    assert sorted(map(tuple, video.decode_clips(clips).collect())) == sorted(map(tuple, frames.collect()))
    broken = spark.createDataFrame([("c", b"nothing"), ("d", None), ("b", b"CLIP2")], "video string, content binary")
    got = {r["video"]: (r["n"], r["h"], r["w"], r["duration_sec"]) for r in video.probe_clips(clips.select("video", "content").unionByName(broken)).collect()}
    assert got == {"a": (3, 4, 5, 3 / 12.5), "b": (0, 0, 0, 0.0), "c": (0, 0, 0, 0.0), "d": (0, 0, 0, 0.0)}
    with pytest.raises(Exception, match="one size"):
        video.encode_clips(frames.withColumn("w", F.when(F.col("frame_idx") == 1, 6).otherwise(F.col("w")))).collect()


def test_seeking_reads_the_chunks_it_needs(spark):
    """Of 40 frames in chunks of 8 two are wanted: two of five chunks are unpacked, and none beyond its wanted frame."""
    rng = np.random.default_rng(2)
    rows = [("a", k, 2, 3, rng.integers(0, 256, 18, dtype=np.uint8).tobytes()) for k in range(0, 80, 2)]
    clips = video.encode_clips(spark.createDataFrame(rows, "video string, frame_idx long, h int, w int, rgb binary"), chunk=16)
    wanted = spark.createDataFrame([("a", 4), ("a", 78), ("a", 5), ("b", 0)], "video string, frame_idx long")
    got = video.decode_clips(clips, wanted, chunk=16)
    assert sorted(map(tuple, got.collect())) == [rows[2], rows[39]]
    assert clips.count() == 5 and clips.join(wanted.select("video", F.floor(F.col("frame_idx") / 16).alias("chunk")).distinct(), ["video", "chunk"]).count() == 2
    # What stands behind the last wanted frame may be broken: it isn't looked at.
    whole = video.pack_clip([0, 1, 2], 2, 3, 25.0, [r[4] for r in rows[:3]])
    assert list(video.unpack_clip(whole[:-9], [0, 1])) == [(0, rows[0][4]), (1, rows[1][4])]
    with pytest.raises(Exception):
        list(video.unpack_clip(whole[:-9]))
    kept = video.decode_sampled(clips, spark.createDataFrame([("a", 80, 25.0)], "video string, n long, fps double"), max_frames=3, uniform=True, chunk=16)
    assert [(r["pos"], r["frame_idx"]) for r in kept.collect()] == [(0, 0)]  # 39 and 79 are no frames of this clip


def read_png(data):
    assert data[:8] == video.PNG_MAGIC
    at, body, head = 8, b"", None
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        chunk = data[at + 8 : at + 8 + size]
        assert struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0] == zlib.crc32(kind + chunk)
        head = struct.unpack(">IIBBBBB", chunk) if kind == b"IHDR" else head
        body += chunk if kind == b"IDAT" else b""
        at += 12 + size
    w, h, depth, colour = head[:4]
    step = w * (3 if colour == 2 else 1)
    raw = zlib.decompress(body)
    assert depth == 8 and len(raw) == h * (step + 1) and not any(raw[k * (step + 1)] for k in range(h))
    return h, w, b"".join(raw[k * (step + 1) + 1 : (k + 1) * (step + 1)] for k in range(h))


def test_pictures(spark, frames):
    want = {(r["video"], f"{r['frame_idx']:06d}.png"): r["rgb"] for r in frames.collect()}
    got = {(r["video"], r["name"]): read_png(bytes(r["content"])) for r in video.pictures(frames, edited_name(F.col("frame_idx"))).collect()}
    assert got == {k: (4, 5, bytes(v)) for k, v in want.items()}
    masks = spark.createDataFrame([("a", 0, 1, 0), ("a", 0, 1, 19), ("a", 2, 1, 7)], "video string, frame long, obj int, px long")
    files = {r["frame"]: read_png(bytes(r["content"])) for r in video.mask_pictures(masks, 4, 5).collect()}
    assert {f: [k for k, v in enumerate(p) if v] for f, (_, _, p) in files.items()} == {0: [0, 19], 2: [7]} and set(files[0][2]) == {0, 255}


def test_small_clips_leave_together(spark):
    """Unpacked frames of many small clips are few batches, not one for each clip, and chunks are packed without pandas."""
    frames = spark.range(2000).select((F.col("id") % 500).alias("video"), F.floor(F.col("id") / 500).alias("frame_idx"), F.lit(1).alias("h"), F.lit(1).alias("w"), F.unhex(F.format_string("%06x", "id")).alias("rgb"))
    clips = video.encode_clips(frames, chunk=2)
    assert clips.count() == 1000 and "InPandas" not in clips._jdf.queryExecution().optimizedPlan().toString()
    got = video.decode_clips(clips)
    assert "InPandas" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in frames.collect())
