"""Frames of videos: which ones a decoder keeps, a lossless container for clips, and PNG pictures.

Frames are rows (video, frame_idx, h, w, rgb), rgb the bytes of h x w x 3 values in row order. There is no MP4 codec
here: that attaches as a hook. The container keeps every pixel, so it serves for masks and for passing clips on.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

#: How a PNG file begins, and its greyscale and RGB colour types.
PNG_MAGIC = b"\x89PNG\r\n\x1a\n"
GREY, RGB = 0, 2
CLIP_MAGIC = b"CLIP2\n"
#: Frames, height, width, rate.
CLIP_HEADER = struct.Struct("<IIId")
CLIP_BYTES = len(CLIP_MAGIC) + CLIP_HEADER.size
#: Frame numbers between two whole frames of a clip.
KEY_EVERY = 24
#: Bytes of unpacked frames that a task passes on at a time, a clip more at most.
HELD_BYTES = 32_000_000


def kept_frames(n: int, fps: float, max_frames: int | None = None, target_fps: float | None = None, uniform: bool = False) -> np.ndarray:
    """Indices that a decoder keeps of n frames.

    Uniform: max_frames evenly spread ones, if there are more; the rate doesn't matter then. Else a frame is kept when
    it reaches the next due time, which moves by fps / target_fps, and the first max_frames of these.
    """
    if uniform and max_frames is not None and n > max_frames:
        return np.linspace(0, n - 1, max_frames).astype(np.int64)
    interval = fps / target_fps if target_fps is not None and target_fps != fps else 1.0
    if interval <= 1.0:
        kept = np.arange(n)
    else:
        due = np.add.accumulate(np.concatenate([[0.0], np.full(int(n / interval) + 2, interval)]))
        kept = np.ceil(due).astype(np.int64)
        kept = kept[kept < n]
    return kept if max_frames is None else kept[:max_frames]


def sample(videos: DataFrame, max_frames: int | None = None, target_fps: float | None = None, uniform: bool = False) -> DataFrame:
    """(video, n, fps) to (video, pos, frame_idx, fps): the kept frames in order, and the rate they stand for."""
    kind = dict(videos.dtypes)["video"]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            kept = [kept_frames(int(n), float(fps), max_frames, target_fps, uniform) for n, fps in zip(rows["n"], rows["fps"], strict=True)]
            spread = [uniform and max_frames is not None and n > max_frames for n in rows["n"]]
            rate = [float(fps) if target_fps is None or s else target_fps for fps, s in zip(rows["fps"], spread, strict=True)]
            yield pd.DataFrame({"video": rows["video"], "frames": kept, "fps": rate})

    out = videos.select("video", "n", "fps").mapInPandas(each, f"video {kind}, frames array<long>, fps double")
    return out.select("video", F.posexplode("frames").alias("pos", "frame_idx"), "fps").withColumn("pos", F.col("pos").cast("long"))


def decode(frames: DataFrame, videos: DataFrame, max_frames: int | None = None, target_fps: float | None = None, uniform: bool = False) -> DataFrame:
    """The kept frames with their pictures: (video, pos, frame_idx, fps and the other columns of frames)."""
    return sample(videos, max_frames, target_fps, uniform).join(frames, ["video", "frame_idx"])


def encode_clips(frames: DataFrame, fps: float = 30.0, chunk: int = KEY_EVERY) -> DataFrame:
    """(video, chunk, n_frames, content): each video's frames in lossless containers, one for every chunk frame numbers.

    A container begins with a whole frame; the others are stored as differences to the one before. Chunks are packed by
    themselves, so that the frames of one video keep many tasks busy, and each can be read without the others. Frames of
    a chunk have one size; frame numbers may have gaps. A video without frames has no row.
    """
    kind = dict(frames.dtypes)["video"]

    def each(rows: pa.Table) -> pa.Table:
        numbers, pictures = rows["frame_idx"].to_pylist(), rows["rgb"].to_pylist()
        sizes = set(zip(rows["h"].to_pylist(), rows["w"].to_pylist(), strict=True))
        if len(sizes) > 1:
            raise ValueError("the frames of a clip must have one size")
        order = sorted(range(len(numbers)), key=numbers.__getitem__)
        content = pack_clip([numbers[k] for k in order], *map(int, sizes.pop()), fps, [pictures[k] for k in order])
        return pa.table({"video": rows["video"].slice(0, 1), "chunk": rows["chunk"].slice(0, 1), "n_frames": pa.array([len(numbers)], pa.int64()), "content": pa.array([content], pa.binary())})

    rows = frames.select("video", F.floor(F.col("frame_idx") / chunk).alias("chunk"), "frame_idx", "h", "w", "rgb")
    return rows.groupBy("video", "chunk").applyInArrow(each, f"video {kind}, chunk long, n_frames long, content binary")


def pack_clip(numbers: list[int], h: int, w: int, fps: float, pictures: Iterable[bytes]) -> bytes:
    """A container: header, frame numbers, where each frame's bytes end, and the frames, the first one whole."""
    before, parts = None, []
    for rgb in pictures:
        now = np.frombuffer(rgb, np.uint8)
        parts.append(zlib.compress((now if before is None or len(now) != len(before) else now - before).tobytes(), 6))
        before = now
    ends = np.cumsum([len(p) for p in parts], dtype=np.int64)
    return CLIP_MAGIC + CLIP_HEADER.pack(len(parts), h, w, fps) + np.array(numbers, "<i8").tobytes() + ends.astype("<i8").tobytes() + b"".join(parts)


def clip_info(content: bytes) -> tuple[int, int, int, float]:
    """Number of frames, height, width and rate of a clip, read without unpacking it."""
    if content[: len(CLIP_MAGIC)] != CLIP_MAGIC:
        raise ValueError("no clip")
    return CLIP_HEADER.unpack_from(content, len(CLIP_MAGIC))


def unpack_clip(content: bytes, wanted: Iterable[int] | None = None) -> Iterator[tuple[int, bytes]]:
    """(frame number, pixels) of a container's frames, or of the wanted ones; what comes after the last is not unpacked."""
    n, *_ = clip_info(content)
    at = CLIP_BYTES + 16 * n
    numbers, ends = np.frombuffer(content, "<i8", 2 * n, CLIP_BYTES).reshape(2, n)
    want = set(numbers.tolist() if wanted is None else wanted)
    last = max((k for k, f in enumerate(numbers.tolist()) if f in want), default=-1)
    image, begin = None, 0
    for k in range(last + 1):
        part = np.frombuffer(zlib.decompress(content[at + begin : at + int(ends[k])]), np.uint8)
        image, begin = (part if image is None else image + part), int(ends[k])
        if int(numbers[k]) in want:
            yield int(numbers[k]), image.tobytes()


def decode_clips(clips: DataFrame, wanted: DataFrame | None = None, chunk: int = KEY_EVERY) -> DataFrame:
    """Containers (video, content) to frames (video, frame_idx, h, w, rgb).

    With wanted (video, frame_idx) only these frames: clips (video, chunk, content) are joined to the chunks that have
    some, and of these none is unpacked beyond its last wanted frame.
    """
    kind = dict(clips.dtypes)["video"]
    if wanted is None:
        rows = clips.select("video", "content", F.lit(None).cast("array<long>").alias("wanted"))
    else:
        place = wanted.select("video", F.floor(F.col("frame_idx") / chunk).alias("chunk"), F.col("frame_idx").cast("long").alias("frame_idx"))
        rows = clips.select("video", "chunk", "content").join(place.groupBy("video", "chunk").agg(F.collect_set("frame_idx").alias("wanted")), ["video", "chunk"]).select("video", "content", "wanted")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, out, held = [], [], 0
            table = lambda of, out, batch=batch: pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True))], ["video", "frame_idx", "h", "w", "rgb"])
            for k in range(batch.num_rows):
                content, want = batch.column(1)[k].as_py(), batch.column(2)[k].as_py()
                _, h, w, _ = clip_info(content)
                for f, rgb in unpack_clip(content, want):
                    of.append(k)
                    out.append((f, h, w, rgb))
                    held += len(rgb)
                # Frames of many clips leave together, of large ones not much more than HELD_BYTES.
                if held >= HELD_BYTES:
                    yield table(of, out)
                    of, out, held = [], [], 0
            if of:
                yield table(of, out)

    return rows.mapInArrow(each, f"video {kind}, frame_idx long, h int, w int, rgb binary")


def decode_sampled(clips: DataFrame, videos: DataFrame, max_frames: int | None = None, target_fps: float | None = None, uniform: bool = False, chunk: int = KEY_EVERY) -> DataFrame:
    """(video, pos, frame_idx, fps, h, w, rgb): the frames of clips that a decoder keeps, out of the chunks that hold them."""
    kept = sample(videos, max_frames, target_fps, uniform)
    return kept.join(decode_clips(clips, kept.select("video", "frame_idx"), chunk), ["video", "frame_idx"]).select("video", "pos", "frame_idx", "fps", "h", "w", "rgb")


def probe_clips(clips: DataFrame) -> DataFrame:
    """(video, n, h, w, fps, duration_sec) from the headers of a video's containers; with a broken one it has 0 frames."""
    kind = dict(clips.dtypes)["video"]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for video, content in zip(rows["video"], rows["content"], strict=True):
                try:
                    out.append((video, *clip_info(content), False))
                except (ValueError, struct.error, TypeError):
                    out.append((video, 0, 0, 0, 0.0, True))
            yield pd.DataFrame(out, columns=["video", "n", "h", "w", "fps", "broken"])

    # The header is all that is sent to Python.
    heads = clips.select("video", F.substring("content", 1, CLIP_BYTES).alias("content")).mapInPandas(each, f"video {kind}, n long, h int, w int, fps double, broken boolean")
    whole = heads.groupBy("video").agg(F.max("broken").alias("broken"), F.sum("n").alias("n"), F.max("h").alias("h"), F.max("w").alias("w"), F.max("fps").alias("fps"))
    known = lambda c: F.when(F.col("broken"), F.lit(0)).otherwise(F.col(c)).cast(dict(whole.dtypes)[c]).alias(c)
    return whole.select("video", *map(known, ("n", "h", "w", "fps"))).withColumn("duration_sec", F.when(F.col("fps") > 0, F.col("n") / F.col("fps")).otherwise(F.lit(0.0)))


def png(pixels: bytes, height: int, width: int, colour: int = RGB) -> bytes:
    """A PNG file of rows of pixels."""
    step = width * (3 if colour == RGB else 1)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    lines = b"".join(b"\0" + pixels[k * step : (k + 1) * step] for k in range(height))
    return PNG_MAGIC + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


@F.pandas_udf(BinaryType())
def frame_png(rgb: pd.Series, h: pd.Series, w: pd.Series) -> pd.Series:
    """A frame as a PNG file."""
    return pd.Series([png(p, a, b) for p, a, b in zip(rgb, h, w, strict=True)])


@F.pandas_udf(BinaryType())
def mask_png(px: pd.Series, h: pd.Series, w: pd.Series) -> pd.Series:
    """A mask, given by its pixels, as a greyscale PNG file of 0 and 255."""
    out = []
    for p, a, b in zip(px, h, w, strict=True):
        image = np.zeros(a * b, np.uint8)
        image[np.asarray(p, np.int64)] = 255
        out.append(png(image.tobytes(), a, b, GREY))
    return pd.Series(out)


def mask_pictures(masks: DataFrame, height: int, width: int) -> DataFrame:
    """(video, frame, obj, content): a PNG file of each mask (video, frame, obj, px)."""
    packed = masks.groupBy("video", "frame", "obj").agg(F.collect_set("px").alias("px"))
    size = (F.lit(height), F.lit(width))
    return packed.select("video", "frame", "obj", mask_png("px", *size).alias("content"))


def pictures(frames: DataFrame, name: Column) -> DataFrame:
    """(video, name, content): a PNG file of each frame."""
    return frames.select("video", name.alias("name"), frame_png("rgb", "h", "w").alias("content"))
