"""What MP4 files say of themselves: frames, rate, size and duration, from the movie box, without any codec.

A file is a row of boxes, each a length, a name and a body; boxes hold boxes. The walk goes from header to header and
looks into the movie box alone, so that the frames themselves, in mdat or anywhere else, are stepped over.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PROBE_SCHEMA = "fps double, width int, height int, frame_count long, duration_sec double"
NOTHING = (0.0, 0, 0, 0, 0.0)


def boxes(data: bytes, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, begin, end) of the bodies of the boxes in a range; a length of 1 has 64 bits, one of 0 reaches to the end."""
    while start + 8 <= end:
        size, name = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            if start + 16 > end:
                raise ValueError("a box ends within its header")
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            raise ValueError(f"box {name!r} doesn't fit in the one around it")
        yield name, start + head, start + size
        start += size


def inside(data: bytes, start: int, end: int, *path: bytes) -> Iterator[tuple[int, int]]:
    """Bodies of all boxes at the end of a path of names."""
    for name, b, e in boxes(data, start, end):
        if name == path[0]:
            if len(path) == 1:
                yield b, e
            else:
                yield from inside(data, b, e, *path[1:])


def _first(data: bytes, place: tuple[int, int], *path: bytes) -> tuple[int, int]:
    for found in inside(data, *place, *path):
        return found
    raise ValueError(f"there is no {path[-1]!r}")


def _times(data: bytes, at: int) -> tuple[int, int]:
    """Units per second and duration of an mvhd or mdhd body, of version 0 or 1."""
    return struct.unpack_from(">IQ", data, at + 20) if data[at] else struct.unpack_from(">II", data, at + 12)


def _fragments(data: bytes, track: int) -> tuple[int, int]:
    """Samples and their summed durations of a track in movie fragments; 0 as duration where they leave it to a default."""
    n = total = 0
    for b, e in inside(data, 0, len(data), b"moof", b"traf"):
        header, _ = _first(data, (b, e), b"tfhd")
        if struct.unpack_from(">I", data, header + 4)[0] != track:
            continue
        flags = struct.unpack_from(">I", data, header)[0] & 0xFFFFFF
        at = header + 8 + (8 if flags & 1 else 0) + (4 if flags & 2 else 0)
        each = struct.unpack_from(">I", data, at)[0] if flags & 8 else 0
        for t, _ in inside(data, b, e, b"trun"):
            own, count = struct.unpack_from(">II", data, t)
            step = 4 * bin(own >> 8 & 15).count("1")
            first = t + 8 + (4 if own & 1 else 0) + (4 if own & 4 else 0)
            n += count
            total += sum(struct.unpack_from(">I", data, first + step * k)[0] for k in range(count)) if own & 0x100 else count * each
    return n, total


def movie(data: bytes) -> tuple[float, int, int, int, float]:
    """(fps, width, height, frame_count, duration_sec) of the first picture track; a file without one raises ValueError."""
    moov = _first(data, (0, len(data)), b"moov")
    for trak in inside(data, *moov, b"trak"):
        mdia = _first(data, trak, b"mdia")
        handler, _ = _first(data, mdia, b"hdlr")
        if data[handler + 8 : handler + 12] != b"vide":
            continue
        per_second, duration = _times(data, _first(data, mdia, b"mdhd")[0])
        header, end = _first(data, trak, b"tkhd")
        width, height = (v >> 16 for v in struct.unpack_from(">II", data, end - 8))
        table = _first(data, mdia, b"minf", b"stbl")
        sizes, _ = _first(data, table, b"stsz")
        frames = struct.unpack_from(">I", data, sizes + 8)[0]
        times, _ = _first(data, table, b"stts")
        runs = struct.iter_unpack(">II", data[times + 8 : times + 8 + 8 * struct.unpack_from(">I", data, times + 4)[0]])
        total = sum(n * delta for n, delta in runs)
        if not frames:
            version = data[header]
            frames, total = _fragments(data, struct.unpack_from(">I", data, header + (20 if version else 12))[0])
        total = total or duration
        fps = frames * per_second / total if total and frames else 0.0
        return fps, width, height, frames, frames / fps if fps else 0.0
    raise ValueError("there is no picture track")


def probe_movies(files: DataFrame, content: str = "content") -> DataFrame:
    """files without content, with fps, width, height, frame_count, duration_sec; all 0 for null and broken content."""
    others = [c for c in files.columns if c != content]
    kinds = ", ".join(f"`{c}` {t}" for c, t in files.dtypes if c != content)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for data in rows[content]:
                try:
                    out.append(movie(data))
                except (ValueError, TypeError, struct.error, IndexError):
                    out.append(NOTHING)
            yield pd.concat([rows[others].reset_index(drop=True), pd.DataFrame(out, columns=[f.split()[0] for f in PROBE_SCHEMA.split(", ")])], axis=1)

    return files.select(*others, content).mapInPandas(each, f"{kinds}, {PROBE_SCHEMA}")


def probe_folder(spark: SparkSession, path: str, pattern: str = "*.mp4") -> DataFrame:
    """(path, length, fps, width, height, frame_count, duration_sec) of the movies under a folder, read by Spark."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")  # whole files are in a batch
    return probe_movies(files.select(F.col("path"), "length", "content"))
