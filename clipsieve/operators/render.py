"""Overlay rendering on pixel relations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipsieve.functions.scalar import PALETTE, object_color
from clipsieve.operators.video import encode_clips


def blend(value: Column, colour: Column, alpha: float = 0.5) -> Column:
    """Alpha blend, truncated to a whole number."""
    return F.floor(F.lit(1 - alpha) * value + F.lit(alpha) * colour).cast("int")


def overlay(pixels: DataFrame, masks: DataFrame, alpha: float = 0.5) -> DataFrame:
    """(frame, px, r, g, b) with the masks (frame, obj, px) painted one after the other by ascending object."""
    paint = masks.distinct().withColumn("c", object_color(F.col("obj"))).groupBy("frame", "px").agg(F.sort_array(F.collect_list(F.struct("obj", "c"))).alias("paint"))
    j = pixels.join(paint, ["frame", "px"], "left")

    def fold(channel: str) -> Column:
        done = F.aggregate("paint", F.col(channel).cast("int"), lambda v, p: blend(v, p["c"][channel], alpha))
        return F.coalesce(done, F.col(channel).cast("int")).alias(channel)

    return j.select("frame", "px", fold("r"), fold("g"), fold("b"))


def with_masks(frames: DataFrame, masks: DataFrame) -> DataFrame:
    """Frames with the number of their masks; 0 without any."""
    n = masks.groupBy("frame").agg(F.count_distinct("obj").alias("n_masks"))
    return frames.join(n, "frame", "left").select("frame", F.coalesce("n_masks", F.lit(0).cast("long")).alias("n_masks"))


def overlay_frames(frames: DataFrame, masks: DataFrame, alpha: float = 0.5) -> DataFrame:
    """Frames (video, frame_idx, h, w, rgb) with the masks (video, frame, obj, px) painted on them by ascending object.

    The same as overlay, a whole frame at a time instead of a row per pixel; a frame without masks stays as it is.
    """
    own = masks.groupBy("video", F.col("frame").alias("frame_idx"), "obj").agg(F.collect_set("px").alias("px"))
    own = own.groupBy("video", "frame_idx").agg(F.sort_array(F.collect_list(F.struct("obj", "px"))).alias("paint"))
    joined = frames.select("video", "frame_idx", "h", "w", "rgb").join(own, ["video", "frame_idx"], "left")

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for rgb, paint in zip(rows["rgb"], rows["paint"], strict=True):
                image = np.frombuffer(rgb, np.uint8).reshape(-1, 3).copy()
                for p in paint if paint is not None else ():
                    at, colour = np.asarray(p["px"], np.int64), np.array(PALETTE[(int(p["obj"]) - 1) % len(PALETTE)])
                    image[at] = np.floor((1 - alpha) * image[at] + alpha * colour).astype(np.uint8)
                out.append(image.tobytes())
            yield rows[["video", "frame_idx", "h", "w"]].assign(rgb=out)

    kind = dict(frames.dtypes)["video"]
    return joined.mapInPandas(each, f"video {kind}, frame_idx long, h int, w int, rgb binary")


def overlay_clips(frames: DataFrame, masks: DataFrame, fps: float = 30.0, alpha: float = 0.5) -> DataFrame:
    """(video, n_frames, content): the painted frames of each video as a clip."""
    return encode_clips(overlay_frames(frames, masks, alpha), fps)
