"""Frame sampling, anchors and filling, as relations over (video, frame_idx)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def uniform_indices(n: Column, m: int) -> Column:
    """Indices of m of n frames as a truncated even division of 0..n-1, the last forced to n-1; all if n <= m."""
    last = n - 1
    if m == 1:
        some = F.array(F.lit(0).cast("bigint"))
    else:
        step = last / F.lit(m - 1)
        some = F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda i: F.when(i == m - 1, last).otherwise((i * step).cast("bigint")))
    every = F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), last)).otherwise(F.array().cast("array<bigint>"))
    return F.when(n > m, some).otherwise(every)


def uniform_subsample(videos: DataFrame, m: int) -> DataFrame:
    """(video, n) to (video, pos, frame_idx)."""
    return videos.select("video", F.posexplode(F.array_distinct(uniform_indices(F.col("n"), m))).alias("pos", "frame_idx"))


def fps_resample(videos: DataFrame, source: float, target: float) -> DataFrame:
    """(video, n) to the kept (video, frame_idx): a frame is kept when it reaches the next due time, which moves by
    source / target. The additions are done one after the other, as doubles, so that rounding is the same; the due
    times are the same for all videos, so each batch adds them up once, for its longest video."""
    if target <= 0:
        raise ValueError("target must be positive")
    interval = source / target

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            longest = int(rows["n"].max())
            if interval <= 1.0:
                kept = np.arange(longest)  # at most one frame becomes due per frame, and each frame is due
            else:
                due = np.add.accumulate(np.concatenate([[0.0], np.full(int(longest / interval) + 2, interval)]))
                kept = np.ceil(due).astype(np.int64)
            yield rows[["video"]].assign(frames=[kept[: np.searchsorted(kept, n)] for n in rows["n"]])

    kind = dict(videos.dtypes)["video"]
    return videos.select("video", "n").mapInPandas(each, f"video {kind}, frames array<long>").select("video", F.explode("frames").alias("frame_idx"))


def first_frames(frames: DataFrame, n: int | None) -> DataFrame:
    """Frames before the n-th; all without n."""
    return frames if n is None else frames.where(F.col("frame_idx") < n)


def zipped(left: DataFrame, right: DataFrame) -> DataFrame:
    """Both sides' rows of the same (video, frame_idx); what only one side has goes."""
    return left.join(right, ["video", "frame_idx"])


def tracker_subsample(videos: DataFrame, cap: int) -> DataFrame:
    """(video, n, anchor) to (video, pos, frame_idx): an even sub-sample with the anchor put in."""
    at = F.array_sort(F.array_distinct(F.array_append(uniform_indices(F.col("n"), cap), F.col("anchor"))))
    return videos.select("video", F.posexplode(at).alias("pos", "frame_idx"))


def anchor_frame(detections: DataFrame, stride: int = 5, sure: float = 0.9, least: float = 0.3, last: str | None = None) -> DataFrame:
    """(video, frame_idx, score) to (video, anchor_idx, anchor_score, found): of every stride-th frame and the last the
    first with a sure score, else the best; found is false below least. last names a column with the number of frames;
    without it the last frame with a score is taken for the last."""
    last = F.max("frame_idx").over(Window.partitionBy("video")) if last is None else F.col(last) - 1
    c = detections.withColumn("last", last).where((F.col("frame_idx") % stride == 0) | (F.col("frame_idx") == F.col("last")))
    is_sure = F.col("score") >= sure
    w = Window.partitionBy("video").orderBy(F.desc(is_sure), F.when(is_sure, F.col("frame_idx")), F.desc("score"), "frame_idx")
    best = c.withColumn("r", F.row_number().over(w)).where("r = 1")
    return best.select("video", F.col("frame_idx").alias("anchor_idx"), F.col("score").alias("anchor_score"), (F.col("score") >= least).alias("found"))


def largest_detection(detections: DataFrame) -> DataFrame:
    """(frame_idx, det_idx, area): the largest of each frame, the first of equal ones."""
    w = Window.partitionBy("frame_idx").orderBy(F.desc("area"), "det_idx")
    return detections.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def nearest_fill(frames: DataFrame) -> DataFrame:
    """(video, frame_idx, tracked) to source_idx: the nearest tracked frame, the earlier of two as near; null without one."""
    w = Window.partitionBy("video").orderBy("frame_idx")
    own = F.when(F.col("tracked"), F.col("frame_idx"))
    before = F.last(own, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(own, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    f = frames.withColumns({"before": before, "after": after})
    left = F.col("after").isNull() | (F.col("frame_idx") - F.col("before") <= F.col("after") - F.col("frame_idx"))
    return f.select("video", "frame_idx", F.when(F.col("before").isNotNull() & left, F.col("before")).otherwise(F.col("after")).alias("source_idx"))


def merge_directions(forward: DataFrame, backward: DataFrame, keys: tuple[str, ...] = ("frame_idx",)) -> DataFrame:
    """(keys, area) of both passes: the forward mask unless it is missing or empty; direction tells which was taken."""
    f, b = forward.withColumnRenamed("area", "fa"), backward.withColumnRenamed("area", "ba")
    j = f.join(b, list(keys), "full")
    use_forward = (F.coalesce("fa", F.lit(0)) > 0) | F.col("ba").isNull()
    return j.select(*keys, F.when(use_forward, F.col("fa")).otherwise(F.col("ba")).alias("area"), F.when(use_forward, "forward").otherwise("backward").alias("direction"))


def spine_fill(spine: DataFrame, masks: DataFrame, keys: tuple[str, ...] = ("frame_idx",)) -> DataFrame:
    """Every key of the spine with its area; 0 where no mask is."""
    return spine.join(masks, list(keys), "left").select(*keys, F.coalesce("area", F.lit(0).cast("long")).alias("area"), F.col("area").isNotNull().alias("tracked"))
