"""Removing masked pixels from frames: group after group, with a plain filling where the model fails.

Frames are rows (video, frame_idx, h, w, rgb), rgb the bytes of h x w x 3 values in row order; masks are pixels
(video, frame, obj, px). A task has a chunk of a video's frames at a time, with some frames before and after it as
context for the model; each further group is a pass of its own over stored frames, as groups build on one another.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clipsieve.config import InpaintSettings
from clipsieve.functions.scalar import MIN_DILATION, cover_crop
from clipsieve.operators import runs
from clipsieve.operators.cluster import LINE
from clipsieve.operators.masks import preprocess
from clipsieve.operators.telea import telea
from clipsieve.sources.shared import stored

#: Gets frames (n, h, w, 3) and masks (n, h, w) and returns frames; may have another size.
Inpaint = Callable[[np.ndarray, np.ndarray], np.ndarray]


#: Frames that a model gets together, besides those for context.
CHUNK = 50


def fill_frames(frames: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """The masked pixels of each frame filled from around them, frame by frame: what stands in for a model that fails."""
    return np.stack([telea(f, m) for f, m in zip(frames, masks, strict=True)])


def resize(image: np.ndarray, height: int, width: int, lobes: int = 4) -> np.ndarray:
    """An image (h, w, 3) in another size by a Lanczos kernel, both axes one after the other, borders repeated."""

    def along(a: np.ndarray, size: int) -> np.ndarray:
        at = (np.arange(size) + 0.5) * a.shape[0] / size - 0.5
        place = np.floor(at).astype(int)[:, None] + np.arange(-lobes + 1, lobes + 1)
        x = at[:, None] - place
        weight = np.sinc(x) * np.sinc(x / lobes)
        weight /= weight.sum(axis=1, keepdims=True)
        return np.einsum("st,st...->s...", weight, a[np.clip(place, 0, a.shape[0] - 1)])

    out = along(along(image.astype(np.float64), height).swapaxes(0, 1), width).swapaxes(0, 1)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def match_resolution(frames: DataFrame, width: int, height: int) -> DataFrame:
    """Frames scaled until they cover a size and cut to it around their centre; of that size already, they stay as they are.

    So does a frame that can't be scaled, such as one whose bytes aren't h x w x 3.
    """
    kind = dict(frames.dtypes)["video"]
    place = F.when((F.col("w") > 0) & (F.col("h") > 0), cover_crop(F.col("w"), F.col("h"), width, height))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for h, w, rgb, to_h, to_w, y, x in zip(*(rows[c] for c in ("h", "w", "rgb", "to_h", "to_w", "to_y", "to_x")), strict=True):
                try:
                    if (h, w) != (height, width):
                        rgb = resize(np.frombuffer(rgb, np.uint8).reshape(h, w, 3), to_h, to_w)[y : y + height, x : x + width].tobytes()
                    out.append((height, width, rgb))
                except (ValueError, ZeroDivisionError, IndexError, TypeError):
                    out.append((h, w, rgb))
            yield rows[["video", "frame_idx"]].assign(h=[o[0] for o in out], w=[o[1] for o in out], rgb=[o[2] for o in out])

    rows = frames.select("video", "frame_idx", "h", "w", "rgb", place.alias("c")).select("video", "frame_idx", "h", "w", "rgb", *(F.col(f"c.{k}").alias(f"to_{k}") for k in "hwyx"))
    return rows.mapInPandas(each, f"video {kind}, frame_idx long, h int, w int, rgb binary")


def _painted(model: Inpaint | None, fallback: Inpaint, images: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, str, str | None, str | None]:
    """Frames out of the model, or the fallback if there is none or it raises; the method, the reason and a size that was changed back."""
    reason, resized, (h, w) = None, None, images.shape[1:3]
    try:
        if model is None:
            raise RuntimeError("no model is registered")
        done = np.asarray(model(images, mask))
    except Exception as e:  # any failure of a model, told in the row
        done, reason = fallback(images, mask), str(e)
    if done.shape[1:3] != (h, w):
        resized = f"{done.shape[2]}x{done.shape[1]}"
        done = np.stack([resize(f, h, w) for f in done])
    return done.astype(np.uint8), "model" if reason is None else "fallback", reason, resized


def inpaint_groups(frames: DataFrame, masks: DataFrame, model: Inpaint | None, fallback: Inpaint = fill_frames, chunk: int = CHUNK, context: int = 0) -> DataFrame:
    """(video, frame_idx, h, w, rgb, method, fallback_reason, resized_from): the output of a group is the input of the next.

    A video's groups go by ascending obj, those without a pixel in any frame are left out beforehand. A model gets the
    chunk of frames that begins at a multiple of chunk, and up to context frames before and after it, whose output is
    dropped; the fallback gets frame by frame if there is no model at all. If the model raises, the fallback does that
    chunk, and the reason of the last such group is told in its frames. Frames of another size than the input's are
    resized back. A video without masks comes back as it is, with method none. Frames of a chunk have one size.
    """
    kind = dict(frames.dtypes)["video"]
    start, end = (F.col("y") * LINE + F.col(x) for x in ("x0", "x1"))
    packed = runs.from_pixels(masks, LINE, ("video", "frame", "obj")).groupBy("video", F.col("frame").alias("frame_idx"), "obj").agg(F.collect_list(F.struct(start.alias("start"), end.alias("end"))).alias("runs"))
    packed = stored(packed, "inpaint-masks")
    order = packed.select("video", "obj").distinct().withColumn("rank", F.row_number().over(Window.partitionBy("video").orderBy("obj")))
    order = stored(order, "inpaint-groups")
    last = order.agg(F.max("rank")).first()[0] or 0
    no = F.lit(None).cast("string")
    now = frames.select("video", "frame_idx", "h", "w", "rgb", F.lit("none").alias("method"), no.alias("fallback_reason"), no.alias("resized_from"))
    schema = f"video {kind}, frame_idx long, h int, w int, rgb binary, method string, fallback_reason string, resized_from string"

    def frame_masks(rows: pd.DataFrame, h: int, w: int) -> np.ndarray:
        out = np.zeros((len(rows), h * w), bool)
        for mask, own in zip(out, rows["runs"], strict=True):
            for r in own if own is not None else ():
                mask[r["start"] : r["end"]] = True
        return out.reshape(-1, h, w)

    def each(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("frame_idx", ignore_index=True)
        own = (rows["frame_idx"] // chunk == rows["part"]).to_numpy() if "part" in rows else np.ones(len(rows), bool)
        h, w = int(rows["h"].iloc[0]), int(rows["w"].iloc[0])
        if not own.any():  # only context of a chunk that isn't there
            return rows.loc[own, [f.split()[0] for f in schema.split(", ")]]
        images = np.stack([np.frombuffer(b, np.uint8).reshape(h, w, 3) for b in rows["rgb"]])
        done, method, reason, resized = _painted(model, fallback, images, frame_masks(rows, h, w))
        rows = rows.loc[own]
        before = rows["method"] == "fallback"
        return pd.DataFrame({
            "video": rows["video"], "frame_idx": rows["frame_idx"], "h": h, "w": w, "rgb": [f.tobytes() for f in done[own]], "method": np.where(before, "fallback", method),
            "fallback_reason": rows["fallback_reason"] if reason is None else reason, "resized_from": rows["resized_from"] if resized is None else resized,
        })

    def frame_by_frame(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for k in range(len(rows)):
                yield each(rows.iloc[k : k + 1])

    for rank in range(1, last + 1):
        group = order.where(F.col("rank") == rank).select("video", "obj")
        rows = now.join(group, "video").join(packed, ["video", "obj", "frame_idx"], "left").drop("obj")
        if model is None:
            done = rows.mapInPandas(frame_by_frame, schema)
        else:
            at = F.floor((F.col("frame_idx") + context) / chunk)
            part = F.explode(F.sequence(F.floor((F.col("frame_idx") - context) / chunk), at)) if context else at
            done = rows.withColumn("part", part).groupBy("video", "part").applyInPandas(each, schema)
        now = done.unionByName(now.join(group.select("video"), "video", "left_anti"))
        if rank < last:
            now = stored(now, "inpaint-frames")
    return now


def remove(frames: DataFrame, masks: DataFrame, width: int, height: int, model: Inpaint | None, settings: InpaintSettings = InpaintSettings(), fallback: Inpaint = fill_frames) -> tuple[DataFrame, DataFrame]:
    """The frames without what the masks cover, and an info record per video.

    Masks are eroded, grown by four pixels at least so that thin parts survive a model's own scaling, and blurred.
    """
    grown = max(settings.dilate_px, MIN_DILATION)
    ready = preprocess(masks, width, height, settings.erode_px, grown, settings.feather_sigma, keys=("video", "frame", "obj"))
    out = inpaint_groups(frames, ready, model, fallback, settings.chunk, settings.context)
    info = out.groupBy("video").agg(
        F.max("method").alias("method"), F.max("fallback_reason").alias("fallback_reason"), F.max("resized_from").alias("resized_from"), F.count("*").alias("num_frames"),
        F.concat(F.max("w").cast("string"), F.lit("x"), F.max("h").cast("string")).alias("resolution"), F.lit(json.dumps(settings.record())).alias("config"),
    )
    return out, info
