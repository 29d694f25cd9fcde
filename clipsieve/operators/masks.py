"""Masks as relations: a row per pixel (frame, obj, px), or a bitmap per object in buckets of 32,768 pixels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipsieve.operators import runs

BITMAP_BITS = 32_768


def areas(masks: DataFrame) -> DataFrame:
    """(frame, obj, area): repeated pixels count once. A row per object and 32,768 pixels crosses the shuffle, not one per pixel."""
    return bitmap_areas(to_bitmaps(masks))


def to_bitmaps(masks: DataFrame) -> DataFrame:
    """(frame, obj, px) to (frame, obj, bucket, bits)."""
    return masks.groupBy("frame", "obj", F.bitmap_bucket_number("px").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("px")).alias("bits"))


def bitmap_areas(bitmaps: DataFrame) -> DataFrame:
    return bitmaps.groupBy("frame", "obj").agg(F.sum(F.bitmap_count("bits")).alias("area"))


def union(masks: DataFrame, keys: tuple[str, ...] = ("frame",)) -> DataFrame:
    """Pixels (keys, px) in any mask of a key."""
    return masks.select(*keys, "px").distinct()


def bitmap_union(bitmaps: DataFrame) -> DataFrame:
    """(frame, area) of the union of a frame's masks."""
    u = bitmaps.groupBy("frame", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    return u.groupBy("frame").agg(F.sum(F.bitmap_count("bits")).alias("area"))


def mean_area(masks: DataFrame, pixels: int, frames: int) -> DataFrame:
    """total_area and mean_area_frac over frames and objects; overlaps count once per object."""
    total = areas(masks).agg(F.sum("area").alias("total_area"))
    return total.select("total_area", (F.col("total_area") / F.lit(pixels * frames)).alias("mean_area_frac"))


def dilate(masks: DataFrame, width: int, height: int, radius: int, keys: tuple[str, ...] = ("frame", "obj"), shape: str = "square") -> DataFrame:
    """Pixels within the structuring element of a mask's pixel, clipped to the image; by runs."""
    return runs.to_pixels(runs.dilate(runs.from_pixels(masks, width, keys), width, height, radius, keys, shape), width, keys)


def erode(masks: DataFrame, width: int, height: int, radius: int, keys: tuple[str, ...] = ("frame", "obj")) -> DataFrame:
    """Pixels whose whole square is in the mask; outside the image nothing is, so pixels near its border go; by runs."""
    return runs.to_pixels(runs.erode(runs.from_pixels(masks, width, keys), radius, keys), width, keys)


def blur_threshold(masks: DataFrame, width: int, height: int, sigma: float, keys: tuple[str, ...] = ("frame", "obj")) -> DataFrame:
    """Pixels where a mask blurred by a Gaussian stays above one half.

    The kernel reaches four standard deviations; beyond its border an image is mirrored. One mask is one array, so a
    task holds a mask at a time.
    """
    reach = int(4.0 * sigma + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    kernel /= kernel.sum()
    kinds = ", ".join(f"{k} {t}" for k, t in masks.dtypes if k in keys)

    def along(image: np.ndarray) -> np.ndarray:
        # The first axis; a mirror wider than the image repeats.
        place = np.arange(-reach, image.shape[0] + reach) % (2 * image.shape[0])
        wide = image[np.where(place < image.shape[0], place, 2 * image.shape[0] - 1 - place)]
        return sum(w * wide[i : i + image.shape[0]] for i, w in enumerate(kernel)).astype(np.float32)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for pixels in rows["pixels"]:
                image = np.zeros(width * height, np.float32)
                image[np.asarray(pixels, np.int64)] = 1.0
                image = along(along(image.reshape(height, width)).T).T
                out.append(np.flatnonzero(image.reshape(-1) > 0.5))
            yield rows[list(keys)].assign(pixels=out)

    packed = masks.groupBy(*keys).agg(F.collect_set("px").alias("pixels"))
    return packed.mapInPandas(each, f"{kinds}, pixels array<long>").select(*keys, F.explode("pixels").alias("px"))


def preprocess(masks: DataFrame, width: int, height: int, erode_px: int = 0, dilate_px: int = 4, sigma: float = 0.0, keys: tuple[str, ...] = ("frame", "obj")) -> DataFrame:
    """Erosion, then dilation, then a blur and a threshold; a radius or sigma of 0 leaves its step out."""
    m = runs.from_pixels(masks, width, keys)
    m = runs.erode(m, erode_px, keys) if erode_px else m
    m = runs.to_pixels(runs.dilate(m, width, height, dilate_px, keys) if dilate_px else m, width, keys)
    return blur_threshold(m, width, height, sigma, keys) if sigma > 0 else m


def _common(pairs: DataFrame, *keys: str) -> DataFrame:
    """(keys, overlap) of pairs of bitmaps (keys, bucket, bits_a, bits_b): bits that both have."""
    each = pairs.select(*keys, "bucket", F.explode(F.array("bits_a", "bits_b")).alias("bits"))
    both = each.groupBy(*keys, "bucket").agg(F.bitmap_and_agg("bits").alias("bits"))
    return both.groupBy(*keys).agg(F.sum(F.bitmap_count("bits")).alias("overlap"))


def overlap_pairs(masks: DataFrame) -> DataFrame:
    """(frame, a, b, overlap) of objects a < b with common pixels: bitmaps of a frame's bucket meet by an equi-join."""
    m = to_bitmaps(masks)
    a, b = (m.select("frame", "bucket", F.col("obj").alias(k), F.col("bits").alias(f"bits_{k}")) for k in "ab")
    return _common(a.join(b, ["frame", "bucket"]).where("a < b"), "frame", "a", "b").where("overlap > 0")


def area_gate(masks: DataFrame, anchors: DataFrame, ratio: float = 3.0) -> DataFrame:
    """Areas with those above ratio times the object's anchor area set to 0."""
    j = areas(masks).join(anchors, "obj")
    over = F.col("area") > F.lit(ratio) * F.col("anchor_area")
    return j.select("frame", "obj", F.when(over, F.lit(0).cast("long")).otherwise(F.col("area")).alias("area"), over.alias("flagged"))


def overlap_gate(masks: DataFrame, spatial: DataFrame, least: float = 0.10) -> DataFrame:
    """(frame, obj) areas, 0 where too little of the mask lies in spatial (frame, px)."""
    m = to_bitmaps(masks)
    there = to_bitmaps(spatial.select("frame", F.lit(0).alias("obj"), "px")).select("frame", "bucket", F.col("bits").alias("bits_b"))
    inside = _common(m.withColumnRenamed("bits", "bits_a").join(there, ["frame", "bucket"]), "frame", "obj")
    g = bitmap_areas(m).join(inside, ["frame", "obj"], "left").withColumn("overlap", F.coalesce("overlap", F.lit(0).cast("long")))
    low = F.col("overlap") / F.greatest(F.col("area").cast("double"), F.lit(1.0)) < least
    return g.select("frame", "obj", F.when(low, F.lit(0).cast("long")).otherwise(F.col("area")).alias("area"), "overlap", low.alias("flagged"))
