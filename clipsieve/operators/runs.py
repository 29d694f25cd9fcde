"""Masks as runs: rows (keys, y, x0, x1) for the pixels x0 to x1 - 1 of line y.

A mask of a real frame has some runs per line where it has a thousand pixels, so that growing, shrinking, joining and
comparing masks moves a row per run and not one per pixel. What overlaps on a line is found by sweeping over it: in
order of their beginnings, runs that begin before the furthest end so far belong to one island.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("frame", "obj")
#: Runs that are spread over the lines they reach at a time, by a task that grows masks: a bound on its memory.
PIECE = 16_384


def reach(radius: int, shape: str = "square") -> list[int]:
    """How far a structuring element reaches to both sides in the line dy = 0 ... radius away from its centre.

    A line of an ellipse reaches as far as the rounded half chord.
    """
    return [radius if shape == "square" else round(math.sqrt(radius * radius - dy * dy)) for dy in range(radius + 1)]


def _islands(runs: DataFrame, lines: tuple[str, ...], touch: bool) -> DataFrame:
    """runs with island, which counts along each line the groups of runs that overlap (or, with touch, adjoin) each other."""
    w = Window.partitionBy(*lines).orderBy("x0", "x1")
    end = F.max("x1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    begins = end.isNull() | (F.col("x0") > end if touch else F.col("x0") >= end)
    # Of runs with the same beginning at most one begins an island; all of them get its number.
    upto = Window.partitionBy(*lines).orderBy("x0").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return runs.withColumn("_new", begins.cast("int")).withColumn("island", F.sum("_new").over(upto)).drop("_new")


def merged(runs: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, y, x0, x1) without overlaps: runs of a line that overlap or adjoin become one."""
    lines = (*keys, "y")
    i = _islands(runs.select(*lines, "x0", "x1"), lines, touch=True)
    return i.groupBy(*lines, "island").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("island")


def from_pixels(masks: DataFrame, width: int, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, px) to runs; repeated pixels count once."""
    x = (F.col("px") % width).cast("long")
    rows = masks.select(*keys, F.floor(F.col("px") / width).cast("long").alias("y"), x.alias("x0"), (x + 1).alias("x1"))
    return merged(rows, keys)


def to_pixels(runs: DataFrame, width: int, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, px) of merged runs."""
    x = F.explode(F.sequence("x0", F.col("x1") - 1))
    return runs.select(*keys, "y", x.alias("x")).select(*keys, (F.col("y") * width + F.col("x")).cast("long").alias("px"))


def areas(runs: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, area) of merged runs."""
    return runs.groupBy(*keys).agg(F.sum(F.col("x1") - F.col("x0")).alias("area"))


def clipped(runs: DataFrame, width: int, height: int) -> DataFrame:
    """What of the runs lies within the image."""
    inside = runs.where((F.col("y") >= 0) & (F.col("y") < height))
    inside = inside.withColumns({"x0": F.greatest("x0", F.lit(0).cast("long")), "x1": F.least("x1", F.lit(width).cast("long"))})
    return inside.where("x0 < x1")


def joined(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches in order of their beginnings as islands: those that overlap or adjoin become one."""
    if not len(begin):
        return begin, end
    upto = np.maximum.accumulate(end)
    first = np.concatenate([[0], np.flatnonzero(begin[1:] > upto[:-1]) + 1])
    return begin[first], upto[np.append(first[1:], len(begin)) - 1]


def _grown(mask: np.ndarray, y: np.ndarray, x0: np.ndarray, x1: np.ndarray, width: int, height: int, far: np.ndarray) -> tuple[np.ndarray, ...]:
    """Merged runs (mask, y, x0, x1), in this order, of what the structuring element reaches within the image.

    A line of a mask, a beginning and an end make one number, so that a sort of numbers puts in place what a piece of
    the runs reaches. A piece is PIECE runs that follow one another; only its merged runs are kept.
    """
    bits, low = int(width).bit_length(), (1 << int(width).bit_length()) - 1
    dy = np.arange(1 - len(far), len(far))
    side, order, parts = far[np.abs(dy)], np.lexsort((y, mask)), []
    for k in range(0, len(order) + 1, PIECE):
        own = order[k : k + PIECE, None]
        line, left, right = y[own] + dy, np.maximum(x0[own] - side, 0), np.minimum(x1[own] + side, width)
        inside = (line >= 0) & (line < height) & (left < right)
        parts.append(_merged_packed((((mask[own] * height + line) << bits | left) << bits | right)[inside], bits))
    packed = parts[0] if len(parts) == 1 else _merged_packed(np.concatenate(parts), bits)
    line = packed >> 2 * bits
    return line // height, line % height, packed >> bits & low, packed & low


def _merged_packed(packed: np.ndarray, bits: int) -> np.ndarray:
    """Runs as numbers (line, beginning, end; bits for each of the two) without overlaps, in order."""
    packed, low = np.sort(packed), (1 << bits) - 1
    begin, end = joined(packed >> bits, packed >> 2 * bits << bits | packed & low)
    return begin << bits | end & low


def _numbers(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table[n].to_numpy().astype(np.int64, copy=False) for n in names]


def dilate(runs: DataFrame, width: int, height: int, radius: int, keys: tuple[str, ...] = KEYS, shape: str = "square") -> DataFrame:
    """Merged runs of the pixels within the structuring element of a mask's pixel, clipped to the image; from any runs.

    The masks that agree in all keys but the last, those of a frame, are grown in one task: the rows for each line that a
    run reaches are made, PIECE runs at a time, and put together there. They are neither sorted nor dealt by Spark.
    """
    far, kinds = np.array(reach(radius, shape), np.int64), dict(runs.dtypes)

    def each(frame: pa.Table) -> pa.Table:
        codes = _codes(frame[keys[-1]])
        mask, y, x0, x1 = _grown(codes, *_numbers(frame, "y", "x0", "x1"), width, height, far)
        at = np.unique(codes, return_index=True)[1]
        return pa.table({**{k: frame[k].take(pa.array(at[mask])) for k in keys}, "y": y, "x0": x0, "x1": x1})

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "y long, x0 long, x1 long"])
    return runs.select(*keys, "y", "x0", "x1").groupBy(*(keys[:-1] or keys)).applyInArrow(each, schema)


def shifted(runs: DataFrame, width: int, height: int, radius: int, keys: tuple[str, ...] = KEYS, shape: str = "square") -> DataFrame:
    """Runs that cover just the pixels within the structuring element: on a line that several runs reach as few as can be."""
    return dilate(runs, width, height, radius, keys, shape)


def _codes(values: pa.ChunkedArray) -> np.ndarray:
    """Numbers from 0 for the distinct values, in order of their first rows."""
    return values.combine_chunks().dictionary_encode("encode").indices.to_numpy().astype(np.int64)


def erode(runs: DataFrame, radius: int, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Merged runs of the pixels whose whole square of 2 radius + 1 lines is in the mask; outside the image nothing is.

    Runs are cut at both ends; what is left must lie one above the other in all lines of the square, which a sweep over
    their beginnings and ends counts.
    """
    n = 2 * radius + 1
    cut = runs.select(*keys, "y", (F.col("x0") + radius).alias("x0"), (F.col("x1") - radius).alias("x1")).where("x0 < x1")
    spread = cut.select(*keys, F.explode(F.sequence(F.col("y") - radius, F.col("y") + radius)).alias("y"), "x0", "x1")
    ends = F.array(F.struct(F.col("x0").alias("x"), F.lit(1).alias("d")), F.struct(F.col("x1").alias("x"), F.lit(-1).alias("d")))
    lines = (*keys, "y")
    at = spread.select(*lines, F.explode(ends).alias("e")).groupBy(*lines, F.col("e.x").alias("x0")).agg(F.sum("e.d").alias("d"))
    w = Window.partitionBy(*lines).orderBy("x0")
    deep = at.withColumns({"depth": F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0)), "x1": F.lead("x0").over(w)})
    # Pieces of full depth that adjoin each other are one run.
    return merged(deep.where(F.col("depth") == n), keys)


def union(runs: DataFrame, keys: tuple[str, ...] = ("frame",)) -> DataFrame:
    """Merged runs of the pixels in any mask of a key."""
    return merged(runs, keys)


def overlaps(runs: DataFrame) -> DataFrame:
    """(frame, a, b, overlap) of objects a < b with common pixels, from merged runs: those of a line meet if they overlap."""
    a, b = (runs.select("frame", "y", F.col("obj").alias(k), F.col("x0").alias(f"{k}0"), F.col("x1").alias(f"{k}1")) for k in "ab")
    meet = a.join(b, ["frame", "y"]).where("a < b AND a0 < b1 AND b0 < a1")
    return meet.groupBy("frame", "a", "b").agg(F.sum(F.least("a1", "b1") - F.greatest("a0", "b0")).alias("overlap"))


def touching(runs: DataFrame) -> DataFrame:
    """(frame, a, b) links that join all objects whose runs overlap, directly or through others; runs needn't be merged.

    Not all pairs: each object of an island is linked to the smallest one in it, so that links are no more than runs.
    """
    i = _islands(runs.select("frame", "obj", "y", "x0", "x1"), ("frame", "y"), touch=False)
    members = i.select("frame", "y", "island", "obj").distinct()
    first = F.min("obj").over(Window.partitionBy("frame", "y", "island"))
    return members.select("frame", first.alias("a"), F.col("obj").alias("b")).where("a < b").distinct()


def near(runs: DataFrame, width: int, height: int, radius: int) -> DataFrame:
    """(frame, a, b) links that join all objects whose masks, grown by an ellipse, overlap, directly or through others,
    and each object with itself; runs (frame, obj, y, x0, x1) needn't be merged.

    As touching, but a frame is grown and swept over in one task, so that grown runs cross no shuffle: links are all
    that leaves it.
    """
    far, kinds = np.array(reach(radius, "ellipse"), np.int64), dict(runs.dtypes)

    def each(frame: pa.Table) -> pa.Table:
        objects, codes = np.unique(frame["obj"].to_numpy(), return_inverse=True)
        mask, y, x0, x1 = _grown(codes.astype(np.int64), *_numbers(frame, "y", "x0", "x1"), width, height, far)
        own = np.arange(len(objects))
        pairs = own * len(objects) + own
        if len(y):
            order = np.lexsort((x0, y))
            member, begin, end = mask[order], (y * (width + 1) + x0)[order], (y * (width + 1) + x1)[order]
            first = np.concatenate([[0], np.flatnonzero(begin[1:] >= np.maximum.accumulate(end)[:-1]) + 1])
            smallest = np.repeat(np.minimum.reduceat(member, first), np.diff(np.append(first, len(member))))
            pairs = np.unique(np.concatenate([pairs, smallest * len(objects) + member]))
        values = pa.array(objects, frame.schema.field("obj").type)
        return pa.table({"frame": frame["frame"].take(pa.array(np.zeros(len(pairs), np.int64))), "a": values.take(pa.array(pairs // len(objects))), "b": values.take(pa.array(pairs % len(objects)))})

    rows = runs.select("frame", "obj", "y", "x0", "x1").where("obj IS NOT NULL")
    return rows.groupBy("frame").applyInArrow(each, f"frame {kinds['frame']}, a {kinds['obj']}, b {kinds['obj']}")


def atoms(runs: DataFrame, keys: tuple[str, ...] = ("frame",), member: str = "obj") -> DataFrame:
    """(keys, y, x0, x1, members): pieces of each line with the objects that cover it, at least one; from merged runs.

    Masks of a frame may overlap; its atoms don't. A run that overlaps no other is an atom as it is; islands of several
    are put together and cut at each end of any.
    """
    lines = (*keys, "y")
    i = _islands(runs.select(*lines, "x0", "x1", F.col(member).alias("o")), lines, touch=False)
    i = i.withColumn("n", F.count("*").over(Window.partitionBy(*lines, "island")))
    alone = i.where("n = 1").select(*lines, "x0", "x1", F.array("o").alias("members"))
    crowd = i.where("n > 1").groupBy(*lines, "island").agg(F.collect_list(F.struct("x0", "x1", "o")).alias("r"))
    at = F.array_sort(F.array_distinct(F.concat(F.col("r.x0"), F.col("r.x1"))))
    cut = crowd.select(*lines, "r", at.alias("at")).select(*lines, "r", "at", F.posexplode("at").alias("k", "x0")).select(*lines, "r", "x0", F.get("at", F.col("k") + 1).alias("x1")).where("x1 IS NOT NULL")
    own = F.array_sort(F.transform(F.filter("r", lambda p: (p["x0"] <= F.col("x0")) & (p["x1"] >= F.col("x1"))), lambda p: p["o"]))
    return alone.unionByName(cut.select(*lines, "x0", "x1", own.alias("members")).where(F.size("members") > 0))
