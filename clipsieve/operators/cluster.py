"""Grouping a frame's masks, and following groups from frame to frame."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clipsieve.operators import runs

#: Places in a line where masks come as numbered pixels and the width of the image doesn't matter.
LINE = 4_096
#: Frames up to which their order is broadcast, some 24 bytes each.
BROADCAST_FRAMES = 1_000_000
#: Bits of a word in sets of masks.
WORD = 62


def proximity_links(masks: DataFrame, width: int, height: int, proximity: int) -> DataFrame:
    """(frame, a, b) links between objects, from runs, so that all whose masks, grown by proximity, touch are joined."""
    return (runs.near(masks, width, height, proximity) if proximity else runs.touching(masks)).where("a < b")


def proximity_pairs(masks: DataFrame, width: int, height: int, proximity: int) -> DataFrame:
    """The same from pixels."""
    return proximity_links(runs.from_pixels(masks, width), width, height, proximity)


def components_per_frame(objects: DataFrame, pairs: DataFrame) -> DataFrame:
    """(frame, obj, group): objects (frame, obj) that pairs (frame, a, b) join, directly or through others.

    Groups are numbered from 1 by their smallest object. The union-find runs per frame over its few objects.
    """
    own = objects.select("frame", F.col("obj").alias("a")).distinct().withColumn("b", F.col("a"))
    return _components(own.unionByName(pairs))


def _components(pairs: DataFrame) -> DataFrame:
    """The same from links that have each object with itself among them."""

    def group(frame: pd.DataFrame) -> pd.DataFrame:
        parent = {o: o for o in frame["a"]}

        def root(o):
            while parent[o] != o:
                parent[o] = parent[parent[o]]
                o = parent[o]
            return o

        for a, b in zip(frame["a"], frame["b"], strict=True):
            low, high = sorted((root(a), root(b)))
            parent[high] = low
        roots = {o: root(o) for o in sorted(parent)}
        number = {r: i + 1 for i, r in enumerate(sorted(set(roots.values())))}
        return pd.DataFrame({"frame": frame["frame"].iloc[0], "obj": list(roots), "group": [number[r] for r in roots.values()]})

    kind = dict(pairs.dtypes)
    return pairs.groupBy("frame").applyInPandas(group, f"frame {kind['frame']}, obj {kind['a']}, group int")


def proximity_groups(masks: DataFrame, width: int, height: int, proximity: int) -> DataFrame:
    """(frame, obj, group): objects whose masks, both grown by proximity, touch directly or through others."""
    return proximity_run_groups(runs.from_pixels(masks, width), width, height, proximity)


def proximity_run_groups(masks: DataFrame, width: int, height: int, proximity: int) -> DataFrame:
    """The same from runs: what crosses a shuffle are the runs, once, and links, never what the runs reach."""
    if not proximity:
        return components_per_frame(masks.select("frame", "obj"), proximity_links(masks, width, height, proximity))
    return _components(runs.near(masks, width, height, proximity))


def group_run_areas(masks: DataFrame, groups: DataFrame) -> DataFrame:
    """(frame, group, area): pixels in any member of a group, from runs, merged or not; a frame's runs are joined in one task."""
    kinds = dict(groups.dtypes)

    def each(rows: pa.Table, own: pa.Table) -> pa.Table:
        number = dict(zip(own["obj"].to_pylist(), own["group"].to_pylist(), strict=True))
        found = np.unique(rows["obj"].to_numpy(), return_inverse=True)
        names = sorted({number[o] for o in found[0].tolist() if o in number})
        place = np.array([names.index(number[o]) if o in number else -1 for o in found[0].tolist()], np.int64)[found[1]] if len(names) else np.zeros(0, np.int64)
        y, x0, x1 = (rows[c].to_numpy() for c in ("y", "x0", "x1"))
        area = []
        for k in range(len(names)):
            begin, end = (y << 32) + x0, (y << 32) + x1
            order = np.flatnonzero(place == k)
            order = order[np.argsort(begin[order])]
            begin, end = runs.joined(begin[order], end[order])
            area.append(int((end - begin).sum()))
        return pa.table({"frame": pa.repeat(rows["frame"][0] if len(rows) else own["frame"][0], len(names)), "group": pa.array(names, own.schema.field("group").type), "area": pa.array(area, pa.int64())})

    rows = masks.select("frame", "obj", *(F.col(c).cast("long").alias(c) for c in ("y", "x0", "x1")))
    return rows.groupBy("frame").cogroup(groups.groupBy("frame")).applyInArrow(each, f"frame {kinds['frame']}, group {kinds['group']}, area long")


def group_union(masks: DataFrame, groups: DataFrame) -> DataFrame:
    """(frame, group, area): pixels in any member of a group."""
    return masks.join(groups, ["frame", "obj"]).select("frame", "group", "px").distinct().groupBy("frame", "group").agg(F.count("*").alias("area"))


def fold_frame(state: dict[int, set[int]], detections: list[set[int]], n_groups: int) -> tuple[list[int], dict[int, set[int]]]:
    """One step of the ordered fold: the group of each detection, and the groups' pixels after this frame.

    A detection joins the group it overlaps most in the frame before, the lowest of equal ones, and group 1 without any
    overlap. A single group takes all. A frame without detections leaves all groups empty.
    """
    after: dict[int, set[int]] = {g: set() for g in range(1, n_groups + 1)}
    joined = []
    for pixels in detections:
        g = 1 if n_groups == 1 else max(after, key=lambda k: (len(pixels & state.get(k, set())), -k))
        joined.append(g)
        after[g] |= pixels
    return joined, after


def assign_groups(detections: DataFrame, start: DataFrame) -> DataFrame:
    """(video, frame, det, group) by an ordered fold per video; start (video, group, px) is the state before frame 1.

    detections: (video, frame, det, px), frames counted by every row of the video, a frame without detections as a row
    with null det. Pixels become runs of equal places in any line, as only what masks have in common counts.
    """
    own = runs.from_pixels(detections.where("det IS NOT NULL AND px IS NOT NULL"), LINE, ("video", "frame", "det"))
    return assign_run_groups(detections.select("video", "frame", "det"), own, runs.from_pixels(start, LINE, ("video", "group")))


def _covered(at: np.ndarray, number: np.ndarray, begin: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Which of n masks cover each piece that begins at one of the places, as bits of as many words as it takes; a mask's
    stretches don't overlap each other, so that adding its bit where one begins and taking it where one ends is enough."""
    words = np.zeros((len(at), (n + WORD - 1) // WORD), np.int64)
    bit = np.int64(1) << (number % WORD)
    np.add.at(words, (np.searchsorted(at, begin), number // WORD), bit)
    np.subtract.at(words, (np.searchsorted(at, end), number // WORD), bit)
    return words.cumsum(0)


def _common(frame: pa.Table) -> pa.Table:
    """One row for a frame's rows (video, frame, side, number, begin, end): dets, ids, members and n. Of n, numbers for
    each set of members that covers pixels and each detection, sum up to the detection's pixels in this set's atoms."""
    side, number, begin = (frame[c].to_numpy() for c in ("side", "number", "begin"))
    dets, ids = np.unique(number[side != 1]), np.unique(number[side == 1])
    whole = side != 0
    side, number, begin, end = side[whole], number[whole], begin[whole].astype(np.int64), frame["end"].to_numpy()[whole].astype(np.int64)
    at = np.unique(np.concatenate([begin, end]))
    by_side = [_covered(at, np.searchsorted(names, number[side == k]), begin[side == k], end[side == k], len(names)) for k, names in ((1, ids), (2, dets))]
    both = np.flatnonzero(by_side[0].any(1) & by_side[1].any(1))
    size = (at[both + 1] - at[both]).astype(float)
    sets, which = np.unique(by_side[0][both], axis=0, return_inverse=True) if len(both) else (by_side[0][both], both)
    n = np.zeros((len(dets), len(sets)), np.int64)
    for d in range(len(dets) if len(both) else 0):
        n[d] = np.bincount(which.ravel(), size * (by_side[1][both, d // WORD] >> (d % WORD) & 1), len(sets))
    small = n.astype(np.int32) if n.max(initial=0) < 2**31 else n
    first = frame.select(["video", "frame"]).slice(0, 1)
    packed = {"dets": pa.array([dets], pa.list_(pa.int64())), "ids": pa.array([ids], pa.list_(pa.int64())), "members": pa.array([sets.tobytes()], pa.binary()), "n": pa.array([small.tobytes()], pa.binary())}
    return pa.table({**{c: first[c] for c in first.column_names}, **packed})


def assign_run_groups(present: DataFrame, detections: DataFrame, start: DataFrame) -> DataFrame:
    """The same from merged runs: present (video, frame, det), detections (video, frame, det, y, x0, x1), start (video, group, y, x0, x1).

    The frame before is cut into atoms, the pixels that the same detections (at first: groups) cover. How many pixels of a
    detection lie in each atom is all that the fold needs to know: a group's overlap is the sum over atoms with a member
    in it, whichever group the members will have joined, and exact where they overlap. A frame's runs and those of the
    frame before meet in one task, which counts them; the fold itself, in order of frames, has a row of counts per frame.
    """
    kind = dict(present.dtypes)["video"]
    seen = present.select("video", F.col("frame").cast("long").alias("frame"), F.col("det").cast("long").alias("det")).distinct()
    order = Window.partitionBy("video").orderBy("frame")
    frames = seen.select("video", "frame").distinct().withColumns({"after": F.lead("frame").over(order), "place": F.row_number().over(order)})
    # A run is a stretch of a row of all lines. A member is twice a detection's number, or twice a group's plus one.
    ends = [(F.col("y").cast("long") * 2**32 + F.col(x)).alias(c) for x, c in (("x0", "begin"), ("x1", "end"))]
    rows = lambda df, frame, side, number: df.select("video", F.col(frame).alias("frame"), F.lit(side).alias("side"), number.cast("long").alias("number"), "begin", "end")
    own = detections.where("det IS NOT NULL").select("video", F.col("frame").cast("long").alias("frame"), "det", *ends)
    after = frames.where("after IS NOT NULL").select("video", "frame", "after")
    # A shuffle of all runs only for more frames than can be broadcast.
    moved = own.join(F.broadcast(after) if after.count() <= BROADCAST_FRAMES else after, ["video", "frame"])
    given = start.select("video", "group", *ends).join(frames.where("place = 1").select("video", "frame"), "video")
    no = F.lit(None).cast("long")
    all_rows = rows(seen.where("det IS NOT NULL").withColumns({"begin": no, "end": no}), "frame", 0, F.col("det"))
    all_rows = all_rows.unionByName(rows(moved, "after", 1, F.col("det") * 2)).unionByName(rows(given, "frame", 1, F.col("group") * 2 + 1)).unionByName(rows(own, "frame", 2, F.col("det")))
    counts = all_rows.groupBy("video", "frame").applyInArrow(_common, f"video {kind}, frame long, dets array<long>, ids array<long>, members binary, n binary")
    groups = start.groupBy("video").agg(F.max("group").cast("long").alias("groups"))

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        n = int(rows["groups"].fillna(1).iloc[0])
        joined: dict[int, int] = {2 * g + 1: g for g in range(1, n + 1)}
        out = []
        for r in rows[rows["dets"].str.len() > 0].sort_values("frame").itertuples():
            overlap = np.zeros((len(r.dets), n), np.int64)
            if n > 1 and r.members:
                sets = np.frombuffer(r.members, np.int64).reshape(-1, (len(r.ids) + WORD - 1) // WORD)
                pixels = np.frombuffer(r.n, np.int32 if len(r.n) == 4 * len(sets) * len(r.dets) else np.int64).reshape(len(r.dets), len(sets))
                for g in range(n):
                    mine = np.zeros(sets.shape[1], np.int64)
                    for k, m in enumerate(r.ids):
                        mine[k // WORD] |= np.int64(joined[m] == g + 1) << np.int64(k % WORD)
                    overlap[:, g] = pixels[:, (sets & mine).any(1)].sum(1)
            now = {2 * int(d): int(g) + 1 for d, g in zip(r.dets, overlap.argmax(1), strict=True)}
            out += [(rows["video"].iloc[0], int(r.frame), m // 2, g) for m, g in now.items()]
            joined |= now
        return pd.DataFrame(out, columns=["video", "frame", "det", "group"])

    return counts.join(groups, "video", "left").groupBy("video").applyInPandas(fold, f"video {kind}, frame long, det long, group int")
