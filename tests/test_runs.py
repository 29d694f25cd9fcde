"""Masks as runs against sets of pixels, and the ordered fold on them."""

import math
import random

import pytest
from pyspark.sql import functions as F

from clipsieve.operators import cluster, masks, runs

W, H = 40, 24


def blobs(seed, objects=4, spots=5):
    """Sets of pixels: ragged spots, single pixels, a spot with a hole, all over the image and at its borders."""
    rng = random.Random(seed)
    out = {}
    for o in range(objects):
        px = set()
        for _ in range(spots):
            cx, cy, r = rng.randrange(W), rng.randrange(H), rng.randrange(5)
            px |= {(y, x) for y in range(cy - r, cy + r + 1) for x in range(cx - r, cx + r + 1) if 0 <= y < H and 0 <= x < W and rng.random() < 0.9}
        px |= {(rng.randrange(H), rng.randrange(W))}
        out[o] = px - {(H // 2, W // 2)}
    return out


def frame_of(spark, sets, frame=0):
    return spark.createDataFrame([(frame, o, y * W + x) for o, px in sets.items() for y, x in px], "frame long, obj long, px long").repartition(3)


def pixels(df):
    out = {}
    for r in runs.to_pixels(df, W).collect():
        out.setdefault(r["obj"], []).append((r["px"] // W, r["px"] % W))
    assert all(len(v) == len(set(v)) for v in out.values())
    return {o: set(v) for o, v in out.items()}


def grow(px, radius, shape):
    reach = {dy: radius if shape == "square" else round(math.sqrt(radius * radius - dy * dy)) for dy in range(-radius, radius + 1)}
    return {(y + dy, x + dx) for y, x in px for dy, r in reach.items() for dx in range(-r, r + 1) if 0 <= y + dy < H and 0 <= x + dx < W}


@pytest.mark.parametrize(("radius", "shape"), [(1, "square"), (3, "ellipse"), (4, "square"), (5, "ellipse"), (9, "ellipse"), (30, "ellipse")])
def test_dilation(spark, radius, shape):
    sets = blobs(radius)
    m = runs.from_pixels(frame_of(spark, sets), W)
    assert pixels(m) == sets
    assert pixels(runs.dilate(m, W, H, radius, shape=shape)) == {o: grow(px, radius, shape) for o, px in sets.items()}


@pytest.mark.parametrize("radius", [1, 2])
def test_erosion(spark, radius):
    sets = blobs(radius + 50, spots=12)
    want = {o: {(y, x) for y, x in px if all((y + dy, x + dx) in px for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1))} for o, px in sets.items()}
    assert pixels(runs.erode(runs.from_pixels(frame_of(spark, sets), W), radius)) == {o: px for o, px in want.items() if px}


def test_rows_of_a_solid_mask(spark):
    """A mask of a hundred thousand pixels: a row per line and one per line that its ends reach, not (2 r + 1) per line."""
    box = spark.range(250).select(F.lit(0).alias("frame"), F.lit(1).alias("obj"), (F.col("id") + 300).alias("y"), F.lit(500).cast("long").alias("x0"), F.lit(900).cast("long").alias("x1"))
    assert runs.shifted(box, 1920, 1080, 50, shape="ellipse").count() == 250 + 2 * 50
    disc = spark.range(-200, 201).select(F.lit(0).alias("frame"), F.lit(1).alias("obj"), (F.col("id") + 500).alias("y"), F.floor(900 - F.sqrt(40_000 - F.col("id") * F.col("id"))).alias("x0"), F.ceil(900 + F.sqrt(40_000 - F.col("id") * F.col("id")) + 1).alias("x1"))
    assert runs.shifted(disc, 1920, 1080, 50, shape="ellipse").count() < 401 * 101 / 2
    grown = runs.areas(runs.dilate(disc, 1920, 1080, 50, shape="ellipse")).first()["area"]
    assert abs(grown - math.pi * 250**2) < 0.02 * grown


def test_areas_unions_overlaps(spark):
    sets = blobs(7)
    m = runs.from_pixels(frame_of(spark, sets), W)
    assert {r["obj"]: r["area"] for r in runs.areas(m).collect()} == {o: len(px) for o, px in sets.items()}
    assert runs.areas(runs.union(m), ("frame",)).first()["area"] == len(set().union(*sets.values()))
    assert {(r["a"], r["b"]): r["overlap"] for r in runs.overlaps(m).collect()} == {(a, b): n for a in sets for b in sets if a < b and (n := len(sets[a] & sets[b]))}
    by_bits = {(r["a"], r["b"]): r["overlap"] for r in masks.overlap_pairs(frame_of(spark, sets)).collect()}
    assert by_bits == {(r["a"], r["b"]): r["overlap"] for r in runs.overlaps(m).collect()}


def test_atoms(spark):
    sets = blobs(8)
    got = {}
    for r in runs.atoms(runs.from_pixels(frame_of(spark, sets), W)).collect():
        for x in range(r["x0"], r["x1"]):
            assert (r["y"], x) not in got
            got[r["y"], x] = list(r["members"])
    assert got == {p: sorted(o for o in sets if p in sets[o]) for p in set().union(*sets.values())}


@pytest.mark.parametrize("proximity", [0, 1, 4])
def test_groups(spark, proximity):
    sets = blobs(21, objects=9, spots=1)
    grown = {o: grow(px, proximity, "ellipse") for o, px in sets.items()}
    root = {o: o for o in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if grown[a] & grown[b]:
                    root[a] = root[b] = min(root[a], root[b])
    number = {r: i + 1 for i, r in enumerate(sorted(set(root.values())))}
    got = {r["obj"]: r["group"] for r in cluster.proximity_groups(frame_of(spark, sets), W, H, proximity).collect()}
    assert got == {o: number[root[o]] for o in sets}


def fold(start, frames):
    """Frame by frame on sets of pixels."""
    n, state, out = max(start, default=1), start, []
    for frame, dets in frames:
        after = {g: set() for g in range(1, n + 1)}
        for d in sorted(dets):
            g = 1 if n == 1 else max(after, key=lambda k: (len(dets[d] & state.get(k, set())), -k))
            after[g] |= dets[d]
            out.append((frame, d, g))
        state = after
    return sorted(out)


def test_fold_of_overlapping_masks(spark):
    """Detections overlap each other, frames are left out or empty, one video has no groups at its start."""
    rng = random.Random(4)
    det_rows, start_rows, want = [], [], set()
    for video in "abc":
        start = {g: px for g, px in enumerate(blobs(ord(video), objects=3, spots=3).values(), 1)} if video != "c" else {}
        start_rows += [(video, g, y * W + x) for g, px in start.items() for y, x in px]
        frames = []
        for t in (1, 2, 4, 7, 8, 9):
            dets = {} if t == 4 and video == "a" else dict(enumerate(blobs(rng.randrange(999), objects=4, spots=3).values()))
            det_rows += [(video, t, d, y * W + x) for d, px in dets.items() for y, x in px] or [(video, t, None, None)]
            frames.append((t, dets))
        want |= {(video, *r) for r in fold(start, frames)}
    det = spark.createDataFrame(det_rows, "video string, frame long, det int, px long").repartition(4)
    start = spark.createDataFrame(start_rows, "video string, group int, px long")
    out = cluster.assign_groups(det, start)
    assert {tuple(r) for r in out.select("video", "frame", "det", "group").collect()} == want and out.count() == len(want)


def test_fold_of_large_masks(spark):
    """Masks of a hundred thousand pixels that drift: what reaches Python has a row per detection and atom, and no pixel."""
    lines = spark.range(250).crossJoin(spark.range(1, 7).withColumnRenamed("id", "frame")).crossJoin(spark.range(2).withColumnRenamed("id", "det"))
    x0 = 100 + F.col("frame") * 10 + F.col("det") * 900
    m = lines.select(F.lit("v").alias("video"), "frame", "det", (F.col("id") + 50).alias("y"), x0.alias("x0"), (x0 + 400).alias("x1"))
    start = m.where("frame = 1").select("video", (F.col("det") + 1).alias("group"), "y", "x0", "x1")
    later = m.where("frame > 1")
    out = cluster.assign_run_groups(later.select("video", "frame", "det"), later, start)
    assert {(r["frame"], r["det"], r["group"]) for r in out.collect()} == {(t, d, d + 1) for t in range(2, 7) for d in range(2)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    into = plan[plan.index("FlatMapGroupsInPandas") :].splitlines()[1]
    assert "members" in into and "px" not in into and "x0" not in into


def test_crowded_masks_grow_in_their_frame(spark):
    """Many spots on few lines: no row for each line that a run reaches comes from Spark, to be sorted there."""
    spots = spark.range(600).select(F.lit(0).cast("long").alias("frame"), (F.col("id") % 3).alias("obj"), (F.col("id") * 7 % 100).alias("y"), (F.col("id") * 37 % 1500).alias("x0"), (F.col("id") * 37 % 1500 + 9).alias("x1"))
    far = runs.reach(50, "ellipse")
    want = {}
    for r in spots.collect():
        for dy in range(-50, 51):
            if 0 <= r["y"] + dy < 1080:
                want.setdefault(r["obj"], {}).setdefault(r["y"] + dy, set()).update(range(max(r["x0"] - far[abs(dy)], 0), r["x1"] + far[abs(dy)]))
    grown = runs.dilate(spots, 1920, 1080, 50, shape="ellipse")
    assert {r["obj"]: r["area"] for r in runs.areas(grown).collect()} == {o: sum(map(len, lines.values())) for o, lines in want.items()}
    for df in (grown, cluster.proximity_links(spots, 1920, 1080, 50)):
        assert "Generate" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in cluster.group_run_areas(spots, spots.select("frame", "obj", F.lit(1).alias("group")).distinct()).collect()] == [(0, 1, len({(r["y"], x) for r in spots.collect() for x in range(r["x0"], r["x1"])}))]


def test_fold_has_a_row_per_frame(spark):
    """Detections that overlap in very many ways: their atoms are counted in their frame and are no rows of the fold."""
    spots = spark.range(4_000).select(F.lit("v").alias("video"), (F.col("id") % 2).alias("frame"), (F.col("id") % 18).alias("det"), (F.col("id") % 97).alias("y"), (F.col("id") * 37 % 1500).alias("x0"), (F.col("id") * 37 % 1500 + 150).alias("x1"))
    m = runs.merged(spots, ("video", "frame", "det"))
    start = runs.merged(spots.select("video", (F.col("det") % 3 + 1).alias("group"), "y", "x0", "x1"), ("video", "group"))
    out = cluster.assign_run_groups(m.select("video", "frame", "det"), m, start)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "Generate" not in plan[: plan.index("FlatMapGroupsInArrow")]
    px = {}
    for r in m.collect():
        px.setdefault((r["frame"], r["det"]), set()).update((r["y"], x) for x in range(r["x0"], r["x1"]))
    state = {}
    for r in start.collect():
        state.setdefault(r["group"], set()).update((r["y"], x) for x in range(r["x0"], r["x1"]))
    want = set()
    for t in (0, 1):
        dets = sorted(d for f, d in px if f == t)
        joins, state = cluster.fold_frame(state, [px[t, d] for d in dets], 3)
        want |= {("v", t, d, g) for d, g in zip(dets, joins, strict=True)}
    assert {tuple(r) for r in out.collect()} == want


def test_no_masks(spark):
    none = spark.createDataFrame([], "frame long, obj long, px long")
    assert cluster.proximity_groups(none, W, H, 5).isEmpty() and runs.erode(runs.from_pixels(none, W), 1).isEmpty() and runs.touching(runs.from_pixels(none, W)).isEmpty()
