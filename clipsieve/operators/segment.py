"""Segmentation of whole videos from detections: one object, many objects, several prompts, or anchor, track and verify.

Detections are pixels (video, frame, det, score, px), videos (video, n) give the number of frames. The models behind
them are hooks; what is done with their output is relational. Every function returns the masks (video, frame, obj, px)
and a header row per video; a frame without pixels has an empty mask.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipsieve.functions.scalar import area_percent
from clipsieve.operators import cluster, frames
from clipsieve.sources.shared import stored

HEADER = ["video", "object_ids", "selected", "n_frames", "total_area", "mean_area_frac", "merge_info", "error"]


def confident(detections: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Detections whose score reaches the threshold."""
    return detections.where(F.col("score") >= threshold)


def largest(detections: DataFrame, keys: tuple[str, ...] = ("video", "frame")) -> DataFrame:
    """(keys, det, area) of the largest detection of each key, the first of equal ones."""
    areas = detections.groupBy(*keys, "det").agg(F.count("*").alias("area"))
    w = Window.partitionBy(*keys).orderBy(F.desc("area"), "det")
    return areas.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def best_by_score(detections: DataFrame, keys: tuple[str, ...] = ("video", "frame")) -> DataFrame:
    """(keys, det, score) of the detection with the best score, the first of equal ones."""
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "det")
    d = detections.select(*keys, "det", "score").distinct()
    return d.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def spine(videos: DataFrame) -> DataFrame:
    """(video, frame) of all frames of the videos."""
    last = F.when(F.col("n") > 0, F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1)).otherwise(F.array().cast("array<long>"))
    return videos.select("video", F.explode(last).alias("frame"))


def _header(videos: DataFrame, masks: DataFrame, objects: DataFrame, pixels: int, error: str) -> DataFrame:
    """A row per video: objects (video, object_ids, selected, merge_info) and the areas, an error where no objects are."""
    area = masks.groupBy("video").agg(F.count("*").alias("total_area"))
    h = videos.join(objects, "video", "left").join(area, "video", "left").withColumn("total_area", F.coalesce("total_area", F.lit(0).cast("long")))
    failed = F.col("object_ids").isNull()
    frac = F.when(F.col("n") > 0, F.col("total_area") / (F.lit(pixels) * F.col("n"))).otherwise(F.lit(0.0))
    return h.select("video", "object_ids", "selected", F.col("n").alias("n_frames"), "total_area", frac.alias("mean_area_frac"), "merge_info", F.when(failed, F.lit(error)).alias("error"))


def _numbered_groups(members: DataFrame, name: str) -> Column:
    return F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("obj").cast("string"), F.col(name)))))


def segment_video(detections: DataFrame, videos: DataFrame, width: int, height: int, threshold: float = 0.5, select_largest: bool = True, multi_object: bool = False, proximity: int = 50) -> tuple[DataFrame, DataFrame]:
    """One object per video, or groups of objects that stand apart in the first frame.

    One object: the largest detection of the first frame gives the number (without select_largest all are kept there and
    the first gives it); in every later frame the largest detection is that object. Many: the first frame's detections
    form groups by proximity, and each later detection joins the group it overlaps most in the frame before. A video
    without detection in its first frame has an error in its header and no masks.
    """
    d = confident(detections, threshold)
    first = d.where("frame = 0")
    started = first.select("video").distinct()
    if multi_object:
        groups = cluster.proximity_groups(first.select(F.col("video").alias("frame"), F.col("det").alias("obj"), "px"), width, height, proximity)
        groups = groups.select(F.col("frame").alias("video"), F.col("obj").alias("det"), F.col("group").alias("obj"))
        start = first.join(groups, ["video", "det"]).select("video", F.col("obj").alias("group"), "px").distinct()
        later = spine(videos).where("frame > 0").join(started, "video", "left_semi").join(d.where("frame > 0"), ["video", "frame"], "left")
        joined = cluster.assign_groups(later.select("video", "frame", F.col("det").cast("long").alias("det"), "px"), start)
        moved = d.withColumn("det", F.col("det").cast("long")).join(joined, ["video", "frame", "det"]).select("video", "frame", F.col("group").alias("obj"), "px")
        masks = start.select("video", F.lit(0).cast("long").alias("frame"), F.col("group").alias("obj"), "px").unionByName(moved).distinct()
        members = groups.groupBy("video", "obj").agg(F.sort_array(F.collect_list("det")).alias("members"))
        info = F.to_json(F.struct(F.lit(True).alias("multi_object"), F.sum(F.size("members")).alias("num_raw_detections"), F.count("*").alias("num_groups"), F.lit(proximity).alias("merge_proximity_px"), _numbered_groups(members, "members").alias("groups")))
        objects = members.groupBy("video").agg(F.sort_array(F.collect_list("obj")).alias("object_ids"), F.lit(1).alias("selected"), info.alias("merge_info"))
    else:
        top = largest(first).select("video", (F.col("det") + 1).cast("int").alias("selected"))
        if not select_largest:
            top = top.withColumn("selected", F.lit(1))
        every = first.groupBy("video").agg(F.sort_array(F.collect_set((F.col("det") + 1).cast("int"))).alias("every"))
        objects = top.join(every, "video").select("video", F.array("selected").alias("object_ids") if select_largest else F.col("every").alias("object_ids"), "selected", F.lit(None).cast("string").alias("merge_info"))
        kept = largest(d if select_largest else d.where("frame > 0")).select("video", "frame", "det")
        masks = d.join(kept, ["video", "frame", "det"]).join(objects.select("video", "selected"), "video").select("video", "frame", F.col("selected").alias("obj"), "px")
        if not select_largest:
            masks = masks.unionByName(first.select("video", "frame", (F.col("det") + 1).cast("int").alias("obj"), "px"))
        masks = masks.distinct()
    return masks, _header(videos, masks, objects, width * height, "no objects found")


def segment_prompts(detections: DataFrame, videos: DataFrame, prompts: list[str], width: int, height: int, threshold: float = 0.5, proximity: int = 50) -> tuple[DataFrame, DataFrame]:
    """Several prompts per video, from detections (video, prompt, frame, det, score, px), prompt counted from 0.

    Each prompt's mask in a frame is its largest detection. Prompts whose masks in the first frame lie close together,
    directly or through others, are one group in all frames; a prompt without a mask there is a group of its own.
    """
    d = confident(detections, threshold)
    keys = ("video", "prompt", "frame")
    own = d.join(largest(d, keys).select(*keys, "det"), [*keys, "det"]).select(*keys, "px").distinct()
    near = cluster.proximity_pairs(own.where("frame = 0").select(F.col("video").alias("frame"), F.col("prompt").alias("obj"), "px"), width, height, proximity)
    names = F.array(*map(F.lit, prompts))
    every = videos.select("video", F.explode(F.sequence(F.lit(0), F.lit(len(prompts) - 1))).alias("prompt"))
    groups = cluster.components_per_frame(every.select(F.col("video").alias("frame"), F.col("prompt").alias("obj")), near)
    groups = groups.select(F.col("frame").alias("video"), F.col("obj").alias("prompt"), F.col("group").alias("obj"))
    masks = own.join(groups, ["video", "prompt"]).select("video", "frame", "obj", "px").distinct()
    members = groups.groupBy("video", "obj").agg(F.transform(F.sort_array(F.collect_list("prompt")), lambda p: F.get(names, p)).alias("members"))
    info = F.to_json(F.struct(F.lit(True).alias("multi_prompt"), names.alias("prompts"), F.count("*").alias("num_groups"), F.lit(proximity).alias("merge_proximity_px"), _numbered_groups(members, "members").alias("groups")))
    objects = members.groupBy("video").agg(F.sort_array(F.collect_list("obj")).alias("object_ids"), F.lit(1).alias("selected"), info.alias("merge_info"))
    return masks, _header(videos, masks, objects, width * height, "no objects found")


def passes(videos: DataFrame, anchors: DataFrame, cap: int = 500) -> DataFrame:
    """(video, direction, pos, frame, n_pass, kept): the frames of both passes from the anchor, each sub-sampled to cap.

    Forward runs from the anchor to the end, backward, if frames stand before it, from the anchor to the start; pos
    counts along a pass from 0 at the anchor. kept marks the frames that the tracker sees.
    """
    v = videos.join(anchors.select("video", "anchor_idx"), "video")
    ways = F.array(F.struct(F.lit("forward").alias("direction"), (F.col("n") - F.col("anchor_idx")).alias("n_pass"), F.lit(1).alias("step")), F.struct(F.lit("backward").alias("direction"), (F.col("anchor_idx") + 1).alias("n_pass"), F.lit(-1).alias("step")))
    w = v.select("video", "anchor_idx", F.explode(ways).alias("w")).select("video", "anchor_idx", "w.*").where("direction = 'forward' OR anchor_idx > 0")
    kept = F.array_distinct(frames.uniform_indices(F.col("n_pass"), cap))
    rows = w.withColumn("seen", kept).select("video", "direction", "n_pass", "anchor_idx", "step", "seen", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_pass") - 1)).alias("pos"))
    seen = (F.col("n_pass") <= cap) | F.array_contains("seen", F.col("pos"))
    return rows.select("video", "direction", "pos", (F.col("anchor_idx") + F.col("step") * F.col("pos")).alias("frame"), "n_pass", seen.alias("kept"))


def segment_tracked(detections: DataFrame, videos: DataFrame, track: Callable[[DataFrame], DataFrame], width: int, height: int, verify: Callable[[DataFrame], DataFrame] | None = None, threshold: float = 0.5, stride: int = 5, sure: float = 0.9, least: float = 0.3, cap: int = 500, max_area_ratio: float = 3.0, least_overlap: float = 0.10) -> tuple[DataFrame, DataFrame]:
    """One object per video, followed from its surest frame in both directions and checked frame by frame.

    track gets (video, direction, seq, pos, frame, anchor) for the frames of a pass that it may see, numbered by seq;
    anchor, the pixels of the anchor's mask, comes with the first of them only. It returns (video, direction, pos, px),
    px an array, which is stored; a position left out is not tracked. streaming.tracker makes a tracker out of a step
    from frame to frame. Frames that a sub-sampled pass skipped take the mask of the nearest tracked one, which is found
    on rows without masks. The forward mask of a frame counts unless
    it is missing or empty. verify gets (video, frame) and returns the pixels (video, frame, px) that look like the
    object: a mask much larger than the anchor's, or with too little of it there, is emptied and counted as flagged.
    """
    d = confident(detections, threshold)
    top = best_by_score(d)
    found = frames.anchor_frame(top.withColumnRenamed("frame", "frame_idx").join(videos, "video"), stride, sure, least, last="n").where("found")
    anchor = found.select("video", "anchor_idx", "anchor_score").join(top.select("video", F.col("frame").alias("anchor_idx"), "det"), ["video", "anchor_idx"])
    shape = d.withColumnRenamed("frame", "anchor_idx").join(anchor.select("video", "anchor_idx", "det"), ["video", "anchor_idx", "det"]).groupBy("video").agg(F.sort_array(F.collect_set("px")).alias("anchor"))
    p = passes(videos, anchor, cap)
    seen = p.where("kept").withColumn("seq", (F.row_number().over(Window.partitionBy("video", "direction").orderBy("pos")) - 1).cast("long"))
    first = shape.withColumn("seq", F.lit(0).cast("long"))
    tracked = stored(track(seen.join(first, ["video", "seq"], "left").select("video", "direction", "seq", "pos", "frame", "anchor")), "tracked")
    along = p.join(tracked.select("video", "direction", "pos", F.when(F.col("px").isNotNull(), F.col("pos")).alias("own")), ["video", "direction", "pos"], "left")
    # Only a sub-sampled pass is filled.
    w = Window.partitionBy("video", "direction").orderBy("pos")
    before, after = F.last("own", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first("own", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    near = along.withColumns({"before": before, "after": after})
    left = F.col("after").isNull() | (F.col("pos") - F.col("before") <= F.col("after") - F.col("pos"))
    source = F.when(F.col("n_pass") <= cap, F.col("own")).when(F.col("before").isNotNull() & left, F.col("before")).otherwise(F.col("after"))
    filled = near.select("video", "direction", "frame", source.alias("pos")).where("pos IS NOT NULL").join(tracked, ["video", "direction", "pos"]).select("video", "direction", "frame", "px")
    side = lambda name, to: filled.where(F.col("direction") == name).select("video", "frame", F.col("px").alias(to))
    both = side("forward", "f").join(side("backward", "b"), ["video", "frame"], "full")
    merged = both.select("video", "frame", F.when((F.coalesce(F.size("f"), F.lit(0)) > 0) | F.col("b").isNull(), F.col("f")).otherwise(F.col("b")).alias("px"))
    rows = spine(videos).join(anchor.select("video", "anchor_idx", "anchor_score"), "video").join(shape.select("video", F.size("anchor").alias("anchor_area")), "video").join(merged, ["video", "frame"], "left")
    rows = rows.withColumn("px", F.array_distinct(F.coalesce("px", F.array().cast("array<long>")))).withColumn("area", F.size("px"))
    large = F.col("area") > F.lit(max_area_ratio) * F.col("anchor_area")
    if verify is None:
        rows = rows.withColumns({"flagged": F.lit(False), "verified": F.lit(False)})
    else:
        spatial = verify(rows.where("area > 0").select("video", "frame")).groupBy("video", "frame").agg(F.collect_set("px").alias("spatial"))
        rows = rows.join(spatial, ["video", "frame"], "left")
        inside = F.coalesce(F.size(F.array_intersect("px", "spatial")), F.lit(0)) / F.greatest(F.col("area").cast("double"), F.lit(1.0))
        rows = rows.withColumn("flagged", (F.col("area") > 0) & (large | (inside < least_overlap)))
        rows = rows.withColumn("verified", (F.col("area") > 0) & ~F.col("flagged"))
    masks = rows.where(~F.col("flagged")).select("video", "frame", F.lit(1).alias("obj"), F.explode("px").alias("px"))
    info = F.to_json(
        F.struct(
            F.first("anchor_idx").alias("anchor_frame"), F.first("anchor_score").alias("anchor_score"), F.first(area_percent(F.col("anchor_area"), width * height)).alias("anchor_area_percent"),
            F.count_if(F.col("area") > 0).alias("propagated"), F.count_if("verified").alias("verified"), F.count_if("flagged").alias("flagged"),
        )
    )
    objects = rows.groupBy("video").agg(F.array(F.lit(1)).alias("object_ids"), F.lit(1).alias("selected"), info.alias("merge_info"))
    return masks, _header(videos, masks, objects, width * height, "no anchor found")


def with_anchor(rows: DataFrame) -> DataFrame:
    """What a tracker gets, with the anchor's mask on every row, for one that looks at each frame by itself."""
    first = rows.where("anchor IS NOT NULL").select("video", "direction", "anchor")
    return rows.drop("anchor").join(first, ["video", "direction"])


def route(prompts: list[str], tracker: bool = False) -> str:
    """Which of the ways a prompt takes: the tracker for a single one, then several prompts, then frame by frame."""
    return "tracked" if tracker and len(prompts) == 1 else "prompts" if len(prompts) > 1 else "frames"


def mask_of(masks: DataFrame, frame: int, obj: int) -> DataFrame:
    """(video, px) of an object's mask in a frame."""
    return masks.where((F.col("frame") == frame) & (F.col("obj") == obj)).select("video", "px")


def masks_of_object(masks: DataFrame, obj: int) -> DataFrame:
    """(video, frame, px) of an object's masks in all frames that have one."""
    return masks.where(F.col("obj") == obj).select("video", "frame", "px")


def union_of(masks: DataFrame, frame: int) -> DataFrame:
    """(video, px) in any mask of a frame."""
    return masks.where(F.col("frame") == frame).select("video", "px").distinct()


def reuse_masks(saved: DataFrame, header: DataFrame, videos: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Saved masks cut to the frames loaded now, and their header; a video with fewer saved than loaded frames raises."""
    h = header.drop("n").join(videos.select("video", "n"), "video")
    fewer = F.raise_error(F.concat(F.lit("saved masks only have "), F.col("n_frames").cast("string"), F.lit(" frames for video "), F.col("video").cast("string")))
    checked = h.withColumn("n_frames", F.when(F.col("n_frames") < F.col("n"), fewer.cast("long")).otherwise(F.col("n").cast("long"))).drop("n")
    kept = saved.join(checked.select("video", "n_frames"), "video").where(F.col("frame") < F.col("n_frames"))
    return kept.select(saved.columns), checked
