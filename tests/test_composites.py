"""The composites around models and codecs: stand-ins for the models, small hand-made videos."""

import json
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from clipsieve.config import InpaintSettings, check_request
from clipsieve.operators import batch, frames, inpaint, jobs, masks, segment
from clipsieve.operators.telea import telea
from clipsieve.plans import hooks
from clipsieve.sources import readers, writers


@pytest.fixture(scope="module")
def detections(spark):
    """Two videos of a 6 by 4 image: a has two detections in its first frame, b none there."""
    rows = [("a", 0, 0, 0.9, [0, 1]), ("a", 0, 1, 0.8, [10, 11, 17]), ("a", 1, 0, 0.7, [10, 11]), ("a", 1, 1, 0.4, [0, 1, 2, 3]), ("a", 3, 0, 0.6, [1]), ("b", 1, 0, 0.9, [5])]
    return spark.createDataFrame([(v, f, d, s, p) for v, f, d, s, px in rows for p in px], "video string, frame long, det int, score double, px long")


@pytest.fixture(scope="module")
def videos(spark):
    return spark.createDataFrame([("a", 4), ("b", 2)], "video string, n long")


def by_frame(m):
    out = {}
    for r in m.collect():
        out.setdefault((r["video"], r["frame"], r["obj"]), set()).add(r["px"])
    return out


def test_one_object(detections, videos):
    m, h = segment.segment_video(detections, videos, 6, 4)
    assert by_frame(m) == {("a", 0, 2): {10, 11, 17}, ("a", 1, 2): {10, 11}, ("a", 3, 2): {1}}
    got = {r["video"]: r for r in h.collect()}
    assert got["a"]["selected"] == 2 and got["a"]["total_area"] == 6 and got["a"]["mean_area_frac"] == 6 / (24 * 4)
    assert got["b"]["error"] and got["a"]["error"] is None
    m, h = segment.segment_video(detections, videos, 6, 4, select_largest=False)
    assert by_frame(m) == {("a", 0, 1): {0, 1}, ("a", 0, 2): {10, 11, 17}, ("a", 1, 1): {10, 11}, ("a", 3, 1): {1}}
    assert {r["video"]: r["object_ids"] for r in h.collect()}["a"] == [1, 2]


def test_many_objects(detections, videos):
    m, h = segment.segment_video(detections, videos, 6, 4, multi_object=True, proximity=1)
    # Frame 2 is empty, so the state is lost and frame 3 joins group 1.
    assert by_frame(m) == {("a", 0, 1): {0, 1}, ("a", 0, 2): {10, 11, 17}, ("a", 1, 2): {10, 11}, ("a", 3, 1): {1}}
    info = json.loads({r["video"]: r["merge_info"] for r in h.collect()}["a"])
    assert info == {"multi_object": True, "num_raw_detections": 2, "num_groups": 2, "merge_proximity_px": 1, "groups": {"1": [0], "2": [1]}}
    assert json.loads(segment.segment_video(detections, videos, 6, 4, multi_object=True, proximity=9)[1].where("video = 'a'").first()["merge_info"])["num_groups"] == 1


def test_tracked(spark, detections, videos):
    seen = []

    def track(rows):
        seen.extend(rows.select("video", "direction", "pos", "frame").collect())
        return segment.with_anchor(rows).select("video", "direction", "pos", F.transform("anchor", lambda p: p + F.col("frame")).alias("px"))

    m, h = segment.segment_tracked(detections, videos, track, 6, 4, stride=1)
    assert by_frame(m) == {("a", f, 1): {f, f + 1} for f in range(4)} | {("b", f, 1): {5 + f} for f in range(2)}
    assert {r["frame"] for r in seen if r["video"] == "b" and r["direction"] == "backward"} == {0, 1}
    info = {r["video"]: json.loads(r["merge_info"]) for r in h.collect()}
    assert info["a"]["anchor_frame"] == 0 and info["b"]["anchor_frame"] == 1 and info["a"]["propagated"] == 4
    verify = lambda rows: rows.select("video", "frame", F.lit(2).cast("long").alias("px"))
    checked = json.loads(segment.segment_tracked(detections, videos, track, 6, 4, verify, stride=1)[1].where("video = 'a'").first()["merge_info"])
    assert (checked["verified"], checked["flagged"]) == (2, 2)


def test_models_from_hooks(spark, detections, videos):
    def segment_rows(batches):
        for rows in batches:
            yield rows.assign(det=0, score=0.95, px=rows["frame"] + 2)[["video", "frame", "det", "score", "px"]]

    def track(batches):
        for rows in batches:
            first = {d: a for d, s, a in zip(rows["direction"], rows["seq"], rows["anchor"], strict=True) if s == 0}
            yield rows.assign(px=rows["direction"].map(first))[["video", "direction", "pos", "px"]]

    hooks.register("segment", segment_rows)
    hooks.register("track", track)
    try:
        found = hooks.caller("segment")(segment.spine(videos))
        m, _ = segment.segment_tracked(found, videos, hooks.caller("track", per_video=True), 6, 4)
        assert by_frame(m) == {("a", f, 1): {2} for f in range(4)} | {("b", f, 1): {2} for f in range(2)}
    finally:
        hooks._registered.clear()


def test_prompts(spark, videos):
    rows = [("a", 0, 0, [0]), ("a", 1, 0, [1]), ("a", 2, 0, [23]), ("a", 2, 1, [0, 1]), ("b", 0, 0, [3])]
    d = spark.createDataFrame([(v, p, f, 0, 0.9, x) for v, p, f, px in rows for x in px], "video string, prompt int, frame long, det int, score double, px long")
    m, h = segment.segment_prompts(d, videos, ["cat", "dog", "hat"], 6, 4, proximity=1)
    assert by_frame(m) == {("a", 0, 1): {0, 1}, ("a", 0, 2): {23}, ("a", 1, 2): {0, 1}, ("b", 0, 1): {3}}
    assert json.loads(h.where("video = 'a'").first()["merge_info"])["groups"] == {"1": ["cat", "dog"], "2": ["hat"]}


def test_choices():
    assert [segment.route(["a"], True), segment.route(["a", "b"], True), segment.route(["a"])] == ["tracked", "prompts", "frames"]
    check_request("remove", "fill")
    for bad in (("swap", "fill"), ("paint", "fill"), ("remove", "other")):
        with pytest.raises(ValueError):
            check_request(*bad)


def test_accessors_and_reuse(spark, detections, videos, tmp_path):
    m, h = segment.segment_video(detections, videos, 6, 4, multi_object=True, proximity=1)
    assert {r["px"] for r in segment.mask_of(m, 0, 2).collect()} == {10, 11, 17} and segment.masks_of_object(m, 1).count() == 3
    assert segment.union_of(m, 0).count() == 5
    writers.save_masks(m, h, str(tmp_path / "saved"))
    back, header = readers.load_masks(spark, str(tmp_path / "saved"), "a")
    assert by_frame(back) == by_frame(m.where("video = 'a'")) and header.first()["multi_object"]
    kept, cut = segment.reuse_masks(back, header, videos.withColumn("n", F.lit(2).cast("long")))
    assert kept.agg(F.max("frame")).first()[0] == 1 and cut.first()["n_frames"] == 2
    with pytest.raises(Exception, match="saved masks only have"):
        segment.reuse_masks(back, header, videos.withColumn("n", F.lit(9).cast("long")))[1].collect()
    assert writers.mask_files(m).where("frame = 0 AND obj = 2").first()["name"] == "mask_f000000_o2.png"


def pictures(spark, value=100):
    image = np.full((4, 6, 3), value, np.uint8).tobytes()
    return spark.createDataFrame([("a", k, 4, 6, image) for k in range(2)], "video string, frame_idx long, h int, w int, rgb binary")


def test_inpaint_groups_and_fallback(spark):
    m = spark.createDataFrame([("a", 0, 1, 0), ("a", 0, 2, 0), ("a", 1, 2, 5)], "video string, frame long, obj int, px long")
    add = lambda images, mask: images + 7 * mask[..., None].astype(np.uint8)
    got = {r["frame_idx"]: np.frombuffer(r["rgb"], np.uint8).reshape(-1, 3)[:, 0].tolist() for r in inpaint.inpaint_groups(pictures(spark), m, add).collect()}
    assert got[0][:2] == [114, 100] and got[1][5] == 107  # two groups, one after the other

    def fails(images, mask):
        raise RuntimeError("out of memory")

    rows = inpaint.inpaint_groups(pictures(spark), m, fails).collect()
    assert {(r["method"], r["fallback_reason"]) for r in rows} == {("fallback", "out of memory")}
    assert set(np.frombuffer(rows[0]["rgb"], np.uint8)) == {100}
    larger = lambda images, mask: np.full((len(images), 8, 12, 3), 50, np.uint8)
    out, info = inpaint.remove(pictures(spark), m, 6, 4, larger, InpaintSettings())
    r = info.first()
    assert (r["method"], r["resized_from"], r["resolution"], r["num_frames"]) == ("model", "12x8", "6x4", 2) and json.loads(r["config"])["dilate_px"] == 0
    assert set(np.frombuffer(out.first()["rgb"], np.uint8)) == {50}
    assert inpaint.inpaint_groups(pictures(spark), m.limit(0), add).first()["method"] == "none"


def test_inpainting_in_chunks(spark):
    """Two videos of seven frames in chunks of three: the model sees context, gives its own frames, and may fail in a chunk."""
    rows = [(v, k, 2, 3, bytes([k] * 18)) for v in "ab" for k in range(7)]
    df = spark.createDataFrame(rows, "video string, frame_idx long, h int, w int, rgb binary").repartition(3)
    m = spark.createDataFrame([(v, k, o, p) for v, o, p in (("a", 1, 0), ("a", 3, 1), ("b", 2, 2)) for k in range(7)], "video string, frame long, obj int, px long")

    def model(images, mask):
        """Each masked pixel becomes 10 more than the first of the frames seen; a chunk that begins with frame 5 fails."""
        if images[0, 1, 2, 0] == 5:
            raise ValueError("frame 5")
        out = images.copy()
        out[mask] = images[0, 1, 2, 0] + 10
        return out

    got = {(r["video"], r["frame_idx"]): (np.frombuffer(r["rgb"], np.uint8).reshape(6, 3)[:, 0].tolist(), r["method"], r["fallback_reason"]) for r in inpaint.inpaint_groups(df, m, model, chunk=3, context=1).collect()}
    assert len(got) == 14
    for (v, k), (px, method, reason) in got.items():
        first = max(0, k // 3 * 3 - 1)
        value = first + 10 if k < 6 else k  # the fallback fills a frame of one colour with that colour
        assert px == ([value, value] if v == "a" else [k, k]) + ([k] if v == "a" else [value]) + [k] * 3
        assert (method, reason) == (("model", None) if k < 6 else ("fallback", "frame 5"))
    without = inpaint.inpaint_groups(df, m, None)
    assert {(r["method"], r["fallback_reason"]) for r in without.collect()} == {("fallback", "no model is registered")}
    assert {tuple(r) for r in without.select("video", "frame_idx", "rgb").collect()} == {(v, k, rgb) for v, k, _, _, rgb in rows}


def plain_telea(image, mask, radius):
    """The same formula, pixel by pixel on dictionaries, its heap a list that is searched."""
    h, w = mask.shape
    where = [(y, x) for y in range(h) for x in range(w)]
    near4 = lambda p: [q for q in ((p[0] - 1, p[1]), (p[0], p[1] - 1), (p[0], p[1] + 1), (p[0] + 1, p[1])) if 0 <= q[0] < h and 0 <= q[1] < w]
    hole = {p for p in where if mask[p]}
    edge = {p for p in where if p not in hole and any(q in hole for q in near4(p))}

    def front(todo, paint, stop):
        time, settled, todo = {p: 0.0 for p in edge}, set(), set(todo)
        while waiting := [(t, p) for p, t in time.items() if p not in settled]:
            t, p = min(waiting)
            if t > stop:
                break
            settled.add(p)
            for q in sorted(near4(p)):
                if q in settled or q not in todo:
                    continue
                y, x = q
                a, b = (min(time[r] if r in settled else math.inf for r in pair) for pair in (((y - 1, x), (y + 1, x)), ((y, x - 1), (y, x + 1))))
                new = (a + b + math.sqrt(2 - (a - b) ** 2)) / 2 if abs(a - b) < 1 else min(a, b) + 1
                first = q not in time
                if first or new < time[q]:
                    time[q] = new
                if first:
                    paint(q, time)
        return time

    out = front(set(where) - hole - edge, lambda q, t: None, radius + 1)
    level = {p: -out.get(p, radius + 1.0) for p in where if p not in hole}
    value = {p: image[p].astype(float) for p in where if p not in hole}

    def slope(of, p, dy, dx):
        low, high = (p[0] - dy, p[1] - dx), (p[0] + dy, p[1] + dx)
        a, b = low in value, high in value
        return (of[high] - of[low]) / 2 if a and b else of[high] - of[p] if b else of[p] - of[low] if a else of[p] * 0.0

    def paint(p, time):
        times = level | {q: t for q, t in time.items() if q in hole and (q in value or q == p)}
        gy, gx = slope(times, p, 1, 0), slope(times, p, 0, 1)
        total, weights = np.zeros(3), 0.0
        for q in list(value):
            ry, rx = p[0] - q[0], p[1] - q[1]
            if 0 < ry * ry + rx * rx <= radius * radius:
                weight = max(abs(ry * gy + rx * gx) / math.hypot(ry, rx), 1e-6) / (ry * ry + rx * rx) / (1 + abs(times[q] - times[p]))
                total += weight * (value[q] + slope(value, q, 1, 0) * ry + slope(value, q, 0, 1) * rx)
                weights += weight
        value[p] = np.clip(total / weights, 0, 255)

    front(hole, paint, math.inf)
    return np.rint(np.array([[value[y, x] for x in range(w)] for y in range(h)])).astype(np.uint8)


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_telea_against_the_formula(seed):
    rng = np.random.default_rng(seed)
    image = rng.integers(0, 256, (9, 11, 3), dtype=np.uint8) if seed > 2 else np.add.outer(np.arange(9) * 9, np.arange(11) * 11)[..., None].repeat(3, axis=2).astype(np.uint8)
    mask = np.zeros((9, 11), bool)
    mask[2:7, 3:8] = True
    mask |= rng.random((9, 11)) < 0.1 * (seed - 1)
    got, want = telea(image, mask, 3).astype(int), plain_telea(image, mask, 3).astype(int)
    assert np.abs(got - want).max() <= 1  # sums in another order may round another way
    assert (got[~mask] == image[~mask]).all()
    if seed == 1:
        assert np.abs(got - image).max() <= 4  # a ramp is carried on


def test_telea_at_its_limits():
    image = np.full((5, 6, 3), 90, np.uint8)
    for mask in (np.zeros((5, 6), bool), np.ones((5, 6), bool), np.arange(30).reshape(5, 6) < 29, np.arange(30).reshape(5, 6) % 2 == 0):
        assert (telea(image, mask) == 90).all()


def test_warm_models_load_once(spark):
    loads = []

    def load():
        loads.append(1)
        return lambda images, mask: images + np.uint8(len(loads))

    model = hooks.Warm("test", load)
    image = np.zeros((1, 2, 2, 3), np.uint8)
    assert [int(model(image, None).max()) for _ in range(3)] == [1, 1, 1]
    model.release()
    assert int(model(image, None).max()) == 2
    m = spark.createDataFrame([("a", 0, 1, 0)], "video string, frame long, obj int, px long")
    assert {r["method"] for r in inpaint.inpaint_groups(pictures(spark), m, hooks.Warm("other", lambda: lambda images, mask: images)).collect()} == {"model"}
    model.release()


def test_resize_keeps_a_ramp():
    ramp = np.repeat(np.arange(0, 240, 10, dtype=np.uint8)[None, :, None], 8, axis=0).repeat(3, axis=2)
    assert np.array_equal(inpaint.resize(ramp, 8, 24), ramp)
    assert np.abs(inpaint.resize(inpaint.resize(ramp, 16, 48), 8, 24).astype(int) - ramp).max() <= 3


def test_matching_a_resolution(spark):
    same = inpaint.match_resolution(pictures(spark), 6, 4).first()
    assert bytes(same["rgb"]) == bytes(pictures(spark).first()["rgb"])
    r = inpaint.match_resolution(pictures(spark, 30), 9, 4).first()
    assert (r["h"], r["w"]) == (4, 9) and set(r["rgb"]) == {30}
    half = np.zeros((4, 8, 3), np.uint8)
    half[:, 4:] = 200
    wide = spark.createDataFrame([("a", 0, 4, 8, half.tobytes())], "video string, frame_idx long, h int, w int, rgb binary")
    image = np.frombuffer(inpaint.match_resolution(wide, 4, 4).first()["rgb"], np.uint8).reshape(4, 4, 3)
    assert np.array_equal(image, half[:, 2:6])
    broken = spark.createDataFrame([("a", 0, 4, 8, b"too short"), ("a", 1, 0, 0, b"")], "video string, frame_idx long, h int, w int, rgb binary")
    assert sorted(map(tuple, inpaint.match_resolution(broken, 4, 4).collect())) == sorted(map(tuple, broken.collect()))


def test_blur(spark):
    px = [y * 12 + x for y in range(3, 8) for x in range(2, 9)]
    m = spark.createDataFrame([(0, 1, p) for p in px], "frame long, obj int, px long")
    image = np.zeros((10, 12))
    image.reshape(-1)[px] = 1
    reach = 6
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / 1.5) ** 2)
    kernel /= kernel.sum()
    wide = np.pad(image, reach, mode="symmetric")
    want = sum(kernel[i] * kernel[j] * wide[i : i + 10, j : j + 12] for i in range(13) for j in range(13))
    got = {r["px"] for r in masks.blur_threshold(m, 12, 10, 1.5).collect()}
    assert got == set(np.flatnonzero(want.reshape(-1) > 0.5).tolist()) and got


def test_erosion_at_the_border(spark):
    m = spark.createDataFrame([(0, 1, p) for p in range(24)], "frame long, obj int, px long")
    assert {r["px"] for r in masks.erode(m, 6, 4, 1).collect()} == {y * 6 + x for y in (1, 2) for x in range(1, 5)}


def test_jobs_run_longest_first(spark):
    """Each worker begins with its longest job; records say who did what and when; ties and unknown lengths have a place."""
    rows = [(f"v{k:03d}", "cat", f"/v/{k}.mp4") for k in range(50)]
    j = spark.createDataFrame(rows, "video_id string, prompt_word string, path string").repartition(5)
    length = {k: None if k % 10 == 9 else (k * 7) % 12 * 100 for k in range(50)}
    probe = spark.createDataFrame([(f"/v/{k}.mp4", n, 25.0) for k, n in length.items() if n is not None], "path string, frame_count long, fps double")
    out = batch.run_batch(j, j.select("video_id").limit(0), probe, lambda job: "done", "/out", tasks=4).collect()
    queue = sorted(range(50), key=lambda k: (length[k] is None, -(length[k] or 0), f"v{k:03d}"))
    seats = [[0, 1, 2, 3], [3, 2, 1, 0]]
    want = {f"v{k:03d}": (seats[p // 4 % 2][p % 4], p // 4 + 1) for p, k in enumerate(queue)}
    assert {r["video_id"]: (r["worker"], r["ordinal"]) for r in out} == want
    assert {length[int(r["video_id"][1:])] for r in out if r["ordinal"] == 1} == {1100, 1000} and {r["status"] for r in out} == {"success", "failed"}
    by_worker = {w: sum(length[int(r["video_id"][1:])] or 0 for r in out if r["worker"] == w) for w in range(4)}
    assert max(by_worker.values()) - min(by_worker.values()) <= 400


def test_equal_jobs_are_spread(spark):
    """All jobs have the same length: places still come from many ranges."""
    df = spark.range(2_000).select(F.col("id").alias("input_pos"), F.lit(0).cast("long").alias("frame_count")).repartition(6)
    out = jobs.ordinal(df, "at", "frame_count", "input_pos", descending=True)
    assert out.where("at <> input_pos").isEmpty() and out.count() == 2_000
    plan = out._jdf.queryExecution().analyzed().toString()
    path = re.search(r"ordinal-[0-9a-f]+", str(out.inputFiles()))[0]
    sizes = [r["n"] for r in spark.read.parquet(f"{spark.conf.get('spark.checkpoint.dir')}/clipsieve/{path}").groupBy("_range").agg(F.count("*").alias("n")).collect()]
    assert "_range" in plan and len(sizes) == 4 and max(sizes) < 1_000


def test_batch(spark):
    rows = [("1", "cat", "/v/1.mp4"), ("2", "dog", "/v/2.mp4"), ("3", "hat", "/v/3.mp4"), ("4", "cup", "/v/4.mp4")]
    j = spark.createDataFrame(rows, "video_id string, prompt_word string, path string")
    done = spark.createDataFrame([("2",)], "video_id string")
    probe = spark.createDataFrame([("/v/1.mp4", 3000, 29.97), ("/v/2.mp4", 1, 25.0), ("/v/4.mp4", 10, 0.0)], "path string, frame_count long, fps double")

    def process(job):
        if job["video_id"] == "4":
            raise ValueError("broken")
        return job["output_video_path"]

    got = {r["video_id"]: r for r in batch.run_batch(j, done, probe, process, "/out/").collect()}
    assert {k: r["status"] for k, r in got.items()} == {"1": "success", "2": "skipped", "3": "failed", "4": "failed"}
    assert got["1"]["duration_seconds"] == 100.1 and got["1"]["frame_reduction_applied"] and got["1"]["output_video_path"] == "/out/1.mp4"
    assert got["4"]["error_message"] == "broken" and got["3"]["output_video_path"] is None
    assert {r["status"] for r in batch.run_batch(j, done, probe, process, "/out", dry_run=True).collect()} == {"dry_run", "skipped", "failed"}


def test_blank_prompts_and_stems(spark):
    data = spark.createDataFrame([(1, "\t\n"), (2, "\u3000"), (3, " cat\n"), (4, None)], "id long, prompt_word string")
    index = jobs.index_last_wins(spark.createDataFrame([("/v/3.mp4",), ("/v/.mp4",), ("/v/a.b.mp4",)], "path string"))
    assert {r["video_id"] for r in index.collect()} == {"3", ".mp4", "a.b"}
    got = {r["video_id"]: r["status"] for r in jobs.classify(data, index, data.select("id").withColumnRenamed("id", "video_id").limit(0)).collect()}
    assert got == {"1": "skipped", "2": "skipped", "3": None, "4": "skipped"}


def test_ordinal_in_ranges(spark):
    rows = [(i, (i * 37) % 11 if i % 5 else None) for i in range(100)]
    df = spark.createDataFrame(rows, "input_pos long, frame_count long").repartition(7)
    got = {r["input_pos"]: r["at"] for r in jobs.ordinal(df, "at", "frame_count", "input_pos", descending=True).collect()}
    order = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert got == {r[0]: k for k, r in enumerate(order)}
    assert jobs.ordinal(df.limit(0), "at", "frame_count").isEmpty()


def test_resampling_adds_up_like_a_decoder(spark):
    for source, target in ((29.97, 10.0), (25.0, 15.0), (60.0, 7.0), (10.0, 24.0), (30.0, 30.0)):
        due, kept = 0.0, []
        for f in range(500):
            if f >= due:
                kept.append(f)
                due += source / target
        v = spark.createDataFrame([(1, 500), (2, 7), (3, 0)], "video long, n long")
        got = {}
        for r in frames.fps_resample(v, source, target).collect():
            got.setdefault(r["video"], []).append(r["frame_idx"])
        assert sorted(got[1]) == kept and sorted(got[2]) == [k for k in kept if k < 7] and 3 not in got


def test_probed_counts(spark):
    paths = spark.createDataFrame([("a",), ("b",)], "path string")
    assert {tuple(r) for r in readers.probed_counts(paths, spark.createDataFrame([("a", 9)], "path string, frame_count int")).collect()} == {("a", 9), ("b", 0)}
