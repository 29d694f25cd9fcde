"""Small cases of frames, masks, groups, jobs, rendering and files."""

import pytest
from pyspark.sql import functions as F

from clipsieve.functions import scalar
from clipsieve.operators import cluster, frames, jobs, masks, render, runs
from clipsieve.plans import hooks
from clipsieve.sources import readers, writers
from clipsieve.streaming.jobs import follow_groups, plan_jobs


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.mark.parametrize(("n", "m", "expected"), [(10, 4, [0, 3, 6, 9]), (10, 3, [0, 4, 9]), (3, 5, [0, 1, 2]), (7, 1, [0]), (0, 4, [])])
def test_uniform(spark, n, m, expected):
    df = frames.uniform_subsample(spark.createDataFrame([("v", n)], "video string, n bigint"), m)
    assert [r[0] for r in rows(df, "frame_idx")] == expected


@pytest.mark.parametrize(("source", "target", "n", "expected"), [(30.0, 10.0, 7, [0, 3, 6]), (10.0, 20.0, 3, [0, 1, 2])])
def test_fps(spark, source, target, n, expected):
    assert [r[0] for r in rows(frames.fps_resample(spark.createDataFrame([("v", n)], "video string, n bigint"), source, target), "frame_idx")] == expected


@pytest.mark.parametrize(("source", "target"), [(29.97, 10.0), (25.0, 15.0), (60.0, 7.0)])
def test_fps_against_loop(spark, source, target):
    due, kept = 0.0, []
    for f in range(500):
        if f >= due:
            kept.append(f)
            due += source / target
    assert [r[0] for r in rows(frames.fps_resample(spark.createDataFrame([("v", 500)], "video string, n bigint"), source, target), "frame_idx")] == kept


def test_nearest_fill_takes_the_earlier_of_two(spark):
    f = spark.createDataFrame([("v", i, i in (0, 4)) for i in range(6)] + [("w", 0, False)], "video string, frame_idx int, tracked boolean")
    assert rows(frames.nearest_fill(f).where("video = 'v'"), "frame_idx", "source_idx") == [(0, 0), (1, 0), (2, 0), (3, 4), (4, 4), (5, 4)]
    assert frames.nearest_fill(f).where("video = 'w'").first()["source_idx"] is None


def test_anchor(spark):
    d = [("a", i, s) for i, s in enumerate([0.5, 1, 1, 1, 1, 0.9, 0.2, 0.95])] + [("b", 0, 0.1), ("b", 1, 0.9), ("b", 2, 0.2)]
    got = rows(frames.anchor_frame(spark.createDataFrame([(v, i, float(s)) for v, i, s in d], "video string, frame_idx int, score double")), "video", "anchor_idx", "found")
    assert got == [("a", 5, True), ("b", 2, False)]


def test_mean_area_counts_overlaps_twice(spark):
    m = spark.createDataFrame([(0, o, p) for o in (1, 2) for p in range(5)], "frame long, obj int, px long")
    assert masks.mean_area(m, 10, 1).first()["mean_area_frac"] == 1.0


def test_morphology_against_loops(spark):
    w, h, px = 6, 5, {0, 1, 2, 6, 7, 8, 12, 13, 14, 28, 29}
    m = spark.createDataFrame([(0, 1, p) for p in px], "frame long, obj int, px long")
    near = lambda p, r: [(p // w + dy, p % w + dx) for dy in range(-r, r + 1) for dx in range(-r, r + 1) if 0 <= p // w + dy < h and 0 <= p % w + dx < w]
    grown = {y * w + x for p in px for y, x in near(p, 1)}
    # Outside the image no pixel is in the mask, so one at the border always goes.
    shrunk = {p for p in px if len(near(p, 1)) == 9 and all(y * w + x in px for y, x in near(p, 1))}
    assert {r[0] for r in rows(masks.dilate(m, w, h, 1), "px")} == grown
    assert {r[0] for r in rows(masks.erode(m, w, h, 1), "px")} == shrunk
    assert runs.reach(2, "ellipse") == [2, 2, 0] and runs.reach(2) == [2, 2, 2]


def test_proximity_groups(spark):
    at = {1: 0, 2: 2, 3: 4, 4: 14}
    m = spark.createDataFrame([(0, o, p) for o, p in at.items()], "frame long, obj int, px long")
    assert rows(cluster.proximity_groups(m, 15, 1, 1), "obj", "group") == [(1, 1), (2, 1), (3, 1), (4, 2)]
    assert rows(cluster.proximity_groups(m, 15, 1, 0), "obj", "group") == [(1, 1), (2, 2), (3, 3), (4, 4)]


def test_fold(spark):
    start = spark.createDataFrame([("v", 1, 0), ("v", 2, 9)], "video string, group int, px long")
    det = [("v", 1, 0, 9), ("v", 1, 1, 5), ("v", 2, 0, 9), ("v", 3, None, None), ("v", 4, 0, 9)]
    got = rows(cluster.assign_groups(spark.createDataFrame(det, "video string, frame long, det long, px long"), start), "frame", "det", "group")
    assert got == [(1, 0, 2), (1, 1, 1), (2, 0, 2), (4, 0, 1)]


def test_fold_stream_equals_batch(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([("v", 0, [[0], [9]]), ("v", 1, [[9], [5]]), ("v", 2, [[9]])], "video string, frame long, dets array<array<bigint>>").coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema("video string, frame long, dets array<array<bigint>>").parquet(str(src))
    q = follow_groups(stream, 2).writeStream.format("memory").queryName("folded").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.table("folded"), "frame", "det", "group") == [(0, 0, 1), (0, 1, 2), (1, 0, 2), (1, 1, 1), (2, 0, 2)]


def test_jobs(spark, tmp_path):
    data = spark.createDataFrame([("1", "  "), ("2", "cat"), ("3", "dog"), ("4", "cow"), ("5", None)], "id string, prompt_word string")
    index = spark.createDataFrame([("3", "/v/3.mp4"), ("4", "/v/4.mp4")], "video_id string, path string")
    done = spark.createDataFrame([("4",)], "video_id string")
    expected = [("1", "skipped"), ("2", "failed"), ("3", None), ("4", "skipped"), ("5", "skipped")]
    assert sorted(tuple(r) for r in jobs.classify(data, index, done).select("video_id", "status").collect()) == expected
    plan = jobs.classify(data, index, done).where("status IS NOT NULL").select("video_id", "status")
    run = spark.createDataFrame([("3", "success")], "video_id string, status string")
    assert tuple(jobs.summary(jobs.merge_results(plan, run)).first()) == (5, 1, 4, 0)
    data.write.json(str(tmp_path / "in"))
    arriving = spark.readStream.schema("id string, prompt_word string").json(str(tmp_path / "in"))
    plan_jobs(arriving, index, done, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_reduction_is_strict_and_truncates(spark):
    v = spark.createDataFrame([("a", 600, 10.0), ("b", 2000, 29.97), ("c", 5, 0.0)], "video_id string, frame_count int, fps double")
    assert sorted((r["video_id"], r["frame_reduction"], r["max_frames"]) for r in jobs.frame_reduction(v).collect()) == [("a", False, None), ("b", True, 1798), ("c", False, None)]


def test_last_path_wins(spark):
    p = spark.createDataFrame([("/a/x.mp4",), ("/b/x.mp4",), ("/c/x.MP4",), ("/c/y.z.mp4",)], "path string")
    assert sorted(tuple(r) for r in jobs.index_last_wins(p).collect()) == [("x", "/b/x.mp4"), ("y.z", "/c/y.z.mp4")]


def test_scalars(spark):
    c = spark.createDataFrame([(1,), (12,), (13,), (0,)], "i int").select("i", scalar.object_color(F.col("i")).alias("c"))
    assert {r["i"]: tuple(r["c"]) for r in c.collect()} == {1: (255, 0, 0), 12: (0, 128, 255), 13: (255, 0, 0), 0: (0, 128, 255)}
    assert spark.range(1).select(render.blend(F.lit(255), F.lit(0))).first()[0] == 127
    values = [0.125, 0.025, -0.375, 2.675, 1e15, -0.004, *(k / 1000 for k in range(5, 3000, 10)), *(k / 8 for k in range(300)), *(k * 1.37e7 + 0.005 for k in range(200))]
    got = spark.createDataFrame([(i, v) for i, v in enumerate([*values, None, float("nan")])], "i int, x double").select("i", scalar.python_round2("x").alias("r")).collect()
    assert {r["i"]: r["r"] for r in got} == {i: round(v, 2) for i, v in enumerate(values)} | {len(values): None, len(values) + 1: None}


def test_overlay_paints_in_order(spark):
    pix = spark.createDataFrame([(0, 0, 100, 100, 100), (0, 1, 9, 9, 9)], "frame long, px long, r int, g int, b int")
    m = spark.createDataFrame([(0, 2, 0), (0, 1, 0)], "frame long, obj int, px long")
    assert rows(render.overlay(pix, m), "px", "r", "g", "b") == [(0, 88, 152, 25), (1, 9, 9, 9)]


def test_files(spark, tmp_path):
    (tmp_path / "qa.csv").write_text('x,video,questions_and_answers\n1,v,"[T] a, ""b"" -> c"\n')
    assert readers.grouped_csv(spark, str(tmp_path / "qa.csv")).collect() == [("v", '[T] a, "b" -> c')]
    (tmp_path / "data.json").write_text('[{"id": 7, "prompt_word": null}, {"id": "x", "prompt_word": "cat"}]')
    assert readers.prompt_mapping(spark, str(tmp_path / "data.json")).collect() == [("7", None), ("x", "cat")]
    records = spark.createDataFrame([("v", "cat", "success"), ("w", None, "skipped")], "video_id string, prompt_word string, status string")
    writers.append_status(records, str(tmp_path / "s"))
    writers.append_status(records, str(tmp_path / "s"))
    assert readers.status_records(spark, str(tmp_path / "s")).count() == 4
    assert sorted(r[0] for r in writers.status_json(records).collect()) == ['{"video_id":"v","prompt_word":"cat","status":"success"}', '{"video_id":"w","status":"skipped"}']
    m = spark.createDataFrame([("v", 0, 1, 5), ("w", 0, 1, 6)], "video string, frame long, obj int, px long")
    writers.save_masks(m, spark.createDataFrame([("v", 10)], "video string, height int"), str(tmp_path / "m"))
    assert readers.masks(spark, str(tmp_path / "m"), "v").select("px").collect() == [(5,)]
    (tmp_path / "vids/a").mkdir(parents=True)
    (tmp_path / "vids/a/x.mp4").write_bytes(b"x")
    (tmp_path / "vids/a/x.MP4").write_bytes(b"x")
    assert jobs.index_last_wins(readers.video_paths(spark, str(tmp_path / "vids"))).select("video_id").collect() == [("x",)]


def test_hooks_without_a_model_say_so(spark):
    with pytest.raises(NotImplementedError):
        hooks.call("segment", spark.range(1))
    with pytest.raises(ValueError, match="no hook"):
        hooks.register("other", lambda x: x)
