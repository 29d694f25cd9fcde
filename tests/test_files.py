"""Real files: pictures, saved masks in their own layout, one-file outputs, and batches of records that count once."""

import json
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from clipsieve.functions import pictures
from clipsieve.operators import runs, video
from clipsieve.plans import hooks
from clipsieve.sources import files, journal, readers, saved, writers

PAETH = lambda a, b, c: min((a, b, c), key=lambda v: (abs(a + b - c - v), (a, b, c).index(v)))


def chunk(name, body):
    return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))


def png(lines, w, h, depth, colour, filters, palette=None, back=None, lace=0):
    """A PNG file whose lines are filtered as asked for, byte by byte."""
    step, raw = len(lines[0]), b""
    for k, line in enumerate(lines):
        kind, up = filters[k % len(filters)], lines[k - 1] if k else bytes(step)
        out = bytearray()
        for i, v in enumerate(line):
            a, b, c = (line[i - back] if i >= back else 0), up[i], (up[i - back] if k and i >= back else 0)
            out.append((v - (0, a, b, (a + b) // 2, PAETH(a, b, c))[kind]) & 255)
        raw += bytes([kind]) + bytes(out)
    half = len(z := zlib.compress(raw)) // 2
    return pictures.PNG_MAGIC + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, lace)) + (chunk(b"PLTE", palette) if palette else b"") + chunk(b"tEXt", b"a\0b") + chunk(b"IDAT", z[:half]) + chunk(b"IDAT", z[half:]) + chunk(b"IEND", b"")


@pytest.mark.parametrize("filters", [[0], [1], [2], [3], [4], [4, 3, 2, 1, 0]])
@pytest.mark.parametrize(("colour", "depth"), [(0, 8), (2, 8), (4, 8), (6, 8), (2, 16), (0, 16)])
def test_filters_and_colours(colour, depth, filters):
    rng = np.random.default_rng(colour * 100 + depth)
    samples, w, h = pictures.SAMPLES[colour], 7, 6
    values = rng.integers(0, 1 << depth, (h, w, samples))
    lines = [v.astype(">u2" if depth == 16 else np.uint8).tobytes() for v in values]
    want = (values >> 8 if depth == 16 else values)[:, :, :3] if samples > 2 else (values >> 8 if depth == 16 else values)[:, :, :1].repeat(3, axis=2)
    got = pictures.png_pixels(png(lines, w, h, depth, colour, filters, back=samples * depth // 8))
    assert got == (h, w, want.astype(np.uint8).tobytes())


@pytest.mark.parametrize("depth", [1, 2, 4, 8])
def test_palette_and_small_depths(depth):
    rng = np.random.default_rng(depth)
    w, h, n = 11, 3, 1 << depth
    palette, index = rng.integers(0, 256, (n, 3), dtype=np.uint8), rng.integers(0, n, (h, w))
    packed = [np.packbits((row[:, None] >> np.arange(depth - 1, -1, -1) & 1).reshape(-1).astype(np.uint8)).tobytes() for row in index]
    assert pictures.png_pixels(png(packed, w, h, depth, 3, [0, 2, 1], palette.tobytes(), back=1)) == (h, w, palette[index].tobytes())
    if depth < 8:
        grey = (index * (255 // (n - 1))).astype(np.uint8)
        assert pictures.png_pixels(png(packed, w, h, depth, 0, [0, 4], back=1)) == (h, w, grey[:, :, None].repeat(3, axis=2).tobytes())
    with pytest.raises(ValueError, match="palette"):
        pictures.png_pixels(png([b"\xff" * len(p) for p in packed], w, h, depth, 3, [0], palette[:-1].tobytes() if depth > 1 else b"abc", back=1))


def test_broken_pictures():
    good = png([b"abc"] * 2, 3, 2, 8, 0, [0], back=1)
    for bad in (b"", good[:-3], good[:40] + b"x" + good[41:], good.replace(b"IHDR", b"IHDX"), png([b"abc"] * 2, 3, 2, 8, 0, [0], back=1, lace=1), png([b"abc"] * 2, 3, 3, 8, 0, [0], back=1), png([b"abc"] * 2, 3, 2, 8, 5, [0], back=1)):
        with pytest.raises(ValueError):
            pictures.png_pixels(bad)
    rng = random.Random(1)
    for _ in range(300):
        d = bytearray(good)
        d[rng.randrange(len(d))] = rng.randrange(256)
        try:
            pictures.png_pixels(bytes(d))
        except ValueError:
            pass


def test_folder_of_pictures(spark, tmp_path):
    images = {f"{v}/{k:03d}.png": np.random.default_rng(k).integers(0, 256, 24, dtype=np.uint8).tobytes() for v in "ab" for k in (7, 1, 30)}
    for name, rgb in images.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(video.png(rgb, 2, 4))
    got = {(r["folder"][-1], r["frame_idx"]): (r["h"], r["w"], bytes(r["rgb"])) for r in readers.picture_frames(spark, str(tmp_path)).collect()}
    assert got == {(v, i): (2, 4, images[f"{v}/{k:03d}.png"]) for v in "ab" for i, k in enumerate((1, 7, 30))}
    plan = readers.image_frames(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    (tmp_path / "a" / "x.jpg").write_bytes(b"\xff\xd8\xff")
    with pytest.raises(Exception, match="decode_picture"):
        readers.picture_frames(spark, str(tmp_path)).collect()
    hooks.register("decode_picture", lambda content: (1, 1, content))
    try:
        assert [bytes(r["rgb"]) for r in readers.picture_frames(spark, str(tmp_path)).where("h = 1").collect()] == [b"\xff\xd8\xff"]
    finally:
        hooks._registered.pop("decode_picture")


def plain_save(folder, masks, prompt="cup"):
    """As numpy alone writes it."""
    folder.mkdir(parents=True)
    objects = sorted(masks)
    if len(objects) > 1:
        np.savez_compressed(folder / "masks.npz", text_prompt=np.array(prompt), multi_object=np.array(True), **{f"masks_obj{o}": masks[o] for o in objects})
    else:
        np.savez_compressed(folder / "masks.npz", masks=masks[objects[0]], object_id=objects[0], text_prompt=prompt)
    n, h, w = masks[objects[0]].shape
    about = {"object_ids": objects, "selected_object_id": objects[0], "num_frames": n, "height": h, "width": w, "text_prompt": prompt, "mean_mask_area_frac": float(np.mean([m.mean() for m in masks.values()]))}
    (folder / "metadata.json").write_text(json.dumps(about | ({"merge_info": {"groups": {"1": [0]}}} if len(objects) > 1 else {}), indent=2))


@pytest.fixture
def archives(tmp_path):
    rng = np.random.default_rng(3)
    masks = {"one": {4: rng.random((5, 6, 9)) < 0.5}, "two": {1: rng.random((3, 4, 5)) < 0.4, 2: np.zeros((3, 4, 5), bool), 7: np.ones((3, 4, 5), bool)}}
    for v, m in masks.items():
        plain_save(tmp_path / "saved" / v, m)
    (tmp_path / "saved" / "empty").mkdir()
    return tmp_path / "saved", masks


def as_pixels(df):
    return {(r["video"], r["frame"], r["obj"], r["y"], x) for r in df.collect() for x in range(r["x0"], r["x1"])}


def test_archives_of_numpy_are_read(spark, archives):
    root, masks = archives
    want = {(v, f, o, y, x) for v, m in masks.items() for o, a in m.items() for f, y, x in np.argwhere(a).tolist()}
    df = saved.load(spark, str(root))
    assert as_pixels(df) == want and df.rdd.getNumPartitions() == 2
    some = df.where("frame < 2 AND obj IN (1, 7, 99) AND video = 'two' AND y > 0")
    assert as_pixels(some) == {p for p in want if p[1] < 2 and p[2] in (1, 7) and p[0] == "two" and p[3] > 0}
    assert as_pixels(df.where("frame >= 2")) == {p for p in want if p[1] >= 2} and as_pixels(df.where("frame = 1")) == {p for p in want if p[1] == 1}
    assert {r["video"]: (list(r["object_ids"]), r["n_frames"], r["merge_info"] is None) for r in saved.headers(spark, str(root)).collect()} == {"one": ([4], 5, True), "two": ([1, 2, 7], 3, False)}


def test_filters_are_pushed_down(spark, archives):
    """What the reader takes is not in the plan's filter any more, and only what is wanted is read."""
    root, _ = archives
    plan = saved.load(spark, str(root)).where("obj = 7 AND frame <= 1 AND y > 0")._jdf.queryExecution().executedPlan().toString()
    filtered = [line for line in plan.splitlines() if "Filter" in line]
    assert filtered and all("obj" not in line.split("Filter", 1)[1] for line in filtered) and "y" in filtered[0]
    reader = saved.MaskReader([[str(root / v), v] for v in ("one", "two")])
    left = list(reader.pushFilters([saved.EqualTo(("video",), "two"), saved.LessThan(("frame",), 2), saved.In(("obj",), (2, 7)), saved.EqualTo(("y",), 1)]))
    assert left == [saved.EqualTo(("y",), 1)] and [p.video for p in reader.partitions()] == ["two"]
    assert {r[1:3] for p in reader.partitions() for r in reader.read(p)} == {(0, 7), (1, 7)}


def test_saving_and_loading(spark, archives, tmp_path):
    root, masks = archives
    loaded, heads = saved.load(spark, str(root)), saved.headers(spark, str(root))
    for _ in range(2):  # the second time replaces what the first has written
        saved.save(loaded, heads, str(tmp_path / "again"))
    assert as_pixels(saved.load(spark, str(tmp_path / "again"))) == as_pixels(loaded)
    assert sorted(p.name for p in (tmp_path / "again").iterdir()) == ["one", "two"]
    for v, m in masks.items():
        data, old = np.load(tmp_path / "again" / v / "masks.npz"), np.load(root / v / "masks.npz")
        assert sorted(data.files) == sorted(old.files) and all(np.array_equal(data[k], old[k]) and data[k].dtype.kind == old[k].dtype.kind for k in old.files)
        assert json.loads((tmp_path / "again" / v / "metadata.json").read_text()) == json.loads((root / v / "metadata.json").read_text())
    kept = runs.areas(saved.load(spark, str(tmp_path / "again")), ("video", "obj"))
    assert {(r["video"], r["obj"]): r["area"] for r in kept.collect()} == {(v, o): int(a.sum()) for v, m in masks.items() for o, a in m.items() if a.any()}


def test_a_failed_save_leaves_nothing(spark, archives, tmp_path):
    root, _ = archives
    with pytest.raises(Exception, match="no header"):
        saved.save(saved.load(spark, str(root)), saved.headers(spark, str(root)).where("video = 'one'"), str(tmp_path / "new"))
    assert saved.load(spark, str(tmp_path / "new")).isEmpty() if files.exists(spark, str(tmp_path / "new")) else True


RECORDS = "video_id string, status string"


def test_batches_count_once(spark, tmp_path):
    root = str(tmp_path / "run")
    records = lambda *ids: spark.createDataFrame([(i, "success") for i in ids], RECORDS)
    ids = lambda: sorted((r["video_id"], r["batch"]) for r in journal.read(spark, root).collect())
    assert ids() == []
    assert journal.append(records("a", "b"), root, "b1") and not journal.append(records("a", "b", "z"), root, "b1")
    assert ids() == [("a", "b1"), ("b", "b1")]
    # A crash between writing and committing: the records are there, but don't count.
    records("lost").write.json(f"{root}/{journal.PARTS}/unfinished")
    assert ids() == [("a", "b1"), ("b", "b1")]
    # Two writers of one batch: the second to commit is dropped.
    records("c").write.json(f"{root}/{journal.PARTS}/first")
    records("c").write.json(f"{root}/{journal.PARTS}/second")
    assert journal.commit(spark, root, "b2", "first") and not journal.commit(spark, root, "b2", "second")
    assert ids() == [("a", "b1"), ("b", "b1"), ("c", "b2")] and not files.exists(spark, f"{root}/{journal.PARTS}/second")
    skipped = spark.createDataFrame([("s", "skipped")], RECORDS)
    assert journal.merge(spark, root, f"{root}/results.jsonl", skipped) == 4
    lines = [json.loads(x) for x in (tmp_path / "run" / "results.jsonl").read_text().splitlines()]
    assert sorted((x["video_id"], x["status"]) for x in lines) == [("a", "success"), ("b", "success"), ("c", "success"), ("s", "skipped")] and set(lines[0]) == {"video_id", "status"}
    assert sorted(p.name for p in (tmp_path / "run").iterdir() if not p.name.endswith(".crc")) == ["results.jsonl"]


@pytest.mark.parametrize("n", [0, 1, 500])
def test_mapping_is_one_array(spark, tmp_path, n):
    """What is written can be read by any JSON reader, and by our own."""
    path = str(tmp_path / "data.json")
    chosen = spark.range(n).select(F.concat(F.lit("v,\n"), F.col("id").cast("string")).alias("video"), F.when(F.col("id") % 3 > 0, F.concat(F.lit('a "cup" é '), F.col("id").cast("string"))).alias("prompt_word")).repartition(4)
    for _ in range(2):
        writers.write_mapping(chosen, path)
    got = json.loads((tmp_path / "data.json").read_text())
    assert sorted((r["id"], r["prompt_word"]) for r in got) == sorted((f"v,\n{k}", f'a "cup" é {k}' if k % 3 else None) for k in range(n))
    assert readers.prompt_mapping(spark, path).count() == n
