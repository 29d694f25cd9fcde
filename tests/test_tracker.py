"""Passes of a tracker that needs its predecessor's mask, in batch and as a stream."""

import json
import random

import pytest
from pyspark.sql import functions as F

from clipsieve.streaming.tracker import track_in_order

SCHEMA = "video string, direction string, seq long, pos long, frame long, anchor array<bigint>"


def step(memory, frame, anchor):
    """The object moves by the frame's number; every fifth frame can't be tracked, but is remembered."""
    seen = [*json.loads(memory)["seen"], frame] if memory else [frame]
    px = anchor if anchor is not None else [p + frame for p in json.loads(memory)["px"]]
    return (None if frame % 5 == 4 else px), json.dumps({"px": px, "seen": seen}).encode()


def passes(n):
    return [(v, d, k, 2 * k, k if d == "forward" else n - k, [100, 200] if k == 0 else None) for v in ("a", "b") for d in ("forward", "backward") for k in range(n)]


def want(rows):
    out, memory = set(), {}
    for v, d, _, pos, frame, anchor in sorted(rows):
        px, memory[v, d] = step(memory.get((v, d)), frame, anchor)
        if px is not None:
            out.add((v, d, pos, tuple(px)))
    return out


def got(rows):
    return {(r["video"], r["direction"], r["pos"], tuple(r["px"])) for r in rows}


def test_batch_in_any_order(spark):
    rows = passes(30)
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    out = track_in_order(step)(df).collect()
    assert got(out) == want(rows) and len(out) == len(got(out))


def test_a_missing_frame_stops_its_pass(spark):
    rows = [r for r in passes(10) if not (r[0] == "a" and r[2] == 6)]
    assert got(track_in_order(step)(spark.createDataFrame(rows, SCHEMA)).collect()) == want([r for r in rows if r[0] == "b" or r[2] < 6])


def test_stream_with_early_and_repeated_frames(spark, tmp_path):
    """Frames come over four batches, each later one partly before its turn, some twice: the same masks, each once."""
    rows = passes(24)
    order = random.Random(3).sample(rows, len(rows))
    for k in range(4):
        part = order[k::4] + (order[:3] if k else [])
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = track_in_order(step)(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start(str(tmp_path / "out"))
    query.awaitTermination(180)
    assert query.exception() is None and len(query.recentProgress) >= 4
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    assert got(out) == want(rows) and len(out) == len(got(out))


@pytest.mark.parametrize("rows", [[], [("a", "forward", 0, 0, 7, [1])]])
def test_small_tables(spark, rows):
    assert track_in_order(step)(spark.createDataFrame(rows, SCHEMA).withColumn("other", F.lit(1))).count() == len(rows)
