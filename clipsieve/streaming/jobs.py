"""Job planning and the ordered fold as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from clipsieve.operators.cluster import fold_frame
from clipsieve.operators.jobs import classify


def plan_jobs(arriving: DataFrame, index: DataFrame, done: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Classifies prompts (id, prompt_word) as they arrive and appends the records under path.

    Each batch goes to a folder of its own number, overwritten if the batch is tried again, so no record is written twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        classify(batch, index, done).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return arriving.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def follow_groups(frames: DataFrame, n_groups: int) -> DataFrame:
    """The ordered fold over a stream of frames (video, frame, dets array<array<bigint>>), state kept per video.

    Frames of a video must arrive in order, as for a live video; those of one batch are put in order. The first frame's
    detections become the groups. Emits (video, frame, det, group).
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("frame")
        groups = {i + 1: set(p) for i, p in enumerate(state.get[0])} if state.exists else {}
        out = []
        for frame, dets in zip(rows["frame"], rows["dets"], strict=True):
            dets = [set(map(int, p)) for p in dets]
            if not groups:
                groups = {i + 1: dets[i] if i < len(dets) else set() for i in range(n_groups)}
                joined = [min(i + 1, n_groups) for i in range(len(dets))]
            else:
                joined, groups = fold_frame(groups, dets, n_groups)
            out += [(key[0], int(frame), i, g) for i, g in enumerate(joined)]
        state.update(([sorted(groups[g]) for g in sorted(groups)],))
        yield pd.DataFrame(out, columns=["video", "frame", "det", "group"])

    kind = dict(frames.dtypes)["video"]
    return frames.groupBy("video").applyInPandasWithState(step, f"video {kind}, frame long, det long, group int", "groups array<array<bigint>>", "append", "NoTimeout")
