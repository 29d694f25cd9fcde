"""A tracker's pass over a video as ordered keyed state: each frame is tracked with what the tracker remembers of those before.

Frames may come in any order and in any number of batches. State is kept per video and direction: the number of the next
frame, the tracker's memory as bytes, and frames that came before their turn. It lives in the state store, so that a pass
is neither held in a task's memory nor bound to one batch; the anchor's mask comes once, with the first frame.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Gets the memory (null at first), the frame's number and the anchor's pixels (null but for the first frame), and returns
#: the mask's pixels, null if the frame can't be tracked, and the memory for the next frame.
Step = Callable[[bytes | None, int, list[int] | None], tuple[list[int] | None, bytes | None]]

#: State of several columns needs this store.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class OrderedPass(StatefulProcessor):
    def __init__(self, step: Step) -> None:
        self.step = step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.memory = handle.getValueState("memory", "next long, memory binary")
        self.early = handle.getMapState("early", "seq long", "pos long, frame long, anchor array<bigint>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at, memory = self.memory.get() if self.memory.exists() else (0, None)
        for batch in rows:
            for seq, pos, frame, anchor in zip(*(batch[c] for c in ("seq", "pos", "frame", "anchor")), strict=True):
                if seq >= at:  # a frame that comes again after its turn is done already
                    self.early.updateValue((int(seq),), (int(pos), int(frame), None if anchor is None else [int(p) for p in anchor]))
        out = []
        while self.early.containsKey((at,)):
            pos, frame, anchor = self.early.getValue((at,))
            self.early.removeKey((at,))
            pixels, memory = self.step(memory, frame, anchor)
            if pixels is not None:
                out.append((*key, pos, pixels))
            at += 1
        self.memory.update((at, memory))
        if out:
            yield pd.DataFrame(out, columns=["video", "direction", "pos", "px"])

    def close(self) -> None:
        pass


def track_in_order(step: Step) -> Callable[[DataFrame], DataFrame]:
    """A tracker for segment.segment_tracked, or for a stream, out of what it does with a frame.

    The table has (video, direction, seq, pos, frame, anchor), seq counting a pass's frames from 0; the result (video,
    direction, pos, px) has the frames up to the first that is missing.
    """

    def track(rows: DataFrame) -> DataFrame:
        spark = rows.sparkSession
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
        _ = spark.streams.active  # the stores' coordinator begins with the session's streams; a table needs it, too
        kind = dict(rows.dtypes)["video"]
        passes = rows.select("video", "direction", "seq", "pos", "frame", "anchor").groupBy("video", "direction")
        return passes.transformWithStateInPandas(OrderedPass(step), f"video {kind}, direction string, pos long, px array<long>", "append", "none")

    return track
