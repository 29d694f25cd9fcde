"""Places where models and codecs attach. The engine has none of its own: without a registered function each raises."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Hook names and the columns that a registered function must return.
SCHEMAS = {
    "segment": "video string, frame long, det int, score double, px long",
    "segment_box": "video string, frame long, det int, score double, px long",
    "track": "video string, direction string, pos long, px array<long>",
    "verify": "video string, frame long, px long",
    "inpaint": "video string, frame_idx long, rgb binary, method string, fallback_reason string",
    "decode": "video string, frame_idx long, h int, w int, rgb binary",
    "encode": "video string, path string, n_frames long",
    "probe": "path string, fps double, width int, height int, frame_count int",
    "decode_picture": "h int, w int, rgb binary",
}
_registered: dict[str, Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]] = {}


def register(name: str, function: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> None:
    if name not in SCHEMAS:
        raise ValueError(f"no hook named {name}")
    _registered[name] = function


def registered(name: str) -> Callable | None:
    return _registered.get(name)


def call(name: str, rows: DataFrame, per_video: bool = False) -> DataFrame:
    """Runs a registered function: over batches, so that a worker loads its model once, or over each video's rows."""
    if name not in SCHEMAS:
        raise ValueError(f"no hook named {name}")
    function = _registered.get(name)
    if function is None:
        raise NotImplementedError(f"no function is registered for {name}")
    if per_video:
        return rows.groupBy("video").applyInPandas(lambda f: pd.concat(list(function(iter([f])))), SCHEMAS[name])
    return rows.mapInPandas(function, SCHEMAS[name])


def caller(name: str, per_video: bool = False) -> Callable[[DataFrame], DataFrame]:
    """The hook as a function of a table, as operators.segment takes models."""
    return lambda rows: call(name, rows, per_video)


_loaded: dict[str, Callable] = {}


class Warm:
    """A model that each Python worker loads once, by its name, and keeps for all later tasks; release() lets it go."""

    def __init__(self, name: str, load: Callable[[], Callable]) -> None:
        self.name, self.load = name, load

    def __call__(self, *args):
        if self.name not in _loaded:
            _loaded[self.name] = self.load()
        return _loaded[self.name](*args)

    def release(self) -> None:
        """In the process that calls it."""
        _loaded.pop(self.name, None)
