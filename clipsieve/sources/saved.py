"""Saved masks, a folder per video with metadata.json and masks.npz, as a Spark data source of runs.

Reading makes a partition per video. Of an archive only the arrays of wanted objects are opened, and each is read frame
by frame up to the last wanted one, so that a task never holds more than a frame; filters on video, frame and obj are
pushed down. Writing streams a frame at a time into archives of a temporary folder, and the commit puts each video's
folder in place by a rename.
"""

from __future__ import annotations

import json
import math
import uuid
import zipfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import groupby

import numpy as np
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from clipsieve.sources import files

#: The names of a video's files and of the arrays in its archive.
METADATA, ARCHIVE = "metadata.json", "masks.npz"
ONE, EACH = "masks", "masks_obj{}"

SCHEMA = "video string, frame long, obj long, y long, x0 long, x1 long"
WRITE_SCHEMA = "video string, obj long, frame long, metadata string, runs array<struct<y: long, x0: long, x1: long>>"


def _open(path: str):
    system, at = arrow_fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (arrow_fs.LocalFileSystem(), path)
    return system, at


def runs_of(mask: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(y, x0, x1) of a mask's lines."""
    wide = np.zeros((mask.shape[0], mask.shape[1] + 2), np.int8)
    wide[:, 1:-1] = mask
    step = np.diff(wide, axis=1)
    (y, x0), (_, x1) = np.nonzero(step == 1), np.nonzero(step == -1)
    yield from zip(y.tolist(), x0.tolist(), x1.tolist(), strict=True)


def frames_of(archive: zipfile.ZipFile, name: str, last: float) -> Iterator[tuple[int, np.ndarray]]:
    """(frame, mask) of an array (frames, height, width) of an archive, up to a frame."""
    with archive.open(f"{name}.npy") as f:
        version = np.lib.format.read_magic(f)
        shape, fortran, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
        if fortran or len(shape) != 3 or kind.hasobject:
            raise ValueError("masks must be an array of frames, lines and pixels")
        size = shape[1] * shape[2] * kind.itemsize
        for k in range(shape[0]):
            if k > last:
                return
            data = f.read(size)
            if len(data) < size:
                raise ValueError("the archive ends within a frame")
            yield k, np.frombuffer(data, kind).reshape(shape[1:]) != 0


@dataclass
class Folder(InputPartition):
    path: str
    video: str


class MaskReader(DataSourceReader):
    """Filters that it takes hold for all rows it gives."""

    def __init__(self, folders: list[list[str]]) -> None:
        self.folders = folders
        self.taken: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, IsNotNull):
                continue  # no column is ever null
            if isinstance(f, (EqualTo, In, LessThan, LessThanOrEqual, GreaterThan, GreaterThanOrEqual)) and f.attribute in (("video",), ("frame",), ("obj",)):
                self.taken.append(f)
            else:
                yield f

    def wanted(self, column: str, value) -> bool:
        tests = {EqualTo: lambda v: value == v, LessThan: lambda v: value < v, LessThanOrEqual: lambda v: value <= v, GreaterThan: lambda v: value > v, GreaterThanOrEqual: lambda v: value >= v, In: lambda v: value in v}
        return all(tests[type(f)](f.value) for f in self.taken if f.attribute == (column,))

    def last_frame(self) -> float:
        of = [f for f in self.taken if f.attribute == ("frame",)]
        return min([math.inf, *(max(f.value, default=-1) if isinstance(f, In) else f.value for f in of if isinstance(f, (EqualTo, In, LessThan, LessThanOrEqual)))])

    def partitions(self) -> Sequence[InputPartition]:
        return [Folder(path, video) for path, video in self.folders if self.wanted("video", video)]

    def read(self, partition: Folder | None) -> Iterator[tuple]:
        if partition is None:  # so Spark asks where there are no partitions
            return
        system, at = _open(partition.path)
        with system.open_input_stream(f"{at}/{METADATA}") as f:
            about = json.loads(f.read())
        with system.open_input_file(f"{at}/{ARCHIVE}") as f, zipfile.ZipFile(f) as archive:
            several = f"{ONE}.npy" not in archive.namelist()
            for obj in about["object_ids"] if several else [about["selected_object_id"]]:
                if self.wanted("obj", obj):
                    for frame, mask in frames_of(archive, EACH.format(obj) if several else ONE, min(self.last_frame(), about["num_frames"] - 1)):
                        if self.wanted("frame", frame):
                            for y, x0, x1 in runs_of(mask):
                                yield partition.video, frame, obj, y, x0, x1


@dataclass
class Written(WriterCommitMessage):
    videos: list[str]


class MaskWriter(DataSourceWriter):
    """Gets each video's rows one after the other: its metadata, then the masks of each object, frame by frame."""

    def __init__(self, path: str, token: str) -> None:
        self.path, self.staged = path, f"{path}/_new-{token}"

    def write(self, rows: Iterator[Row]) -> Written:
        system, at = _open(self.staged)
        done = []
        for video, own in groupby(rows, key=lambda r: r["video"]):
            head = next(own)
            if head["metadata"] is None:
                raise ValueError(f"masks of video {video!r} have no header")
            about = json.loads(head["metadata"])
            # A folder of this attempt alone: another attempt at the same task leaves another one.
            folder = f"{at}/{uuid.uuid4().hex}"
            system.create_dir(folder, recursive=True)
            with system.open_output_stream(f"{folder}/{ARCHIVE}") as f, zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as archive:
                _archive(archive, about, own)
            with system.open_output_stream(f"{folder}/{METADATA}") as f:
                f.write(json.dumps(about, indent=2).encode())
            done.append(f"{folder}\t{video}")
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        system, at = _open(self.path)
        for line in (v for m in messages if m for v in m.videos):
            folder, _, video = line.partition("\t")
            if system.get_file_info(f"{at}/{video}").type != arrow_fs.FileType.NotFound:
                system.delete_dir(f"{at}/{video}")
            system.move(folder, f"{at}/{video}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        system, at = _open(self.staged)
        if system.get_file_info(at).type != arrow_fs.FileType.NotFound:
            system.delete_dir(at)


def _array(archive: zipfile.ZipFile, name: str, value) -> None:
    with archive.open(f"{name}.npy", "w") as f:
        np.lib.format.write_array(f, np.asarray(value), allow_pickle=False)


def _archive(archive: zipfile.ZipFile, about: dict, rows: Iterator[Row]) -> None:
    """The arrays of a video: one per object if it has several, each frame written as it comes, empty ones between."""
    h, w, n = about["height"], about["width"], about["num_frames"]
    several = len(about["object_ids"]) > 1
    _array(archive, "text_prompt", about["text_prompt"])
    if several:
        _array(archive, "multi_object", True)
    else:
        _array(archive, "object_id", about["selected_object_id"])
    by_object = groupby(rows, key=lambda r: r["obj"])
    pending = next(by_object, None)
    for obj in sorted(about["object_ids"]) if several else [about["selected_object_id"]]:
        while pending is not None and pending[0] < obj:
            pending = next(by_object, None)  # masks of an object that the header doesn't name
        own = iter(pending[1]) if pending is not None and pending[0] == obj else iter(())
        row = next(own, None)
        with archive.open(f"{EACH.format(obj) if several else ONE}.npy", "w", force_zip64=True) as f:
            np.lib.format.write_array_header_1_0(f, {"descr": "|b1", "fortran_order": False, "shape": (n, h, w)})
            for frame in range(n):
                mask = np.zeros((h, w), bool)
                while row is not None and row["frame"] <= frame:
                    for r in row["runs"] if row["frame"] == frame else ():
                        mask[r["y"], r["x0"] : r["x1"]] = True
                    row = next(own, None)
                f.write(mask.tobytes())


class SavedMasks(DataSource):
    @classmethod
    def name(cls) -> str:
        return "saved_masks"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> MaskReader:
        return MaskReader(json.loads(self.options["folders"]))

    def writer(self, schema: StructType, overwrite: bool) -> MaskWriter:
        return MaskWriter(self.options["path"], self.options["token"])


def load(spark: SparkSession, root: str) -> DataFrame:
    """Runs (video, frame, obj, y, x0, x1) of the masks saved under root; a folder without both files is left out.

    Of a video with a single array only the selected object is there. Folders are listed by the driver, a name per video.
    """
    spark.dataSource.register(SavedMasks)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    have = [v for v in files.names(spark, root) if not v.startswith(("_", ".")) and {METADATA, ARCHIVE} <= set(files.names(spark, f"{root}/{v}"))]
    return spark.read.format("saved_masks").option("folders", json.dumps([[f"{root}/{v}", v] for v in have])).load()


def headers(spark: SparkSession, root: str) -> DataFrame:
    """(video, object_ids, selected, n_frames, height, width, text_prompt, mean_mask_area_frac, merge_info) of saved videos."""
    schema = "object_ids array<long>, selected_object_id long, num_frames long, height long, width long, text_prompt string, mean_mask_area_frac double, merge_info string"
    text = spark.read.text(f"{root}/*/{METADATA}", wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), f"([^/]+)/{METADATA}$", 1).alias("video"), F.from_json("value", schema).alias("m"))
    return text.select("video", "m.object_ids", F.col("m.selected_object_id").alias("selected"), F.col("m.num_frames").alias("n_frames"), "m.height", "m.width", "m.text_prompt", "m.mean_mask_area_frac", "m.merge_info")


def save(runs: DataFrame, header: DataFrame, root: str) -> None:
    """Merged runs (video, frame, obj, y, x0, x1) and a header row per video, as above, as folders under root.

    A video's frames pass through one task, a frame at a time; videos side by side. A video saved before is replaced when
    all are written. merge_info is JSON text or null.
    """
    spark = header.sparkSession
    spark.dataSource.register(SavedMasks)
    info = F.when(F.col("merge_info").isNotNull(), F.concat(F.lit(', "merge_info": '), "merge_info")).otherwise(F.lit(""))
    named = F.struct("object_ids", F.col("selected").alias("selected_object_id"), F.col("n_frames").alias("num_frames"), "height", "width", "text_prompt", "mean_mask_area_frac")
    # A null text stays a key; merge_info goes in as what it is, not as quoted text.
    about = F.concat(F.regexp_replace(F.to_json(named, {"ignoreNullFields": "false"}), "[}]$", ""), info, F.lit("}"))
    long = lambda v: F.lit(v).cast("long")
    no_runs = F.lit(None).cast("array<struct<y: bigint, x0: bigint, x1: bigint>>")
    heads = header.select(F.col("video").cast("string").alias("video"), long(None).alias("obj"), long(None).alias("frame"), about.alias("metadata"), no_runs.alias("runs"))
    packed = runs.select(F.col("video").cast("string").alias("video"), F.col("obj").cast("long").alias("obj"), F.col("frame").cast("long").alias("frame"), F.struct(*(F.col(c).cast("long").alias(c) for c in ("y", "x0", "x1"))).alias("r"))
    packed = packed.groupBy("video", "obj", "frame").agg(F.collect_list("r").alias("runs")).select("video", "obj", "frame", F.lit(None).cast("string").alias("metadata"), "runs")
    rows = heads.unionByName(packed).repartition("video").sortWithinPartitions("video", F.asc_nulls_first("obj"), "frame")
    rows.write.format("saved_masks").mode("append").option("path", root).option("token", uuid.uuid4().hex).save()
