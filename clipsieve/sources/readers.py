"""Readers of the engine's inputs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clipsieve.functions.pictures import PNG_MAGIC, png_pixels
from clipsieve.functions.scalar import probed
from clipsieve.operators.jobs import STATUS
from clipsieve.plans import hooks

#: Files whose order is sent to all tasks: some 20 MB of paths.
LISTED = 100_000


def grouped_csv(spark: SparkSession, path: str) -> DataFrame:
    """Grouped questions and answers: a CSV file with header, columns in any order, quotes doubled."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df.select("video", F.coalesce("questions_and_answers", F.lit("")).alias("questions_and_answers"))


def prompt_mapping(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of objects with id and prompt_word; a number as id becomes its text."""
    return spark.read.schema("id string, prompt_word string").option("multiLine", True).json(path)


def video_paths(spark: SparkSession, root: str, suffix: str = ".mp4") -> DataFrame:
    """(path) of all files under root with the suffix; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(root)
    return files.select("path", "modificationTime", "length")


def image_frames(spark: SparkSession, folder: str) -> DataFrame:
    """(folder, frame_idx, path, content) of the png, jpg and jpeg files under a folder, each folder's in order of their names.

    The order comes from a listing without contents. Up to LISTED files it is sent to the tasks that read the contents;
    more are joined by a shuffle.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{png,jpg,jpeg}").load(folder)
    own = F.regexp_replace("path", "/[^/]*$", "")
    index = found.select("path", own.alias("folder"))  # contents are not read for the order
    index = index.withColumn("frame_idx", F.row_number().over(Window.partitionBy("folder").orderBy("path")) - 1)
    index = F.broadcast(index) if index.count() <= LISTED else index
    return found.join(index, "path").select("folder", "frame_idx", "path", "content")


def pixels_of(pictures: DataFrame, content: str = "content") -> DataFrame:
    """pictures with h, w and rgb in place of their files' bytes.

    PNG files are read here; files of other formats go to the hook decode_picture, a function from bytes to (h, w, rgb),
    and without one they raise. So does a broken file.
    """
    other = hooks.registered("decode_picture")
    kept = [c for c in pictures.columns if c != content]
    kinds = ", ".join(f"`{c}` {t}" for c, t in pictures.dtypes if c != content)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for data in rows[content]:
                if data[:8] == PNG_MAGIC:
                    out.append(png_pixels(data))
                elif other is None:
                    raise NotImplementedError("no function is registered for decode_picture, which a file other than PNG needs")
                else:
                    out.append(other(data))
            yield rows[kept].assign(h=[p[0] for p in out], w=[p[1] for p in out], rgb=[p[2] for p in out])

    return pictures.select(*kept, content).mapInPandas(each, f"{kinds}, h int, w int, rgb binary")


def picture_frames(spark: SparkSession, folder: str) -> DataFrame:
    """(folder, frame_idx, path, h, w, rgb) of the pictures under a folder."""
    return pixels_of(image_frames(spark, folder))


def probed_counts(paths: DataFrame, counts: DataFrame) -> DataFrame:
    """(path, frame_count): what the probe found for each path, 0 for a file that it could not read."""
    return paths.select("path").join(counts.select("path", F.col("frame_count").cast("long").alias("frame_count")), "path", "left").select("path", probed(F.col("frame_count")).alias("frame_count"))


def status_records(spark: SparkSession, path: str) -> DataFrame:
    """Status records of one or more JSONL files; keys that a record lacks are null."""
    return spark.read.schema(STATUS).json(path)


def masks(spark: SparkSession, path: str, video: str | None = None) -> DataFrame:
    """A saved mask table (see sources.writers.save_masks); a video prunes its partition."""
    df = spark.read.parquet(f"{path}/masks")
    return df if video is None else df.where(F.col("video") == video)


def header(spark: SparkSession, path: str) -> DataFrame:
    """The header row of each saved video."""
    return spark.read.parquet(f"{path}/header")


def load_masks(spark: SparkSession, path: str, video: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Saved masks and their headers. Of a video whose header does not say multi_object only the selected object is loaded."""
    h = header(spark, path)
    if video is not None:
        h = h.where(F.col("video") == video)
    m = masks(spark, path, video)
    kept = m.join(h.select("video", "selected", "multi_object"), "video").where(F.coalesce("multi_object", F.lit(False)) | (F.col("obj") == F.col("selected")))
    return kept.select(m.columns), h
