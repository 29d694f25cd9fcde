"""Writers of the engine's outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipsieve.functions.scalar import mask_name, now_iso
from clipsieve.sources.files import one_file


def status_json(records: DataFrame) -> DataFrame:
    """(json): a line per record without the keys that are null."""
    return records.select(F.to_json(F.struct("*"), {"ignoreNullFields": "true"}).alias("json"))


def append_status(records: DataFrame, path: str) -> None:
    """Adds records to a folder as they are; a batch that may be written twice goes through sources.journal."""
    records.write.mode("append").option("ignoreNullFields", True).json(path)


def write_log(records: DataFrame, path: str, record_type: str = "clip") -> None:
    """A log that starts anew each time."""
    records.withColumn("record_type", F.lit(record_type)).write.mode("overwrite").json(path)


def write_mapping(selected: DataFrame, path: str) -> None:
    """(id, prompt_word) as one JSON array of objects; a null prompt stays as null. A file there before is replaced."""
    entry = F.struct(F.col("video").cast("string").alias("id"), "prompt_word")
    lines = selected.select(F.concat(F.lit("  "), F.to_json(entry, {"ignoreNullFields": "false"})).alias("value"))
    one_file(lines, path, "[\n", ",\n", "\n]\n")


def merge_status(parts: list[DataFrame], path: str) -> None:
    """All parts in one file of JSON lines; sources.journal does the same for a run's batches, and removes them."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    one_file(status_json(out).withColumnRenamed("json", "value"), path)


def write_info(info: DataFrame, path: str) -> None:
    """Information on each video's edit, a JSON record with the time of writing."""
    info.withColumn("timestamp", now_iso()).write.mode("overwrite").option("ignoreNullFields", True).json(path)


def mask_files(mask_table: DataFrame) -> DataFrame:
    """(video, frame, obj, name): the picture file that each mask would have."""
    return mask_table.select("video", "frame", "obj").distinct().withColumn("name", mask_name(F.col("frame"), F.col("obj")))


def save_masks(mask_table: DataFrame, header: DataFrame, path: str) -> None:
    """Masks (video, frame, obj, px) in a folder per video, and a header row per video, marked if it has several objects."""
    header = header.withColumn("multi_object", F.size("object_ids") > 1) if "object_ids" in header.columns else header
    mask_table.write.mode("overwrite").partitionBy("video").parquet(f"{path}/masks")
    header.write.mode("overwrite").parquet(f"{path}/header")
