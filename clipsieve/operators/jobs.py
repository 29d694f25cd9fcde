"""Planning batch jobs and adding up their results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipsieve.functions.scalar import stem
from clipsieve.functions.text import is_blank
from clipsieve.sources.shared import stored

STATUS = "video_id string, prompt_word string, input_video_path string, output_video_path string, duration_seconds double, frame_reduction_applied boolean, status string, error_message string"


def index_last_wins(paths: DataFrame, suffix: str = ".mp4") -> DataFrame:
    """(path) to (video_id, path): stems of files with the suffix; of equal stems the greatest path wins."""
    return paths.where(F.col("path").endswith(suffix)).select(stem(F.col("path")).alias("video_id"), "path").groupBy("video_id").agg(F.max("path").alias("path"))


def classify(data: DataFrame, index: DataFrame, done: DataFrame) -> DataFrame:
    """Each (id, prompt_word) with status and error_message; status null marks a job to run. The order of tests is part of the result."""
    d = data.withColumn("video_id", F.col("id").cast("string"))
    joined = d.join(index, "video_id", "left").join(done.select("video_id", F.lit(True).alias("is_done")).distinct(), "video_id", "left")
    empty = F.col("prompt_word").isNull() | is_blank(F.col("prompt_word"))
    as_state = lambda status, message: F.struct(F.lit(status).alias("status"), F.lit(message).alias("error_message"))
    state = F.when(empty, as_state("skipped", "null or empty prompt"))
    state = state.when(F.col("path").isNull(), as_state("failed", "video file not found"))
    state = state.when(F.col("is_done"), as_state("skipped", "output already exists"))
    return joined.withColumn("state", state).select("video_id", "prompt_word", "path", "state.status", "state.error_message")


def longest_first(jobs: DataFrame) -> DataFrame:
    """Jobs (video_id, frame_count, input_pos) with their place in the queue."""
    return ordinal(jobs, "queue_pos", "frame_count", "input_pos", descending=True)


def ordinal(df: DataFrame, name: str, lead: str, *rest: str, descending: bool = False) -> DataFrame:
    """df with each row's place from 0 in an order by a column (null last) and then others, which no single task sees.

    Rows are dealt into ranges of the whole order, so that equal values of the first column are spread by the others, and
    stored, as they are read twice: once for the ranges' sizes, a row each, and once to be numbered within their range.
    Only rows that are alike in all these columns stay together; their places among themselves are any.
    """
    spark = df.sparkSession
    order = [F.desc_nulls_last(lead) if descending else F.asc_nulls_last(lead), *(F.asc_nulls_last(c) for c in rest)]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), "ordinal")
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_size"))
    before = sizes.select("_range", F.coalesce(F.sum("_size").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row per range
    placed = dealt.withColumn("_own", F.row_number().over(Window.partitionBy("_range").orderBy(*order))).join(F.broadcast(before), "_range")
    return placed.select(*df.columns, (F.col("_own") - 1 + F.col("_before")).cast("long").alias(name))


def dealt_to(place: Column, workers: int) -> Column:
    """The worker of a job by its place in the queue: to and fro, so that each gets long and short jobs alike."""
    lap, seat = F.floor(place / workers), F.pmod(place, F.lit(workers))
    return F.when(lap % 2 == 0, seat).otherwise(workers - 1 - seat).cast("int")


def first_rows(df: DataFrame, n: int, position: str = "input_pos") -> DataFrame:
    """The first n rows by a column that counts them from 0; all for n <= 0."""
    return df.where(F.col(position) < n) if n > 0 else df


def examples(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows in an order: a report, for which Spark keeps n rows per task."""
    return df.orderBy(*order).limit(n)


def frame_reduction(videos: DataFrame, max_duration: float = 60.0) -> DataFrame:
    """(video_id, frame_count, fps) to duration, frame_reduction and max_frames (null without reduction)."""
    duration = F.when(F.col("fps") > 0, F.col("frame_count") / F.col("fps")).otherwise(F.lit(0.0))
    v = videos.withColumn("duration_sec", duration)
    return v.withColumn("frame_reduction", F.col("duration_sec") > max_duration).withColumn("max_frames", F.when(F.col("frame_reduction"), (F.lit(max_duration) * F.col("fps")).cast("int")))


def merge_results(skipped: DataFrame, results: DataFrame) -> DataFrame:
    """One table of status records; origin tells the records of planning from those of the run."""
    return skipped.withColumn("origin", F.lit("plan")).unionByName(results.withColumn("origin", F.lit("run")), allowMissingColumns=True)


def summary(records: DataFrame) -> DataFrame:
    """total, success, skipped, failed. Records of planning count as skipped whatever they say, and so does a dry run."""
    skipped = (F.col("origin") == "plan") | F.col("status").isin("skipped", "dry_run")
    return records.agg(
        F.count("*").alias("total"), F.count_if(~skipped & (F.col("status") == "success")).alias("success"),
        F.count_if(skipped).alias("skipped"), F.count_if(~skipped & (F.col("status") != "success")).alias("failed"),
    )


def unprocessed(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """Jobs without a record: what a stopped run has left."""
    return jobs.join(results.select("video_id"), "video_id", "left_anti")


def required_missing(required: DataFrame, present: DataFrame) -> DataFrame:
    """Names (name) that are required but not present."""
    return required.join(present, "name", "left_anti")


def availability(required: DataFrame, present: DataFrame) -> DataFrame:
    """(available, message): whether all required names are present, and which are not, in order of their names."""
    missing = required_missing(required, present).agg(F.sort_array(F.collect_list("name")).alias("missing"))
    message = F.when(F.size("missing") == 0, "available").otherwise(F.concat(F.lit("missing: "), F.array_join("missing", ", ")))
    return missing.select((F.size("missing") == 0).alias("available"), message.alias("message"))


def passed(results: DataFrame) -> DataFrame:
    """(total, passed) of rows with an error column, null for those that went well."""
    return results.agg(F.count("*").alias("total"), F.count_if(F.col("error").isNull()).alias("passed"))


def preferred_file(files: DataFrame, keys: tuple[str, ...], name: str = "edited.mp4") -> DataFrame:
    """(keys, path): of a key's files (path, modificationTime) that of the name, else the latest, the greatest of equal ones."""
    own = F.col("path").endswith(f"/{name}")
    return files.groupBy(*keys).agg(F.max_by("path", F.struct(own, "modificationTime", "path")).alias("path"))
