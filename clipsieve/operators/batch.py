"""The batch driver: a table of jobs in, a table of status records out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipsieve.functions.scalar import python_round2
from clipsieve.operators.jobs import STATUS, dealt_to, frame_reduction, ordinal

#: Gets a job's row as a dict and returns the path of the edited video; raises if the job fails.
Process = Callable[[dict], str]


def run_batch(jobs: DataFrame, done: DataFrame, probe: DataFrame, process: Process, out_root: str, max_duration: float = 60.0, dry_run: bool = False, tasks: int | None = None) -> DataFrame:
    """Status records of jobs (video_id, prompt_word, path).

    done (video_id) is looked up again here: what appeared since planning is skipped. probe (path, frame_count, fps)
    has what is known of the files; a job whose file is not in it fails. Long videos are marked for sub-sampling. A
    job that raises becomes a failed record and stops no other; a dry run processes nothing. A repeated job runs twice.

    With a number of tasks, each is a worker that gets jobs from the longest to the shortest (jobs of unknown length
    last, equal ones by video_id), dealt to and fro, and works on them in this order; records then also have the worker
    and the job's ordinal there, from 1. More tasks than run at a time let a worker that is done take the next task.
    """
    target = F.concat(F.lit(out_root.rstrip("/") + "/"), F.col("video_id"), F.lit(".mp4"))
    j = jobs.select("video_id", "prompt_word", F.col("path").alias("input_video_path")).withColumn("output_video_path", target)
    j = j.join(done.select("video_id", F.lit(True).alias("is_done")).distinct(), "video_id", "left")
    info = frame_reduction(probe.select(F.col("path").alias("video_id"), "frame_count", "fps"), max_duration)
    j = j.join(info.withColumnRenamed("video_id", "input_video_path").withColumn("is_known", F.lit(True)), "input_video_path", "left")
    j = j.select(*("video_id", "prompt_word", "input_video_path", "output_video_path"), "frame_count", python_round2(F.col("duration_sec")).alias("duration_seconds"), F.col("frame_reduction").alias("frame_reduction_applied"), "max_frames", "is_done", "is_known")
    schema = STATUS
    if tasks:
        schema += ", worker int, ordinal int"
        j = ordinal(j, "place", "frame_count", "video_id", descending=True).withColumn("worker", dealt_to(F.col("place"), tasks))
        j = j.repartitionById(tasks, "worker").sortWithinPartitions("place")

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = 0
        for rows in batches:
            out = []
            for job in rows.astype(object).where(rows.notna(), None).to_dict("records"):
                status = {k: job[k] for k in ("video_id", "prompt_word", "input_video_path", "output_video_path", "duration_seconds", "frame_reduction_applied")} | {"error_message": None}
                if job["is_done"]:
                    status |= {"duration_seconds": None, "frame_reduction_applied": None, "status": "skipped", "error_message": "output already exists"}
                elif not job["is_known"]:
                    status |= {"output_video_path": None, "status": "failed", "error_message": "no information on the video file"}
                elif dry_run:
                    status["status"] = "dry_run"
                else:
                    try:
                        if not process(job):
                            raise RuntimeError("no edited video came out")
                        status["status"] = "success"
                    except Exception as e:  # whatever a job raises is its own record
                        status |= {"status": "failed", "error_message": str(e)}
                at += 1
                out.append(status | {"worker": job.get("worker"), "ordinal": at})
            yield pd.DataFrame(out, columns=[f.split()[0] for f in schema.split(", ")])

    return j.mapInPandas(each, schema)
