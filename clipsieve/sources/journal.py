"""Status records of a run, batch by batch, each of which counts once or not at all.

A batch is written into a folder of its own, which no reader looks at. It counts from the moment that a small file with
the folder's name stands under the batch's name, and a rename puts it there. A batch that is written again finds the name
taken and its folder is dropped; one whose writer dies before the rename was never there.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipsieve.operators.jobs import STATUS
from clipsieve.sources import files

COMMITS, PARTS = "_commits", "_parts"


def append(records: DataFrame, root: str, batch: str) -> bool:
    """Adds a batch's records; False if the batch was there already, whose records then stay as they are."""
    spark = records.sparkSession
    if files.exists(spark, f"{root}/{COMMITS}/{batch}"):
        return False
    folder = uuid.uuid4().hex
    records.write.option("ignoreNullFields", True).json(f"{root}/{PARTS}/{folder}")
    return commit(spark, root, batch, folder)


def commit(spark: SparkSession, root: str, batch: str, folder: str) -> bool:
    """Makes a written folder count as a batch."""
    files.make_folder(spark, f"{root}/{COMMITS}")
    files.put_text(spark, f"{root}/{PARTS}/{folder}.commit", folder)
    if files.move(spark, f"{root}/{PARTS}/{folder}.commit", f"{root}/{COMMITS}/{batch}"):
        return True
    files.remove(spark, f"{root}/{PARTS}/{folder}.commit")
    files.remove(spark, f"{root}/{PARTS}/{folder}")
    return False


def batches(spark: SparkSession, root: str) -> list[str]:
    """The names of the batches that count."""
    return files.names(spark, f"{root}/{COMMITS}")


def read(spark: SparkSession, root: str, schema: str = STATUS) -> DataFrame:
    """The records of all batches that count, with their batch; none without any."""
    kept = [(b, files.get_text(spark, f"{root}/{COMMITS}/{b}")) for b in batches(spark, root)]
    if not kept:
        return spark.createDataFrame([], f"{schema}, batch string")
    # Folders with an underscore are hidden from a listing, but not if they are named.
    got = spark.read.schema(schema).json([f"{root}/{PARTS}/{folder}" for _, folder in kept])
    name = F.create_map(*(x for b, folder in kept for x in (F.lit(folder), F.lit(b))))
    return got.withColumn("batch", name[F.regexp_extract(F.col("_metadata.file_path"), f"/{PARTS}/([^/]+)/", 1)])


def merge(spark: SparkSession, root: str, path: str, first: DataFrame | None = None, schema: str = STATUS) -> int:
    """All records as one file of JSON lines, those of first (such as skipped jobs) among them; then the batches go.

    The file is in place before the first batch goes: a merge that dies leaves either the batches or file and batches,
    and can be run again. The number of lines is returned.
    """
    done = read(spark, root, schema).drop("batch")
    everything = done if first is None else first.unionByName(done, allowMissingColumns=True)
    files.one_file(everything.select(F.to_json(F.struct("*"), {"ignoreNullFields": "true"}).alias("value")), path)
    n = spark.read.text(path).count()
    for part in (COMMITS, PARTS):
        files.remove(spark, f"{root}/{part}")
    return n
