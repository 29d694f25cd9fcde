"""What the corpus operators share: reading, the shared folder, word hashing and Arrow batches."""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: The white space that separates words; the same class as bytes.split() uses.
SPACE = " \t\n\x0b\x0c\r"
SPACE_RE = "[\\x20\\x09-\\x0D]+"
#: Rows of one Arrow batch handed to Python. Texts reach 100 KB and more, so batches stay small.
BATCH_ROWS = 500
#: Bytes of rows, by their widths, of a table that may be sent to every executor; in memory they take a few times that.
BROADCAST_BYTES = 16_000_000
#: Distinct words that a worker remembers the hash of before it starts again; more are no faster, as most are rare.
HASH_CACHE = 60_000

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
SECOND_MULTIPLIER = np.uint64(0xC2B2AE3D27D4EB4F)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bounds the Arrow batches of the plans made from now on in this session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share. One is made up only on a single machine and if none is set."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not base:
        base = sc._jsc.sc().getCheckpointDir()
        base = base.get() if base.isDefined() else None
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='clipsieve-')}"
        sc.setCheckpointDir(base)
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/clipsieve/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it again: the lineage is cut, executors may be lost."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes what stored() has written, once nothing that is still to be computed reads it."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t._stored_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def broadcast_if_small(table: DataFrame, row_bytes: int, of: Column | None = None) -> DataFrame:
    """A stored table marked for broadcast if its rows (or the sum of a column, such as the sizes of arrays) times
    row_bytes stay within BROADCAST_BYTES; else as it is, and Spark joins it by a shuffle."""
    n = table.select(F.count("*") if of is None else F.sum(of)).first()[0] or 0
    return F.broadcast(table) if n * row_bytes <= BROADCAST_BYTES else table


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing refers to any more.

    References go step by step: from Python, then in the JVM, then Spark's cleaner, which runs beside.
    """
    for _ in range(3):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.6)


def free_name(df: DataFrame) -> str:
    """The beginning of names that no column of df has."""
    return f"_{max(df.columns, key=len)}"


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys into as many partitions as shuffles have in this session."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def trimmed(text: str | Column = "text") -> Column:
    return F.btrim(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), F.lit(SPACE))


def word_array(text: str | Column = "text") -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text as an array; none for null or white space only."""
    t = trimmed(text)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACE_RE))


def word_count(text: str | Column = "text") -> Column:
    t = trimmed(text)
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, SPACE_RE))).cast("long")


def bytes_column(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit("")).cast("binary").alias(name)


def map_arrow(df: DataFrame, each: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | StructType) -> DataFrame:
    """mapInArrow with a function of one batch; small batches are set for the plan."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := each(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


class WordHasher(dict):
    """Word to 64-bit hash, the same in every process. Forgets all words now and then to bound memory."""

    def __missing__(self, word: bytes | str) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def array(self, words: Sequence[bytes]) -> np.ndarray:
        if len(self) > HASH_CACHE:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


#: One for all operators, as a worker serves one after the other.
HASHER = WordHasher()


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values one to one."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def grams(h: np.ndarray, n: int, multiplier: np.uint64 = MULTIPLIER) -> np.ndarray:
    """Hashes of all runs of n consecutive values, by doubling: log2(n) vector steps."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out, done, power, width, scale = None, 0, h, 1, multiplier
    while True:
        if n & width:
            if out is None:
                out = power
            else:
                size = len(h) - (done + width) + 1
                out = out[:size] * scale_of(multiplier, width) + power[done : done + size]
            done += width
        if done == n:
            return mix(out[: len(h) - n + 1])
        power = power[:-width] * scale + power[width:] if len(power) > width else power[:0]
        width *= 2
        scale = scale_of(multiplier, width)


def scale_of(multiplier: np.uint64, width: int) -> np.uint64:
    return np.uint64(pow(int(multiplier), width, 1 << 64))


def long_array(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def list_column(flat: np.ndarray, lengths: Sequence[int], kind: pa.DataType) -> pa.ListArray:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


def remainder(id_col: str, mod: int) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(mod))


def fit_rows(docs: DataFrame, labels: DataFrame, label: str, train: Column, bound: int, id_col: str = "doc_id") -> DataFrame:
    """About bound labelled training rows (text, label), the same on each run: those with the smallest id hashes.

    Their ids and labels, a table of that bound, are sent to where the texts are.
    """
    known = labels.select(id_col, F.col(label).alias("label")).where(F.col(label).isin(0, 1) & train).groupBy(id_col).agg(F.max("label").alias("label"))
    n = known.count()
    if n > bound:
        limit = int(bound / n * (1 << 31))
        known = known.where(F.pmod(F.xxhash64(F.col(id_col), F.lit("fit")), F.lit(1 << 31)) < limit)
    return docs.select(id_col, "text").join(F.broadcast(stored(known, "fit-ids")), id_col).select("text", "label")
