"""What Spark's own writers don't do with files: existence, renaming as a commit, and several files as one.

All goes through Hadoop's file systems, so that it works wherever Spark reads and writes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, in order; none if it isn't there."""
    fs, p = _at(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)


def make_folder(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.mkdirs(p)


def move(spark: SparkSession, source: str, target: str) -> bool:
    """Renames a file; False if the target is there already."""
    fs, a = _at(spark, source)
    _, b = _at(spark, target)
    return False if fs.exists(b) else bool(fs.rename(a, b))


def put_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _at(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def get_text(spark: SparkSession, path: str) -> str:
    fs, p = _at(spark, path)
    opened = fs.open(p)
    data = spark._jvm.org.apache.commons.io.IOUtils.toByteArray(opened)
    opened.close()
    return bytes(data).decode()


def one_file(lines: DataFrame, path: str, begin: str = "", between: str = "\n", end: str = "\n") -> None:
    """The single text column of lines as one file, put in place by a rename; the file before goes at the last moment.

    Tasks write the lines in parts, which are then copied one after the other in the JVM, a buffer at a time.
    """
    spark = lines.sparkSession
    parts, whole = f"{path}.parts", f"{path}.new"
    lines.write.mode("overwrite").option("lineSep", between).text(parts)
    fs, folder = _at(spark, parts)
    jvm = spark._jvm
    sizes = [(s.getPath(), s.getLen()) for s in sorted(fs.listStatus(folder), key=lambda s: s.getPath().getName()) if s.getPath().getName().startswith("part-") and s.getLen()]
    out = fs.create(jvm.org.apache.hadoop.fs.Path(whole), True)
    out.write(bytearray(begin.encode()))
    for k, (part, size) in enumerate(sizes):
        opened = fs.open(part)
        # The separator behind the very last line stays out.
        jvm.org.apache.commons.io.IOUtils.copyLarge(opened, out, 0, size - (len(between.encode()) if k == len(sizes) - 1 else 0))
        opened.close()
    out.write(bytearray((end if sizes or begin else "").encode()))
    out.close()
    remove(spark, path)
    move(spark, whole, path)
    remove(spark, parts)
