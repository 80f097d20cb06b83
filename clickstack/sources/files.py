"""File-system questions, answered by the file system that Spark uses for the path (never by the driver's disk alone)."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _at(spark, path)
    return fs.exists(p)


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes of all files under ``path``; 0 where there is none."""
    p, fs = _at(spark, path)
    return int(fs.getContentSummary(p).getLength()) if fs.exists(p) else 0


def stamp(spark: SparkSession, path: str) -> str | None:
    """Size and time of a file, or of the files right below a folder; None where there is none."""
    p, fs = _at(spark, path)
    if not fs.exists(p):
        return None
    own = fs.getFileStatus(p)
    listed = fs.listStatus(p) if own.isDirectory() else [own]
    sizes = [(str(s.getPath().getName()), int(s.getLen()), int(s.getModificationTime()) // 1000) for s in listed]
    return repr(sorted(sizes))


def delete(spark: SparkSession, path: str) -> bool:
    p, fs = _at(spark, path)
    return bool(fs.delete(p, True))
