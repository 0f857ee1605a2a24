"""File-system checks through Hadoop's FileSystem API (works for local, HDFS and object stores)."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _fs_and_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs_and_path(spark, path)
    return bool(fs.exists(p))


def _files(spark: SparkSession, path: str) -> list:
    fs, p = _fs_and_path(spark, path)
    if not fs.exists(p):
        return []
    found, entries = [], fs.listFiles(p, True)
    while entries.hasNext():
        found.append(entries.next())
    return found


def listing_stamp(spark: SparkSession, path: str) -> tuple:
    """(path, length, modification time) of all files under ``path``, in its folders too; empty when it is missing."""
    return tuple(sorted((s.getPath().toString(), int(s.getLen()), int(s.getModificationTime()))
                        for s in _files(spark, path)))


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the entries of a folder; empty when it is missing."""
    fs, p = _fs_and_path(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def total_bytes(spark: SparkSession, path: str) -> int:
    return sum(int(s.getLen()) for s in _files(spark, path))


def rename(spark: SparkSession, source: str, target: str) -> None:
    """Put a written folder in place of another one."""
    fs, p = _fs_and_path(spark, source)
    _, q = _fs_and_path(spark, target)
    fs.delete(q, True)
    if not fs.rename(p, q):
        raise OSError(f"cannot rename {source} to {target}")


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder; a missing one is fine."""
    fs, p = _fs_and_path(spark, path)
    fs.delete(p, True)
