"""Versions of a table, each in a folder of its own; readers take only those that were written to their end."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def complete(spark: SparkSession, path: str, prefix: str = "run=") -> list[str]:
    """Names after the prefix of the folders below path that have a _SUCCESS mark, oldest first; none where path isn't there.

    Numbers are in order of their value. If any name isn't a number, all are in order of the time of their mark, then by name.
    """
    fs, where = _at(spark, path)
    if not fs.exists(where):
        return []
    found = []
    for folder in fs.listStatus(where):
        mark = spark._jvm.org.apache.hadoop.fs.Path(folder.getPath(), "_SUCCESS")
        name = folder.getPath().getName()
        if name.startswith(prefix) and fs.exists(mark):
            found.append((fs.getFileStatus(mark).getModificationTime(), name.removeprefix(prefix)))
    numbers = all(name.isdecimal() for _, name in found)
    return [name for _, name in sorted(found, key=(lambda f: int(f[1])) if numbers else None)]


def remove(spark: SparkSession, path: str) -> None:
    fs, where = _at(spark, path)
    fs.delete(where, True)


def break_off(spark: SparkSession, path: str) -> None:
    """Takes a version's mark away, so that readers pass it over."""
    remove(spark, f"{path}/_SUCCESS")
