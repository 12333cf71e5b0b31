"""Small files in a shared folder, through the file system that Spark uses for it."""

from __future__ import annotations

import time

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    target, system = _at(spark, path)
    return system.exists(target)


def create(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small new file; false if there is one. The file system decides who is first where it creates files atomically."""
    target, system = _at(spark, path)
    try:
        stream = system.create(target, False)
    except Py4JJavaError as exc:
        if "exist" in str(exc.java_exception):
            return False
        raise
    stream.write(bytearray(text.encode()))
    stream.close()
    return True


def read_text(spark: SparkSession, path: str) -> str:
    target, system = _at(spark, path)
    stream = system.open(target)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def remove(spark: SparkSession, path: str) -> None:
    target, system = _at(spark, path)
    system.delete(target, True)


def _entries(spark: SparkSession, path: str) -> list:
    target, system = _at(spark, path)
    return list(system.listStatus(target)) if system.exists(target) else []


def numbered(spark: SparkSession, path: str) -> list[int]:
    """Numbers that name the files of a folder."""
    names = [x.getPath().getName() for x in _entries(spark, path)]
    return [int(n) for n in names if n.isdigit()]


def folders(spark: SparkSession, path: str) -> list[tuple[str, float]]:
    """Names and ages in seconds of a folder's folders."""
    now = time.time()
    return [(x.getPath().getName(), now - x.getModificationTime() / 1000) for x in _entries(spark, path) if x.isDirectory()]
