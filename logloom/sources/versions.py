"""Numbered versions of a name in a shared folder, taken one after another.

A run that changes what it has read names its result as the version after the one it read. Only one
run can have a number, so a run that comes second notices it and does its change again on the newer
version. The numbers are files made exclusively, as HDFS and local file systems can; a store without
exclusive creation needs another way to claim a number.
"""

from __future__ import annotations

import time

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

KEPT = 100  # versions whose number files stay


def _folder(spark: SparkSession, root: str, name: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/versions/{name}")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _file(spark: SparkSession, folder, number: int):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder, f"{number:012d}")


def latest(spark: SparkSession, root: str, name: str) -> tuple[int, str]:
    """Number and content of the last version; 0 and an empty text if there is none."""
    fs, folder = _folder(spark, root, name)
    if not fs.exists(folder):
        return 0, ""
    numbers = [int(s.getPath().getName()) for s in fs.listStatus(folder) if s.getPath().getName().isdigit()]
    if not numbers:
        return 0, ""
    return max(numbers), content_of(spark, root, name, max(numbers))


def content_of(spark: SparkSession, root: str, name: str, number: int) -> str:
    """The content of one version; an empty text if there is no such version (any more)."""
    fs, folder = _folder(spark, root, name)
    path, content = _file(spark, folder, number), ""
    for _ in range(20):
        if not fs.exists(path):
            return ""
        stream = fs.open(path)
        try:
            content = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        if content:
            break
        time.sleep(0.1)  # made, but not written yet
    return content


def claim(spark: SparkSession, root: str, name: str, after: int, content: str) -> bool:
    """Make version ``after + 1`` with this content (not empty); False if another run has made it."""
    fs, folder = _folder(spark, root, name)
    try:
        stream = fs.create(_file(spark, folder, after + 1), False)
    except Py4JJavaError as error:
        if "FileAlreadyExists" in str(error.java_exception):
            return False
        raise
    stream.write(bytearray(content.encode()))
    stream.close()
    if after >= KEPT:
        fs.delete(_file(spark, folder, after + 1 - KEPT), False)
    return True
