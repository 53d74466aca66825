"""Small files in the store that Spark reads, through Hadoop's client: manifests, not data."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names of the files in a folder, in order; none if it doesn't exist."""
    path, fs = _at(spark, folder)
    return sorted(f.getPath().getName() for f in fs.listStatus(path)) if fs.exists(path) else []


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _at(spark, path)
    return fs.exists(at)


def text(spark: SparkSession, path: str) -> str:
    at, fs = _at(spark, path)
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def create(spark: SparkSession, path: str, content: str) -> bool:
    """Writes a whole file under a name that nobody has taken yet; False if somebody has.

    The content goes to another name first and is then renamed without overwriting, so readers see all of it or nothing."""
    at, fs = _at(spark, path)
    waits = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    stream = fs.create(waits, False)
    stream.write(content.encode())
    stream.close()
    kind = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri() if at.toUri().getScheme() else fs.getUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(waits, at, spark.sparkContext._gateway.new_array(kind, 0))
    except Py4JJavaError as e:
        fs.delete(waits, False)
        if "FileAlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    return True
