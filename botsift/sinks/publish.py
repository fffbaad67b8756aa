"""Small files that appear, or are replaced, as a whole: manifests, pointers and log entries.

A file is written beside its place under another name and then renamed over it (through Hadoop's file interface, so any
file system that Spark reads will do). A reader finds the old content or the new one, never less; a writer that dies leaves a hidden file at most.
"""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _system(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def put(spark: SparkSession, path: str, text: str) -> None:
    """Write or replace a small file in one step."""
    folder, _, name = path.rpartition("/")
    jvm, beside = spark._jvm, f"{folder}/.{name}.{uuid.uuid4().hex[:12]}"
    # an instance of our own, without the checksum file that a local file system would keep beside each file: two files can't be
    # replaced in one step
    fs = jvm.org.apache.hadoop.fs.FileSystem.newInstance(_path(spark, folder).toUri(), spark._jsc.hadoopConfiguration())
    fs.setWriteChecksum(False)
    out = fs.create(_path(spark, beside), True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(_path(spark, beside)).toUri(), spark._jsc.hadoopConfiguration())
    how = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(fs.makeQualified(_path(spark, beside)), fs.makeQualified(_path(spark, path)), how)
    fs.close()


def get(spark: SparkSession, path: str) -> str | None:
    """The content of a small file, None where there is none."""
    fs, place = _system(spark, path), _path(spark, path)
    if not fs.exists(place):
        return None
    source = fs.open(place)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(source)).decode()
    finally:
        source.close()


def names(spark: SparkSession, folder: str, pattern: str = "*") -> list[str]:
    """Names of the visible files and folders in a folder, in order; none where it is absent."""
    found = _system(spark, folder).globStatus(_path(spark, f"{folder}/{pattern}"))
    return sorted(n for n in (s.getPath().getName() for s in found or ()) if not n.startswith((".", "_")))


def remove(spark: SparkSession, path: str) -> None:
    _system(spark, path).delete(_path(spark, path), True)
