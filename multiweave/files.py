"""Small files through Hadoop's file systems, so that any store that Spark reaches will do."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return fs.exists(at)


def names(spark: SparkSession, path: str) -> list[str]:
    fs, at = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def size(spark: SparkSession, path: str) -> int:
    """Bytes of a file, or of all files of a folder."""
    fs, at = _fs(spark, path)
    return fs.getContentSummary(at).getLength()


def delete(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return fs.delete(at, True)


def read_text(spark: SparkSession, path: str) -> str:
    fs, at = _fs(spark, path)
    stream = fs.open(at)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _context(spark: SparkSession, at):
    """The FileContext of a path, or None where its scheme has none."""
    from py4j.protocol import Py4JJavaError

    fs, conf = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), spark.sparkContext._jsc.hadoopConfiguration()
    try:
        return spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf)
    except Py4JJavaError as e:
        if "UnsupportedFileSystem" in str(e.java_exception):
            return None
        raise


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Replaces the file in one step where the store renames in one step and its scheme has a FileContext; else the old one goes first."""
    fs, at = _fs(spark, path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    part = hadoop.Path(f"{path}.{uuid.uuid4().hex}")
    stream = fs.create(part, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if _context(spark, at) is not None:
        options = getattr(hadoop, "Options$Rename")
        over = spark.sparkContext._gateway.new_array(options, 1)
        over[0] = options.OVERWRITE
        _context(spark, at).rename(fs.makeQualified(part), fs.makeQualified(at), over)
        return
    fs.delete(at, False)
    if not fs.rename(part, at):
        raise OSError(f"{path} could not be replaced")
