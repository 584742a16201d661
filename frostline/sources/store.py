"""Small files and byte ranges of any store: the driver's by Hadoop's file systems, the tasks' by pyarrow's.

What makes a thing final is a file or folder that appears under its name at once and only if there is none: `create_once` and `move_once` rename without overwriting, which is atomic where the
store's rename is (HDFS, local disks); of two that try, one is told that it came second.
"""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _hadoop(spark: SparkSession, uri: str):
    """(file system, qualified path)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, fs.makeQualified(path)


def exists(spark: SparkSession, uri: str) -> bool:
    fs, path = _hadoop(spark, uri)
    return fs.exists(path)


def names(spark: SparkSession, uri: str) -> list[str]:
    """The names in a folder, in order, without hidden ones; none if there is no folder."""
    fs, path = _hadoop(spark, uri)
    found = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    return sorted(n for n in found if n[0] not in "._")


def read_text(spark: SparkSession, uri: str) -> str:
    fs, path = _hadoop(spark, uri)
    stream = fs.open(path)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def move_once(spark: SparkSession, source: str, target: str) -> bool:
    """Renames a file or folder; False, and nothing changes, if there is a target already."""
    fs, path = _hadoop(spark, target)
    fs.mkdirs(path.getParent())
    jvm = spark._jvm
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.NONE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(_hadoop(spark, source)[1], path, how)
    except Exception as e:
        if "FileAlreadyExistsException" in str(e) or (fs.exists(path) and exists(spark, source)):
            return False
        raise
    return True


def create_once(spark: SparkSession, uri: str, text: str) -> bool:
    """A small file that appears whole or not at all; False if there is one already."""
    folder, _, name = uri.rpartition("/")
    fs, path = _hadoop(spark, f"{folder}/.{name}-{uuid.uuid4().hex}")
    out = fs.create(path)
    out.write(text.encode())
    out.close()
    if move_once(spark, str(path.toString()), uri):
        return True
    fs.delete(path, False)
    return False


def opened(uri: str):
    """(file system, path) by pyarrow, for tasks; it knows local files, S3, Google Cloud Storage, and HDFS where libhdfs is there. uri is not percent-encoded."""
    from urllib.parse import quote

    from pyarrow import fs

    return fs.FileSystem.from_uri(quote(uri if ":/" in uri else f"file://{uri}", safe=":/@"))
