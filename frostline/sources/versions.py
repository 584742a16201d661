"""A table as a log of versions, each a list of files: rows are deleted by writing anew only the files that hold them.

uri/log/00000001.json and on name the list of each version (uri/lists/..., Parquet); new data goes to uri/data. A version is there when its log entry is, which `create_once` makes at once; who planned
on a version that is not the newest any more is refused. Old versions stay readable, and files that no list names are left-overs of lost races.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from frostline.plans.lineage import cut
from frostline.sources.store import create_once, names, read_text

FILES = "path string, n_rows long, n_bytes long"


class Moved(RuntimeError):
    """The table has a newer version than the one that was planned on."""


def _entry(uri: str, version: int) -> str:
    return f"{uri}/log/{version:08d}.json"


def current(spark: SparkSession, uri: str) -> int:
    """The newest version; 0 if there is no table."""
    return max((int(n.removesuffix(".json")) for n in names(spark, f"{uri}/log")), default=0)


def history(spark: SparkSession, uri: str) -> DataFrame:
    """(version, list, schema, note) of all versions: a row per log entry."""
    rows = [{"version": v, **json.loads(read_text(spark, _entry(uri, v)))} for v in range(1, current(spark, uri) + 1)]
    return spark.createDataFrame([(r["version"], r["list"], r["schema"], r["note"]) for r in rows], "version long, list string, schema string, note string")


def files_of(spark: SparkSession, uri: str, version: int | None = None) -> DataFrame:
    """The files of a version, the newest if none is given: path, n_rows, n_bytes."""
    entry = json.loads(read_text(spark, _entry(uri, version or current(spark, uri))))
    return spark.read.schema(FILES).parquet(entry["list"])


def _listed(spark: SparkSession, paths: list[str], schema: StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read_version(spark: SparkSession, uri: str, version: int | None = None) -> DataFrame:
    """The rows of a version; the driver learns the names of its files, as for any scan."""
    version = version or current(spark, uri)
    schema = StructType.fromJson(json.loads(json.loads(read_text(spark, _entry(uri, version)))["schema"]))
    return _listed(spark, [r.path for r in files_of(spark, uri, version).select("path").collect()], schema)


def file_of_row():
    """The file that a row is read from, as lists name it."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def _described(rows: DataFrame) -> DataFrame:
    return rows.select(file_of_row().alias("path"), F.col("_metadata.file_size").alias("n_bytes")).groupBy("path", "n_bytes").agg(F.count("*").alias("n_rows")).select("path", "n_rows", "n_bytes")


def _commit(spark: SparkSession, uri: str, version: int, files: DataFrame, schema: StructType, note: str) -> int:
    where = f"{uri}/lists/{uuid.uuid4().hex}"
    files.write.parquet(where)
    if not create_once(spark, _entry(uri, version), json.dumps({"list": where, "schema": schema.json(), "note": note})):
        raise Moved(f"{uri} has a version {version} already")
    return version


def adopt(spark: SparkSession, uri: str, source: str) -> int:
    """Version 1 of a table: the Parquet files at source, where they are; nothing is copied, and they must stay."""
    rows = spark.read.parquet(source)
    return _commit(spark, uri, 1, _described(rows), rows.schema, "adopted")


def delete_keys(spark: SparkSession, uri: str, planned: int, keys: DataFrame, key: str, note: str = "deleted") -> int:
    """A version without the rows whose key is in keys, made from the version that was planned on; Moved if that is not the newest.

    One scan of the key column between the least and the greatest of keys tells the files that hold such rows. Files of nothing else are dropped, others with such rows are written anew without them, and all others go on by
    name. No such row makes no version. A null key is never deleted, a repeated one with all its rows.
    """
    if current(spark, uri) != planned:
        raise Moved(f"{uri} is not at version {planned}")
    gone = cut(keys.select(key).where(F.col(key).isNotNull()).distinct())
    low, high = gone.agg(F.min(key), F.max(key)).first()
    if low is None:
        return planned
    rows, files = read_version(spark, uri, planned), files_of(spark, uri, planned)
    held = rows.where(F.col(key).between(low, high)).select(key, file_of_row().alias("path")).join(gone, key, "left_semi").groupBy("path").agg(F.count("*").alias("n_gone"))
    touched = cut(files.join(held, "path"))
    if touched.isEmpty():
        return planned
    part = [r.path for r in touched.where("n_gone < n_rows").select("path").collect()]
    after = files.join(touched, "path", "left_anti").select("path", "n_rows", "n_bytes")
    if part:
        data = f"{uri}/data/{uuid.uuid4().hex}"
        _listed(spark, part, rows.schema).join(gone, key, "left_anti").select(rows.columns).write.parquet(data)
        after = after.unionByName(_described(spark.read.schema(rows.schema).parquet(data)))
    return _commit(spark, uri, planned + 1, after, rows.schema, note)


def fates(spark: SparkSession, uri: str, before: int, after: int) -> DataFrame:
    """(path, fate) of the files of two versions: kept, gone or new."""
    a, b = (files_of(spark, uri, v).select("path", F.lit(True).alias(s)) for v, s in ((before, "a"), (after, "b")))
    fate = F.when(F.col("a") & F.col("b"), "kept").when(F.col("a"), "gone").otherwise("new")
    return a.join(b, "path", "full").select("path", fate.alias("fate"))
