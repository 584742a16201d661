"""Reading source tables and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan(spark: SparkSession, path: str, columns: list[str], fmt: str = "parquet", **options: str) -> DataFrame:
    """The columns of a table at a path; pruning and later filters reach the files."""
    return spark.read.format(fmt).options(**options).load(path).select(*columns)


def scan_documents(spark: SparkSession, path: str, key_field: str = "_id", time_field: str = "ts") -> DataFrame:
    """(key, raw, at) of a file of JSON lines: the raw text stays as it is."""
    return as_documents(spark.read.text(path).withColumnRenamed("value", "raw"), "raw", key_field, time_field)


def as_documents(df: DataFrame, raw: str, key_field: str = "_id", time_field: str = "ts") -> DataFrame:
    return df.select(
        F.get_json_object(raw, f"$.{key_field}").alias("key"), F.col(raw).alias("raw"), F.try_to_timestamp(F.get_json_object(raw, f"$.{time_field}")).alias("at")
    )


def lookup(archive: DataFrame, keys: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The archived rows of the given keys, one per key, projected; Catalyst broadcasts the keys only if they are small."""
    return archive.join(keys.select(key).distinct(), key, "left_semi").select(*columns)
