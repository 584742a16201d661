"""Where long jobs cut their lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that spark.checkpoint.dir names; only a local session without one gets its own."""
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="frostline-checkpoints-")
    spark.sparkContext.setCheckpointDir(shared)


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and read from the shared checkpoint folder from now on; survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def own_prefix(df: DataFrame) -> str:
    """A prefix that none of df's columns has, for columns that come and go."""
    p = "__"
    while any(c.startswith(p) for c in df.columns):
        p += "_"
    return p


def extended(df: DataFrame, more: str) -> StructType:
    """df's schema and then the columns of a DDL string."""
    return StructType([*df.schema.fields, *StructType.fromDDL(more).fields])
