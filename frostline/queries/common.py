"""Tables, policies and derived copies that the queries share, and their SQL.

The test tables hold no changed rows, so the queries derive them from the keys: of the source as it is now every 11th order
is gone, every 7th has another price and every 13th a new date; of the serving copy every 17th is missing,
every 19th is there twice and every 23rd has another price. Times are literals, never now().
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frostline.operators.select import assign_batches, eligible
from frostline.plans.lineage import ensure_checkpoint_dir
from frostline.plans.model import Plan, Policy
from frostline.sources import versions

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

AS_OF = datetime(2001, 8, 2)
ORDERS = Policy("orders-old", "orders", "o_orderkey", "o_orderdate", 730)
PLAN = Plan.freeze(ORDERS, AS_OF)
CUT = "TIMESTAMP '1999-08-03 00:00:00'"
COLUMNS = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate"]


def query(sql: str | None = None):
    """Registers a query under its function's name, with DuckDB SQL for the same rows."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def okey():
    return F.col("o_orderkey")


def scratch(spark: SparkSession) -> str:
    """A new folder under the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/frostline-{uuid.uuid4().hex}"


def archived_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old orders in their batches."""
    rows = eligible(table(spark, sf_dir, "orders"), PLAN).select("o_orderkey", *COLUMNS)
    return assign_batches(rows, "o_orderkey", ORDERS.batch_size).drop("row_no")


def current_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").where(k % 11 != 0).select(
        "o_orderkey", "o_custkey", "o_orderstatus", (F.col("o_totalprice") + F.when(k % 7 == 0, 1.0).otherwise(0.0)).alias("o_totalprice"),
        F.when(k % 13 == 0, F.lit("2001-07-01").cast("timestamp_ntz")).otherwise(F.col("o_orderdate")).alias("o_orderdate"),
    )


def versioned_orders(spark: SparkSession, sf_dir: str) -> str:
    """The orders as a versioned table, whose first version is the given file."""
    uri = scratch(spark)
    versions.adopt(spark, uri, f"{sf_dir}/orders.parquet")
    return uri


def no_jobs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "policy string, status string, deleted boolean, imported boolean")


def served(table: str, arc: DataFrame) -> DataFrame:
    """A serving copy that answers for the archive row by row."""
    return arc.drop("batch_seq").repartition(3)


def serving_orders(arc: DataFrame) -> DataFrame:
    k = F.col("o_orderkey")
    own = arc.where(k % 17 != 0).select("o_orderkey", "o_custkey", "o_orderstatus", (F.col("o_totalprice") + F.when(k % 23 == 0, 1.0).otherwise(0.0)).alias("o_totalprice"), "o_orderdate")
    extra = arc.where(k % 29 == 0).select((k + 1_000_000_000).alias("o_orderkey"), *COLUMNS)
    return own.unionByName(own.where(k % 19 == 0)).unionByName(extra)


ARC_SQL = f"""arc AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate,
  (row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 + 1 AS batch_seq FROM orders WHERE o_orderdate < {CUT})"""
NOW_SQL = """src AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice + CASE WHEN o_orderkey % 7 = 0 THEN 1.0 ELSE 0.0 END AS o_totalprice,
  CASE WHEN o_orderkey % 13 = 0 THEN TIMESTAMP '2001-07-01' ELSE o_orderdate END AS o_orderdate FROM orders WHERE o_orderkey % 11 <> 0)"""
SERVING_SQL = """own AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice + CASE WHEN o_orderkey % 23 = 0 THEN 1.0 ELSE 0.0 END AS o_totalprice, o_orderdate
  FROM arc WHERE o_orderkey % 17 <> 0),
srv AS (SELECT * FROM own UNION ALL SELECT * FROM own WHERE o_orderkey % 19 = 0
  UNION ALL SELECT o_orderkey + 1000000000, o_custkey, o_orderstatus, o_totalprice, o_orderdate FROM arc WHERE o_orderkey % 29 = 0)"""
SAME_SQL = " AND ".join(f"a.{c} IS NOT DISTINCT FROM s.{c}" for c in COLUMNS)
