"""Digests of files by byte ranges, and of tables by key ranges: trees whose leaves are computed by many tasks, and which say where two copies differ.

A file's digest is the root of a tree over SHA-256 of its ranges of RANGE bytes, so a large file is read by as many tasks as it has ranges, each in pieces of constant size. A table's is a
count and two hash sums for each range of keys, combined map-side; two copies are compared range by range, and only rows of ranges that differ meet in a join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from frostline.operators.reconcile import reconcile
from frostline.plans.lineage import cut
from frostline.sources.store import opened

RANGE = 8 << 20
#: Children of a node of a file's tree; two levels reach 8 PiB.
FANOUT = 1024
_PIECE = 1 << 20
MAX_TASKS = 10_000


def file_ranges(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """(name, path, length, range_no) of the Parquet files of a folder; reads no content. An empty file has one range of no bytes."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select("path", "length")
    last = F.greatest(F.ceil(F.col("length") / size) - 1, F.lit(0)).cast("long")
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "path", "length", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("range_no"))


def range_digests(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """(name, length, range_no, sha256): each range read by one task, a piece at a time."""
    ranges = cut(file_ranges(spark, path, size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for uri, rows in groupby(b.to_pylist(), key=lambda r: r["path"]):
                fs, place = opened(uri)
                with fs.open_input_file(place) as f:
                    for r in rows:
                        digest, at = hashlib.sha256(), r["range_no"] * size
                        end = min(at + size, r["length"])
                        while at < end:
                            piece = f.read_at(min(_PIECE, end - at), at)
                            if not piece:
                                break
                            digest.update(piece)
                            at += len(piece)
                        out.append((r["name"], r["length"], r["range_no"], digest.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names=["name", "length", "range_no", "sha256"])

    dealt = ranges.repartition(max(1, min(ranges.count(), MAX_TASKS)))
    return dealt.sortWithinPartitions("path", "range_no").mapInArrow(run, "name string, length long, range_no long, sha256 string")


def file_fingerprints(ranges: DataFrame) -> DataFrame:
    """(name, n_bytes, sha256) from range_digests(): the root of each file's tree."""
    node, nodes = ranges.select("name", "length", F.col("range_no").alias("i"), "sha256"), None
    for _ in range(2):
        kids = F.array_sort(F.collect_list(F.struct("i", "sha256")))
        nodes = node.groupBy("name", "length", F.floor(F.col("i") / FANOUT).cast("long").alias("parent")).agg(F.sha2(F.array_join(F.transform(kids, lambda x: x["sha256"]), ""), 256).alias("sha256"))
        node = nodes.withColumnRenamed("parent", "i")
    return node.select("name", F.col("length").alias("n_bytes"), "sha256")


def differing_ranges(now: DataFrame, want: DataFrame, size: int = RANGE) -> DataFrame:
    """(name, range_no, first_byte, what) of the ranges of want that now (both as range_digests() gives them) lacks or holds otherwise, and of those that only now has."""
    w = want.select("name", "range_no", F.col("sha256").alias("w"))
    both = w.join(now.select("name", "range_no", F.col("sha256").alias("h")), ["name", "range_no"], "full").where(~F.col("w").eqNullSafe(F.col("h")))
    what = F.when(F.col("h").isNull(), "missing").when(F.col("w").isNull(), "foreign").otherwise("changed")
    return both.select("name", "range_no", (F.col("range_no") * size).alias("first_byte"), what.alias("what"))


def row_hashes(columns: list[str]) -> list[Column]:
    """Two hashes of a row's canonical text: -0.0 differs from 0.0 and null from an empty text."""
    text = F.array(*(F.col(c).cast("string") for c in columns))
    marks = F.concat(*(F.when(F.col(c).isNull(), "0").otherwise("1") for c in columns))
    return [F.xxhash64(F.lit(seed), marks, text) for seed in (1, 2)]


def key_bucket(df: DataFrame, key: str, low, width: int, ranges: int) -> Column:
    """A key's range: of whole numbers `ranges` ranges of that width from low on, with one before and one after them; of other keys, which have no widths, a hash."""
    if isinstance(df.schema[key].dataType, IntegralType):
        at = F.floor((F.col(key).cast("decimal(20,0)") - F.lit(str(low)).cast("decimal(20,0)")) / width)
        return F.greatest(F.lit(-1), F.least(F.lit(ranges), at)).cast("long")
    return F.pmod(F.xxhash64(F.col(key)), F.lit(ranges))


def range_sums(df: DataFrame, key: str, columns: list[str], bucket: Column) -> DataFrame:
    """(bucket, n, sum1, sum2), rows combined before they are shuffled; a null key is of no range."""
    one, two = row_hashes([key, *columns])
    rows = df.where(F.col(key).isNotNull()).select(bucket.alias("bucket"), one.cast("decimal(38,0)").alias("one"), two.alias("two"))
    return rows.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("one").alias("sum1"), F.bit_xor("two").alias("sum2"))


def differing_buckets(a: DataFrame, b: DataFrame) -> DataFrame:
    """(bucket,): the ranges whose sums differ."""
    sums = lambda x, name: x.select("bucket", F.struct("n", "sum1", "sum2").alias(name))
    return sums(a, "l").join(sums(b, "r"), "bucket", "full").where(~F.col("l").eqNullSafe(F.col("r"))).select("bucket")


def reconcile_by_tree(src: DataFrame, arc: DataFrame, key: str, columns: list[str], fan: int = 4096) -> DataFrame:
    """(key, batch_seq, status) of the keys on which src and arc differ, as reconcile() gives them; what both hold alike is compared by sums and never joined.

    First `fan` ranges over the archive's keys (and what lies outside), then each that differs in fan ranges more; only rows of the small ranges left are joined by key. A null key is left out, as it equals none.
    """
    ends = arc.agg(F.min(key), F.max(key)).first()
    whole = isinstance(arc.schema[key].dataType, IntegralType)
    low, span = (ends[0] or 0, (ends[1] or 0) - (ends[0] or 0) + 1) if whole else (0, fan**2)
    levels = [(w, -(-span // w)) for w in (max(1, -(-span // fan)), max(1, -(-span // fan**2)))]
    sides = [src, arc]
    for width, ranges in levels:
        buckets = [key_bucket(x, key, low, width, ranges) for x in sides]
        found = cut(differing_buckets(*(range_sums(x, key, columns, b) for x, b in zip(sides, buckets))).select(F.col("bucket").alias("__bucket")))
        if found.isEmpty():
            return reconcile(src.limit(0), arc.limit(0), key, columns)
        if width == levels[0][0]:  # at most fan + 2 rows
            found = F.broadcast(found)
        sides = [x.join(found, b == F.col("__bucket"), "left_semi") for x, b in zip(sides, buckets)]
    return reconcile(*sides, key, columns).where("status <> 'match'")
