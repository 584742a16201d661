"""What Parquet footers know: ranges and counts of each row group, and bounds that follow from them without reading a row."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from frostline.operators.select import before
from frostline.sources.store import opened

MAX_TASKS = 10_000


def row_groups(spark: SparkSession, path: str, column: str) -> DataFrame:
    """(path, row_group, n_rows, n_bytes, nulls, low, high) of the Parquet files at path, low and high of the column's type; what a footer does not tell is null. Each footer is read by one task, and no data."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select("path")
    field = spark.read.parquet(path).schema[column]
    kind = spark.createDataFrame([], StructType([field])).toArrow().schema.field(0).type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        for uri in chain.from_iterable(b.column(0).to_pylist() for b in batches):
            fs, place = opened(uri)
            with fs.open_input_file(place) as f:
                meta = pq.ParquetFile(f).metadata
            at = next(i for i in range(meta.num_columns) if meta.schema.column(i).path == column)
            rows = []
            for g in range(meta.num_row_groups):
                group = meta.row_group(g)
                s = group.column(at).statistics
                ends = (s.min, s.max) if s is not None and s.has_min_max else (None, None)
                rows.append((uri, g, group.num_rows, group.total_byte_size, s.null_count if s is not None and s.has_null_count else None, *ends))
            if rows:
                types = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), kind, kind]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=["path", "row_group", "n_rows", "n_bytes", "nulls", "low", "high"])

    of = field.dataType.simpleString()
    return files.repartition(max(1, min(files.count(), MAX_TASKS))).mapInArrow(run, f"path string, row_group int, n_rows long, n_bytes long, nulls long, low {of}, high {of}")


def eligible_bounds(groups: DataFrame, cutoff: datetime) -> DataFrame:
    """One row (n_rows, at_least, at_most, unknown_rows) from row_groups() of the time column: rows older than the cutoff for certain, and those that may be. Rows of groups without a range count as possible and as unknown."""
    known = F.col("low").isNotNull() & F.col("high").isNotNull()
    filled = F.col("n_rows") - F.coalesce("nulls", F.lit(0))
    sure = F.when(known & F.col("nulls").isNotNull() & before(groups, "high", cutoff), filled)
    may = F.when(known & ~before(groups, "low", cutoff), 0).when(known, filled).when(F.col("nulls").eqNullSafe(F.col("n_rows")), 0).otherwise(F.col("n_rows"))
    unknown = F.when(~known & ~F.col("nulls").eqNullSafe(F.col("n_rows")), F.col("n_rows"))
    return groups.agg(*(F.coalesce(F.sum(x), F.lit(0)).cast("long").alias(a) for x, a in ((F.col("n_rows"), "n_rows"), (sure, "at_least"), (may, "at_most"), (unknown, "unknown_rows"))))
