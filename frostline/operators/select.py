"""Which rows are archived, and in which batch: age, equality, key ranges, parents, batch numbers."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

from frostline.plans.lineage import cut
from frostline.plans.model import ForeignKey, Plan, Policy, group_order


def before(df: DataFrame, time_col: str, cutoff: datetime) -> Column:
    """Strictly older than the cutoff (UTC); a null time never is. The literal has the column's kind, so Parquet can skip row groups."""
    kind = df.schema[time_col].dataType
    at = F.lit(cutoff.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz" if isinstance(kind, TimestampNTZType) else kind.simpleString())
    return F.col(time_col) < at


def eligible(df: DataFrame, plan: Plan) -> DataFrame:
    p = plan.policy
    rows = df.where(before(df, p.time_col, plan.cutoff))
    if p.equals:
        rows = rows.where(F.col(p.equals[0]).cast("string") == p.equals[1])
    return rows if plan.upper_key is None else rows.where(F.col(p.key) <= plan.upper_key)


def upper_key(df: DataFrame, key: str, where: Column | None = None):
    """The greatest key of all rows, or of those where the predicate holds; None for no rows, for which nothing is scanned."""
    return (df if where is None else df.where(where)).agg(F.max(key)).first()[0]


def key_range(df: DataFrame, key: str, after, upper, limit: int) -> DataFrame:
    """The next page in key order: limit rows over after (None: from the start) and up to upper (None: nothing)."""
    if upper is None:
        return df.limit(0)
    rows = df.where(F.col(key) <= upper)
    return (rows if after is None else rows.where(F.col(key) > after)).orderBy(key).limit(limit)


def estimate_eligible(df: DataFrame, plan: Plan, fraction: float | None = None, seed: int = 0) -> DataFrame:
    """One row (eligible, exact): counted, or scaled up from a sample of that fraction."""
    if fraction is None:
        return eligible(df, plan).agg(F.count("*").alias("eligible"), F.lit(True).alias("exact"))
    n = eligible(df.sample(fraction, seed), plan).agg(F.count("*").alias("n"))
    return n.select(F.round(F.col("n") / fraction).cast("long").alias("eligible"), F.lit(False).alias("exact"))


def assign_batches(df: DataFrame, key: str, size: int = 1000, ranges: int | None = None) -> DataFrame:
    """df with batch_seq (from 1) and row_no (from 1): rows in key order, cut every size rows; a unique key.

    No task sees all rows: the table is ranged and sorted by key once and written to the checkpoint folder, so that every
    partition keeps its rows and order from then on; a count per partition (as many rows as partitions) gives the offsets, and the
    place within its partition completes a row's number. Pass only the columns that the batches need.
    """
    ranged = df.repartitionByRange(ranges, key) if ranges else df.repartitionByRange(key)
    fixed = cut(ranged.sortWithinPartitions(key)).withColumn("__at", F.monotonically_increasing_id())
    part = F.shiftright("__at", 33)
    counts = fixed.groupBy(part.alias("p")).count().collect()
    offsets, total = [], 0
    for r in sorted(counts, key=lambda r: r.p):
        offsets.append((r.p, total))
        total += r["count"]
    table = F.broadcast(df.sparkSession.createDataFrame(offsets, "__part long, __offset long"))  # a row per partition
    numbered = fixed.withColumn("__part", part).join(table, "__part")
    row = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("__offset") + 1
    out = numbered.withColumn("row_no", row).withColumn("batch_seq", F.floor((F.col("row_no") - 1) / size).cast("long") + 1)
    return out.select(*df.columns, "row_no", "batch_seq")


def budget(batched: DataFrame, max_rows: int) -> DataFrame:
    """At most max_rows rows, in order: the last batch is cut short."""
    return batched.where(F.col("row_no") <= max_rows)


def text_bytes(df: DataFrame, columns: list[str]) -> Column:
    return sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in columns), F.lit(0)).cast("long")


def batch_summary(batched: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(batch_seq, n_rows, n_bytes, first_key, last_key)."""
    return batched.groupBy("batch_seq").agg(
        F.count("*").alias("n_rows"), F.sum(text_bytes(batched, columns)).alias("n_bytes"), F.min(key).alias("first_key"), F.max(key).alias("last_key")
    )


def parent_keys(parents: DataFrame, columns: list[str]) -> DataFrame:
    """The different key tuples of archived parents; tuples with a null refer to nothing."""
    return parents.select(*columns).na.drop("any").distinct()


def select_children(child: DataFrame, parents: list[tuple[DataFrame, ForeignKey]]) -> DataFrame:
    """Children of which any foreign key points at a selected parent, each once; age does not count.

    One key is a semi join. Several are one existence join each, over parents' distinct tuples, so no child multiplies.
    """
    hit = F.lit(False)
    rows, drop = child, []
    for i, (parent, fk) in enumerate(parents):
        names = [f"__p{i}_{c}" for c in fk.parent_cols]
        keys = parent_keys(parent, list(fk.parent_cols)).select(*(F.col(c).alias(n) for c, n in zip(fk.parent_cols, names)))
        same = [F.col(c) == F.col(n) for c, n in zip(fk.child_cols, names)]
        if len(parents) == 1:
            return child.join(keys, same, "left_semi")
        rows = rows.join(keys, same, "left")
        drop += names
        hit = hit | F.col(names[0]).isNotNull()
    return rows.where(hit).drop(*drop)


def select_group(tables: dict[str, DataFrame], policy: Policy, fks: list[ForeignKey], as_of: datetime) -> dict[str, DataFrame]:
    """The rows of every table of a group: the policy's table by age, the others by their selected parents; parents first."""
    order = group_order(list(tables), fks)
    out: dict[str, DataFrame] = {}
    for t in order:
        if t == policy.table:
            out[t] = eligible(tables[t], Plan.freeze(policy, as_of))
            continue
        own = [(out[fk.parent], fk) for fk in fks if fk.child == t]
        if not own:
            raise ValueError(f"{t} has no parent in the group and no policy")
        out[t] = select_children(tables[t], own)
    return out
