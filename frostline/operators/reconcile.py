"""Do two copies agree? Value-exact comparison by key, of sets of keys, and of tables without a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frostline.functions.codecs import rows_equal
from frostline.operators.gates import violation

MATCH, CHANGED, MISSING, EXTRA = "match", "changed", "missing_in_source", "extra_in_source"


def _side(df: DataFrame, key: str, columns: list[str], name: str, more: list[str] | None = None) -> DataFrame:
    return df.select(F.col(key), F.struct(*(F.col(c) for c in columns)).alias(name), *(more or []))


def reconcile(src: DataFrame, arc: DataFrame, key: str, columns: list[str], upper=None, within: Column | None = None) -> DataFrame:
    """(key, batch_seq, status) of every key of either side; arc has batch_seq. A source row over upper is not compared, and one that the archive lacks counts as extra only where within, a predicate over src, holds.

    One full outer join on the key; both sides are cut to the compared columns first.
    """
    src = src if upper is None else src.where(F.col(key) <= upper)
    inside = F.coalesce(F.lit(True) if within is None else within, F.lit(False)).alias("inside")
    both = _side(arc, key, columns, "a", ["batch_seq"]).join(_side(src, key, columns, "s", [inside]), key, "full").where("a is not null or inside")
    same = rows_equal(both, "a", "s", columns)
    status = F.when(F.col("s").isNull(), MISSING).when(F.col("a").isNull(), EXTRA).when(same, MATCH).otherwise(CHANGED)
    return both.select(key, "batch_seq", status.alias("status"))


def reconcile_serving(arc: DataFrame, serving: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, status) by key, whatever the order: match, changed, missing, extra or duplicate; other columns in serving fail all."""
    if set(serving.columns) != {key, *columns}:
        return arc.select(key, F.lit("columns").alias("status"))
    s = serving.groupBy(key).agg(F.count("*").alias("n"), F.first(F.struct(*(F.col(c) for c in columns))).alias("s"))
    both = _side(arc, key, columns, "a").join(s, key, "full")
    status = (
        F.when(F.col("n") > 1, "duplicate").when(F.col("s").isNull(), "missing").when(F.col("a").isNull(), "extra")
        .when(rows_equal(both, "a", "s", columns), "match").otherwise("changed")
    )
    return both.select(key, status.alias("status"))


def shadow_report(source: DataFrame, serving: DataFrame, arc: DataFrame, expected_batches: int) -> DataFrame:
    """One row: n_rows and n_batches compared, source_mismatches (batches), serving_mismatches (rows), status."""
    src = source.agg(
        F.count_if(F.col("status") != EXTRA).alias("n_rows"),
        F.count_distinct(F.when(F.col("status") != EXTRA, F.col("batch_seq"))).alias("n_batches"),
        (F.count_distinct(F.when(~F.col("status").isin(MATCH, EXTRA), F.col("batch_seq"))) + F.when(F.count_if(F.col("status") == EXTRA) > 0, 1).otherwise(0)).alias("source_mismatches"),
        F.lit(0).cast("long").alias("serving_mismatches"),
    )
    srv = serving.agg(*(F.lit(0).cast("long").alias(c) for c in ("n_rows", "n_batches", "source_mismatches")), F.count_if(F.col("status") != "match").alias("serving_mismatches"))
    total = src.unionByName(srv).agg(*(F.sum(c).alias(c) for c in ("n_rows", "n_batches", "source_mismatches", "serving_mismatches")))
    bad = F.col("source_mismatches") + F.col("serving_mismatches") > 0
    return total.withColumn("status", F.when(F.col("n_batches") < expected_batches, "incomplete").when(bad, "mismatch").otherwise("passed"))


def validate_restore(arc: DataFrame, target: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Violations: archived rows that the target lacks or holds otherwise, and rows that only the target has."""
    r = reconcile(target, arc, key, columns)
    rule = F.when(F.col("status") == MISSING, "not_restored").when(F.col("status") == CHANGED, "restored_differently").when(F.col("status") == EXTRA, "foreign_row")
    return r.select(*violation(rule, F.col(key), F.coalesce(F.col("batch_seq").cast("string"), F.lit("")))).where("rule is not null")


def key_set_diff(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side) of the keys that only one side has; repeated keys count once."""
    left, right = a.select(key).distinct().withColumn("in_a", F.lit(True)), b.select(key).distinct().withColumn("in_b", F.lit(True))
    both = left.join(right, key, "full").where("in_a is null or in_b is null")
    return both.select(key, F.when(F.col("in_a").isNotNull(), "a").otherwise("b").alias("side"))


def multiset_diff(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """columns, n_a, n_b of the rows that occur more often on one side; for tables without a unique key.

    Floats count by their text, so that -0.0 and 0.0 differ. Both sides are counted before they meet.
    """
    marked = a.select(*columns, F.lit(1).alias("__a")).unionByName(b.select(*columns, F.lit(0).alias("__a")))
    kinds = dict(marked.dtypes)
    keys = [F.col(c).cast("string").alias(c) if kinds[c] in ("float", "double") else F.col(c) for c in columns]
    n = marked.groupBy(*keys).agg(F.sum("__a").alias("n_a"), F.count_if(F.col("__a") == 0).alias("n_b")).where("n_a <> n_b")
    return n.select(*(F.col(c).cast(kinds[c]).alias(c) for c in columns), "n_a", "n_b")


def fk_orphans(child: DataFrame, parent: DataFrame, child_cols: list[str], parent_cols: list[str]) -> DataFrame:
    """Child rows whose tuple has no null and no parent."""
    keys = parent.select(*(F.col(c).alias(f"__p_{c}") for c in parent_cols))
    same: list[Column] = [F.col(c) == F.col(f"__p_{p}") for c, p in zip(child_cols, parent_cols)]
    return child.na.drop("any", subset=child_cols).join(keys, same, "left_anti")


def copies_report(checked: DataFrame, serving: DataFrame | None, job: DataFrame, started_ms: int, finished_ms: int) -> DataFrame:
    """One row as authorize_delete() takes it, from what was compared: reconcile() over the frozen range, and reconcile_serving() of the copy that answers for the archive.

    Without a serving copy the report says not_checked and has no lookups, and it authorises nothing. job is one row with job_id, n_batches and digest. An extra source row, or one of the serving copy, is a mismatch; n_rows and n_batches count what was compared of the archive.
    """
    none = lambda kind, *names: [F.lit(None).cast(kind).alias(c) for c in names]
    one = F.lit(1).cast("long")
    src = checked.select(F.when(F.col("status") != EXTRA, one).alias("n"), (F.col("status") != MATCH).cast("long").alias("bad"), F.when(F.col("status") != EXTRA, F.col("batch_seq")).cast("long").alias("batch"), *none("long", "found", "served_bad"))
    parts = src
    if serving is not None:
        parts = parts.unionByName(serving.select(*none("long", "n", "bad", "batch"), F.when(~F.col("status").isin("extra", "columns"), one).alias("found"), (F.col("status") != "match").cast("long").alias("served_bad")))
    sums = parts.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(a) for c, a in (("n", "n_rows"), ("bad", "source_mismatches"), ("found", "found"), ("served_bad", "served_bad"))))
    # batches are counted by groups of their own, so that no task holds all; then the one-row frames become one row
    batches = parts.where("batch is not null").groupBy("batch").count().agg(F.count("*").alias("n_batches"))
    own = job.select(F.col("job_id").cast("string").alias("job_id"), "digest", F.col("n_batches").alias("expected"))
    rows = own.unionByName(sums, allowMissingColumns=True).unionByName(batches, allowMissingColumns=True)
    all_ = rows.agg(*(F.max(c).alias(c) for c in rows.columns))
    bad = F.col("source_mismatches") + F.col("served_bad") > 0
    status = F.when(F.lit(serving is None), "not_checked").when(bad, "mismatch").when(F.col("n_batches") < F.col("expected"), "incomplete").otherwise("passed")
    looked = lambda c: F.col(c) if serving is not None else F.lit(None).cast("long")
    return all_.select(
        "job_id", F.lit(started_ms).alias("started"), F.lit(finished_ms).alias("finished"), status.alias("status"), "n_rows", "n_batches", looked("found").alias("lookups"), "source_mismatches",
        looked("served_bad").alias("serving_mismatches"), "digest",
    )


def authorize_delete(jobs: DataFrame, reports: DataFrame, now_ms: int, max_age_ms: int, allow_empty: bool = False) -> DataFrame:
    """(job_id, group_id, allowed): the job's latest report passed, covers all its rows and batches, every row was looked up in the serving copy, nothing was wrong, it is of the job's manifest and
    young enough; a job of a group only if all members are so. A job of no rows only with allow_empty, as in a cycle that has compared them itself.

    jobs: job_id, group_id, n_rows, n_batches, digest. reports: job_id, started, finished, status, n_rows, n_batches, lookups, source_mismatches, serving_mismatches, digest (times in ms). What a report does not know (null) allows nothing.
    """
    latest = reports.groupBy("job_id").agg(F.max_by(F.struct(*(F.col(c) for c in reports.columns if c != "job_id")), "started").alias("r"))
    r = lambda c: F.col(f"r.{c}")
    good = (
        (r("status") == "passed") & (r("finished") >= r("started")) & (r("finished") <= now_ms) & (r("n_rows") == F.col("n_rows")) & (F.lit(allow_empty) | (F.col("n_rows") > 0)) & (r("n_batches") == F.col("n_batches"))
        & (r("lookups") == F.col("n_rows")) & (r("source_mismatches") == 0) & (r("serving_mismatches") == 0) & (r("digest") == F.col("digest"))
        & (now_ms >= r("started")) & (now_ms - r("started") <= max_age_ms)
    )
    each = jobs.join(latest, "job_id", "left").select("job_id", "group_id", F.coalesce(good, F.lit(False)).alias("own"))
    groups = each.where("group_id is not null").groupBy("group_id").agg(F.bool_and("own").alias("all"))
    return each.join(groups, "group_id", "left").select("job_id", "group_id", (F.col("own") & F.coalesce("all", F.lit(True))).alias("allowed"))
