"""Deleting from the source only what provably equals the archive, and keeping the books of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostline.functions.codecs import rows_equal
from frostline.operators.gates import ROW_LIMIT, text_bytes
from frostline.operators.select import before
from frostline.plans.lineage import cut, own_prefix
from frostline.plans.model import ForeignKey, Plan


def blocked_parents(parents: DataFrame, children: list[tuple[DataFrame, ForeignKey]]) -> DataFrame:
    """The parents that some child still points at; they must stay, whatever the key would do on delete."""
    out, p = None, own_prefix(parents)
    for child, fk in children:
        keys = child.select(*(F.col(c).alias(f"{p}{c}") for c in fk.child_cols))
        hit = parents.join(keys, [F.col(a) == F.col(f"{p}{c}") for a, c in zip(fk.parent_cols, fk.child_cols)], "left_semi")
        out = hit if out is None else out.unionByName(hit)
    return out.distinct() if len(children) > 1 else out


def _compared(arc: DataFrame, src: DataFrame, key: str, columns: list[str]) -> DataFrame:
    a = arc.select(key, "batch_seq", F.struct(*(F.col(c) for c in columns)).alias("a"))
    return a.join(src.select(key, F.struct(*(F.col(c) for c in columns)).alias("s")), key, "left")


def plan_delete(arc: DataFrame, src: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, batch_seq, decision) in strict mode: delete, absent, or kept from the first batch on that has a changed row.

    A changed row stops its whole batch and the run, so only batches before the first such one are deleted from.
    """
    met = _compared(arc, src, key, columns)
    state = F.when(F.col("s").isNull(), "absent").when(rows_equal(met, "a", "s", columns), "delete").otherwise("changed")
    rows = cut(met.select(key, "batch_seq", state.alias("state")))
    stop = rows.where("state = 'changed'").agg(F.min("batch_seq")).first()[0]
    if stop is None:
        return rows.withColumnRenamed("state", "decision")
    return rows.select(key, "batch_seq", F.when(F.col("batch_seq") >= stop, "kept").otherwise(F.col("state")).alias("decision"))


def plan_delete_live(arc: DataFrame, src: DataFrame, key: str, columns: list[str], plan: Plan, limit: int = ROW_LIMIT) -> DataFrame:
    """(key, batch_seq, decision) by row: delete, absent, or deferred (changed, no longer old enough, or over the size limit)."""
    ok = before(src, plan.policy.time_col, plan.cutoff)
    if plan.policy.equals:
        ok = ok & (F.col(plan.policy.equals[0]).cast("string") == plan.policy.equals[1])
    s = src.select(key, F.struct(*(F.col(c) for c in columns)).alias("s"), F.coalesce(ok, F.lit(False)).alias("old"), (text_bytes(src, columns) > limit).alias("big"))
    met = arc.select(key, "batch_seq", F.struct(*(F.col(c) for c in columns)).alias("a")).join(s, key, "left")
    fits = rows_equal(met, "a", "s", columns) & F.col("old") & ~F.col("big")
    return met.select(key, "batch_seq", F.when(F.col("s").isNull(), "absent").when(fits, "delete").otherwise("deferred").alias("decision"))


def plan_delete_documents(arc: DataFrame, src: DataFrame, key: str = "key", raw: str = "body") -> DataFrame:
    """plan_delete on the documents' bytes alone."""
    return plan_delete(arc, src, key, [raw])


def survivors(src: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    return src.join(decisions.where("decision = 'delete'").select(key), key, "left_anti")


def deletion_batches(decisions: DataFrame) -> DataFrame:
    """The ledger: (batch_seq, processed, deleted, absent, deferred); batches that were kept are not in it."""
    n = lambda d: F.count_if(F.col("decision") == d)
    done = decisions.where("decision <> 'kept'").groupBy("batch_seq")
    return done.agg(F.count("*").alias("processed"), n("delete").alias("deleted"), n("absent").alias("absent"), n("deferred").alias("deferred"))


def deletion_progress(batches: DataFrame, jobs: DataFrame) -> DataFrame:
    """(job_id, processed, deleted, absent, deferred, uncertain, complete): uncertain are the absences of batches that took more
    than one attempt; complete if every batch of the job is there. batches has job_id and attempts; jobs: job_id, n_batches."""
    sums = [F.sum(c).alias(c) for c in ("processed", "deleted", "absent", "deferred")]
    b = batches.groupBy("job_id").agg(*sums, F.sum(F.when(F.col("attempts") > 1, F.col("absent")).otherwise(0)).alias("uncertain"), F.count_distinct("batch_seq").alias("n"))
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("processed", "deleted", "absent", "deferred", "uncertain")}
    both = jobs.join(b, "job_id", "left")
    return both.withColumns(zero).select("job_id", *zero, (F.coalesce("n", F.lit(0)) == F.col("n_batches")).alias("complete"))


def require_allowed(allowed: DataFrame, job_id: str) -> None:
    """Refuses a job without exactly one row in authorize_delete()'s frame that allows it."""
    rows = allowed.where(F.col("job_id") == job_id).select("allowed").limit(2).collect()
    if [r.allowed for r in rows] != [True]:
        raise PermissionError(f"{job_id}: no current authorisation to delete")


def purge(src: DataFrame, decisions: DataFrame, key: str, out: str, allowed: DataFrame, job_id: str) -> None:
    """A new table without the deleted rows, for sources that are no versioned tables (`plans.deletion` deletes from those); an existing path is refused, the source is not touched."""
    require_allowed(allowed, job_id)
    survivors(src, decisions, key).write.mode("errorifexists").parquet(out)
