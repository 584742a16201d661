"""Recurring retention: one cycle of a policy or of a group over versioned tables.

A cycle exports the old rows, verifies the archive, compares source, archive and serving copy, and deletes as the authorisation that this comparison earns allows. Each step has its own journal, so a cycle that
was stopped is called again with the same arguments and goes on.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frostline.operators.purge import blocked_parents, plan_delete, survivors
from frostline.operators.reconcile import authorize_delete, copies_report, reconcile, reconcile_serving
from frostline.operators.select import assign_batches, before, select_group
from frostline.plans.deletion import Target, has_deleted, run_deletion
from frostline.plans.lineage import cut, own_prefix
from frostline.plans.model import ForeignKey, Plan, Policy, group_order
from frostline.sources import store, versions
from frostline.sources.archive import read_archive, read_manifest, verify_archive
from frostline.sources.export import export, write_archive

MAX_REPORT_AGE_MS = 3_600_000


@dataclass(frozen=True)
class Checks:
    """What a cycle must be told before it may delete; nothing has a default, so nothing is skipped by leaving it out.

    jobs: the policy's earlier jobs (policy, status, deleted, imported). serving: reads the copy that answers for the archive, given the table's name and the archived rows; None if there is none, which deletes nothing. admitted: admission()'s
    one row for now (allowed, reason), or None for a source without a protection policy. children: tables (as functions that read them now) that may point at the rows.
    """

    jobs: DataFrame
    serving: Callable[[str, DataFrame], DataFrame] | None
    admitted: DataFrame | None
    children: list[tuple[Callable[[], DataFrame], ForeignKey]]


def may_run(jobs: DataFrame) -> DataFrame:
    """(policy, ready): every earlier job of the policy is finished and deleted and none was imported. jobs: policy, status, deleted, imported."""
    done = (F.col("status") == "completed") & F.col("deleted") & ~F.col("imported")
    return jobs.groupBy("policy").agg(F.bool_and(done).alias("ready"))


def require_ready(jobs: DataFrame, policy: str) -> None:
    """Refuses a cycle while an earlier job of the policy is unfinished, undeleted or imported; no earlier job is no hindrance."""
    if not may_run(jobs.where(F.col("policy") == policy)).where("not ready").isEmpty():
        raise PermissionError(f"{policy}: an earlier job is not finished and deleted")


def require_admitted(admitted: DataFrame | None, policy: str) -> None:
    """Refuses to delete while telemetry says no, or says nothing although there is a protection policy."""
    if admitted is not None:
        rows = admitted.select("allowed", "reason").limit(2).collect()
        if [r.allowed for r in rows] != [True]:
            raise PermissionError(f"{policy}: not admitted ({', '.join(r.reason for r in rows) or 'no decision'})")


def require_same(spark: SparkSession, uri: str, told: dict) -> None:
    """A cycle that is called again has the tables and the time that it began with."""
    text = json.dumps(told, sort_keys=True)
    if not store.create_once(spark, uri, text) and store.read_text(spark, uri) != text:
        raise ValueError(f"{uri} was begun with other tables or another time")


def job_row(spark: SparkSession, uri: str, job: str, group: str | None = None) -> DataFrame:
    """(job_id, group_id, n_rows, n_batches, digest) of a finished archive; the digest is over its batches' digests, of 4096 batches and then of those."""
    b = read_manifest(spark, uri).where("batch_seq is not null")
    node = b.select(F.col("batch_seq").alias("i"), "digest", "n_rows", F.lit(1).cast("long").alias("n_batches"))
    for _ in range(3):
        kids = F.array_sort(F.collect_list(F.struct("i", "digest")))
        node = node.groupBy(F.shiftright("i", 12).alias("i")).agg(F.sha2(F.array_join(F.transform(kids, lambda x: x["digest"]), "\n"), 256).alias("digest"), F.sum("n_rows").alias("n_rows"), F.sum("n_batches").alias("n_batches"))
    whole = node.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum("n_batches"), F.lit(0)).alias("n_batches"), F.coalesce(F.max("digest"), F.lit("")).alias("digest"))
    return cut(whole.select(F.lit(job).alias("job_id"), F.lit(group).cast("string").alias("group_id"), "n_rows", "n_batches", "digest"))


def _compared(src: DataFrame, arc: DataFrame, within, serving: DataFrame | None, row: DataFrame, key: str, columns: list[str], started: int) -> DataFrame:
    checked = cut(reconcile(src, arc, key, columns, within=within))
    served = None if serving is None else cut(reconcile_serving(arc, serving, key, [c for c in columns if c != key]))
    return cut(copies_report(checked, served, row, started, int(time.time() * 1000)))


def run_cycle(spark: SparkSession, table: str, lake: str, policy: Policy, as_of: datetime, cycle: int, checks: Checks) -> int:
    """Archives the policy's old rows of the versioned table, verifies and compares them, and deletes them; returns the table's version, a new one only if rows went.

    The whole table is read again each time, so rows that came late or with an old date are caught by the next cycle. A row that came into the frozen range after the export, a changed row, a serving copy that differs or is not there,
    a source that is not admitted and a child that would be left without its parent all refuse the deletion: PermissionError, and the archive stays.
    """
    require_ready(checks.jobs, policy.name)
    started = int(time.time() * 1000)
    job, uri = f"{policy.name}-{cycle}", f"{lake}/{policy.name}-{cycle}"
    require_same(spark, f"{lake}/{job}.json", {"tables": {policy.table: table}, "as_of": as_of.isoformat()})
    src = versions.read_version(spark, table)
    plan = Plan.freeze(policy, as_of)
    export(src, plan, uri, job, src.columns)
    if not verify_archive(spark, uri, policy.key).isEmpty():
        raise ValueError(f"{job}: the archive does not verify")
    arc = read_archive(spark, uri, verified=True)
    if arc.isEmpty():  # nothing was old enough, so there is nothing to authorise
        return versions.current(spark, table)
    require_admitted(checks.admitted, policy.name)
    if not has_deleted(spark, table, job):
        src = versions.read_version(spark, table)
        within = before(src, policy.time_col, plan.cutoff)
        if policy.equals:
            within = within & (F.col(policy.equals[0]).cast("string") == policy.equals[1])
        row = job_row(spark, uri, job)
        serving = None if checks.serving is None else checks.serving(policy.table, arc)
        report = _compared(src, arc, within, serving, row, policy.key, src.columns, started)
        authorize_delete(row, report, int(time.time() * 1000), MAX_REPORT_AGE_MS).coalesce(1).write.mode("overwrite").parquet(f"{lake}/{job}-authorisation")
    allowed = spark.read.parquet(f"{lake}/{job}-authorisation")
    run_deletion(spark, Target(table, policy.key, src.columns, checks.children), arc, f"{lake}/{job}-deletion", job, allowed)
    return versions.current(spark, table)


def run_group_cycle(spark: SparkSession, tables: dict[str, str], keys: dict[str, str], lake: str, policy: Policy, fks: list[ForeignKey], as_of: datetime, cycle: int, checks: Checks) -> dict[str, int]:
    """run_cycle over a group of versioned tables: parents are archived first; all members are verified, compared and planned before any row is deleted, children first.

    One member that is not authorised keeps all. So does a parent to be deleted at which a child would still point that stays.
    """
    require_ready(checks.jobs, policy.name)
    started = int(time.time() * 1000)
    now = {t: versions.read_version(spark, p) for t, p in tables.items()}
    order = group_order(list(tables), fks)
    names = {t: f"{policy.name}-{t}-{cycle}" for t in order}
    require_same(spark, f"{lake}/{policy.name}-{cycle}-group.json", {"tables": tables, "as_of": as_of.isoformat()})
    uris = {t: f"{lake}/{names[t]}" for t in order}
    if not all(store.exists(spark, f"{u}/manifest") for u in uris.values()):
        picked = select_group(now, policy, fks, as_of)
        for t in order:
            if not store.exists(spark, f"{uris[t]}/manifest"):
                write_archive(assign_batches(picked[t], keys[t], policy.batch_size), uris[t], names[t], keys[t], now[t].columns)
    for t in order:
        if not verify_archive(spark, uris[t], keys[t]).isEmpty():
            raise ValueError(f"{names[t]}: the archive does not verify")
    arcs = {t: read_archive(spark, uris[t], verified=True) for t in order}
    full = [t for t in order if not arcs[t].isEmpty()]
    require_admitted(checks.admitted, policy.name)
    if full and not any(has_deleted(spark, tables[t], names[t]) for t in full):
        decisions = {t: cut(plan_delete(arcs[t], now[t], keys[t], now[t].columns)) for t in order}
        for t in order:
            gone = now[t].join(decisions[t].where("decision = 'delete'").select(keys[t]), keys[t], "left_semi")
            children = [(survivors(now[k.child], decisions[k.child], keys[k.child]), k) for k in fks if k.parent == t]
            if children and not blocked_parents(gone, children).isEmpty():
                raise PermissionError(f"{names[t]}: rows that stay point at rows to be deleted")
        rows, reports = None, None
        for t in full:
            # what belongs in the range is told by the parents as they are now, not by age alone
            mark = f"{own_prefix(now[t])}in"
            again = select_group(now, policy, fks, as_of)[t].select(F.col(keys[t]).alias(mark)).distinct()
            src = now[t].join(again, F.col(keys[t]) == F.col(mark), "left")
            row = job_row(spark, uris[t], names[t], policy.name)
            serving = None if checks.serving is None else checks.serving(t, arcs[t])
            report = _compared(src, arcs[t], F.col(mark).isNotNull(), serving, row, keys[t], now[t].columns, started)
            rows, reports = (row, report) if rows is None else (rows.unionByName(row), reports.unionByName(report))
        authorize_delete(rows, reports, int(time.time() * 1000), MAX_REPORT_AGE_MS).coalesce(1).write.mode("overwrite").parquet(f"{lake}/{policy.name}-{cycle}-authorisation")
    for t in reversed(order):
        if t in full:
            inner = [(lambda k=k: versions.read_version(spark, tables[k.child]), k) for k in fks if k.parent == t]
            outer = [c for c in checks.children if c[1].parent == t]
            target = Target(tables[t], keys[t], now[t].columns, [*inner, *outer])
            run_deletion(spark, target, arcs[t], f"{lake}/{names[t]}-deletion", names[t], spark.read.parquet(f"{lake}/{policy.name}-{cycle}-authorisation"))
    return {t: versions.current(spark, tables[t]) for t in order}
