"""Deletion as a journal of attempts: rounds of batches, each planned on the newest version of the table, deleted as the next version, and recorded; it may stop anywhere and be run again.

A round that was deleted but not recorded (a lost acknowledgement) is planned again: its rows are absent now, and since that is not the first attempt at their batches they count as uncertain. Attempts are counted for each batch,
since the next run may cut other rounds. In strict mode a changed row stops the run before its batch; what was deleted before stays recorded, and the next run begins with that batch.
"""

from __future__ import annotations

import json
import uuid
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frostline.operators.purge import blocked_parents, deletion_batches, plan_delete, plan_delete_live, require_allowed
from frostline.plans.lineage import cut
from frostline.plans.model import ForeignKey, Plan
from frostline.sources import store, versions

LEDGER = "job_id string, batch_seq long, attempts int, processed long, deleted long, absent long, deferred long, uncertain long"


class Stopped(RuntimeError):
    """A batch holds a row that differs from the archive; nothing from that batch on was deleted."""


@dataclass(frozen=True)
class Target:
    """A versioned table, its key and compared columns, and the tables (as functions that read them now) whose rows may point at it."""

    uri: str
    key: str
    columns: list[str]
    children: list[tuple[Callable[[], DataFrame], ForeignKey]]


def note_of(job_id: str, first: int | str) -> str:
    return f"{job_id} from batch {first}"


def has_deleted(spark: SparkSession, target_uri: str, job_id: str) -> bool:
    """Whether a version of the table was made by this job: its deletion has begun, and goes on under the authorisation that it began with."""
    return not versions.history(spark, target_uri).where(F.col("note").startswith(note_of(job_id, ""))).isEmpty()


def _records(spark: SparkSession, uri: str) -> list[dict]:
    return [json.loads(store.read_text(spark, f"{uri}/records/{n}")) for n in store.names(spark, f"{uri}/records")]


def ledger(spark: SparkSession, uri: str) -> DataFrame:
    """LEDGER rows of all recorded batches; the driver reads a small file per round."""
    rows = [r["rows"] for r in _records(spark, uri) if r["rows"]]
    return spark.read.schema(LEDGER).parquet(*rows) if rows else spark.createDataFrame([], LEDGER)


def _begun(spark: SparkSession, uri: str, known: dict[str, int | None]) -> list[tuple[int, int, int | None]]:
    """(first batch, number, last batch) of every attempt that was begun; files that known has are not read again. A journal written before attempts told their last batch has None."""
    for n in store.names(spark, f"{uri}/attempts"):
        if n not in known:
            known[n] = json.loads(store.read_text(spark, f"{uri}/attempts/{n}")).get("to")
    return [(*map(int, n.removesuffix(".json").split("-")), to) for n, to in known.items()]


def attempts(spark: SparkSession, uri: str) -> DataFrame:
    """(first_batch, attempt, last_batch) of every attempt to delete that was begun, after its round was planned and nothing forbade it."""
    return spark.createDataFrame(_begun(spark, uri, {}), "first_batch long, attempt int, last_batch long")


def _tries(begun: list[tuple[int, int, int | None]], first: int, to: int):
    """Which attempt at its batch this is, for batches from first to to: one more than the begun ones that reach it. One without a last batch may have reached any, unless it was recorded: the last from a batch that has been passed."""
    final = {b: k for b, k, _ in sorted(begun, key=lambda x: x[:2]) if b < first}
    reach = Counter((max(b, first), to if e is None else min(e, to)) for b, k, e in begun if e is not None or final.get(b) != k)
    return sum((F.col("batch_seq").between(a, z).cast("int") * n for (a, z), n in reach.items() if a <= z), F.lit(1))


def run_deletion(spark: SparkSession, target: Target, arc: DataFrame, uri: str, job_id: str, allowed: DataFrame, plan: Plan | None = None, batches: int = 10_000, at: Callable[[str], None] = lambda step: None) -> DataFrame:
    """Deletes the archived rows (arc, with batch_seq) from the target, so many batches to a round, and returns the ledger kept at uri.

    allowed is authorize_delete()'s frame. Strict unless a plan is given; with one, rows are decided one by one and those that changed, are too young or too wide now are deferred. A round is refused as long as a row that
    stays points at one of its rows. A version that came between planning and deleting (versions.Moved) or a crash leaves the round to the next call.
    """
    require_allowed(allowed, job_id)
    last = arc.agg(F.max("batch_seq")).first()[0] or 0
    first, known = max((r["to"] for r in _records(spark, uri)), default=0) + 1, {}
    while first <= last:
        part = arc.where(F.col("batch_seq").between(first, first + batches - 1))
        version = versions.current(spark, target.uri)
        src = versions.read_version(spark, target.uri, version)
        ends = part.agg(F.min(target.key), F.max(target.key)).first()
        near = src.where(F.col(target.key).between(*ends))
        decisions = cut(plan_delete(part, near, target.key, target.columns) if plan is None else plan_delete_live(part, near, target.key, target.columns, plan))
        keys = decisions.where("decision = 'delete'").select(target.key)
        if target.children and not blocked_parents(near.join(keys, target.key, "left_semi"), [(read(), fk) for read, fk in target.children]).isEmpty():
            raise PermissionError(f"{job_id}: rows that stay point at rows to be deleted")
        stop = decisions.where("decision = 'kept'").agg(F.min("batch_seq")).first()[0]
        to = min(first + batches - 1, last) if stop is None else stop - 1
        at("planned")
        begun = _begun(spark, uri, known)
        number = sum(b == first for b, *_ in begun) + 1
        while not store.create_once(spark, f"{uri}/attempts/{first:012d}-{number:06d}.json", json.dumps({"to": max(first, to)})):
            number += 1
        at("begun")
        versions.delete_keys(spark, target.uri, version, keys, target.key, note_of(job_id, first))
        at("deleted")
        if to >= first:
            tries = _tries(begun, first, to)
            rows = deletion_batches(decisions).withColumns({"job_id": F.lit(job_id), "attempts": tries, "uncertain": F.when(tries > 1, F.col("absent")).otherwise(0).cast("long")})
            where = f"{uri}/rows/{uuid.uuid4().hex}"
            rows.select(*(c.split()[0] for c in LEDGER.split(", "))).write.parquet(where)
            at("written")
            store.create_once(spark, f"{uri}/records/{first:012d}.json", json.dumps({"to": to, "rows": where}))
            at("recorded")
        if stop is not None:
            raise Stopped(f"{job_id}: batch {stop} differs from the archive")
        first = to + 1
    return ledger(spark, uri)
