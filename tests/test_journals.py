"""Exports, restores, deletions and versions that are stopped at every step, and copies that are damaged or raced."""

import random
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from frostline.operators import purge, reconcile, select
from frostline.plans import deletion
from frostline.plans.model import ForeignKey, Plan, Policy
from frostline.sources import archive, digests, export, store, versions

POLICY = Policy("p", "t", "id", "at", 1, batch_size=10)
PLAN = Plan.freeze(POLICY, datetime(2000, 1, 1))


class Crash(RuntimeError):
    pass


def crash_after(n: int, seen: list):
    """Fails at the n-th step of all."""

    def at(step: str) -> None:
        seen.append(step)
        if len(seen) == n:
            raise Crash(step)

    return at


@pytest.fixture(scope="module")
def source(spark):
    return spark.range(0, 95, 1, 3).select("id", F.when(F.col("id") % 9 == 0, "2001-01-01").otherwise("1999-01-01").cast("timestamp_ntz").alias("at"), F.concat(F.lit("v"), "id").alias("v"))


def contents(spark, uri: str) -> list:
    return sorted(tuple(r) for r in archive.read_archive(spark, uri, verified=True).collect())


def test_export_crashes_at_every_step(spark, source, tmp_path):
    """Wherever it is stopped, the next call ends with the same batches and digests, and no file is there twice."""
    whole, seen = str(tmp_path / "whole"), []
    assert export.export(source, PLAN, whole, "j", ["id", "at", "v"], round_rows=60, at=lambda s: seen.append(s)) == "finished"
    batches = lambda u: sorted(tuple(r) for r in archive.read_manifest(spark, u).where("batch_seq is not null").select("batch_seq", "n_rows", "first_key", "last_key", "digest").collect())
    want, rows = batches(whole), contents(spark, whole)
    assert len(rows) == 84 and {"planned", "staged", "prepared", "moved", "published", "committed", "ranges", "manifest"} <= set(seen)
    firsts = {s: seen.index(s) + 1 for s in seen}  # each kind of step once, and some in later rounds
    for n in sorted({*firsts.values(), seen.index("committed") + 3}):
        uri = str(tmp_path / f"n{n}")
        with pytest.raises(Crash):
            export.export(source, PLAN, uri, "j", ["id", "at", "v"], round_rows=60, at=crash_after(n, []))
        if seen[n - 1] not in ("manifest",):
            with pytest.raises(FileNotFoundError):
                archive.read_archive(spark, uri)
        assert export.export(source, PLAN, uri, "j", ["id", "at", "v"], round_rows=60) == "finished"
        assert batches(uri) == want and contents(spark, uri) == rows
    assert archive.verify_archive(spark, uri, "id").isEmpty()
    # the frozen plan is the job's: rows that came over the upper key later are not in it, and another cutoff is refused
    more = source.unionByName(spark.createDataFrame([(1000, datetime(1990, 1, 1), "x")], source.schema))
    assert export.export(more, PLAN, whole, "j", ["id", "at", "v"], round_rows=60) == "finished" and contents(spark, whole) == rows
    with pytest.raises(ValueError):
        export.export(source, Plan.freeze(POLICY, datetime(2000, 1, 2)), whole, "j", ["id", "at", "v"])


def test_rounds_and_budget(spark, source, tmp_path):
    uri = str(tmp_path / "u")
    states = []
    while export.export(source, PLAN, uri, "j", ["id", "at", "v"], max_rounds=1, round_rows=30) == "unfinished":
        states.append(export.journal(spark, uri).where("state = 'committed'").count())
    assert len(states) >= 2 and states == sorted(set(states))
    got = [r.batch_seq for r in archive.read_manifest(spark, uri).where("batch_seq is not null").orderBy("batch_seq").collect()]
    assert got == list(range(1, len(got) + 1))
    none = str(tmp_path / "none")
    assert export.export(source.limit(0), PLAN, none, "j", ["id", "at", "v"]) == "finished" and archive.read_archive(spark, none).isEmpty() and archive.verify_archive(spark, none, "id").isEmpty()


def test_publishing_refuses_another_file(spark, source, tmp_path):
    uri = str(tmp_path / "u")
    with pytest.raises(Crash):
        export.export(source, PLAN, uri, "j", ["id", "at", "v"], at=crash_after(3, []))  # prepared
    staged = next(Path(tmp_path / "u" / "staging").glob("000001-*/data/*.parquet"))
    store.create_once(spark, f"{uri}/data/000001-{staged.name}", "something else")
    with pytest.raises(FileExistsError):
        export.export(source, PLAN, uri, "j", ["id", "at", "v"])
    assert staged.exists()


def test_wide_rows_are_archived(spark, tmp_path):
    """Rows of a megabyte make files of few rows, not a refusal."""
    df = spark.range(12).select("id", F.repeat(F.sha2(F.col("id").cast("string"), 256), 16_000).alias("v"))
    uri = str(tmp_path / "u")
    folder = f"{uri}-staged"
    export.stage(select.assign_batches(df, "id"), folder, "id", ["id", "v"], file_bytes=3_000_000)
    assert digests.file_fingerprints(spark.read.parquet(f"{folder}/ranges")).count() >= 4
    export.write_archive(select.assign_batches(df, "id"), uri, "j", "id", ["id", "v"])
    assert archive.verify_archive(spark, uri, "id").isEmpty() and archive.read_archive(spark, uri).count() == 12


def test_restore_crashes_at_every_step(spark, source, tmp_path):
    uri = str(tmp_path / "arc")
    export.export(source, PLAN, uri, "j", ["id", "at", "v"])
    rows = sorted((r.id, r.v) for r in archive.read_archive(spark, uri).collect())
    for n in (1, 2, 3, 6):
        target = str(tmp_path / f"t{n}")
        with pytest.raises(Crash):
            export.restore(spark, uri, target, batches=3, at=crash_after(n, []))
        with pytest.raises(FileNotFoundError):
            export.restored(spark, target)
        assert export.restore(spark, uri, target, batches=3) == "restored"
        assert sorted((r.id, r.v) for r in export.restored(spark, target).collect()) == rows
        assert export.restore(spark, uri, target, batches=3) == "same"
    other = str(tmp_path / "arc2")
    export.export(source.where("id < 50"), PLAN, other, "j", ["id", "at", "v"])
    foreign = str(tmp_path / "foreign")
    source.write.parquet(foreign)
    for u, t in ((other, str(tmp_path / "t1")), (uri, foreign)):
        with pytest.raises(FileExistsError):
            export.restore(spark, u, t)


def lake_of(spark, source, top: str):
    source.write.parquet(f"{top}-files")
    versions.adopt(spark, f"{top}-t", f"{top}-files")
    arc = select.assign_batches(select.eligible(source, PLAN), "id", 10).drop("row_no")
    return deletion.Target(f"{top}-t", "id", ["id", "at", "v"], []), arc, spark.createDataFrame([("j", True), ("no", False)], "job_id string, allowed boolean")


@pytest.mark.parametrize("step", ["planned", "begun", "deleted", "written", "recorded"])
def test_deletion_is_replayed(spark, source, tmp_path, step):
    """Stopped after any step of its second round, it ends with all rows gone once and the absences of a lost acknowledgement uncertain."""
    target, arc, allowed = lake_of(spark, source, str(tmp_path / "a"))
    n = [0]

    def at(now: str) -> None:
        n[0] += now == step
        if now == step and n[0] == 2:
            raise Crash(step)

    uri = str(tmp_path / "ledger")
    with pytest.raises(Crash):
        deletion.run_deletion(spark, target, arc, uri, "j", allowed, batches=3, at=at)
    rows = deletion.run_deletion(spark, target, arc, uri, "j", allowed, batches=3).collect()
    assert sorted(r.batch_seq for r in rows) == list(range(1, 10)) and sum(r.processed for r in rows) == 84
    lost = {r.batch_seq: r for r in rows if r.uncertain}
    assert set(lost) == ({4, 5, 6} if step in ("deleted", "written") else set())
    assert sum(r.deleted for r in rows) == 84 - sum(r.absent for r in rows) and all(r.uncertain == r.absent == 10 for r in lost.values())
    assert {r.batch_seq for r in rows if r.attempts == 2} == ({4, 5, 6} if step in ("begun", "deleted", "written") else set())
    left = versions.read_version(spark, target.uri)
    assert left.count() == 11 and left.where("at < '2000-01-01'").isEmpty()


@pytest.mark.parametrize(("before", "after"), [(3, 6), (6, 2), (None, 3)])
def test_attempts_are_counted_by_batch(spark, source, tmp_path, before, after):
    """A run that loses an acknowledgement goes on in rounds of another size: only batches that it may have deleted are tried twice, and all of those. A journal that does not tell (None) may mean any."""
    target, arc, allowed = lake_of(spark, source, str(tmp_path / "a"))
    uri, gone = str(tmp_path / "ledger"), arc.where("batch_seq in (2, 5, 8)").groupBy("batch_seq").agg(F.min("id").alias("id"))
    versions.delete_keys(spark, target.uri, 1, gone, "id")

    def at(now: str) -> None:
        if now == "deleted":
            raise Crash(now)

    if before:
        with pytest.raises(Crash):
            deletion.run_deletion(spark, target, arc, uri, "j", allowed, batches=before, at=at)
    else:
        store.create_once(spark, f"{uri}/attempts/{1:012d}-{1:06d}.json", "{}")
    got = {r.batch_seq: r for r in deletion.run_deletion(spark, target, arc, uri, "j", allowed, batches=after).collect()}
    absent = lambda b: (10 if b < 9 else 4) if before and b <= before else int(b in (2, 5, 8))
    twice = range(1, (before or 9) + 1)
    want = {b: (2, absent(b), absent(b)) if b in twice else (1, absent(b), 0) for b in range(1, 10)}
    assert {b: (r.attempts, r.absent, r.uncertain) for b, r in got.items()} == want


def test_attempts_of_older_journals(spark):
    """Of attempts that do not tell their last batch, those that were recorded reach no later batch, all others any."""
    begun = [(1, 1, None), (4, 1, None), (4, 2, None), (7, 1, 8), (7, 2, None)]
    got = spark.range(7, 10).select(F.col("id").alias("batch_seq")).select(deletion._tries(begun, 7, 9)).collect()
    assert [r[0] for r in got] == [4, 4, 3]
    assert [r[0] for r in spark.range(10, 12).select(F.col("id").alias("batch_seq")).select(deletion._tries(begun, 10, 11)).collect()] == [2, 2]


def test_deletion_stops_and_refuses(spark, source, tmp_path):
    target, arc, allowed = lake_of(spark, source.withColumn("v", F.when(F.col("id") == 40, "other").otherwise(F.col("v"))), str(tmp_path / "a"))
    arc = arc.withColumn("v", F.concat(F.lit("v"), "id"))
    uri = str(tmp_path / "ledger")
    for job in ("no", "unknown"):
        with pytest.raises(PermissionError):
            deletion.run_deletion(spark, target, arc, uri, job, allowed)
    with pytest.raises(deletion.Stopped):
        deletion.run_deletion(spark, target, arc, uri, "j", allowed, batches=3)
    stop = arc.where("id = 40").first().batch_seq
    assert sorted(r.batch_seq for r in deletion.ledger(spark, uri).collect()) == list(range(1, stop))
    children = spark.createDataFrame([(94,)], "parent long")
    guarded = deletion.Target(target.uri, "id", ["id", "at", "v"], [(lambda: children, ForeignKey("f", "c", ("parent",), "t", ("id",)))])
    with pytest.raises(PermissionError, match="point at"):
        deletion.run_deletion(spark, guarded, arc.where("batch_seq = 9").withColumn("batch_seq", F.lit(1).cast("long")), f"{uri}-2", "j", allowed)
    deferred = deletion.run_deletion(spark, target, arc, f"{uri}-3", "j", allowed, plan=PLAN)
    assert deferred.agg(F.sum("deferred")).first()[0] == 1


def test_versions(spark, source, tmp_path):
    """Untouched files go on by name, old versions stay, a lost race changes nothing."""
    files, uri = str(tmp_path / "f i+les"), str(tmp_path / "t")
    for lo in (0, 30, 60):
        source.where(F.col("id").between(lo, lo + 29)).coalesce(1).write.mode("append").parquet(files)
    assert versions.adopt(spark, uri, files) == 1
    with pytest.raises(versions.Moved):
        versions.adopt(spark, uri, files)
    keys = spark.createDataFrame([(5,), (6,), (None,), (5,)] + [(i,) for i in range(30, 60)], "id long")
    assert versions.delete_keys(spark, uri, 1, keys, "id") == 2
    fates = {r.fate: r.n for r in versions.fates(spark, uri, 1, 2).groupBy("fate").agg(F.count("*").alias("n")).collect()}
    assert fates == {"kept": 1, "gone": 2, "new": 1}
    assert versions.read_version(spark, uri).count() == 58 and versions.read_version(spark, uri, 1).count() == 90
    for planned in (1, 3):
        with pytest.raises(versions.Moved):
            versions.delete_keys(spark, uri, planned, spark.range(3), "id")
    assert versions.delete_keys(spark, uri, 2, spark.range(500, 510), "id") == 2 == versions.current(spark, uri)
    # two that planned on the same version: the second to commit is told, though it saw nothing newer when it began
    real, first = versions._listed, []

    def racing(*args):
        if not first:
            first.append(True)
            assert versions.delete_keys(spark, uri, 2, spark.range(80, 82), "id") == 3
        return real(*args)

    versions._listed = racing
    try:
        with pytest.raises(versions.Moved):
            versions.delete_keys(spark, uri, 2, spark.range(70, 72), "id")
    finally:
        versions._listed = real
    assert versions.read_version(spark, uri).where("id in (70, 71)").count() == 2
    assert versions.delete_keys(spark, uri, 3, spark.range(1000), "id") == 4 and versions.read_version(spark, uri).isEmpty()
    assert [r.version for r in versions.history(spark, uri).orderBy("version").collect()] == [1, 2, 3, 4]


def test_damage_is_found_by_range(spark, tmp_path, monkeypatch):
    """One flipped byte is told by its range; the digest does not depend on who read what."""
    monkeypatch.setattr(digests.range_digests, "__defaults__", (1000,))
    monkeypatch.setattr(digests.differing_ranges, "__defaults__", (1000,))
    uri = str(tmp_path / "u")
    df = spark.range(3000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("v"))
    export.write_archive(select.assign_batches(df, "id"), uri, "j", "id", ["id", "v"])
    assert archive.damaged_ranges(spark, uri).isEmpty() and archive.file_violations(spark, uri).isEmpty()
    file = max(Path(tmp_path / "u" / "data").glob("*.parquet"), key=lambda p: p.stat().st_size)
    data = bytearray(file.read_bytes())
    data[4321] ^= 1
    file.write_bytes(bytes(data))
    for crc in Path(tmp_path / "u" / "data").glob(".*.crc"):
        crc.unlink()
    assert [(r.name, r.range_no, r.first_byte, r.what) for r in archive.damaged_ranges(spark, uri).collect()] == [(file.name, 4, 4000, "changed")]
    assert [(r.rule, r.entity) for r in archive.file_violations(spark, uri).collect()] == [("file_digest", file.name)]
    file.write_bytes(bytes(data[:2500]))
    assert {r.what for r in archive.damaged_ranges(spark, uri).collect()} == {"changed", "missing"}


@pytest.mark.parametrize("fan", [2, 7, 4096])
def test_tree_comparison_is_the_full_one(spark, fan):
    rng = random.Random(fan)
    arc = [(i * 3, float(i), None if i % 5 == 0 else str(i), i // 10 + 1) for i in range(200)]
    src = [(k, -0.0 if k == 0 else v, s) for k, v, s, _ in arc if rng.random() > 0.05]
    src = [(k, v, "" if s is None and rng.random() < 0.1 else s) for k, v, s in src] + [(1, 1.0, "extra"), (-50, 1.0, "below"), (10**6, 2.0, "over")]
    a, s = spark.createDataFrame(arc, "k long, v double, s string, batch_seq long"), spark.createDataFrame(src, "k long, v double, s string")
    for key in (F.col("k"), F.col("k").cast("string")):
        x, y = s.withColumn("k", key), a.withColumn("k", key)
        rows = lambda df: sorted(map(str, df.collect()))
        assert rows(digests.reconcile_by_tree(x, y, "k", ["v", "s"], fan)) == rows(reconcile.reconcile(x, y, "k", ["v", "s"]).where("status <> 'match'"))
        assert digests.reconcile_by_tree(y.drop("batch_seq"), y, "k", ["v", "s"], fan).isEmpty()
    assert digests.reconcile_by_tree(s, a.limit(0), "k", ["v", "s"], fan).count() == len(src)


def test_equal_copies_shuffle_no_rows(spark):
    """Equal copies are compared by sums alone: the plan of the sums has no exchange of rows, only of ranges."""
    df = spark.range(1000).withColumn("v", F.col("id") * 2)
    plan = digests.range_sums(df, "id", ["v"], digests.key_bucket(df, "id", 0, 10, 100))._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_count") > plan.index("Exchange hashpartitioning(bucket")


def test_gate_knows_what_it_has_seen(spark):
    """Extras, batches, and a serving copy that is missing or was not asked."""
    arc = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id long, v string, batch_seq long")
    job = spark.createDataFrame([("j", None, 2, 2, "d")], "job_id string, group_id string, n_rows long, n_batches long, digest string")
    src = arc.drop("batch_seq")
    old = F.col("id") < 10

    def outcome(source, serving, told=job, looked=arc):
        checked = reconcile.reconcile(source, looked, "id", ["v"], within=old)
        report = reconcile.copies_report(checked, None if serving is None else reconcile.reconcile_serving(looked, serving, "id", ["v"]), told, 10, 20)
        allowed = reconcile.authorize_delete(told, report, 30, 100).first().allowed
        return report.first().status, allowed

    assert outcome(src, src) == ("passed", True)
    assert outcome(src, None) == ("not_checked", False)
    assert outcome(src.unionByName(spark.createDataFrame([(3, "late")], src.schema)), src) == ("mismatch", False)
    assert outcome(src.unionByName(spark.createDataFrame([(30, "young")], src.schema)), src) == ("passed", True)
    assert outcome(src, src.where("id = 1")) == ("mismatch", False) and outcome(src, src.withColumn("w", F.lit(1))) == ("mismatch", False)
    assert outcome(src.where("id = 1"), src.where("id = 1"), looked=arc.where("id = 1")) == ("incomplete", False)
    assert purge.require_allowed(spark.createDataFrame([("j", True)], "job_id string, allowed boolean"), "j") is None
