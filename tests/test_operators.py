"""Truth tables on small rows."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from frostline.functions import codecs
from frostline.operators import purge, reconcile, reports, select
from frostline.plans import cycles
from frostline.plans.model import Column, ForeignKey, Plan, Policy, group_order
from frostline.sources import archive, export, versions
from frostline.streaming import transitions

NAN = float("nan")
AT = datetime(2000, 1, 1)


def test_exact_equality(spark):
    pairs = [(0.0, -0.0, False), (NAN, NAN, True), (None, None, True), (None, 0.0, False), (1.0, 1.0, True)]
    df = spark.createDataFrame(pairs, "a double, b double, want boolean")
    assert df.where(codecs.exact_equal(F.col("a"), F.col("b"), True) != F.col("want")).count() == 0
    text = spark.createDataFrame([("", None), ("1.0", "1.00")], "a string, b string")
    assert text.where(codecs.exact_equal(F.col("a"), F.col("b"))).count() == 0


def test_hex_and_keys(spark):
    df = spark.createDataFrame([("é\n\x00",), ("",)], "s string")
    back = df.select("s", F.decode(codecs.hex_decode(codecs.hex_encode(F.col("s"))), "UTF-8").alias("b"))
    assert back.where("s <> b").count() == 0
    keys = [0, 1, 2**63 - 1, 2**63, 2**64 - 1]
    k = spark.createDataFrame([(str(x),) for x in keys], "t string").select(F.col("t").cast("decimal(20,0)").alias("k"))
    tokens = [r.t for r in k.orderBy("k").select(codecs.key_token(F.col("k")).alias("t")).collect()]
    assert tokens == [x - 2**63 for x in keys]
    texts = spark.createDataFrame([("0", True), ("007", False), ("-1", False), (str(2**64 - 1), True), (str(2**64), False), ("x", False)], "t string, want boolean")
    assert texts.where(codecs.canonical_unsigned(F.col("t")) != F.col("want")).count() == 0


def test_types_are_refused(spark):
    df = spark.createDataFrame([("1",)], "a string")
    with pytest.raises(ValueError):
        codecs.to_archive_types(df, [Column("a", "int8[]")])
    typed = codecs.to_archive_types(df, [Column("a", "int8", False)])
    assert typed.schema["a"].metadata == {"native_type": "int8", "nullable": False}


def test_null_time_is_never_old(spark):
    rows = [(1, datetime(2000, 1, 1)), (2, None), (3, datetime(2001, 1, 1))]
    df = spark.createDataFrame(rows, "id long, at timestamp_ntz")
    plan = Plan.freeze(Policy("p", "t", "id", "at", 1), datetime(2001, 1, 2))
    assert [r.id for r in select.eligible(df, plan).collect()] == [1]


def test_batches_over_many_ranges(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7 % 5003).alias("k"))
    got = select.assign_batches(df, "k", 100, ranges=7).orderBy("k").collect()
    assert [r.row_no for r in got] == list(range(1, 5001)) and got[100].batch_seq == 2
    assert select.assign_batches(df.limit(0), "k").count() == 0


def test_group_order():
    fk = lambda c, p: ForeignKey(f"{c}{p}", c, ("x",), p, ("y",))
    assert group_order(["g", "c", "p"], [fk("g", "c"), fk("c", "p")]) == ["p", "c", "g"]
    for bad in ([fk("c", "p"), fk("p", "c")], [fk("c", "c")], [fk("x", "p")]):
        with pytest.raises(ValueError):
            group_order(["c", "p"], bad)
    with pytest.raises(ValueError):
        group_order(["c", "c"], [])


def test_children_of_any_parent_once(spark):
    a, b = spark.createDataFrame([(1,), (1,)], "k int"), spark.createDataFrame([(5, 6)], "x int, y int")
    child = spark.createDataFrame([(1, 5, 6), (1, 0, 6), (2, 5, 6), (None, 5, None), (3, 0, 0)], "k int, x int, y int")
    picked = select.select_children(child, [(a, ForeignKey("a", "c", ("k",), "a", ("k",))), (b, ForeignKey("b", "c", ("x", "y"), "b", ("x", "y")))])
    assert sorted((r.k, r.x) for r in picked.collect()) == [(1, 0), (1, 5), (2, 5)]


def test_strict_delete_stops_at_the_first_changed_batch(spark):
    arc = spark.createDataFrame([(1, 1, "a"), (2, 1, "b"), (3, 2, "c"), (4, 2, "d"), (5, 3, "e")], "id int, batch_seq int, v string")
    src = spark.createDataFrame([(1, "a"), (3, "c"), (4, "x"), (5, "e")], "id int, v string")
    got = {r.id: r.decision for r in purge.plan_delete(arc, src, "id", ["v"]).collect()}
    assert got == {1: "delete", 2: "absent", 3: "kept", 4: "kept", 5: "kept"}


def test_live_delete_by_row(spark):
    old, new = datetime(1999, 1, 1), datetime(2001, 1, 1)
    cols = "id int, at timestamp_ntz, v string"
    arc = spark.createDataFrame([(i, old, "v", 1) for i in range(1, 6)], cols + ", batch_seq int")
    src = spark.createDataFrame([(1, old, "v"), (2, old, "changed"), (3, new, "v"), (4, old, "v" * 5)], cols)
    plan = Plan.freeze(Policy("p", "t", "id", "at", 1), datetime(2000, 1, 1))
    got = {r.id: r.decision for r in purge.plan_delete_live(arc, src, "id", ["at", "v"], plan).collect()}
    assert got == {1: "delete", 2: "deferred", 3: "deferred", 4: "deferred", 5: "absent"}


def test_serving_copy(spark):
    arc = spark.createDataFrame([(1, "1.0"), (2, None), (3, "3"), (4, "4")], "id int, amount string")
    srv = spark.createDataFrame([(1, "1.00"), (2, None), (4, "4"), (4, "4"), (9, "9")], "id int, amount string")
    got = {r.id: r.status for r in reconcile.reconcile_serving(arc, srv, "id", ["amount"]).collect()}
    assert got == {1: "changed", 2: "match", 3: "missing", 4: "duplicate", 9: "extra"}
    assert reconcile.reconcile_serving(arc, srv.drop("amount"), "id", ["amount"]).where("status = 'columns'").count() == 4


def test_archive_notices_damage(spark, tmp_path):
    df = spark.range(0, 2500).select("id", F.concat(F.lit("v"), F.col("id").cast("string")).alias("v"))
    uri = str(tmp_path / "job")
    export.write_archive(select.assign_batches(df, "id"), uri, "j", "id", ["id", "v"])
    assert archive.verify_archive(spark, uri, "id").count() == 0
    with pytest.raises(Exception):
        export.write_archive(select.assign_batches(df, "id"), uri, "j", "id", ["id", "v"])
    with pytest.raises(ValueError):
        export.restore(spark, uri, "/x/t/", "/x/t")
    spark.createDataFrame([(1, 9999, "foreign")], "batch_seq long, id long, v string").write.mode("append").parquet(f"{uri}/data")
    rules = {r.rule for r in archive.verify_archive(spark, uri, "id").collect()}
    assert {"file_foreign", "batch_n_rows"} <= rules
    with pytest.raises(ValueError):
        archive.read_archive(spark, uri)


def test_resume_keeps_the_plan(spark):
    journal, objects = spark.createDataFrame([(1, "committed")], "batch_seq long, state string"), spark.createDataFrame([(1,)], "batch_seq long")
    with pytest.raises(ValueError):
        archive.resume_plan(journal, objects, {"cutoff": AT, "upper": 5}, {"cutoff": AT, "upper": 6})
    assert archive.resume_plan(journal, objects, {"cutoff": AT, "upper": 5}, {"cutoff": AT, "upper": 5}).first().action == "keep"


def test_native_values_refuse_what_json_lacks(spark):
    df = spark.createDataFrame([(1, 1.5), (2, None)], "id long, v double")
    assert [r[0] for r in df.select(codecs.native_value(df, ["id", "v"])).collect()] == ['{"id":1,"v":1.5}', '{"id":2,"v":null}']
    bad = spark.createDataFrame([(1, NAN)], "id long, v double")
    with pytest.raises(Exception):
        bad.select(codecs.native_value(bad, ["v"])).collect()


def test_group_keeps_parents_of_children_that_stay(spark, tmp_path):
    """A child of a new date stays, so its parent may not go, and no table of the group gets a new version."""
    old, late = datetime(1999, 1, 1), (12, 2, "late")
    parents = spark.createDataFrame([(1, old), (2, old)], "id long, at timestamp_ntz")
    children = [(10, 1, "a"), (11, 2, "b")]
    fk = ForeignKey("fk", "child", ("pid",), "parent", ("id",))
    policy = Policy("p", "parent", "id", "at", 1)
    jobs = spark.createDataFrame([], "policy string, status string, deleted boolean, imported boolean")
    checks = cycles.Checks(jobs, lambda table, arc: arc.drop("batch_seq"), None, [])
    real = cycles.plan_delete

    def plan(arc, src, key, columns):  # a child that came after the group was selected
        decisions = real(arc, src, key, columns)
        return decisions.where("cid <> 11") if key == "cid" else decisions

    for name, rows, planned in (("good", children, real), ("bad", [*children, late], plan)):
        tables = {t: str(tmp_path / name / t) for t in ("parent", "child")}
        for t, df in (("parent", parents), ("child", spark.createDataFrame(rows, "cid long, pid long, v string"))):
            df.write.parquet(str(tmp_path / name / f"{t}-files"))
            versions.adopt(spark, tables[t], str(tmp_path / name / f"{t}-files"))
        cycles.plan_delete = planned
        run = lambda: cycles.run_group_cycle(spark, tables, {"parent": "id", "child": "cid"}, str(tmp_path / name), policy, [fk], datetime(2000, 1, 1), 1, checks)  # noqa: B023, E731
        try:
            if name == "good":
                assert run() == {"parent": 2, "child": 2} and all(versions.read_version(spark, u).isEmpty() for u in tables.values())
            else:
                with pytest.raises(PermissionError):
                    run()
                assert all(versions.current(spark, u) == 1 for u in tables.values())
        finally:
            cycles.plan_delete = real


def test_admission(spark):
    policy = {"window": None, "max_age_ms": 100, "limits": {"cpu": 50.0}, "min_delay_ms": 0, "max_delay_ms": 1000}
    samples = spark.createDataFrame([("a", 1000, 25.0), ("a", 2000, 50.0), ("a", 3000, None)], "source string, ts long, cpu double")
    checks = spark.createDataFrame([("a", t) for t in (500, 1000, 1101, 2050, 3000)] + [("b", 1000)], "source string, ts long")
    got = {(r.source, r.ts): (r.reason, r.delay_ms) for r in reports.admission(checks, samples, policy).collect()}
    assert got[("a", 1000)] == ("admitted", 250)
    assert got[("a", 500)][0] == got[("b", 1000)][0] == "sample_missing"
    assert got[("a", 1101)][0] == "sample_age"
    assert got[("a", 2050)][0] == "metric_limit" and got[("a", 3000)][0] == "metric_missing"


def test_admission_over_buckets(spark, monkeypatch):
    """The as-of sample is the same whatever the time that makes a group, for a busy source, ties and a null source."""
    rows = [(s, t * 37 % 5000, float(t % 60)) for t in range(400) for s in ("busy", None)] + [("busy", 100, 3.0), ("busy", 100, 4.0)]
    samples = spark.createDataFrame(rows, "source string, ts long, cpu double")
    checks = spark.createDataFrame([(s, t) for t in range(0, 6000, 50) for s in ("busy", None, "other")], "source string, ts long")
    policy = {"window": None, "max_age_ms": 900, "limits": {"cpu": 50.0}, "min_delay_ms": 0, "max_delay_ms": 1000}
    got = []
    for ms in (10, 1000, 10**9):
        monkeypatch.setattr(reports, "BUCKET_MS", ms)
        got.append(sorted(map(str, reports.admission(checks, samples, policy).collect())))
    assert got[0] == got[1] == got[2] and len(got[0]) == 360


def test_chunks(spark):
    rows = [(1, i, "x" * n) for i, n in enumerate([10, 100_000, 100_000, 10])]
    got = reports.pack_chunks(spark.createDataFrame(rows, "batch_seq long, id long, v string"), "id", ["v"]).orderBy("key").collect()
    assert [r.chunk for r in got] == [1, 1, 2, 2]


def test_stream_ignores_replays(spark, tmp_path):
    rows = [(1, "job", "a", False), (2, "job", "a", True), (2, "job", "a", True), (3, "job", "a", True), (4, "job", "a", False), (1, "job", "b", True)]
    df = spark.createDataFrame(rows, "seq long, kind string, entity string, failed boolean")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = transitions.transitions_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
    q.trigger(availableNow=True).start().awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("job", "a", 2, "firing"), ("job", "a", 4, "resolved"), ("job", "b", 1, "firing")]


def test_sequence_gaps_over_ranges(spark):
    far = (1 << 20) + 5
    df = spark.createDataFrame([(s,) for s in (3, 4, 7, far)], "seq long")
    got = sorted(tuple(r) for r in transitions.sequence_gaps(df, 1).collect())
    assert got == [(2, 2), (5, 6), (8, far - 1)]
    with pytest.raises(ValueError):
        transitions.sequence_gaps(df, far + 1)
