"""Indexes of files, databases and key discovery."""

import random
from datetime import datetime, timedelta
from itertools import combinations
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from frostline.queries.values import DERBY
from frostline.sources import catalog, database, footers, index


def test_lookup_opens_only_files_that_may_hold_a_key(spark, tmp_path):
    data, top = str(tmp_path / "data"), str(tmp_path / "index")
    # zones overlap, so that filters must tell: even keys here, odd there; and a file of nulls
    for lo, step in ((0, 2), (1, 2), (5000, 1)):
        spark.range(lo, lo + 1000, step).select("id", F.concat(F.lit("v"), "id").alias("v")).coalesce(1).write.mode("append").parquet(data)
    spark.createDataFrame([(None, "n")], "id long, v string").coalesce(1).write.mode("append").parquet(data)
    index.build_index(spark, data, "id", top)
    keys = spark.createDataFrame([(4,), (6,), (6,), (None,), (10**9,)], "id long")
    found = index.candidates(spark, top, keys, "id")
    assert {r.id for r in found.collect()} >= {4, 6} and found.where("id > 1000").isEmpty()
    rows = index.lookup_indexed(spark, data, top, keys, "id", ["id", "v"])
    assert sorted(tuple(r) for r in rows.collect()) == [(4, "v4"), (6, "v6")]
    assert len(rows.inputFiles()) < 4 and len(list(Path(data).glob("*.parquet"))) == 4
    every = index.candidates(spark, top, spark.range(0, 6000), "id")
    true = spark.read.parquet(data).select("id", F.col("_metadata.file_path").alias("f"))
    assert every.select("id").distinct().count() >= 2000 - 1 and every.count() < 1.1 * true.where("id is not null").count()
    assert index.lookup_indexed(spark, data, top, keys.limit(0), "id", ["id"]).isEmpty()


def test_keys_meet_zones_over_tiles(spark):
    rng = random.Random(1)
    zones = [(f"f{i}", a, a + rng.randint(0, 60)) for i, a in ((i, rng.randint(0, 900)) for i in range(40))]
    keys = [rng.randint(-10, 1000) for _ in range(80)]
    want = sorted({(k, n) for k in keys for n, a, z in zones if a <= k <= z})
    z = spark.createDataFrame(zones + [("none", None, None)], "name string, low long, high long")
    got = index.within(spark.createDataFrame([(k,) for k in set(keys)], "k long"), "k", z, tile=4)
    assert sorted(tuple(r) for r in got.collect()) == want


@pytest.fixture(scope="module")
def derby(spark):
    url = "jdbc:derby:memory:sources;create=true"
    with database.Metadata(spark, url, driver=DERBY) as db:
        run = db.connection.createStatement().execute
        run("CREATE TABLE T (K BIGINT NOT NULL, V VARCHAR(20), A INT, B INT, CONSTRAINT T_KEY PRIMARY KEY (B, A, K))")
        run("CREATE TABLE EMPTY (K BIGINT)")
        run("CREATE UNIQUE INDEX BY_V ON T (V, K)")
    rows = [(k, f"v{k}", k % 7, k % 3) for k in [*range(900), *range(10**15, 10**15 + 90), -(10**12)]]
    spark.createDataFrame(rows, "K long, V string, A int, B int").coalesce(1).write.jdbc(url, "T", mode="append", properties={"driver": DERBY})
    return url, rows


def test_database_is_read_by_even_ranges(spark, derby):
    """Keys far apart with a hot range: partitions share the rows, whatever the keys' spread."""
    url, rows = derby
    cuts = database.key_ranges(spark, url, "T", "K", -(10**12), 10**15 + 89, 10, ranges=16, driver=DERBY)
    assert sum(n for *_, n in cuts) == 991 and max(n for *_, n in cuts) <= 200 and all(a[1] < b[0] for a, b in zip(cuts, cuts[1:]))
    got = database.scan_table(spark, url, "T", ["K", "V"], "K", partitions=10, driver=DERBY)
    assert sorted(tuple(r) for r in got.collect()) == sorted((k, v) for k, v, *_ in rows)
    assert got.rdd.getNumPartitions() >= 8
    assert database.scan_table(spark, url, "T", ["K"], "K", upper=500, partitions=4, driver=DERBY).agg(F.max("K")).first()[0] == 500
    assert database.scan_table(spark, url, "T", ["K"], "K", upper=-(10**13), driver=DERBY).isEmpty() and database.scan_table(spark, url, "EMPTY", ["K"], "K", driver=DERBY).isEmpty()
    plan = got.where("V = 'v5'")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "EqualTo(V,v5)" in plan.replace("*", "")


def test_database_tells_its_catalog(spark, derby):
    with database.Metadata(spark, derby[0], driver=DERBY) as db:
        assert db.tables("APP") == ["EMPTY", "T"]
        assert [tuple(r) for r in db.keys("APP").collect()] == [("APP", "T", ["B", "A", "K"])]
        own = {r.name: (r.unique, r.columns) for r in db.indexes("APP").collect()}
        assert own["BY_V"] == (True, ["V", "K"])
        assert {r.name: r.nullable for r in db.columns("APP").where("table = 'T'").collect()} == {"K": False, "V": True, "A": False, "B": False}


def test_least_keys(spark):
    rng = random.Random(3)
    for seed in range(4):
        rows = [(i, rng.randrange(40), rng.randrange(40), i % 30, None if i == 9 else i) for i in range(60 + seed)]
        df = spark.createDataFrame(rows, "a int, b int, c int, d int, e int")
        unique = lambda s: len({tuple(r["abcde".index(x)] for x in s) for r in rows}) == len(rows)  # noqa: B023, E731
        want, names = [], "abcd"  # e has a null
        for w in (1, 2, 3):
            want += [list(s) for s in combinations(names, w) if unique(s) and not any(set(k) <= set(s) for k in want)]
        assert catalog.minimal_keys(df, 3) == want
    assert catalog.minimal_keys(df.limit(0)) == [["a"], ["b"], ["c"], ["d"], ["e"]]


def test_assessment_has_the_files_sizes(spark):
    from frostline.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    got = {r.table: r.total_bytes for r in QUERIES["measured_assessment"](spark, sf).collect()}
    assert got == {t: Path(f"{sf}/{t}.parquet").stat().st_size for t in got} and len(got) == 14


def test_bounds_from_footers(spark, tmp_path):
    """Files sorted by time bound the eligible rows from both sides; null times never count, and a column without ranges is unknown."""
    path = str(tmp_path / "t")
    at = lambda lo: spark.range(lo, lo + 100).select("id", F.when(F.col("id") % 10 != 3, F.timestamp_seconds(F.col("id") * 86400).cast("timestamp_ntz")).alias("at"), F.array("id").alias("list"))
    for lo in (0, 100, 200):
        at(lo).coalesce(1).write.mode("append").parquet(path)
    at(0).select("id", F.lit(None).cast("timestamp_ntz").alias("at"), "list").coalesce(1).write.mode("append").parquet(path)
    groups = footers.row_groups(spark, path, "at")
    assert [(r.n_rows, r.nulls) for r in groups.orderBy("low").collect()] == [(100, 100), (100, 10), (100, 10), (100, 10)]
    for day, want in ((0, (0, 0)), (150, (90, 180)), (200, (180, 180)), (1000, (270, 270))):
        b = footers.eligible_bounds(groups, datetime(1970, 1, 1) + timedelta(days=day)).first()
        assert (b.at_least, b.at_most, b.unknown_rows, b.n_rows) == (*want, 0, 400)
    blind = groups.withColumns({"low": F.lit(None).cast("timestamp_ntz"), "high": F.lit(None).cast("timestamp_ntz"), "nulls": F.lit(None).cast("long")})
    b = footers.eligible_bounds(blind, datetime(1970, 5, 1)).first()
    assert (b.at_least, b.at_most, b.unknown_rows) == (0, 400, 400)


def test_sketches_merge(spark):
    df = spark.range(20_000).select("id", (F.col("id") % 700).cast("double").alias("x"), F.concat(F.lit("s"), F.col("id") % 50).alias("s"), F.when(F.col("id") % 4 == 0, F.col("id")).alias("n"))
    parts = [df.where(F.col("id") % 3 == k) for k in range(3)]
    profile = lambda d: catalog.column_sketches(d, ["id", "x", "s", "n"])
    merged = catalog.merge_sketches(profile(parts[0]).unionByName(profile(parts[1])).unionByName(profile(parts[2])).unionByName(profile(df.limit(0))))
    got = {r.name: r for r in catalog.sketch_estimates(merged, 0.25).collect()}
    assert {n: (r.n_rows, r.n_nulls) for n, r in got.items()} == {"id": (20_000, 0), "x": (20_000, 0), "s": (20_000, 0), "n": (20_000, 15_000)}
    assert abs(got["id"].n_values - 20_000) < 1000 and abs(got["x"].n_values - 700) < 20 and got["s"].n_values == 50 and got["s"].quantile is None
    assert abs(got["id"].quantile - 5000) < 600 and abs(got["x"].quantile - 175) < 21 and abs(got["n"].quantile - 5000) < 600
