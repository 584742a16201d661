"""Comparing copies, planning deletes, and the books of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frostline.operators import gates, purge, reconcile
from frostline.plans.lineage import cut
from frostline.queries.common import (
    ARC_SQL, COLUMNS, CUT, NOW_SQL, PLAN, SAME_SQL, SERVING_SQL, archived_orders, current_orders, query, scratch, serving_orders, table,
)
from frostline.sources import digests

RECONCILED = f"""rec AS (SELECT coalesce(a.o_orderkey, s.o_orderkey) AS o_orderkey, a.batch_seq, CASE WHEN s.o_orderkey IS NULL THEN 'missing_in_source'
  WHEN a.o_orderkey IS NULL THEN 'extra_in_source' WHEN {SAME_SQL} THEN 'match' ELSE 'changed' END AS status FROM arc a FULL JOIN
  (SELECT * FROM src WHERE o_orderkey <= (SELECT max(o_orderkey) FROM arc)) s ON a.o_orderkey = s.o_orderkey)"""
SERVED = f"""cnt AS (SELECT o_orderkey, count(*) AS n, any_value(o_custkey) AS o_custkey, any_value(o_orderstatus) AS o_orderstatus, any_value(o_totalprice) AS o_totalprice,
  any_value(o_orderdate) AS o_orderdate FROM srv GROUP BY o_orderkey),
ser AS (SELECT coalesce(a.o_orderkey, s.o_orderkey) AS o_orderkey, CASE WHEN n > 1 THEN 'duplicate' WHEN s.o_orderkey IS NULL THEN 'missing' WHEN a.o_orderkey IS NULL THEN 'extra'
  WHEN {SAME_SQL} THEN 'match' ELSE 'changed' END AS status FROM arc a FULL JOIN cnt s ON a.o_orderkey = s.o_orderkey)"""
STRICT = f"""st AS (SELECT a.o_orderkey, a.batch_seq, CASE WHEN s.o_orderkey IS NULL THEN 'absent' WHEN {SAME_SQL} THEN 'delete' ELSE 'changed' END AS state
  FROM arc a LEFT JOIN late s ON a.o_orderkey = s.o_orderkey),
dec AS (SELECT o_orderkey, batch_seq, CASE WHEN batch_seq >= (SELECT min(batch_seq) FROM st WHERE state = 'changed') THEN 'kept' ELSE state END AS decision FROM st)"""
LATE = "late AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice + CASE WHEN o_orderkey % 2003 = 2002 THEN 1.0 ELSE 0.0 END AS o_totalprice, o_orderdate FROM orders WHERE o_orderkey % 11 <> 0)"
LIVE = f"""dec AS (SELECT a.o_orderkey, a.batch_seq, CASE WHEN s.o_orderkey IS NULL THEN 'absent' WHEN {SAME_SQL} AND s.o_orderdate < {CUT} THEN 'delete' ELSE 'deferred' END AS decision
  FROM arc a LEFT JOIN src s ON a.o_orderkey = s.o_orderkey)"""


def reconciled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    arc = archived_orders(spark, sf_dir)
    upper = arc.agg(F.max("o_orderkey")).first()[0]
    return arc, reconcile.reconcile(current_orders(spark, sf_dir), arc, "o_orderkey", COLUMNS, upper)


@query(f"WITH {ARC_SQL}, {NOW_SQL}, {RECONCILED} SELECT * FROM rec")
def reconcile_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconciled(spark, sf_dir)[1]


@query(f"WITH {ARC_SQL}, {SERVING_SQL}, {SERVED} SELECT * FROM ser")
def reconcile_serving(spark: SparkSession, sf_dir: str) -> DataFrame:
    arc = archived_orders(spark, sf_dir)
    return reconcile.reconcile_serving(arc, serving_orders(arc), "o_orderkey", COLUMNS)


@query(f"""WITH {ARC_SQL}, {NOW_SQL}, {RECONCILED}, {SERVING_SQL}, {SERVED}, n AS (SELECT count(*) AS n_rows, max(batch_seq) AS n_batches FROM arc)
SELECT 'changed' AS trial, count(*) FILTER (status <> 'extra_in_source') AS n_rows, count(DISTINCT CASE WHEN status <> 'extra_in_source' THEN batch_seq END) AS n_batches,
  count(DISTINCT CASE WHEN status IN ('changed', 'missing_in_source') THEN batch_seq END) + CASE WHEN count(*) FILTER (status = 'extra_in_source') > 0 THEN 1 ELSE 0 END AS source_mismatches,
  (SELECT count(*) FROM ser WHERE status <> 'match') AS serving_mismatches,
  CASE WHEN (SELECT count(*) FROM rec WHERE status <> 'match') + (SELECT count(*) FROM ser WHERE status <> 'match') > 0 THEN 'mismatch' ELSE 'passed' END AS status FROM rec
UNION ALL SELECT 'same', n_rows, n_batches, 0, 0, 'passed' FROM n UNION ALL SELECT 'short', n_rows, n_batches, 0, 0, CASE WHEN n_batches < n_batches + 1 THEN 'incomplete' END FROM n""")
def shadow_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three trials: source and serving as they are now, both as they were exported, and the latter with a batch that never came."""
    arc, source = reconciled(spark, sf_dir)
    arc = cut(arc)
    served = lambda s: reconcile.reconcile_serving(arc, s, "o_orderkey", COLUMNS)
    n = arc.agg(F.max("batch_seq")).first()[0]
    own = arc.select("o_orderkey", *COLUMNS)
    exported = reconcile.reconcile(table(spark, sf_dir, "orders").join(arc.select("o_orderkey"), "o_orderkey", "left_semi"), arc, "o_orderkey", COLUMNS)
    trials = [("changed", source, served(serving_orders(arc)), n), ("same", exported, served(own), n), ("short", exported, served(own), n + 1)]
    out = None
    for name, src, srv, expected in trials:
        one = reconcile.shadow_report(src, srv, arc, expected)
        one = one.select(F.lit(name).alias("trial"), *(F.col(c).cast("long").alias(c) for c in one.columns[:-1]), "status")
        out = one if out is None else out.unionByName(one)
    return out


def late_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few changed rows, the first of them not in the first batch."""
    k = F.col("o_orderkey")
    price = F.col("o_totalprice") + F.when(k % 2003 == 2002, 1.0).otherwise(0.0)
    return table(spark, sf_dir, "orders").where(k % 11 != 0).select("o_orderkey", "o_custkey", "o_orderstatus", price.alias("o_totalprice"), "o_orderdate")


@query(f"WITH {ARC_SQL}, {LATE}, {STRICT} SELECT * FROM dec")
def delete_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return purge.plan_delete(archived_orders(spark, sf_dir), late_orders(spark, sf_dir), "o_orderkey", COLUMNS)


@query(f"WITH {ARC_SQL}, {NOW_SQL}, {LIVE} SELECT * FROM dec")
def delete_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return purge.plan_delete_live(archived_orders(spark, sf_dir), current_orders(spark, sf_dir), "o_orderkey", COLUMNS, PLAN)


@query(f"""WITH {ARC_SQL}, {NOW_SQL}, {LIVE} SELECT batch_seq, count(*) AS processed, count(*) FILTER (decision = 'delete') AS deleted, count(*) FILTER (decision = 'absent') AS absent,
  count(*) FILTER (decision = 'deferred') AS deferred FROM dec GROUP BY batch_seq""")
def deletion_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return purge.deletion_batches(delete_live(spark, sf_dir))


BATCHES = """led AS (SELECT 'job-' || batch_seq % 3 AS job_id, *, batch_seq % 2 + 1 AS attempts FROM (SELECT batch_seq, count(*) AS processed, count(*) FILTER (decision = 'delete') AS deleted,
  count(*) FILTER (decision = 'absent') AS absent, count(*) FILTER (decision = 'deferred') AS deferred FROM dec GROUP BY batch_seq))"""


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deletion_ledger(spark, sf_dir).select(F.concat(F.lit("job-"), (F.col("batch_seq") % 3).cast("string")).alias("job_id"), "*", (F.col("batch_seq") % 2 + 1).alias("attempts"))


@query(f"""WITH {ARC_SQL}, {NOW_SQL}, {LIVE}, {BATCHES}, jobs AS (SELECT job_id, count(*) + CASE WHEN job_id = 'job-1' THEN 1 ELSE 0 END AS n_batches FROM led GROUP BY job_id)
SELECT job_id, CAST(sum(processed) AS BIGINT) AS processed, CAST(sum(deleted) AS BIGINT) AS deleted, CAST(sum(absent) AS BIGINT) AS absent, CAST(sum(deferred) AS BIGINT) AS deferred,
  CAST(sum(CASE WHEN attempts > 1 THEN absent ELSE 0 END) AS BIGINT) AS uncertain, count(DISTINCT batch_seq) = any_value(n_batches) AS complete FROM led JOIN jobs USING (job_id) GROUP BY job_id""")
def deletion_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    batches = ledger(spark, sf_dir)
    jobs = batches.groupBy("job_id").agg((F.count("*") + F.when(F.col("job_id") == "job-1", 1).otherwise(0)).alias("n_batches"))
    return purge.deletion_progress(batches, jobs)


@query(f"""WITH {ARC_SQL}, {NOW_SQL}, {LIVE}, {BATCHES} SELECT CASE WHEN batch_seq % 4 = 0 THEN 'balance' ELSE 'uncertain' END AS rule, job_id || '/' || batch_seq AS entity,
  CAST(processed AS VARCHAR) AS detail FROM led WHERE batch_seq % 4 = 0 OR batch_seq % 5 = 0""")
def ledger_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = ledger(spark, sf_dir)
    wrong = b.withColumn("deleted", F.col("deleted") + F.when(F.col("batch_seq") % 4 == 0, 1).otherwise(0)).withColumn(
        "uncertain", F.when(F.col("batch_seq") % 5 == 0, F.col("absent") + 1).otherwise(0)
    )
    return gates.ledger_violations(wrong)


@query(f"WITH {ARC_SQL}, {NOW_SQL}, {LIVE} SELECT o_orderkey, o_custkey FROM src WHERE o_orderkey NOT IN (SELECT o_orderkey FROM dec WHERE decision = 'delete')")
def survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return purge.survivors(current_orders(spark, sf_dir), delete_live(spark, sf_dir), "o_orderkey").select("o_orderkey", "o_custkey")


@query(f"WITH {ARC_SQL}, {NOW_SQL}, {LIVE} SELECT o_orderkey, o_totalprice FROM src WHERE o_orderkey NOT IN (SELECT o_orderkey FROM dec WHERE decision = 'delete')")
def purge_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch(spark)
    purge.purge(current_orders(spark, sf_dir), delete_live(spark, sf_dir), "o_orderkey", out, authorisations(spark, sf_dir), "exported")
    return spark.read.parquet(out).select("o_orderkey", "o_totalprice")


def authorisations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three jobs of the same archive: one compared with the orders that were exported and a copy of the archive, one with the orders as they are now, which differ, and one without any serving copy."""
    arc = cut(archived_orders(spark, sf_dir))
    own = arc.agg(F.count("*").alias("n_rows"), F.count_distinct("batch_seq").alias("n_batches"), F.sha2(F.sum(F.xxhash64("o_orderkey", *COLUMNS).cast("decimal(38,0)")).cast("string"), 256).alias("digest"))
    jobs, reports = None, None
    orders = table(spark, sf_dir, "orders")
    old = F.col("o_orderdate") < F.lit("1999-08-03").cast("timestamp_ntz")
    for name, src, copy in (("exported", orders, arc), ("drifted", current_orders(spark, sf_dir), arc), ("unserved", orders, None)):
        job = own.select(F.lit(name).alias("job_id"), F.lit(None).cast("string").alias("group_id"), "n_rows", "n_batches", "digest")
        checked = reconcile.reconcile(src, arc, "o_orderkey", COLUMNS, within=old)
        serving = None if copy is None else reconcile.reconcile_serving(arc, copy.select("o_orderkey", *COLUMNS), "o_orderkey", COLUMNS)
        report = reconcile.copies_report(checked, serving, job, 4000, 4500)
        jobs, reports = (job, report) if jobs is None else (jobs.unionByName(job), reports.unionByName(report))
    return reconcile.authorize_delete(jobs, reports, 4800, 900)


@query(f"""WITH {ARC_SQL}, {NOW_SQL}, {LIVE} SELECT 'exported' AS job_id, 'purged' AS outcome, count(*) AS n_left FROM src WHERE o_orderkey NOT IN (SELECT o_orderkey FROM dec WHERE decision = 'delete')
UNION ALL SELECT 'drifted', 'refused', count(*) FROM src UNION ALL SELECT 'unserved', 'refused', count(*) FROM src""")
def guarded_deletion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each job tries to delete; what it may not delete stays."""
    src, decisions, allowed, rows = current_orders(spark, sf_dir), cut(delete_live(spark, sf_dir)), authorisations(spark, sf_dir), None
    for job in ("exported", "drifted", "unserved"):
        out = scratch(spark)
        try:
            purge.purge(src, decisions, "o_orderkey", out, allowed, job)
            left, outcome = spark.read.parquet(out), "purged"
        except PermissionError:
            left, outcome = src, "refused"
        one = left.agg(F.lit(job).alias("job_id"), F.lit(outcome).alias("outcome"), F.count("*").alias("n_left"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


@query("""SELECT event_id AS key, CASE WHEN event_id % 11 = 0 THEN 'absent' ELSE 'delete' END AS decision, event_id // 100 + 1 AS batch_seq FROM events WHERE event_id // 100 + 1 < 8
  UNION ALL SELECT event_id, 'kept', event_id // 100 + 1 FROM events WHERE event_id // 100 + 1 >= 8""")
def delete_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    docs = table(spark, sf_dir, "events").select(k.alias("key"), F.lower(F.hex("props")).alias("body"), (F.floor(k / 100) + 1).alias("batch_seq"))
    now = docs.where("key % 11 <> 0").select("key", F.when(F.col("key") % 1000 == 703, F.concat("body", F.lit("00"))).otherwise(F.col("body")).alias("body"))
    return purge.plan_delete_documents(docs, now)


@query(f"""WITH {ARC_SQL} SELECT CASE WHEN o_orderkey % 31 = 0 THEN 'not_restored' ELSE 'restored_differently' END AS rule, CAST(o_orderkey AS VARCHAR) AS entity, CAST(batch_seq AS VARCHAR) AS detail
  FROM arc WHERE o_orderkey % 31 = 0 OR o_orderkey % 37 = 0 UNION ALL SELECT 'foreign_row', CAST(o_orderkey AS VARCHAR), '' FROM orders WHERE NOT o_orderdate < {CUT} AND o_orderkey % 41 = 0""")
def restore_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    arc, k = archived_orders(spark, sf_dir), F.col("o_orderkey")
    price = F.col("o_totalprice") + F.when(k % 37 == 0, 1.0).otherwise(0.0)
    own = arc.where(k % 31 != 0).select("o_orderkey", "o_custkey", "o_orderstatus", price.alias("o_totalprice"), "o_orderdate")
    foreign = table(spark, sf_dir, "orders").where((F.col("o_orderdate") >= F.lit("1999-08-03").cast("timestamp_ntz")) & (k % 41 == 0)).select("o_orderkey", *COLUMNS)
    return reconcile.validate_restore(arc, own.unionByName(foreign), "o_orderkey", COLUMNS)


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'b' ELSE 'a' END AS side FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 5 <> 0 OR o_orderkey % 5 = 0 AND o_orderkey % 3 <> 0")
def key_set_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    return reconcile.key_set_diff(orders.where("o_orderkey % 5 = 0"), orders.where("o_orderkey % 3 = 0"), "o_orderkey")


@query("""WITH m AS (SELECT l_orderkey, l_linenumber, l_quantity, 1 AS a FROM lineitem WHERE l_orderkey % 97 <> 0 UNION ALL SELECT l_orderkey, l_linenumber,
  l_quantity + CASE WHEN l_orderkey % 89 = 0 THEN 1.0 ELSE 0.0 END, 0 FROM lineitem) SELECT l_orderkey, l_linenumber, l_quantity, CAST(sum(a) AS BIGINT) AS n_a, count(*) FILTER (a = 0) AS n_b
FROM m GROUP BY l_orderkey, l_linenumber, l_quantity HAVING sum(a) <> count(*) FILTER (a = 0)""")
def multiset_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    l, k = table(spark, sf_dir, "lineitem"), F.col("l_orderkey")  # noqa: E741
    cols = ["l_orderkey", "l_linenumber", "l_quantity"]
    b = l.select("l_orderkey", "l_linenumber", (F.col("l_quantity") + F.when(k % 89 == 0, 1.0).otherwise(0.0)).alias("l_quantity"))
    return reconcile.multiset_diff(l.where(k % 97 != 0).select(*cols), b, cols)


@query("""WITH jobs AS (SELECT o_custkey AS job_id, CASE WHEN o_custkey % 3 = 0 THEN o_custkey // 30 END AS group_id, count(*) AS n_rows FROM orders GROUP BY o_custkey),
own AS (SELECT *, job_id % 10 <> 0 AND job_id % 7 <> 1 AND job_id % 11 <> 3 AND job_id % 13 <> 5 AND 5000 - (4000 + job_id % 900) <= 900 AND n_rows > 0 AS ok FROM jobs)
SELECT o.job_id, o.group_id, ok AND (o.group_id IS NULL OR (SELECT bool_and(x.ok) FROM own x WHERE x.group_id = o.group_id)) AS allowed FROM own o""")
def delete_authorisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("job_id")
    jobs = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("job_id")).agg(F.count("*").alias("n_rows"))
    jobs = jobs.select("job_id", F.when(k % 3 == 0, F.floor(k / 30)).alias("group_id"), "n_rows", F.lit(2).alias("n_batches"), F.sha2(k.cast("string"), 256).alias("digest"))
    good = jobs.select(
        "job_id", (4000 + k % 900).alias("started"), F.lit(4990).alias("finished"), F.when(k % 10 == 0, "mismatch").otherwise("passed").alias("status"), "n_rows", F.when(k % 11 == 3, 1).otherwise(2).alias("n_batches"), F.when(k % 13 != 5, F.col("n_rows")).alias("lookups"),
        F.lit(0).alias("source_mismatches"), F.when(k % 7 == 1, 1).otherwise(0).alias("serving_mismatches"), "digest",
    )
    older = good.withColumns({"started": F.lit(10), "finished": F.lit(20), "status": F.lit("mismatch")})
    return reconcile.authorize_delete(jobs, good.unionByName(older), 5000, 900)


@query("""WITH o AS (SELECT o_custkey AS job_id, sum(CASE WHEN o_custkey % 9 = 0 AND o_orderkey % 5 = 0 THEN 2 ELSE 1 END) AS r, sum(length(o_orderpriority)) AS b, max(o_orderkey) AS k,
  count(*) AS n_rows, max(o_orderkey) + CASE WHEN o_custkey % 8 = 0 THEN 1 ELSE 0 END AS last_key FROM orders GROUP BY o_custkey)
SELECT * FROM (SELECT CASE WHEN r <> n_rows THEN 'rows' WHEN job_id % 13 = 0 THEN 'bytes' WHEN k <> last_key THEN 'last_key' END AS rule, CAST(job_id AS VARCHAR) AS entity, CAST(r AS VARCHAR) AS detail FROM o)
WHERE rule IS NOT NULL""")
def totals_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, c = table(spark, sf_dir, "orders"), F.col("o_custkey")
    objects = orders.select(c.alias("job_id"), F.when((c % 9 == 0) & (F.col("o_orderkey") % 5 == 0), 2).otherwise(1).alias("n_rows"), F.length("o_orderpriority").alias("n_bytes"), F.col("o_orderkey").alias("last_key"))
    jobs = orders.groupBy(c.alias("job_id")).agg(F.count("*").alias("n_rows"), F.sum(F.length("o_orderpriority")).alias("b"), F.max("o_orderkey").alias("k"))
    k = F.col("job_id")
    jobs = jobs.select("job_id", "n_rows", (F.col("b") + F.when(k % 13 == 0, 1).otherwise(0)).alias("n_bytes"), (F.col("k") + F.when(k % 8 == 0, 1).otherwise(0)).alias("last_key"))
    return gates.totals_violations(objects, jobs)


@query(f"""WITH {ARC_SQL}, {NOW_SQL}, b AS (SELECT a.o_orderkey AS ak, s.o_orderkey AS sk, a.batch_seq, {SAME_SQL} AS same FROM arc a FULL JOIN src s ON a.o_orderkey = s.o_orderkey)
SELECT coalesce(ak, sk) AS o_orderkey, batch_seq, CASE WHEN sk IS NULL THEN 'missing_in_source' WHEN ak IS NULL THEN 'extra_in_source' ELSE 'changed' END AS status FROM b WHERE ak IS NULL OR sk IS NULL OR NOT same""")
def reconcile_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the orders as they are now and their archive differ, found by sums over key ranges."""
    return digests.reconcile_by_tree(current_orders(spark, sf_dir), cut(archived_orders(spark, sf_dir)), "o_orderkey", COLUMNS)
