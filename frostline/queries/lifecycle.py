"""Archives on disk, restores, cycles, events and reports."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from frostline.operators import gates, reports
from frostline.operators.select import eligible
from frostline.plans import cycles, deletion
from frostline.plans.lineage import cut
from frostline.plans.model import ForeignKey, Plan
from frostline.queries.common import ARC_SQL, AS_OF, CUT, ORDERS, PLAN, archived_orders, no_jobs, okey, query, scratch, served, table, versioned_orders
from frostline.queries.selection import CUSTOMERS, IDLE, ORDER_CUSTOMER, dated_customers
from frostline.sources import archive, export, versions
from frostline.streaming import transitions as st

COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate"]


def written(spark: SparkSession, sf_dir: str) -> str:
    uri = scratch(spark)
    export.write_archive(archived_orders(spark, sf_dir), uri, "orders-1", "o_orderkey", COLS)
    return uri


@query(f"WITH {ARC_SQL} SELECT batch_seq, o_orderkey, o_totalprice, o_orderdate FROM arc")
def archive_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.read_archive(spark, written(spark, sf_dir)).select("batch_seq", "o_orderkey", "o_totalprice", "o_orderdate")


@query(f"""SELECT 'first' AS attempt, 'created' AS outcome, count(*) AS n_rows FROM orders WHERE o_orderdate < {CUT} UNION ALL SELECT 'again', 'same', count(*) FROM orders WHERE o_orderdate < {CUT}
UNION ALL SELECT 'changed', 'refused', count(*) FROM orders WHERE o_orderdate < {CUT}""")
def published_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive is published, published again with the same rows, and with others; each time its rows are read."""
    uri, arc, out = scratch(spark), archived_orders(spark, sf_dir), None
    for name, rows in (("first", arc), ("again", arc), ("changed", arc.withColumn("o_totalprice", F.col("o_totalprice") + 1))):
        try:
            outcome = export.publish_archive(rows, uri, "orders-1", "o_orderkey", COLS)
        except FileExistsError:
            outcome = "refused"
        one = archive.read_archive(spark, uri).agg(F.lit(name).alias("attempt"), F.lit(outcome).alias("outcome"), F.count("*").alias("n_rows"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {ARC_SQL} SELECT batch_seq, count(*) AS n_rows, CAST(min(o_orderkey) AS VARCHAR) AS first_key, CAST(max(o_orderkey) AS VARCHAR) AS last_key FROM arc GROUP BY batch_seq")
def archive_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.read_manifest(spark, written(spark, sf_dir)).where("batch_seq is not null").select("batch_seq", "n_rows", "first_key", "last_key")


@query(f"""WITH {ARC_SQL}, last AS (SELECT max(batch_seq) AS b FROM arc), n AS (SELECT batch_seq, count(*) AS n FROM arc GROUP BY batch_seq)
SELECT 'whole' AS archive, NULL AS rule, 0 AS n UNION ALL SELECT 'damaged', 'file_foreign', 1 UNION ALL SELECT 'damaged', 'batch_n_rows', 1 FROM last UNION ALL SELECT 'damaged', 'batch_foreign', 1 UNION ALL SELECT 'damaged', 'key_repeated', 1""")
def archive_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with a whole archive, and with one to which a foreign file has brought a copy of each row of the first batch and a batch of its own."""
    whole, damaged = written(spark, sf_dir), written(spark, sf_dir)
    first = archived_orders(spark, sf_dir).where("batch_seq = 1")
    extra = first.unionByName(first.withColumn("batch_seq", F.lit(10**9).cast("long"))).coalesce(1)
    extra.select(spark.read.parquet(f"{damaged}/data").columns).write.mode("append").parquet(f"{damaged}/data")
    out = None
    for name, uri in (("whole", whole), ("damaged", damaged)):
        found = archive.verify_archive(spark, uri, "o_orderkey").groupBy("rule").agg(F.count("*").alias("n"))
        every = found if name == "damaged" else found.agg(F.max("rule").alias("rule"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
        one = every.select(F.lit(name).alias("archive"), "rule", F.col("n").cast("long").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {ARC_SQL} SELECT 'orders-1' AS job_id, count(*) AS n_rows, 'unauthenticated' AS basis FROM arc")
def archive_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "orders").select(F.concat(F.lit("other-"), okey().cast("string")).alias("job_id"))
    return archive.import_archive(spark, written(spark, sf_dir), "o_orderkey", known).select("job_id", "n_rows", "basis")


@query(f"SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders WHERE o_orderdate < {CUT}")
def restored_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = scratch(spark)
    export.restore(spark, written(spark, sf_dir), target)
    return export.restored(spark, target).select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")


class Crash(RuntimeError):
    """Made by the queries that stop a job in its middle."""


def crash_at(step: str, times: int = 1):
    """A step function that fails when that step comes for so many-th time."""
    left = [times]

    def at(now: str) -> None:
        left[0] -= now == step
        if now == step and left[0] == 0:
            raise Crash(step)

    return at


@query(f"SELECT 'crashed' AS outcome, o_orderkey, o_totalprice FROM orders WHERE o_orderdate < {CUT}")
def restore_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A restore in rounds of four batches that stops after its first round and is called again."""
    uri, target = written(spark, sf_dir), scratch(spark)
    try:
        export.restore(spark, uri, target, batches=4, at=crash_at("moved"))
        outcome = "whole"
    except Crash:
        outcome = "crashed"
    export.restore(spark, uri, target, batches=4)
    return export.restored(spark, target).select(F.lit(outcome).alias("outcome"), "o_orderkey", "o_totalprice")


@query(f"""SELECT 'unfinished crashed crashed finished' AS story, o_orderkey, o_totalprice FROM orders WHERE o_orderdate < {CUT}""")
def export_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An export in rounds: one round and a stop, a crash before a round's files are all published, a crash after staging, and to the end."""
    uri, orders, story = scratch(spark), table(spark, sf_dir, "orders"), []
    n = max(1, archive_size(spark, sf_dir) // 4)
    for rounds, at in ((1, crash_at("never")), (None, crash_at("moved")), (None, crash_at("staged")), (None, crash_at("never"))):
        try:
            story.append(export.export(orders, PLAN, uri, "orders-1", COLS, max_rounds=rounds, round_rows=n, at=at))
        except Crash:
            story.append("crashed")
    if not archive.verify_archive(spark, uri, "o_orderkey").isEmpty():
        story.append("but the archive does not verify")
    return archive.read_archive(spark, uri).select(F.lit(" ".join(story)).alias("story"), "o_orderkey", "o_totalprice")


def archive_size(spark: SparkSession, sf_dir: str) -> int:
    return eligible(table(spark, sf_dir, "orders"), PLAN).count()


@query("""SELECT CAST(o_orderkey % 12 AS BIGINT) AS residue, CASE WHEN o_orderkey % 12 IN (0, 5) THEN 'new' ELSE 'kept' END AS fate, CAST(count(*) AS BIGINT) AS n_rows FROM orders
WHERE o_orderkey % 12 <> 7 AND NOT (o_orderkey % 12 IN (0, 5) AND o_orderkey % 36 < 12) GROUP BY ALL""")
def touched_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in twelve files by the key's residue: what deleting some rows of two and all rows of one makes of each file."""
    uri, orders = scratch(spark), table(spark, sf_dir, "orders")
    for r in range(12):
        orders.where(okey() % 12 == r).coalesce(1).write.mode("append").parquet(f"{uri}-files")
    versions.adopt(spark, uri, f"{uri}-files")
    r = okey() % 12
    gone = orders.where((r == 7) | (r.isin(0, 5) & (okey() % 36 < 12))).select("o_orderkey")
    versions.delete_keys(spark, uri, 1, gone, "o_orderkey")
    fates = versions.fates(spark, uri, 1, 2).where("fate <> 'gone'")
    # a file written anew may hold rows of several
    rows = versions.read_version(spark, uri).select(versions.file_of_row().alias("path"), r.cast("long").alias("residue")).groupBy("path", "residue").agg(F.count("*").alias("n_rows"))
    return rows.join(fates, "path").groupBy("residue", "fate").agg(F.sum("n_rows").alias("n_rows"))


@query(f"""WITH {ARC_SQL} SELECT batch_seq, CAST(CASE WHEN batch_seq <= 3 THEN 2 ELSE 1 END AS INTEGER) AS attempts, count(*) AS processed, count(*) FILTER (batch_seq > 3 AND o_orderkey % 11 <> 0) AS deleted,
count(*) FILTER (batch_seq <= 3 OR o_orderkey % 11 = 0) AS absent, CAST(0 AS BIGINT) AS deferred, count(*) FILTER (batch_seq <= 3) AS uncertain FROM arc GROUP BY batch_seq""")
def replayed_deletion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deletion in rounds of three batches from a table where every 11th order is gone; it loses the acknowledgement of its first round and is run again, which finds that round's rows absent."""
    top, arc = scratch(spark), cut(archived_orders(spark, sf_dir))
    table(spark, sf_dir, "orders").where(okey() % 11 != 0).select("o_orderkey", *COLS[1:]).write.parquet(f"{top}-orders")
    versions.adopt(spark, top, f"{top}-orders")
    target = deletion.Target(top, "o_orderkey", COLS, [])
    allowed = spark.createDataFrame([("orders-1", True)], "job_id string, allowed boolean")
    try:
        deletion.run_deletion(spark, target, arc, f"{top}-ledger", "orders-1", allowed, batches=3, at=crash_at("deleted"))
    except Crash:
        pass
    return deletion.run_deletion(spark, target, arc, f"{top}-ledger", "orders-1", allowed, batches=3 * max(1, archive_size(spark, sf_dir) // 9000)).drop("job_id")


@query("""SELECT o_orderkey AS batch_seq, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 5 <> 0 THEN 'keep' WHEN o_orderkey % 3 = 0 THEN 'lost' WHEN o_orderkey % 3 = 1 THEN 'publish' ELSE 'export' END AS action
FROM orders WHERE o_orderkey % 3 <> 2 OR o_orderkey % 5 <> 0""")
def resume_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders stand for batches."""
    o = table(spark, sf_dir, "orders")
    journal = o.where(okey() % 3 != 2).select(okey().alias("batch_seq"), F.when(okey() % 3 == 0, "committed").otherwise("prepared").alias("state"))
    return archive.resume_plan(journal, o.where(okey() % 5 != 0).select(okey().alias("batch_seq")))


@query("""WITH m AS (SELECT o_custkey AS job_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b, o_orderkey AS k, o_orderkey - CASE WHEN o_orderkey % 17 = 0 THEN 100000 ELSE 0 END AS last FROM orders),
p AS (SELECT *, CASE WHEN k % 23 = 0 THEN 2000 ELSE 10 END AS n, lag(last) OVER (PARTITION BY job_id ORDER BY b) AS prior, lag(k % 19 <> 0) OVER (PARTITION BY job_id ORDER BY b) AS follows FROM m),
o AS (SELECT CASE WHEN b > 1 AND NOT follows THEN 'batch_gap' WHEN n > 1000 THEN 'batch_rows' WHEN k % 29 = 0 THEN 'digest' WHEN follows AND k <= prior OR last < k THEN 'key_order' END AS rule, job_id || '/' || b AS entity, CAST(n AS VARCHAR) AS detail
  FROM p WHERE k % 19 <> 0),
h AS (SELECT job_id, sum(n) FILTER (k % 19 <> 0) AS r, max(last) FILTER (k % 19 <> 0) AS top FROM p GROUP BY job_id),
v AS (SELECT CASE WHEN job_id % 13 = 0 THEN 'version' WHEN job_id % 7 = 0 OR r IS NULL THEN 'total_rows' WHEN job_id % 5 = 0 THEN 'last_key' END AS rule, CAST(job_id AS VARCHAR) AS entity,
  CAST(CAST(coalesce(r, 0) AS BIGINT) + CASE WHEN job_id % 7 = 0 OR r IS NULL THEN 1 ELSE 0 END AS VARCHAR) AS detail FROM h)
SELECT rule, entity, detail FROM o WHERE rule IS NOT NULL UNION ALL SELECT rule, entity, detail FROM v WHERE rule IS NOT NULL""")
def manifest_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders stand for the batches of their customer's manifest: every 19th is missing, every 23rd too large, every 29th without a digest, every 17th with a last key under its first."""
    k, j = okey(), F.col("job_id")
    b = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("job_id"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long").alias("batch_seq"), "o_orderkey")
    n = F.when(k % 23 == 0, 2000).otherwise(10).cast("long")
    own = [F.when(j % 13 == 0, 1).otherwise(4).alias("version"), F.lit("{}").alias("schema"), F.lit(1000).alias("batch_size")]
    last = k - F.when(k % 17 == 0, 100000).otherwise(0)
    batches = b.where(k % 19 != 0).select("job_id", *own, "batch_seq", n.alias("n_rows"), (n * 7).alias("n_bytes"), k.cast("string").alias("first_key"), last.cast("string").alias("last_key"), F.when(k % 29 == 0, "no digest").otherwise(F.sha2(k.cast("string"), 256)).alias("digest"), F.lit(None).cast("string").alias("name"))
    there = F.when(k % 19 != 0, n)
    sums = b.groupBy("job_id").agg(F.sum(there).alias("r"), F.max(F.when(k % 19 != 0, last)).alias("top"))
    heads = sums.select("job_id", *own, (F.coalesce("r", F.lit(0)) + F.when((j % 7 == 0) | F.col("r").isNull(), 1).otherwise(0)).alias("n_rows"), (F.coalesce("r", F.lit(0)) * 7).alias("n_bytes"), (F.col("top") + F.when(j % 5 == 0, 1).otherwise(0)).cast("string").alias("last_key"))
    return gates.manifest_violations(batches.unionByName(heads, allowMissingColumns=True))


def checks(spark: SparkSession, jobs: DataFrame | None = None, **more) -> cycles.Checks:
    return cycles.Checks(**({"jobs": no_jobs(spark) if jobs is None else jobs, "serving": served, "admitted": None, "children": []} | more))


@query(f"SELECT o_orderkey, o_totalprice FROM orders WHERE NOT o_orderdate < {CUT}")
def retention_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = versioned_orders(spark, sf_dir)
    cycles.run_cycle(spark, orders, scratch(spark), ORDERS, AS_OF, 1, checks(spark))
    return versions.read_version(spark, orders).select("o_orderkey", "o_totalprice")


@query(f"""WITH n AS (SELECT count(*) AS n, count(*) FILTER (NOT o_orderdate < {CUT}) AS young FROM orders)
SELECT unnest(['unserved', 'served_differently', 'child_left', 'not_admitted', 'late_row', 'earlier_job', 'allowed']) AS what, unnest(['refused', 'refused', 'refused', 'refused', 'refused', 'refused', 'ran']) AS outcome, unnest([n, n, n, n, n + 1, n, young]) AS n_left FROM n""")
def cycle_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One cycle tried under what must refuse it, and at last under nothing: the archive of the first try serves all; the table of the late row got it after its export."""
    orders, lake, out = table(spark, sf_dir, "orders"), scratch(spark), None
    late = orders.limit(1).select(*((F.lit(-1) if c == "o_orderkey" else F.lit("1990-01-01") if c == "o_orderdate" else F.col(c)).cast(t).alias(c) for c, t in orders.dtypes))
    own = versioned_orders(spark, sf_dir)
    orders.unionByName(late).write.parquet(f"{lake}-with-late")
    versions.adopt(spark, f"{lake}-late", f"{lake}-with-late")
    export.export(orders, Plan.freeze(ORDERS, AS_OF), f"{lake}-2/{ORDERS.name}-1", f"{ORDERS.name}-1", orders.columns)
    changed = lambda t, arc: served(t, arc).withColumn("o_custkey", F.when(okey() == arc.agg(F.max("o_orderkey")).first()[0], 0).otherwise(F.col("o_custkey")))
    lines = [(lambda: table(spark, sf_dir, "lineitem"), ForeignKey("line_order", "lineitem", ("l_orderkey",), "orders", ("o_orderkey",)))]
    busy = spark.createDataFrame([(False, "metric_limit")], "allowed boolean, reason string")
    open_job = spark.createDataFrame([(ORDERS.name, "running", False, False)], "policy string, status string, deleted boolean, imported boolean")
    tries = {
        "unserved": (own, {"serving": None}), "served_differently": (own, {"serving": changed}), "child_left": (own, {"children": lines}), "not_admitted": (own, {"admitted": busy}), "late_row": (f"{lake}-late", {}),
        "earlier_job": (own, {"jobs": open_job}), "allowed": (own, {"admitted": spark.createDataFrame([(True, "admitted")], "allowed boolean, reason string")}),
    }
    for what, (uri, told) in tries.items():
        try:
            cycles.run_cycle(spark, uri, lake if uri == own else f"{lake}-2", ORDERS, AS_OF, 1, checks(spark, **told))
            outcome = "ran"
        except PermissionError:
            outcome = "refused"
        one = versions.read_version(spark, uri).agg(F.lit(what).alias("what"), F.lit(outcome).alias("outcome"), F.count("*").alias("n_left"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""SELECT 'customer' AS name, count(*) AS n_rows, CAST(sum(c_custkey) AS BIGINT) AS keys FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) AND c_custkey NOT IN ({IDLE})
UNION ALL SELECT 'orders', count(*), CAST(sum(o_orderkey) AS BIGINT) FROM orders WHERE o_custkey NOT IN ({IDLE})""")
def retention_group_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake = scratch(spark)
    dated_customers(spark, sf_dir).write.parquet(f"{lake}/customer-files")
    tables = {"orders": f"{lake}/orders", "customer": f"{lake}/customer"}
    versions.adopt(spark, tables["orders"], f"{sf_dir}/orders.parquet")
    versions.adopt(spark, tables["customer"], f"{lake}/customer-files")
    cycles.run_group_cycle(spark, tables, {"orders": "o_orderkey", "customer": "c_custkey"}, lake, CUSTOMERS, [ORDER_CUSTOMER], AS_OF, 1, checks(spark))
    n = lambda t, k: versions.read_version(spark, tables[t]).agg(F.lit(t).alias("name"), F.count("*").alias("n_rows"), F.sum(k).alias("keys"))
    return n("customer", "c_custkey").unionByName(n("orders", "o_orderkey"))


@query("SELECT o_orderpriority AS policy, bool_and(o_orderstatus <> 'P' OR o_orderkey % 4 <> 0 OR o_orderpriority <> '5-LOW') AS ready FROM orders GROUP BY o_orderpriority")
def cycle_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = (F.col("o_orderstatus") == "P") & (okey() % 4 == 0) & (F.col("o_orderpriority") == "5-LOW")
    jobs = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("policy"), F.when(bad, "running").otherwise("completed").alias("status"), F.lit(True).alias("deleted"), F.lit(False).alias("imported"))
    return cycles.may_run(jobs)


@query(f"""WITH p AS (SELECT o_orderpriority AS policy, bool_and(o_orderstatus <> 'P' OR o_orderkey % 4 <> 0 OR o_orderpriority <> '5-LOW') AS ready FROM orders GROUP BY o_orderpriority)
SELECT policy, CASE WHEN ready THEN 'ran' ELSE 'refused' END AS outcome, CASE WHEN ready THEN (SELECT count(*) FROM orders WHERE NOT o_orderdate < {CUT}) ELSE (SELECT count(*) FROM orders) END AS n_left
FROM p WHERE policy IN ('1-URGENT', '5-LOW')""")
def gated_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cycle of a policy whose earlier jobs are done, and one of a policy that has an unfinished job."""
    bad = (F.col("o_orderstatus") == "P") & (okey() % 4 == 0) & (F.col("o_orderpriority") == "5-LOW")
    jobs = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("policy"), F.when(bad, "running").otherwise("completed").alias("status"), F.lit(True).alias("deleted"), F.lit(False).alias("imported"))
    out = None
    for name in ("1-URGENT", "5-LOW"):
        orders = versioned_orders(spark, sf_dir)
        try:
            cycles.run_cycle(spark, orders, scratch(spark), replace(ORDERS, name=name), AS_OF, 1, checks(spark, jobs))
            outcome = "ran"
        except PermissionError:
            outcome = "refused"
        one = versions.read_version(spark, orders).agg(F.lit(name).alias("policy"), F.lit(outcome).alias("outcome"), F.count("*").alias("n_left"))
        out = one if out is None else out.unionByName(one)
    return out


def status_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = F.col("event_type") == "error"
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.lit("job").alias("kind"), F.col("user_id").cast("string").alias("entity"), failed.alias("failed"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("created"))


EVENTS = "ev AS (SELECT event_id AS seq, 'job' AS kind, CAST(user_id AS VARCHAR) AS entity, event_type = 'error' AS failed, CAST(floor(epoch(ts)) AS BIGINT) AS created FROM events)"
TRANSITIONS = f"""WITH {EVENTS}, l AS (SELECT *, coalesce(lag(failed) OVER (PARTITION BY kind, entity ORDER BY seq), false) AS prior FROM ev)
SELECT kind, entity, seq, CASE WHEN failed THEN 'firing' ELSE 'resolved' END AS state FROM l WHERE failed <> prior"""


@query(TRANSITIONS)
def incident_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.transitions(status_events(spark, sf_dir))


@query(TRANSITIONS)
def incident_transitions_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream, read to its end; the stream's results are Parquet files in the shared folder."""
    top = scratch(spark)
    schema = table(spark, sf_dir, "events").schema
    raw = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
    failed = F.col("event_type") == "error"
    events = raw.select(F.col("event_id").alias("seq"), F.lit("job").alias("kind"), F.col("user_id").cast("string").alias("entity"), failed.alias("failed"))
    out = st.transitions_stream(events).writeStream.format("parquet").option("path", f"{top}/out").option("checkpointLocation", f"{top}/state").outputMode("append")
    out.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(st.OUT).parquet(f"{top}/out")


@query("""WITH s AS (SELECT event_id AS seq, lag(event_id, 1, 99) OVER (ORDER BY event_id) AS p FROM events WHERE event_id > 99 AND event_id % 10 <> 3 AND event_id % 100 <> 4)
SELECT p + 1 AS first_missing, seq - 1 AS last_missing FROM s WHERE seq > p + 1""")
def sequence_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.sequence_gaps(status_events(spark, sf_dir).where("seq % 10 <> 3 and seq % 100 <> 4"), 99)


@query(f"WITH {EVENTS} SELECT seq, entity FROM ev WHERE failed OR created >= 1706572800 - 10 * 86400")
def pruned_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = status_events(spark, sf_dir).withColumn("delivery", F.when(F.col("failed"), "pending").otherwise("sent"))
    return st.prune_delivered(events, 1706572800, 10).select("seq", "entity")


@query(f"""WITH {EVENTS}, i AS (SELECT kind, entity, max(created) AS updated, max_by(failed, seq) AS active FROM ev GROUP BY kind, entity)
SELECT kind, entity FROM i WHERE active OR updated >= 1706572800 - 2 * 86400 OR EXISTS (SELECT 1 FROM ev WHERE ev.entity = i.entity AND ev.failed AND ev.seq % 50 = 0)""")
def pruned_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = status_events(spark, sf_dir)
    incidents = events.groupBy("kind", "entity").agg(F.max("created").alias("updated"), F.max_by("failed", "seq").alias("active"))
    waiting = events.withColumn("delivery", F.when(F.col("failed") & (F.col("seq") % 50 == 0), "pending").otherwise("sent"))
    return st.prune_incidents(incidents, waiting, 1706572800, 2).select("kind", "entity")


@query("SELECT event_id AS seq FROM events WHERE event_id > (SELECT max(event_id) FROM events) - 500")
def newest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.keep_newest(status_events(spark, sf_dir), 500).select("seq")


@query("""WITH c AS (SELECT o_orderpriority AS policy, year(o_orderdate) AS cycle, o_orderkey AS key FROM orders), t AS (SELECT policy, cycle, max(key) AS hi FROM c GROUP BY policy, cycle),
s AS (SELECT policy, cycle, max(hi) OVER (PARTITION BY policy ORDER BY cycle ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM t)
SELECT policy, cycle, key FROM c JOIN s USING (policy, cycle) WHERE key <= seen""")
def late_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("policy"), F.year("o_orderdate").cast("long").alias("cycle"), okey().alias("key"))
    return st.late_arrivals(c)


@query("""SELECT s AS status, count(o_orderkey) AS n FROM (SELECT unnest(['running', 'completed', 'failed', 'cancelled', 'paused', 'pending', 'active', 'stopped']) AS s)
LEFT JOIN orders ON s = CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END GROUP BY s""")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "running").otherwise("failed")
    return reports.status_counts(table(spark, sf_dir, "orders").select(status.alias("status")))


@query("""SELECT (SELECT count(*) FROM orders) AS archived_rows, (SELECT CAST(sum(length(o_orderpriority)) AS BIGINT) FROM orders) AS archived_bytes,
  (SELECT count(*) FROM orders WHERE o_orderkey % 2 = 0) AS deleted_rows, greatest(1706572800 - (SELECT min(CAST(floor(epoch(ts)) AS BIGINT)) FROM events WHERE event_type IN ('view', 'click')), 0) AS oldest_due""")
def lifecycle_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    jobs = o.groupBy("o_custkey").agg(F.count("*").alias("n_rows"), F.sum(F.length("o_orderpriority")).alias("n_bytes"))
    status = F.when(F.col("event_type") == "view", "pending").when(F.col("event_type") == "click", "running").otherwise("completed")
    queue = table(spark, sf_dir, "events").select(status.alias("status"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("due_at"))
    return reports.lifecycle_totals(jobs, queue, o.groupBy("o_custkey").agg(F.count_if(okey() % 2 == 0).alias("deleted")), 1706572800)


@query("""SELECT o_custkey AS job_id, max(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) AS before, max(CASE WHEN o_orderstatus = 'O' THEN o_orderkey END) AS after,
  CASE WHEN max(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) IS NOT NULL AND max(CASE WHEN o_orderstatus = 'O' THEN o_orderkey END) IS NOT NULL
  THEN greatest(max(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) - max(CASE WHEN o_orderstatus = 'O' THEN o_orderkey END), 0) END AS returned FROM orders GROUP BY o_custkey""")
def storage_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    phase = F.when(F.col("o_orderstatus") == "F", "before").when(F.col("o_orderstatus") == "O", "after").otherwise("during")
    return reports.storage_outcomes(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("job_id"), phase.alias("phase"), okey().alias("bytes")))


@query("SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n <= 3")
def latest_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.latest(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 3).select("o_custkey", "o_orderkey")


@query("""WITH p AS (SELECT user_id AS job_id, epoch(ts) AS ts, sum(event_id % 3) OVER (PARTITION BY user_id ORDER BY ts) AS r, sum(event_id % 7) OVER (PARTITION BY user_id ORDER BY ts) AS b FROM events),
d AS (SELECT job_id, ts, r - lag(r, 1, 0) OVER w AS dr, b - lag(b, 1, 0) OVER w AS db, greatest(ts - lag(ts) OVER w, 0.001) AS dt, lag(ts) OVER w IS NULL AS no FROM p WINDOW w AS (PARTITION BY job_id ORDER BY ts))
SELECT job_id, round(dr / dt, 2) AS rows_per_s, count(*) AS n FROM d WHERE dr <> 0 AND NOT no GROUP BY 1, 2""")
def commit_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts")
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    p = table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), at.alias("t"), F.sum(F.col("event_id") % 3).over(w).alias("n_rows"), F.sum(F.col("event_id") % 7).over(w).alias("n_bytes")).withColumnRenamed("t", "ts")
    return reports.rates(p).groupBy("job_id", F.round("rows_per_s", 2).alias("rows_per_s")).agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, l_orderkey, count(DISTINCT l_linenumber) AS n_jobs FROM lineitem GROUP BY l_returnflag, l_orderkey HAVING count(DISTINCT l_linenumber) > 1")
def duplicate_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.duplicate_generations(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_orderkey", "l_linenumber")


@query("""SELECT 'job' AS kind, CAST(o_orderkey AS VARCHAR) AS entity, CASE WHEN o_orderkey % 3 <> 0 THEN 'opened' WHEN o_orderkey % 5 <> 0 THEN 'resolved' ELSE 'unchanged' END AS change
FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 5 = 0""")
def incident_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.lit("job").alias("kind"), okey().cast("string").alias("entity"), "o_orderkey")
    return reports.reconcile_incidents(o.where(okey() % 3 == 0), o.where(okey() % 5 == 0))


@query("SELECT 'stage/' || o_orderkey AS path, o_orderdate AS seen FROM orders WHERE o_orderkey % 5 = 0")
def orphan_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "orders").select(F.concat(F.lit("stage/"), okey().cast("string")).alias("path"), F.col("o_orderdate").alias("seen"), "o_orderkey")
    return reports.orphan_files(files.select("path", "seen"), files.where(okey() % 5 != 0))


POLICY = {"window": (1200, 300), "max_age_ms": 3_600_000, "limits": {"cpu": 80.0, "lag": 90.0}, "min_delay_ms": 10, "max_delay_ms": 1010}


@query("""WITH s AS (SELECT user_id % 5 AS source, epoch_us(ts) // 1000 AS ts, CASE WHEN event_id % 17 <> 0 THEN value END AS cpu, CAST(event_id % 100 AS DOUBLE) AS lag FROM events WHERE event_type <> 'error'),
c AS (SELECT user_id % 5 AS source, epoch_us(ts) // 1000 AS ts FROM events WHERE event_type = 'error'),
m AS (SELECT c.source, c.ts, s.ts AS st, s.cpu, s.lag FROM c ASOF LEFT JOIN s ON c.source = s.source AND c.ts >= s.ts),
r AS (SELECT *, CASE WHEN NOT ((ts // 60000) % 1440 >= 1200 OR (ts // 60000) % 1440 < 300) THEN 'window' WHEN st IS NULL THEN 'sample_missing'
  WHEN ts - st > 3600000 THEN 'sample_age' WHEN cpu IS NULL THEN 'metric_missing' WHEN cpu < 0 OR cpu >= 80 THEN 'metric_limit'
  WHEN lag >= 90 THEN 'metric_limit' END AS why FROM m)
SELECT source, ts, why IS NULL AS allowed, coalesce(why, 'admitted') AS reason,
  CASE WHEN why IS NULL THEN 10 + CAST(floor(1000.0::DOUBLE * greatest(0.0, cpu / 80, lag / 90) * greatest(0.0, cpu / 80, lag / 90)) AS BIGINT) ELSE 0 END AS delay_ms FROM r""")
def admission_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("source"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"), "event_id", "event_type", "value")
    samples = e.where("event_type <> 'error'").select("source", "ts", F.when(F.col("event_id") % 17 != 0, F.col("value")).alias("cpu"), (F.col("event_id") % 100).cast("double").alias("lag"))
    return reports.admission(e.where("event_type = 'error'").select("source", "ts"), samples, POLICY)
