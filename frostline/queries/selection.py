"""Selecting rows: age, equality, key ranges, batches, parents and children."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frostline.operators import gates, purge, reconcile, select
from frostline.plans.model import ForeignKey, Plan, Policy
from frostline.queries.common import AS_OF, CUT, ORDERS, PLAN, query, table

SUMMARY = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]
OLD = f"(SELECT * FROM orders WHERE o_orderdate < {CUT})"
NUMBERED = f"(SELECT *, row_number() OVER (ORDER BY o_orderkey) AS row_no, (row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 + 1 AS batch_seq FROM {OLD})"
LINE_ORDER = ForeignKey("line_order", "lineitem", ("l_orderkey",), "orders", ("o_orderkey",))
ORDER_CUSTOMER = ForeignKey("order_customer", "orders", ("o_custkey",), "customer", ("c_custkey",))
CUSTOMERS = Policy("customers-idle", "customer", "c_custkey", "last_order", 90)


def old_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.eligible(table(spark, sf_dir, "orders"), PLAN)


@query(f"""SELECT batch_seq, count(*) AS n_rows, CAST(sum(length(CAST(o_orderkey AS VARCHAR)) + length(CAST(o_custkey AS VARCHAR)) + length(o_orderstatus)
  + length(o_orderpriority)) AS BIGINT) AS n_bytes, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM {NUMBERED} GROUP BY batch_seq""")
def eligible_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    batched = select.assign_batches(old_orders(spark, sf_dir).select(*SUMMARY), "o_orderkey", ORDERS.batch_size)
    return select.batch_summary(batched, "o_orderkey", SUMMARY)


@query(f"SELECT o_orderkey, o_orderdate FROM {OLD} WHERE o_orderstatus = 'F'")
def eligible_with_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    policy = Policy("finished", "orders", "o_orderkey", "o_orderdate", 730, ("o_orderstatus", "F"))
    return select.eligible(table(spark, sf_dir, "orders"), Plan.freeze(policy, AS_OF)).select("o_orderkey", "o_orderdate")


@query(f"SELECT DATE '1999-08-03' AS cutoff, count(*) AS n, max(o_orderdate) AS newest FROM {OLD}")
def cutoff_of_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return old_orders(spark, sf_dir).agg(F.lit(PLAN.cutoff.date()).alias("cutoff"), F.count("*").alias("n"), F.max("o_orderdate").alias("newest"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 1000 AND o_orderkey <= (SELECT max(o_orderkey) - 100 FROM orders) ORDER BY o_orderkey LIMIT 500")
def key_range_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    upper = select.upper_key(orders, "o_orderkey")
    return select.key_range(orders, "o_orderkey", 1000, upper - 100, 500).select("o_orderkey", "o_custkey")


@query(f"SELECT max(o_orderkey) AS whole_table, max(CASE WHEN o_orderdate < {CUT} THEN o_orderkey END) AS under_predicate FROM orders")
def upper_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    old = select.before(orders, "o_orderdate", PLAN.cutoff)
    return orders.agg(F.max("o_orderkey").alias("whole_table"), F.max(F.when(old, F.col("o_orderkey"))).alias("under_predicate"))


@query(f"SELECT count(*) AS eligible, true AS exact FROM {OLD}")
def eligible_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.estimate_eligible(table(spark, sf_dir, "orders"), PLAN)


@query(f"SELECT o_orderkey, row_no, batch_seq FROM {NUMBERED}")
def batch_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.assign_batches(old_orders(spark, sf_dir).select("o_orderkey"), "o_orderkey")


@query(f"SELECT batch_seq, count(*) AS n_rows FROM {NUMBERED} WHERE row_no <= 2500 GROUP BY batch_seq")
def run_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    batched = select.assign_batches(old_orders(spark, sf_dir).select("o_orderkey"), "o_orderkey")
    return select.budget(batched, 2500).groupBy("batch_seq").agg(F.count("*").alias("n_rows"))


@query(f"SELECT l_orderkey, l_partkey, l_linenumber, l_quantity FROM lineitem WHERE EXISTS (SELECT 1 FROM {OLD} o WHERE o.o_orderkey = l_orderkey)")
def child_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    picked = select.select_children(table(spark, sf_dir, "lineitem"), [(old_orders(spark, sf_dir), LINE_ORDER)])
    return picked.select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem WHERE EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size < 10)
  OR EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = l_suppkey AND s_acctbal < 2000)""")
def child_selection_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").where("p_size < 10")
    suppliers = table(spark, sf_dir, "supplier").where("s_acctbal < 2000")
    fks = ForeignKey("line_part", "lineitem", ("l_partkey",), "part", ("p_partkey",)), ForeignKey("line_supplier", "lineitem", ("l_suppkey",), "supplier", ("s_suppkey",))
    picked = select.select_children(table(spark, sf_dir, "lineitem"), [(parts, fks[0]), (suppliers, fks[1])])
    return picked.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


@query(f"SELECT DISTINCT nullif(o_custkey % 50, 7) AS k, o_orderstatus AS s FROM {OLD} WHERE nullif(o_custkey % 50, 7) IS NOT NULL")
def parent_tuples(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = old_orders(spark, sf_dir).select(F.nullif(F.col("o_custkey") % 50, F.lit(7)).alias("k"), F.col("o_orderstatus").alias("s"))
    return select.parent_keys(keyed, ["k", "s"])


@query("""WITH jobs AS (SELECT 'job-' || o_orderstatus AS job_id, sha256(o_orderstatus) AS digest, count(*) AS n_rows FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_orderstatus),
plans AS (SELECT o_orderpriority || o_orderstatus AS plan_id, 'job-' || o_orderstatus AS parent_job, CASE WHEN o_orderpriority = '1-URGENT' THEN sha256('?') ELSE sha256(o_orderstatus) END AS digest,
  (SELECT count(*) FROM orders x WHERE x.o_orderstatus = o.o_orderstatus) + CASE WHEN o_orderpriority = '5-LOW' THEN 1 ELSE 0 END AS n_rows FROM orders o GROUP BY o_orderpriority, o_orderstatus)
SELECT * FROM (SELECT CASE WHEN j.digest IS NULL THEN 'parent_missing' WHEN j.digest <> p.digest THEN 'parent_digest' WHEN j.n_rows <> p.n_rows THEN 'parent_rows' END AS rule,
  p.plan_id AS entity, p.parent_job AS detail FROM plans p LEFT JOIN jobs j ON j.job_id = p.parent_job) WHERE rule IS NOT NULL""")
def parent_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    job = F.concat(F.lit("job-"), "o_orderstatus")
    by_status = orders.groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    jobs = by_status.where("o_orderstatus <> 'P'").select(job.alias("job_id"), F.sha2("o_orderstatus", 256).alias("digest"), F.col("n").alias("n_rows"))
    plans = orders.select("o_orderpriority", "o_orderstatus").distinct().join(by_status, "o_orderstatus").select(
        F.concat("o_orderpriority", "o_orderstatus").alias("plan_id"), job.alias("parent_job"),
        F.sha2(F.when(F.col("o_orderpriority") == "1-URGENT", "?").otherwise(F.col("o_orderstatus")), 256).alias("digest"),
        (F.col("n") + F.when(F.col("o_orderpriority") == "5-LOW", 1).otherwise(0)).alias("n_rows"),
    )
    return gates.binding_violations(plans, jobs)


def dated_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("last_order"))
    return table(spark, sf_dir, "customer").join(last, "c_custkey").select("c_custkey", "c_name", "c_acctbal", "last_order")


IDLE = "SELECT o_custkey FROM orders GROUP BY o_custkey HAVING max(o_orderdate) < TIMESTAMP '2001-05-04'"


@query(f"""WITH c AS (SELECT c_custkey FROM customer WHERE c_custkey IN ({IDLE})), o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c)),
l AS (SELECT l_orderkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o))
SELECT 'customer' AS name, count(*) AS n_rows, CAST(sum(c_custkey) AS BIGINT) AS keys FROM c UNION ALL SELECT 'orders', count(*), CAST(sum(o_orderkey) AS BIGINT) FROM o
UNION ALL SELECT 'lineitem', count(*), CAST(sum(l_orderkey) AS BIGINT) FROM l""")
def group_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {"lineitem": table(spark, sf_dir, "lineitem"), "orders": table(spark, sf_dir, "orders"), "customer": dated_customers(spark, sf_dir)}
    picked = select.select_group(tables, CUSTOMERS, [LINE_ORDER, ORDER_CUSTOMER], AS_OF)
    n = lambda t, k: picked[t].agg(F.lit(t).alias("name"), F.count("*").alias("n_rows"), F.sum(k).alias("keys"))
    return n("customer", "c_custkey").unionByName(n("orders", "o_orderkey")).unionByName(n("lineitem", "l_orderkey"))


@query(f"""SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM {OLD}) AND c_custkey IN (SELECT o_custkey FROM orders WHERE NOT o_orderdate < {CUT})""")
def blocked_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    old = select.before(orders, "o_orderdate", PLAN.cutoff)
    candidates = table(spark, sf_dir, "customer").join(orders.where(old), F.col("c_custkey") == F.col("o_custkey"), "left_semi")
    return purge.blocked_parents(candidates.select("c_custkey", "c_name"), [(orders.where(~old), ORDER_CUSTOMER)])


@query("SELECT doc_id, quality FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 10 <> 0)")
def fk_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = table(spark, sf_dir, "documents").where("doc_id % 10 <> 0")
    return reconcile.fk_orphans(table(spark, sf_dir, "labels").select("doc_id", "quality"), kept, ["doc_id"], ["doc_id"])


@query("SELECT 'oversized' AS rule, CAST(doc_id AS VARCHAR) AS entity, CAST(octet_length(encode(text)) AS VARCHAR) AS detail FROM documents WHERE octet_length(encode(text)) > 30720")
def oversized_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.oversized(table(spark, sf_dir, "documents"), "doc_id", ["text"], gates.DOCUMENT_LIMIT)


@query("""SELECT 'null' AS rule, c AS entity, CAST(n AS VARCHAR) AS detail FROM (SELECT 'o_custkey' AS c, count(*) AS n FROM orders WHERE o_custkey % 7 = 0
  UNION ALL SELECT 'o_orderstatus', count(*) FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 'o_orderdate', 0) WHERE n > 0""")
def null_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(
        F.when(F.col("o_custkey") % 7 != 0, F.col("o_custkey")).alias("o_custkey"), F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("o_orderstatus"), "o_orderdate"
    )
    return gates.null_violations(orders, ["o_custkey", "o_orderstatus", "o_orderdate"])


@query("""WITH b AS (SELECT o_orderkey // 100 + 1 AS batch_seq, CASE WHEN o_orderkey % 700 = 0 THEN NULL WHEN o_orderkey % 500 = 1 THEN o_orderkey - 1 WHEN o_orderkey % 900 = 100 THEN o_orderkey - 5
  WHEN o_orderkey % 1100 = 50 THEN o_orderkey + 1000000 ELSE o_orderkey END AS k FROM orders),
s AS (SELECT batch_seq, min(k) AS lo, max(k) AS hi, count(*) AS n, count(k) AS nk, count(DISTINCT k) AS d FROM b GROUP BY batch_seq),
r AS (SELECT s.*, CASE WHEN s.nk < s.n THEN 'key_null' WHEN s.d < s.nk THEN 'key_repeated' WHEN s.lo <= p.hi THEN 'key_order' WHEN s.hi > 900000 THEN 'key_over_upper' END AS rule
  FROM s LEFT JOIN s p ON p.batch_seq + 1 = s.batch_seq)
SELECT rule, CAST(batch_seq AS VARCHAR) AS entity, CAST(lo AS VARCHAR) AS detail FROM r WHERE rule IS NOT NULL""")
def key_order_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    bad = F.when(k % 700 == 0, F.lit(None)).when(k % 500 == 1, k - 1).when(k % 900 == 100, k - 5).when(k % 1100 == 50, k + 1_000_000).otherwise(k)
    batched = table(spark, sf_dir, "orders").select((F.floor(k / 100) + 1).alias("batch_seq"), bad.alias("k"))
    return gates.key_order_violations(batched, "k", 900_000)


@query("""SELECT 'key_repeated' AS rule, l_orderkey || ',' || l_linenumber AS entity, CAST(count(*) AS VARCHAR) AS detail FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""")
def repeated_key_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.repeated_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])
