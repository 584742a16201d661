"""Codecs, digests, documents, profiles and catalogs over the test tables."""

from __future__ import annotations

import uuid
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frostline.functions import codecs
from frostline.operators import gates, reports
from frostline.plans.model import Column
from frostline.operators.select import estimate_eligible
from frostline.plans.lineage import cut
from frostline.queries.common import ARC_SQL, CUT, PLAN, archived_orders, okey, query, scratch, table
from frostline.sources import archive, catalog, export, footers, index, scan
from frostline.sources import database as jdbc

# The test tables' columns and types.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double,"
    " l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}
TABLES = tuple(SCHEMAS)
KEYS = {t: [c.split()[0] for c in s.split(", ")[:1]] for t, s in SCHEMAS.items()} | {"conversations": ["conv_id", "turn"], "lineitem": ["l_orderkey", "l_linenumber"]}


def _tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: table(spark, sf_dir, t) for t in TABLES}


def _columns_sql() -> str:
    """(table, position, name, type, is_time, n_rows, n_nulls) of every column."""
    each = [
        f"SELECT '{t}' AS \"table\", {i} AS position, '{c}' AS name, '{k}' AS type, {str(k.startswith('timestamp')).lower()} AS is_time, count(*) AS n_rows, count(*) - count({c}) AS n_nulls FROM {t}"
        for t, s in SCHEMAS.items()
        for i, (c, k) in enumerate(x.split() for x in s.split(", "))
    ]
    return "col AS (" + " UNION ALL ".join(each) + ")"


def _keys_sql() -> str:
    each = [
        f"SELECT '{t}' AS \"table\", '{','.join(k)}' AS key, count(*) AS n_rows, count(*) = count(DISTINCT ({', '.join(k)})) AND count(*) FILTER ({' OR '.join(f'{c} IS NULL' for c in k)}) = 0 AS uniq FROM {t}"
        for t, k in KEYS.items()
    ]
    return "keys AS (" + " UNION ALL ".join(each) + ")"


@query("""SELECT 'type' AS rule, c AS entity, n AS detail FROM (SELECT 'amount' AS c, count(*) AS n FROM orders WHERE o_orderkey % 7 = 0 UNION ALL SELECT 'flag', count(*) FROM orders
  WHERE o_orderkey % 5 = 3 UNION ALL SELECT 'small', count(*) FROM orders WHERE o_orderkey > 9999 AND o_orderkey % 2 = 1) WHERE n > 0""")
def native_type_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = table(spark, sf_dir, "orders").select(
        F.when(okey() % 7 == 0, F.concat(okey().cast("string"), F.lit("x"))).otherwise(okey().cast("string")).alias("amount"),
        F.element_at(F.array(*(F.lit(x) for x in ("t", "true", "f", "yes", "false"))), (okey() % 5 + 1).cast("int")).alias("flag"),
        (okey() * F.when((okey() > 9999) & (okey() % 2 == 1), 100).otherwise(1) % 10_000_000 + F.when((okey() > 9999) & (okey() % 2 == 1), 40_000).otherwise(F.lit(0) - F.greatest(okey() - 9999, F.lit(0)))).cast("string").alias("small"),
    )
    return codecs.type_violations(text, [Column("amount", "int8"), Column("flag", "bool"), Column("small", "int2")])


@query("""SELECT o_orderkey AS id, o_orderkey % 2 = 0 AS flag, CAST(o_orderkey * 1.5 AS VARCHAR) AS amount FROM orders""")
def archive_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = table(spark, sf_dir, "orders").select(
        okey().cast("string").alias("id"), F.when(okey() % 4 == 0, "t").when(okey() % 4 == 2, "true").when(okey() % 4 == 1, "f").otherwise("false").alias("flag"),
        (okey() * F.lit(1.5).cast("decimal(2,1)")).cast("decimal(20,1)").cast("string").alias("amount"),
    )
    return codecs.to_archive_types(text, [Column("id", "int8", False), Column("flag", "bool"), Column("amount", "numeric")])


@query("SELECT event_id AS key, lower(hex(encode(props))) AS body, props AS raw FROM events")
def document_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = codecs.envelope(table(spark, sf_dir, "events"), "event_id", "props")
    return packed.join(codecs.unenvelope(packed), "key")


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS at, strftime(ts, '%Y-%m-%d') AS day FROM events")
def temporal_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", codecs.temporal_text(F.col("ts"), "timestamp").alias("at"), codecs.temporal_text(F.col("ts"), "date").alias("day"))


@query("""SELECT event_id, CASE WHEN m < 0 THEN '-' ELSE '' END || CASE WHEN abs(m) // 3600000000 < 100 THEN lpad(CAST(abs(m) // 3600000000 AS VARCHAR), 2, '0') ELSE CAST(abs(m) // 3600000000 AS VARCHAR) END || ':' ||
  lpad(CAST(abs(m) // 60000000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(abs(m) // 1000000 % 60 AS VARCHAR), 2, '0') || '.' || lpad(CAST(abs(m) % 1000000 AS VARCHAR), 6, '0') AS took
FROM (SELECT event_id, (event_id - 50) * 7654321 AS m FROM events)""")
def duration_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", codecs.duration_text((F.col("event_id") - 50) * 7654321).alias("took"))


@query("""SELECT 'zero_date' AS rule, CAST(o_orderkey AS VARCHAR) AS entity, CASE WHEN o_orderkey % 35 = 0 THEN 'day,due' WHEN o_orderkey % 5 = 0 THEN 'day' ELSE 'due' END AS detail FROM orders WHERE o_orderkey % 5 = 0 OR o_orderkey % 7 = 0""")
def zero_date_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    text = table(spark, sf_dir, "orders").select("o_orderkey", F.when(okey() % 5 == 0, "0000-00-00").otherwise(day).alias("day"), F.when(okey() % 7 == 0, F.concat(F.substring(day, 1, 8), F.lit("00"))).otherwise(day).alias("due"))
    return codecs.zero_dates(text, "o_orderkey", ["day", "due"])


@query("""SELECT o_orderkey, '{"o_orderkey":' || o_orderkey || ',"open":' || CASE WHEN o_orderstatus = 'O' THEN 'true' ELSE 'false' END || ',"half":' || CASE WHEN o_orderkey % 3 = 0 THEN 'null' ELSE (o_orderkey % 1000) || '.5' END ||
  ',"o_orderdate":"' || CAST(o_orderdate AS VARCHAR) || '"}' AS value FROM orders""")
def native_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = F.when(okey() % 3 != 0, (okey() % 1000).cast("double") + 0.5)
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderstatus") == "O").alias("open"), half.alias("half"), "o_orderdate")
    return o.select("o_orderkey", codecs.native_value(o, o.columns).alias("value"))


@query("""WITH k AS (SELECT o_orderkey, (o_orderkey::HUGEINT * 1229782938247303::HUGEINT) % 18446744073709551616::HUGEINT AS k FROM orders)
SELECT o_orderkey, CAST(k - 9223372036854775808::HUGEINT AS BIGINT) AS token, CAST(k AS VARCHAR) AS back FROM k""")
def unsigned_key_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unsigned keys over the whole range, some for every order."""
    wide = okey().cast("decimal(20,0)") * F.lit(1229782938247303).cast("decimal(17,0)")
    big = table(spark, sf_dir, "orders").select("o_orderkey", (wide % F.lit(str(1 << 64)).cast("decimal(20,0)")).cast("decimal(20,0)").alias("k"))
    token = big.select("o_orderkey", codecs.key_token(F.col("k")).alias("token"))
    return token.withColumn("back", codecs.key_from_token(F.col("token")).cast("string"))


@query("""SELECT o_orderkey, o_orderkey % 4 = 0 OR o_orderkey % 4 = 2 AND o_orderkey < 1845 AS canonical FROM orders""")
def canonical_key_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys as they are, with a leading zero, with 16 zeros behind (over the limit of 64 bits from 1845 on), and with a sign."""
    k = okey().cast("string")
    text = F.when(okey() % 4 == 1, F.concat(F.lit("0"), k)).when(okey() % 4 == 2, F.concat(k, F.lit("0" * 16))).when(okey() % 4 == 3, F.concat(F.lit("-"), k)).otherwise(k)
    return table(spark, sf_dir, "orders").select("o_orderkey", codecs.canonical_unsigned(text).alias("canonical"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, nullif(o_orderstatus, 'P') AS o_orderstatus, CAST(o_orderdate AS VARCHAR) AS o_orderdate FROM orders")
def text_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("o_orderstatus", F.nullif(F.col("o_orderstatus"), F.lit("P")))
    return codecs.to_text_row(o, ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate"])


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN false ELSE true END AS same FROM orders""")
def exact_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    zero = F.when(okey() % 2 == 0, F.lit(0.0)).otherwise(F.lit(float("nan")))
    other = F.when(okey() % 7 == 0, F.when(okey() % 2 == 0, (F.lit(0.0) - F.col("o_totalprice")) * F.lit(0.0)).otherwise(F.lit(0.0))).otherwise(zero)
    both = o.select("o_orderkey", F.struct(zero.alias("v"), F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("s")).alias("a"), F.struct(other.alias("v"), F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("s")).alias("b"))
    return both.select("o_orderkey", codecs.rows_equal(both, "a", "b", ["v", "s"]).alias("same"))


@query("""SELECT o_orderkey, sha256('{"o_orderkey":"' || o_orderkey || '","s":' || CASE WHEN o_orderstatus = 'P' THEN 'null' ELSE '"' || o_orderstatus || '"' END || '}') AS digest FROM orders""")
def row_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("s"))
    return o.select("o_orderkey", codecs.row_digest(["o_orderkey", "s"]).alias("digest"))


@query(f"""WITH {ARC_SQL}, d AS (SELECT batch_seq, o_orderkey, sha256('{{"o_orderkey":"' || o_orderkey || '","o_custkey":"' || o_custkey || '"}}') AS d FROM arc)
SELECT batch_seq, sha256(string_agg(d, chr(10) ORDER BY o_orderkey)) AS digest FROM d GROUP BY batch_seq""")
def batch_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.batch_digest(archived_orders(spark, sf_dir), "o_orderkey", ["o_orderkey", "o_custkey"])


@query("SELECT 'non_finite' AS rule, CAST(event_id AS VARCHAR) AS entity, 'value' AS detail FROM events WHERE event_id % 9 = 0 OR event_id % 10 = 3")
def non_finite_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    bad = F.when(k % 9 == 0, F.lit(float("nan"))).when(k % 10 == 3, F.lit(float("-inf"))).otherwise(F.col("value"))
    return codecs.non_finite(table(spark, sf_dir, "events").select("event_id", bad.alias("value")), "event_id")


@query(f"""WITH {_columns_sql()} SELECT "table", sha256(string_agg(name || ':' || type || ':null', chr(10) ORDER BY position)) AS signature, any_value(n_rows) AS n_rows, CAST(sum(n_nulls) AS BIGINT) AS n_nulls
FROM col GROUP BY "table\"""")
def schema_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each table's signature, and how many rows and nulls it holds under this schema."""
    tables = _tables(spark, sf_dir)
    held = catalog.column_nulls(tables).groupBy("table").agg(F.max("n_rows").alias("n_rows"), F.sum("n_nulls").alias("n_nulls"))
    return codecs.schema_signature(catalog.discover(tables)).select("table", "signature").join(held, "table")


@query("""WITH RECURSIVE r AS (SELECT doc_id // 1000 + 1 AS batch_seq, doc_id AS key, 6 * coalesce(strlen(text), 0) + 4 + 544 AS size, row_number() OVER (PARTITION BY doc_id // 1000 ORDER BY doc_id) AS i FROM documents),
c AS (SELECT batch_seq, key, i, 1 AS chunk, 1 AS n, size AS total FROM r WHERE i = 1 UNION ALL
  SELECT r.batch_seq, r.key, r.i, CASE WHEN n >= 1000 OR total + size > 786432 THEN chunk + 1 ELSE chunk END, CASE WHEN n >= 1000 OR total + size > 786432 THEN 1 ELSE n + 1 END,
    CASE WHEN n >= 1000 OR total + size > 786432 THEN size ELSE total + size END FROM c JOIN r ON r.batch_seq = c.batch_seq AND r.i = c.i + 1)
SELECT batch_seq, key, CAST(chunk AS BIGINT) AS chunk FROM c""")
def wide_row_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (F.floor(F.col("doc_id") / 1000) + 1).alias("batch_seq"))
    return reports.pack_chunks(docs, "doc_id", ["text"])


def documents_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON documents (key, raw): every 7th has another key inside, every 11th no time, every 13th a wrong one."""
    k = F.col("event_id")
    key = k + F.when(k % 7 == 0, 1).otherwise(0)
    at = F.when(k % 13 == 0, F.lit("soon")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    body = F.concat(F.lit('{"_id":"'), key.cast("string"), F.lit('"'), F.when(k % 11 == 0, "").otherwise(F.concat(F.lit(',"at":"'), at, F.lit('"'))), F.lit(',"props":'), F.col("props"), F.lit("}"))
    return table(spark, sf_dir, "events").select(k.cast("string").alias("key"), body.alias("raw"))


@query("""SELECT CASE WHEN event_id % 7 = 0 THEN 'key_differs' ELSE 'time_invalid' END AS rule, CAST(event_id AS VARCHAR) AS entity, CASE WHEN event_id % 11 = 0 THEN '' WHEN event_id % 13 = 0 THEN 'soon'
  ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS detail FROM events WHERE event_id % 7 = 0 OR event_id % 11 = 0 OR event_id % 13 = 0""")
def document_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.document_violations(documents_of_events(spark, sf_dir), "raw", "key", "at")


@query("""SELECT CASE WHEN event_id % 17 = 0 THEN 'key_type' ELSE 'time_type' END AS rule, CAST(event_id AS VARCHAR) AS entity, CASE WHEN event_id % 17 = 0 THEN 'BIGINT' WHEN event_id % 19 = 0 THEN 'ARRAY' ELSE 'OBJECT' END AS detail
FROM events WHERE event_id % 17 = 0 OR event_id % 19 = 0 OR event_id % 23 = 0 UNION ALL SELECT 'ttl_index', CASE WHEN event_id % 2 = 0 THEN 'even' ELSE 'odd' END || '.' || event_id, CAST(event_id * 60 AS VARCHAR) FROM events WHERE event_id % 29 = 0""")
def document_type_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with numbers for keys, arrays and objects for times; events stand for indexes, too, some of which expire documents."""
    k, at = F.col("event_id"), F.concat(F.lit('"'), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit('"'))
    key = F.when(k % 17 == 0, k.cast("string")).otherwise(F.concat(F.lit('"'), k.cast("string"), F.lit('"')))
    time = F.when(k % 19 == 0, F.concat(F.lit("["), at, F.lit("]"))).when(k % 23 == 0, F.concat(F.lit('{"t":'), at, F.lit("}"))).otherwise(at)
    events = table(spark, sf_dir, "events")
    docs = events.select(k.cast("string").alias("key"), F.concat(F.lit('{"_id":'), key, F.lit(',"at":'), time, F.lit("}")).alias("raw"))
    indexes = events.select(F.when(k % 2 == 0, "even").otherwise("odd").alias("collection"), k.cast("string").alias("name"), F.when(k % 29 == 0, k * 60).alias("expire_after"))
    return gates.document_type_violations(docs, "raw", "key", "at").unionByName(gates.ttl_violations(indexes))


@query("""SELECT CAST(event_id AS VARCHAR) AS key FROM events WHERE event_id % 7 <> 0 AND event_id % 11 <> 0 AND event_id % 13 <> 0 AND date_trunc('second', ts) < TIMESTAMP '2024-01-15'""")
def document_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.document_eligible(documents_of_events(spark, sf_dir), "raw", "key", "at", "2024-01-15").select("key")


@query("""SELECT CAST(event_id + CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END AS VARCHAR) AS key, CASE WHEN event_id % 11 <> 0 AND event_id % 13 <> 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS at FROM events""")
def document_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = scan.as_documents(documents_of_events(spark, sf_dir), "raw", "_id", "at")
    return docs.select("key", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("SELECT f AS field, t AS type, count(*) AS n FROM (SELECT 'k' AS f, CASE WHEN event_id % 3 = 0 THEN 'string' ELSE 'integer' END AS t FROM events UNION ALL SELECT 'ok', 'boolean' FROM events WHERE event_id % 2 = 0) GROUP BY f, t")
def document_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    v = F.when(k % 9 == 0, F.lit('"123"')).when(k % 9 == 3, F.lit('"true"')).when(k % 9 == 6, F.lit('"{x"')).otherwise(F.get_json_object("props", "$.k"))
    raw = F.concat(F.lit('{"k":'), v, F.when(k % 2 == 0, F.lit(',"ok":true')).otherwise(""), F.lit("}"))
    return catalog.profile_document_fields(table(spark, sf_dir, "events").select(raw.alias("raw")), "raw")


@query("""SELECT count(*) AS n_rows, 0::BIGINT AS key_nulls, count(DISTINCT o_orderkey) AS keys, count(*) FILTER (o_orderkey % 7 = 0) AS day_nulls,
  min(CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate END) AS day_min, max(CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate END) AS day_max FROM orders""")
def table_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(okey() % 7 != 0, F.col("o_orderdate")).alias("day"))
    return catalog.profile_table(o, "o_orderkey", ["day"])


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def archive_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    keys = o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("o_orderkey"))
    return scan.lookup(o, keys, "o_orderkey", ["o_orderkey", "o_totalprice"])


@query(f"WITH {ARC_SQL} SELECT o_orderkey, o_totalprice FROM arc WHERE o_orderkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def indexed_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive's rows of many keys, by zones and filters of its files."""
    uri, top = scratch(spark), scratch(spark)
    export.write_archive(archived_orders(spark, sf_dir), uri, "orders-1", "o_orderkey", ["o_orderkey", "o_totalprice"])
    index.build_index(spark, f"{uri}/data", "o_orderkey", top)
    keys = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("o_orderkey"))
    return index.lookup_indexed(spark, f"{uri}/data", top, keys, "o_orderkey", ["o_orderkey", "o_totalprice"])


DERBY = "org.apache.derby.jdbc.EmbeddedDriver"


def database(spark: SparkSession, sf_dir: str) -> str:
    """Customers and orders in an embedded database of this process, with keys, a foreign key and indexes; its tables are made by Spark's JDBC writer."""
    url = f"jdbc:derby:memory:d{uuid.uuid4().hex};create=true"
    with jdbc.Metadata(spark, url, driver=DERBY) as db:
        run = db.connection.createStatement().execute
        # a third of the orders stand at keys far away, as in a table that took over another
        orders = table(spark, sf_dir, "orders").select((okey() + F.when(okey() % 3 == 0, 10**12).otherwise(0)).alias("OKEY"), F.col("o_custkey").alias("CKEY"), F.col("o_totalprice").alias("PRICE"), F.col("o_orderdate").cast("timestamp").alias("PLACED"))
        customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("CKEY"), F.col("c_mktsegment").alias("SEGMENT"))
        for name, df in (("CUSTOMERS", customers), ("ORDERS", orders)):
            types = "CKEY BIGINT, SEGMENT VARCHAR(40)" if name == "CUSTOMERS" else "OKEY BIGINT, CKEY BIGINT, PRICE DOUBLE, PLACED TIMESTAMP"
            df.coalesce(4).write.jdbc(url, name, mode="overwrite", properties={"driver": DERBY, "createTableColumnTypes": types})
        for ddl in ("CUSTOMERS ALTER CKEY NOT NULL", "ORDERS ALTER OKEY NOT NULL", "CUSTOMERS ADD CONSTRAINT CUSTOMERS_KEY PRIMARY KEY (CKEY)", "ORDERS ADD CONSTRAINT ORDERS_KEY PRIMARY KEY (OKEY)", "ORDERS ADD CONSTRAINT ORDER_CUSTOMER FOREIGN KEY (CKEY) REFERENCES CUSTOMERS (CKEY)"):
            run(f"ALTER TABLE {ddl}")
        run("CREATE INDEX PLACED_AT ON ORDERS (PLACED, OKEY)")
    return url


@query("SELECT o_orderkey + CASE WHEN o_orderkey % 3 = 0 THEN 1000000000000 ELSE 0 END AS okey, o_totalprice AS price FROM orders WHERE o_totalprice > 1000")
def jdbc_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders read back from a database by key ranges that the database's own counts have cut."""
    rows = jdbc.scan_table(spark, database(spark, sf_dir), "ORDERS", ["OKEY", "PRICE"], "OKEY", partitions=8, driver=DERBY)
    return rows.where("PRICE > 1000").select(F.col("OKEY").alias("okey"), F.col("PRICE").alias("price"))


@query("""WITH n AS (SELECT count(*) AS n FROM orders)
SELECT unnest(['column', 'column', 'column', 'column', 'column', 'column', 'key', 'key', 'foreign key', 'range index']) AS kind, unnest(['CUSTOMERS', 'CUSTOMERS', 'ORDERS', 'ORDERS', 'ORDERS', 'ORDERS', 'CUSTOMERS', 'ORDERS', 'ORDERS', 'ORDERS']) AS "table",
  unnest(['CKEY BIGINT not null', 'SEGMENT VARCHAR null', 'OKEY BIGINT not null', 'CKEY BIGINT null', 'PRICE DOUBLE null', 'PLACED TIMESTAMP null', 'CKEY', 'OKEY', 'CKEY -> CUSTOMERS CKEY', 'PLACED']) AS detail, n AS n_orders FROM n""")
def database_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the database itself tells of its tables, and its time column's index judged by range_indexes(); with the orders that it holds."""
    url = database(spark, sf_dir)
    with jdbc.Metadata(spark, url, driver=DERBY) as db:
        columns, keys, pairs, indexes = db.columns("APP"), db.keys("APP"), db.foreign_key_pairs("APP"), db.indexes("APP")
    fks = catalog.fold_foreign_keys(pairs.withColumn("on_delete", F.lit("a")))
    times = columns.where("type = 'TIMESTAMP'").groupBy("schema", "table").agg(F.collect_list("name").alias("time_columns"))
    own = F.struct("name", F.lit("btree").alias("method"), "columns", F.lit(True).alias("valid"), F.lit(False).alias("partial"), F.lit(False).alias("has_expressions"))
    ranges = reports.range_indexes(times.join(indexes.groupBy("schema", "table").agg(F.collect_list(own).alias("indexes")), ["schema", "table"])).where(F.array_contains("full_indexes", "PLACED_AT"))
    row = lambda df, kind, t, detail: df.select(F.lit(kind).alias("kind"), F.col(t).alias("table"), detail.alias("detail"))
    out = row(columns, "column", "table", F.concat_ws(" ", "name", "type", F.when(F.col("nullable"), "null").otherwise("not null"))).unionByName(row(keys, "key", "table", F.array_join("columns", ",")))
    out = out.unionByName(row(fks, "foreign key", "child", F.concat(F.array_join("child_cols", ","), F.lit(" -> "), "parent", F.lit(" "), F.array_join("parent_cols", ",")))).unionByName(row(ranges, "range index", "table", F.col("column")))
    return out.withColumn("n_orders", F.lit(jdbc.scan_table(spark, url, "ORDERS", ["OKEY"], "OKEY", partitions=4, driver=DERBY).count()))


KEYED = ("region", "nation", "customer", "supplier", "orders", "events", "conversations", "labels")


def _key_sets_sql() -> str:
    parts = []
    for t in KEYED:
        names = [x.split()[0] for x in SCHEMAS[t].split(", ")]
        unique = lambda s: f"(SELECT count(*) = count(DISTINCT ({', '.join(s)})) AND count(*) FILTER ({' OR '.join(f'{c} IS NULL' for c in s)}) = 0 FROM {t})"  # noqa: B023, E731
        ones = [f"SELECT ['{c}'] AS key, {unique([c, c])} AS own, false AS other" for c in names]
        twos = [f"SELECT ['{a}', '{b}'], {unique([a, b])}, {unique([a, a])} OR {unique([b, b])}" for a, b in combinations(names, 2)]
        parts.append(f"SELECT '{t}' AS \"table\", array_to_string(key, ',') AS key FROM ({' UNION ALL '.join(ones + twos)}) WHERE own AND NOT other")
    return " UNION ALL ".join(parts)


@query(_key_sets_sql())
def discovered_key_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every least set of one or two columns that is unique in its table."""
    return catalog.key_sets({t: table(spark, sf_dir, t) for t in KEYED}).select("table", F.array_join("key", ",").alias("key"))


@query("""SELECT unnest(['o_orderkey', 'o_custkey', 'o_totalprice', 'o_orderdate', 'o_orderstatus']) AS name, count(*) AS n_rows, CAST(0 AS BIGINT) AS n_nulls, true AS values_fit, unnest([true, true, true, true, NULL]) AS median_fits FROM orders""")
def merged_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders profiled year by year, the profiles merged, and whether what they tell is within 5 % of the values and 3 % of the rows."""
    o, names = table(spark, sf_dir, "orders"), ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderstatus"]
    year, parts = F.year("o_orderdate"), None
    for y in [r[0] for r in o.select(year).distinct().collect()]:  # a few years
        one = catalog.column_sketches(o.where(year == y), names)
        parts = one if parts is None else parts.unionByName(one)
    told = cut(catalog.sketch_estimates(catalog.merge_sketches(parts)))
    medians = {r.name: r.quantile for r in told.where("quantile is not null").collect()}
    as_number = lambda c: F.unix_micros(F.col(c).cast("timestamp")) if c == "o_orderdate" else F.col(c)
    exact = o.agg(*(F.count_distinct(c).alias(f"d_{c}") for c in names), *(F.count_if(as_number(c) <= m).alias(f"m_{c}") for c, m in medians.items()))
    true = exact.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(f"d_{c}").alias("d"), (F.col(f"m_{c}") if c in medians else F.lit(None).cast("long")).alias("m")) for c in names))).alias("t")).select("t.*")
    fits = [(F.abs(F.col("n_values") - F.col("d")) <= 0.05 * F.col("d") + 1).alias("values_fit"), (F.abs(F.col("m") - F.col("n_rows") / 2) <= 0.03 * F.col("n_rows")).alias("median_fits")]
    return told.join(true, "name").select("name", "n_rows", "n_nulls", *fits)


@query(f"SELECT count(*) AS n_rows, count(*) FILTER (o_orderdate < {CUT}) AS eligible, true AS within, true AS known FROM orders")
def eligible_by_footers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bounds of eligible orders that the files' footers give, held against the count."""
    bounds = footers.eligible_bounds(footers.row_groups(spark, f"{sf_dir}/orders.parquet", "o_orderdate"), PLAN.cutoff)
    n = estimate_eligible(table(spark, sf_dir, "orders"), PLAN).first().eligible
    return bounds.select("n_rows", F.lit(n).alias("eligible"), F.lit(n).between(F.col("at_least"), F.col("at_most")).alias("within"), (F.col("unknown_rows") == 0).alias("known"))


@query()
def measured_assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """archival_assessment with the sizes of the files and the keys that the rows have."""
    tables = {t: table(spark, sf_dir, t) for t in TABLES}
    known = catalog.tables_of(catalog.discover(tables)).join(catalog.unique_keys(tables, KEYS), ["schema", "table"])
    rows = known.select("schema", "table", "primary_key", "time_columns", F.col("n_rows").alias("estimated_rows"), F.lit(False).alias("partitioned"))
    return reports.assess(rows, catalog.table_statistics(tables)).select("rank", "table", "total_bytes", F.array_join("findings", ",").alias("findings"))


@query("SELECT l_orderkey, l_quantity FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01'")
def table_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.scan(spark, f"{sf_dir}/lineitem.parquet", ["l_orderkey", "l_quantity", "l_shipdate"]).where(F.col("l_shipdate") < F.lit("1996-01-01").cast("timestamp_ntz")).drop("l_shipdate")


@query(f'WITH {_columns_sql()} SELECT "table", position, name, type, true AS nullable, is_time, n_rows, n_nulls FROM col')
def discovered_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every column of every table, and how many of its rows have no value there."""
    tables = _tables(spark, sf_dir)
    return catalog.discover(tables).join(catalog.column_nulls(tables), ["schema", "table", "name"]).drop("schema")


@query(f'WITH {_keys_sql()} SELECT "table", CASE WHEN uniq THEN key ELSE \'\' END AS primary_key, n_rows FROM keys')
def discovered_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.unique_keys(_tables(spark, sf_dir), KEYS).select("table", F.array_join("primary_key", ",").alias("primary_key"), "n_rows")


@query()
def table_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.table_statistics(_tables(spark, sf_dir))


@query(f"""WITH {_columns_sql()}, {_keys_sql()}, t AS (SELECT "table", count(*) AS n_columns, bool_or(is_time) AS timed FROM col GROUP BY "table"),
a AS (SELECT "table", CASE WHEN k.n_rows % 2 = 0 THEN k.n_rows * n_columns * 8 END AS total_bytes, CASE WHEN NOT uniq THEN 'missing_primary_key' END AS f1, CASE WHEN NOT timed THEN 'no_time_column' END AS f2,
  CASE WHEN "table" = 'part' THEN 'unknown_row_estimate' END AS f3, CASE WHEN "table" = 'events' THEN 'partitioned_parent' END AS f4 FROM t JOIN keys k USING ("table"))
SELECT CAST(row_number() OVER (ORDER BY total_bytes DESC NULLS LAST, "table") AS INTEGER) AS rank, "table", total_bytes, concat_ws(',', f1, f2, f3, f4) AS findings FROM a""")
def archival_assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys and row counts are read from the rows; tables of an odd number of rows stand for those of unknown size, part for one without an estimate, events for a partitioned one."""
    tables = _tables(spark, sf_dir)
    known = catalog.tables_of(catalog.discover(tables)).join(catalog.unique_keys(tables, KEYS), ["schema", "table"])
    rows = known.select("schema", "table", "primary_key", "time_columns", F.when(F.col("table") != "part", F.col("n_rows")).alias("estimated_rows"), (F.col("table") == "events").alias("partitioned"))
    stats = known.select("schema", "table", F.when(F.col("n_rows") % 2 == 0, F.col("n_rows") * F.size("columns") * 8).alias("total_bytes"))
    return reports.assess(rows, stats).select("rank", "table", "total_bytes", F.array_join("findings", ",").alias("findings"))


@query("""WITH x AS (SELECT o_custkey AS t, CAST(o_orderkey AS VARCHAR) AS name, o_orderstatus AS s, o_orderkey AS k FROM orders)
SELECT CAST(t AS VARCHAR) AS "table", coalesce(string_agg(CASE WHEN s <> 'P' AND k % 3 <> 0 AND k % 5 <> 0 AND k % 2 = 0 AND k % 7 <> 0 THEN name END, ',' ORDER BY k), '') AS full_indexes,
  coalesce(string_agg(CASE WHEN s <> 'P' AND k % 3 <> 0 AND k % 5 <> 0 AND k % 2 = 0 AND k % 7 = 0 THEN name END, ',' ORDER BY k), '') AS partial_indexes FROM x GROUP BY t""")
def range_index_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders stand for indexes of their customer's table."""
    index = F.struct(
        okey().alias("k"), okey().cast("string").alias("name"), F.when(F.col("o_orderstatus") == "P", "hash").when(F.col("o_orderstatus") == "O", "brin").otherwise("btree").alias("method"),
        F.when(okey() % 2 == 0, F.array(F.lit("day"), F.lit("id"))).otherwise(F.array(F.lit("id"), F.lit("day"))).alias("columns"),
        (okey() % 3 != 0).alias("valid"), (okey() % 7 == 0).alias("partial"), (okey() % 5 == 0).alias("has_expressions"),
    )
    tables = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("string").alias("table")).agg(F.sort_array(F.collect_list(index)).alias("indexes"))
    found = reports.range_indexes(tables.select(F.lit("main").alias("schema"), "table", F.array(F.lit("day")).alias("time_columns"), "indexes"))
    return found.select("table", F.array_join("full_indexes", ",").alias("full_indexes"), F.array_join("partial_indexes", ",").alias("partial_indexes"))


@query("""SELECT 'fk-' || o_custkey AS name, string_agg('c' || o_orderkey, ',' ORDER BY o_orderdate, o_orderkey) AS child_cols, string_agg('p' || o_orderkey, ',' ORDER BY o_orderdate, o_orderkey) AS parent_cols,
  CASE o_custkey % 3 WHEN 0 THEN 'CASCADE' WHEN 1 THEN 'SET NULL' ELSE 'NO ACTION' END AS on_delete FROM orders GROUP BY o_custkey""")
def folded_foreign_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders stand for the column pairs of their customer's key, in order of date."""
    c = F.col("o_custkey")
    pairs = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("fk-"), c.cast("string")).alias("name"), F.lit("child").alias("child"), F.lit("parent").alias("parent"), F.struct("o_orderdate", "o_orderkey").alias("position"),
        F.concat(F.lit("c"), okey().cast("string")).alias("child_col"), F.concat(F.lit("p"), okey().cast("string")).alias("parent_col"), F.when(c % 3 == 0, "c").when(c % 3 == 1, "n").otherwise("a").alias("on_delete"),
    )
    folded = catalog.fold_foreign_keys(pairs)
    return folded.select("name", F.array_join("child_cols", ",").alias("child_cols"), F.array_join("parent_cols", ",").alias("parent_cols"), "on_delete")


@query("""SELECT 'fk_type' AS rule, 'fk' || o_orderkey || '.c' AS entity, CASE WHEN o_orderkey % 7 = 0 THEN 'int <> bigint' ELSE 'missing <> bigint' END AS detail FROM orders WHERE o_orderkey % 7 = 0 OR o_orderkey % 11 = 0""")
def fk_type_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order stands for a key from its own child table to its own parent table."""
    o, name = table(spark, sf_dir, "orders"), okey().cast("string")
    child, parent = F.concat(F.lit("c"), name), F.concat(F.lit("p"), name)
    fks = o.select(F.concat(F.lit("fk"), name).alias("name"), child.alias("child"), F.array(F.lit("c")).alias("child_cols"), parent.alias("parent"), F.array(F.lit("p")).alias("parent_cols"))
    own = o.where((okey() % 11 != 0) | (okey() % 7 == 0)).select(child.alias("table"), F.lit("c").alias("name"), F.when(okey() % 7 == 0, "int").otherwise("bigint").alias("type"))
    columns = own.unionByName(o.select(parent.alias("table"), F.lit("p").alias("name"), F.lit("bigint").alias("type")))
    return gates.fk_violations(fks, columns)


@query("""SELECT CASE WHEN o_orderkey % 7 = 0 THEN 'fk_type' WHEN o_orderkey % 11 = 0 THEN 'fk_modifier' ELSE 'fk_collation' END AS rule, 'fk' || o_orderkey || '.c' AS entity,
  CASE WHEN o_orderkey % 7 = 0 THEN 'text <> varchar' WHEN o_orderkey % 11 = 0 THEN '20 <> 10' ELSE 'de <> missing' END AS detail FROM orders WHERE o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 OR o_orderkey % 13 = 0""")
def fk_modifier_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order stands for a key between text columns that differ in type, length or collation now and then."""
    o, name = table(spark, sf_dir, "orders"), okey().cast("string")
    child, parent = F.concat(F.lit("c"), name), F.concat(F.lit("p"), name)
    fks = o.select(F.concat(F.lit("fk"), name).alias("name"), child.alias("child"), F.array(F.lit("c")).alias("child_cols"), parent.alias("parent"), F.array(F.lit("p")).alias("parent_cols"))
    kind = lambda t, c, k, m, g: o.select(t.alias("table"), F.lit(c).alias("name"), k.alias("type"), m.alias("modifier"), g.alias("collation"))
    own = kind(child, "c", F.when(okey() % 7 == 0, "text").otherwise("varchar"), F.when(okey() % 11 == 0, 20).otherwise(10), F.when(okey() % 13 == 0, "de"))
    return gates.fk_violations(fks, own.unionByName(kind(parent, "p", F.lit("varchar"), F.lit(10), F.lit(None).cast("string"))))
