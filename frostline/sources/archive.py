"""Archives: verified Parquet files with a manifest, written once and never overwritten.

A job's folder holds data/ (many batches to a file, batch_seq as a column) and manifest/, which appears last and at once: without it the archive does not exist for readers. The manifest has a row per batch
(rows, keys, content digest) and a row per file (bytes, root of its digest tree); ranges/ has the leaves of the trees. How data gets there, and is taken up again after a crash, is in `export`.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frostline.functions.codecs import row_digest
from frostline.operators.gates import key_order_violations, manifest_violations, violation
from frostline.operators.select import batch_summary
from frostline.plans.lineage import cut
from frostline.sources import store
from frostline.sources.digests import differing_ranges, file_fingerprints, range_digests


def batch_digest(batched: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(batch_seq, digest): SHA-256 over the row digests in key order, whatever the files look like. A batch is at most 1000 rows."""
    rows = batched.select("batch_seq", F.struct(F.col(key).alias("k"), row_digest(columns).alias("d")).alias("r"))
    return rows.groupBy("batch_seq").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda x: x["d"]), "\n"), 256).alias("digest"))


MANIFEST = "job_id string, version int, schema string, batch_size int, batch_seq long, n_rows long, n_bytes long, first_key string, last_key string, digest string, name string"


def schema_text(df: DataFrame) -> str:
    """The columns' types and native types, as a manifest tells them."""
    return json.dumps({f.name: [f.dataType.simpleString(), (f.metadata or {}).get("native_type", "")] for f in df.schema if f.name != "batch_seq"})


def read_manifest(spark: SparkSession, uri: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(f"{uri}/manifest")


def file_violations(spark: SparkSession, uri: str) -> DataFrame:
    """Files that are missing, foreign, or differ from the manifest in size or content."""
    want = read_manifest(spark, uri).where("name is not null").select("name", F.col("n_bytes").alias("wb"), F.col("digest").alias("wd"))
    both = want.join(file_fingerprints(range_digests(spark, f"{uri}/data")), "name", "full")
    rule = F.when(F.col("sha256").isNull(), "file_missing").when(F.col("wd").isNull(), "file_foreign").when(F.col("wb") != F.col("n_bytes"), "file_size").when(F.col("wd") != F.col("sha256"), "file_digest")
    return both.select(*violation(rule, F.col("name"), F.coalesce("n_bytes", F.lit(0)))).where("rule is not null")


def damaged_ranges(spark: SparkSession, uri: str) -> DataFrame:
    """(name, range_no, first_byte, what): where the archive's files are not what was written."""
    return differing_ranges(range_digests(spark, f"{uri}/data"), spark.read.parquet(f"{uri}/ranges"))


def verify_archive(spark: SparkSession, uri: str, key: str) -> DataFrame:
    """All that is wrong with an archive: files, columns with their native types, the manifest itself, key order over all batches, and each batch's rows, keys and content."""
    manifest = cut(read_manifest(spark, uri))
    wrong = cut(file_violations(spark, uri))
    data = spark.read.parquet(f"{uri}/data")
    schema = manifest.where(F.col("schema") != schema_text(data)).select(*violation("schema", F.col("job_id"), F.col("version"))).distinct()
    columns = [c for c in data.columns if c != "batch_seq"]
    now = batch_summary(data, key, columns).join(batch_digest(data, key, columns), "batch_seq")
    have = now.select("batch_seq", *(F.col(c).cast("string").alias(f"h_{c}") for c in ("n_rows", "n_bytes", "first_key", "last_key", "digest")))
    both = manifest.where("batch_seq is not null").join(have, "batch_seq", "full")
    rule = F.when(F.col("h_n_rows").isNull(), "batch_missing").when(F.col("job_id").isNull(), "batch_foreign")
    for c in ("n_rows", "n_bytes", "first_key", "last_key", "digest"):
        rule = rule.when(F.col(c).cast("string") != F.col(f"h_{c}"), f"batch_{c}")
    batches = both.select(*violation(rule, F.col("batch_seq"), F.coalesce("h_n_rows", F.lit("0")))).where("rule is not null")
    kind = data.schema[key].dataType.simpleString()
    return wrong.unionByName(schema).unionByName(batches).unionByName(key_order_violations(data, key)).unionByName(manifest_violations(manifest, kind))


def read_archive(spark: SparkSession, uri: str, verified: bool = False) -> DataFrame:
    """The archived rows of the files whose bytes equal the manifest's; a file that differs fails the read. verified: the caller has just verified it."""
    if not store.exists(spark, f"{uri}/manifest"):
        raise FileNotFoundError(f"{uri} has no manifest: it is no finished archive")
    bad = [] if verified else file_violations(spark, uri).limit(1).collect()
    if bad:
        raise ValueError(f"{uri}: {bad[0].rule} {bad[0].entity}")
    return spark.read.parquet(f"{uri}/data")


def import_archive(spark: SparkSession, uri: str, key: str, jobs: DataFrame) -> DataFrame:
    """A job row (job_id, n_rows, n_bytes, basis) for a finished archive found at uri; refused if it doesn't verify or jobs knows the id."""
    if not verify_archive(spark, uri, key).isEmpty():
        raise ValueError(f"{uri} does not verify")
    row = read_manifest(spark, uri).where("batch_seq is not null").groupBy("job_id").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_bytes").alias("n_bytes"))
    fresh = row.join(jobs.select("job_id"), "job_id", "left_anti")
    if fresh.isEmpty():
        raise ValueError(f"the job of {uri} is known already")
    return fresh.withColumn("basis", F.lit("unauthenticated"))


def resume_plan(journal: DataFrame, objects: DataFrame, frozen: dict | None = None, asked: dict | None = None) -> DataFrame:
    """(batch_seq, action): committed batches with their object are left, prepared ones published again, all others exported again.
    journal: batch_seq, state (prepared or committed); objects: batch_seq. frozen and asked hold cutoff and upper key of the job as it began and as it is
    resumed; a job whose rows would be others is refused."""
    if frozen != asked:
        raise ValueError("a job is resumed with the cutoff and upper key that it began with")
    both = journal.join(objects.select("batch_seq", F.lit(True).alias("there")), "batch_seq", "full")
    done = F.col("state").eqNullSafe("committed")
    action = F.when(done & F.col("there"), "keep").when(done, "lost").when(F.col("state").eqNullSafe("prepared"), "publish").otherwise("export")
    return both.select("batch_seq", action.alias("action"))
