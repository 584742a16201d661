"""Gates: each gives rows (rule, entity, detail) of what is wrong; no rows let the data pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frostline.operators.select import text_bytes

ROW_LIMIT = 64 * 1024
DOCUMENT_LIMIT = 30 * 1024


def violation(rule: str | Column, entity: str | Column, detail: str | Column) -> list[Column]:
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return [as_col(rule).cast("string").alias("rule"), as_col(entity).cast("string").alias("entity"), as_col(detail).cast("string").alias("detail")]


def oversized(df: DataFrame, key: str, columns: list[str], limit: int = ROW_LIMIT) -> DataFrame:
    """Rows whose text is over limit bytes; they are refused, never cut."""
    n = text_bytes(df, columns)
    return df.where(n > limit).select(*violation("oversized", F.col(key), n))


def null_violations(df: DataFrame, required: list[str]) -> DataFrame:
    """Columns that must not be null and are, with the number of rows; one pass."""
    counted = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in required))
    rows = counted.select(F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.col(c).alias("n")) for c in required))).alias("v"))
    return rows.where("v.n > 0").select(*violation("null", F.col("v.c"), F.col("v.n")))


def document_violations(df: DataFrame, raw: str, key: str, time_field: str) -> DataFrame:
    """JSON documents whose key is not the document's own, or whose time field is not one time."""
    body_key, at = F.get_json_object(raw, "$._id"), F.get_json_object(raw, f"$.{time_field}")
    rule = F.when(body_key.isNull(), "key_missing").when(body_key != F.col(key).cast("string"), "key_differs").when(at.isNull() | F.try_to_timestamp(at).isNull(), "time_invalid")
    return df.select(*violation(rule, F.col(key), F.coalesce(at, F.lit("")))).where("rule is not null")


def document_type_violations(df: DataFrame, raw: str, key: str, time_field: str, key_type: str = "STRING") -> DataFrame:
    """Documents whose key is not of key_type (a type name of schema_of_variant), or whose time is an array or object: an array of times is no time."""
    doc = F.try_parse_json(raw)
    kind = lambda name: F.schema_of_variant(F.try_variant_get(doc, f"$.{name}", "variant"))
    typed = df.select(F.col(key), kind("_id").alias("k"), kind(time_field).alias("t"))
    rule = F.when(F.col("k") != key_type, "key_type").when(F.col("t").startswith("ARRAY") | F.col("t").startswith("OBJECT"), "time_type")
    found = F.when(F.col("k") != key_type, F.col("k")).otherwise(F.substring_index("t", "<", 1))
    return typed.select(F.col(key), rule.alias("rule"), found.alias("found")).where("rule is not null").select(*violation(F.col("rule"), F.col(key), F.col("found")))


def ttl_violations(indexes: DataFrame) -> DataFrame:
    """Indexes (collection, name, expire_after) that delete documents by themselves: the source would change under the archive."""
    return indexes.where("expire_after is not null").select(*violation("ttl_index", F.concat_ws(".", "collection", "name"), F.col("expire_after")))


def document_eligible(df: DataFrame, raw: str, key: str, time_field: str, cutoff: str) -> DataFrame:
    """Documents that agree with their key and are older than the cutoff."""
    at = F.try_to_timestamp(F.get_json_object(raw, f"$.{time_field}"))
    return df.where((F.get_json_object(raw, "$._id") == F.col(key).cast("string")) & (at < F.lit(cutoff).cast("timestamp")))


def key_order_violations(batched: DataFrame, key: str, upper: int | None = None) -> DataFrame:
    """Batches with null or repeated keys, with keys not over those of the batch before, or over the upper key.

    Only one row per batch is compared, with the batch numbered one less, by an equi-join: no task sees all batches.
    """
    b = batched.groupBy("batch_seq").agg(
        F.min(key).alias("lo"), F.max(key).alias("hi"), F.count("*").alias("n"), F.count(key).alias("k"), F.count_distinct(key).alias("d")
    )
    prior = b.select((F.col("batch_seq") + 1).alias("batch_seq"), F.col("hi").alias("prior"))
    rule = (
        F.when(F.col("k") < F.col("n"), "key_null").when(F.col("d") < F.col("k"), "key_repeated").when(F.col("lo") <= F.col("prior"), "key_order")
    )
    if upper is not None:
        rule = rule.when(F.col("hi") > upper, "key_over_upper")
    return b.join(prior, "batch_seq", "left").select(*violation(rule, F.col("batch_seq"), F.col("lo"))).where("rule is not null")


def repeated_keys(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).count().where("count > 1").select(*violation("key_repeated", F.concat_ws(",", *key), F.col("count")))


def fk_violations(fks: DataFrame, columns: DataFrame) -> DataFrame:
    """Foreign keys that pair columns of different types, modifiers or collations (two unknown ones are the same).

    fks: name, child, child_cols, parent, parent_cols; columns: table, name, type, and modifier and collation if they are known.
    """
    pairs = fks.select("name", "child", "parent", F.explode(F.arrays_zip("child_cols", "parent_cols")).alias("p"))
    kinds = ["type", *(c for c in ("modifier", "collation") if c in columns.columns)]
    side = lambda t, c: columns.select(F.col("table").alias(t), F.col("name").alias(c), *(F.col(k).cast("string").alias(f"{c}_{k}") for k in kinds))
    flat = pairs.select(F.col("name").alias("fk"), "child", "parent", F.col("p.child_cols").alias("cc"), F.col("p.parent_cols").alias("pc"))
    both = flat.join(side("child", "cc"), ["child", "cc"], "left").join(side("parent", "pc"), ["parent", "pc"], "left")
    differ = {k: ~F.col(f"cc_{k}").eqNullSafe(F.col(f"pc_{k}")) for k in kinds}
    differ["type"] = differ["type"] | F.col("cc_type").isNull()
    rule = F.coalesce(*(F.when(d, f"fk_{k}") for k, d in differ.items()))
    text = F.coalesce(*(F.when(d, F.concat(F.coalesce(f"cc_{k}", F.lit("missing")), F.lit(" <> "), F.coalesce(f"pc_{k}", F.lit("missing")))) for k, d in differ.items()))
    return both.where(rule.isNotNull()).select(*violation(rule, F.concat_ws(".", "fk", "cc"), text))


def binding_violations(plans: DataFrame, jobs: DataFrame) -> DataFrame:
    """Child plans (plan_id, parent_job, digest, n_rows) whose parent job is gone or changed. jobs: job_id, digest, n_rows."""
    j = jobs.select(F.col("job_id").alias("parent_job"), F.col("digest").alias("d"), F.col("n_rows").alias("n"))
    rule = F.when(F.col("d").isNull(), "parent_missing").when(F.col("d") != F.col("digest"), "parent_digest").when(F.col("n") != F.col("n_rows"), "parent_rows")
    return plans.join(j, "parent_job", "left").select(*violation(rule, F.col("plan_id"), F.col("parent_job"))).where("rule is not null")


def totals_violations(objects: DataFrame, jobs: DataFrame) -> DataFrame:
    """Jobs whose objects (job_id, n_rows, n_bytes, last_key) do not add up to them (job_id, n_rows, n_bytes, last_key)."""
    o = objects.groupBy("job_id").agg(F.sum("n_rows").alias("r"), F.sum("n_bytes").alias("b"), F.max("last_key").alias("k"))
    both = jobs.join(o, "job_id", "left")
    rule = (
        F.when(F.coalesce("r", F.lit(0)) != F.col("n_rows"), "rows").when(F.coalesce("b", F.lit(0)) != F.col("n_bytes"), "bytes")
        .when(~F.col("k").eqNullSafe(F.col("last_key")), "last_key")
    )
    return both.select(*violation(rule, F.col("job_id"), F.coalesce(F.col("r"), F.lit(0)))).where("rule is not null")


def manifest_violations(manifests: DataFrame, key_type: str = "bigint") -> DataFrame:
    """What is wrong inside manifests, as archives have them: a head row for each job_id (version, batch_size, n_rows, n_bytes, last_key), a row for each batch (batch_seq) and for each file (name).

    Versions are 2 to 4; batches are numbered from 1 without a gap, each once, hold 1 to batch_size rows, and their keys, read as key_type, go up from batch to batch; digests are 64 hex digits; the head's sums and last key are the batches'.
    Each batch is compared with the one before by an equi-join, so no task sees all batches of a job.
    """
    hexes = ~F.coalesce(F.col("digest").rlike("^[0-9a-f]{64}$"), F.lit(False))
    key = lambda c: F.col(c).cast(key_type)
    b = manifests.where("batch_seq is not null").groupBy("job_id", "batch_seq").agg(
        F.count("*").alias("times"), F.max("batch_size").alias("batch_size"), F.max("n_rows").alias("n_rows"), F.min(key("first_key")).alias("lo"), F.max(key("last_key")).alias("hi"), F.bool_or(hexes).alias("bad"), F.max("n_bytes").alias("n_bytes")
    )
    prior = b.select("job_id", (F.col("batch_seq") + 1).alias("batch_seq"), F.col("hi").alias("prior"), F.lit(True).alias("follows"))
    rule = (
        F.when(F.col("times") > 1, "batch_repeated").when((F.col("batch_seq") < 1) | ((F.col("batch_seq") > 1) & F.col("follows").isNull()), "batch_gap")
        .when((F.col("n_rows") < 1) | (F.col("n_rows") > F.col("batch_size")), "batch_rows").when(F.col("bad"), "digest").when((F.col("lo") <= F.col("prior")) | (F.col("hi") < F.col("lo")), "key_order")
    )
    batches = b.join(prior, ["job_id", "batch_seq"], "left").select(*violation(rule, F.concat_ws("/", "job_id", "batch_seq"), F.col("n_rows"))).where("rule is not null")
    files = manifests.where("name is not null").groupBy("job_id", "name").agg(F.count("*").alias("times"), F.bool_or(hexes).alias("bad"))
    files = files.select(*violation(F.when(F.col("times") > 1, "file_repeated").when(F.col("bad"), "digest"), F.concat_ws("/", "job_id", "name"), F.col("times"))).where("rule is not null")
    sums = b.groupBy("job_id").agg(F.sum("n_rows").alias("r"), F.sum("n_bytes").alias("o"), F.max("hi").alias("k"))
    heads = manifests.where("batch_seq is null and name is null").join(sums, "job_id", "left")
    head = (
        F.when(~F.col("version").between(2, 4), "version").when(F.coalesce("r", F.lit(0)) != F.col("n_rows"), "total_rows")
        .when(F.coalesce("o", F.lit(0)) != F.col("n_bytes"), "total_bytes").when(~F.col("k").eqNullSafe(key("last_key")), "last_key")
    )
    return batches.unionByName(files).unionByName(heads.select(*violation(head, F.col("job_id"), F.col("n_rows"))).where("rule is not null"))


def ledger_violations(batches: DataFrame) -> DataFrame:
    """Deletion batches whose numbers do not balance: processed = deleted + absent + deferred, uncertain within absent, none below 0."""
    n = F.array(*(F.coalesce(F.col(c), F.lit(0)) for c in ("processed", "deleted", "absent", "deferred", "uncertain")))
    rule = (
        F.when(F.array_min(n) < 0, "negative")
        .when(F.col("processed") != F.col("deleted") + F.col("absent") + F.col("deferred"), "balance")
        .when(F.col("uncertain") > F.col("absent"), "uncertain")
    )
    return batches.select(*violation(rule, F.concat_ws("/", "job_id", "batch_seq"), F.col("processed"))).where("rule is not null")
