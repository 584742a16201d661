"""Exports and restores that stop anywhere and go on from there.

A job is frozen when it begins (plan.json: cutoff, upper key, columns, and the key ranges of its rounds). Each round exports one range of keys: its files are staged, a `prepared` entry of the journal names them with their digests,
they are published under data/ by renames that overwrite nothing, and a `committed` entry closes the round. After a crash, a prepared round is published again from what is staged, a round without an entry is exported
again (what it had staged is named by nothing), and a committed one is left. The manifest appears at once after the last round.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frostline.operators.select import assign_batches, batch_summary, eligible, text_bytes, upper_key
from frostline.plans.lineage import cut
from frostline.plans.model import Plan
from frostline.sources import store
from frostline.sources.archive import batch_digest, read_archive, read_manifest, schema_text
from frostline.sources.digests import file_fingerprints, range_digests

#: Rows of a round, and bytes of text to which a file is cut; a row is never cut, whatever its width.
ROUND_ROWS = 100_000_000
FILE_BYTES = 1 << 28
_SAMPLED = 10_000
Step = Callable[[str], None]


def _nothing(step: str) -> None:
    """What tests replace to stop a job after a step."""


def stage(batched: DataFrame, folder: str, key: str, columns: list[str], native: dict[str, str] | None = None, file_bytes: int = FILE_BYTES) -> dict:
    """Writes batched (with batch_seq) to folder/data, its objects to folder/objects and the leaves of the files' trees to folder/ranges; returns the sums. Rows to a file follow from the mean row."""
    spark = batched.sparkSession
    marked = [F.col(c).alias(c, metadata={"native_type": (native or {}).get(c, "")}) if native else F.col(c) for c in columns]
    rows = batched.select("batch_seq", *marked)
    mean = rows.agg(F.avg(text_bytes(rows, columns))).first()[0] or 1
    ordered = rows.repartitionByRange("batch_seq").sortWithinPartitions("batch_seq", key)
    ordered.write.option("compression", "snappy").option("maxRecordsPerFile", max(1, int(file_bytes / max(mean, 1)))).parquet(f"{folder}/data")
    written = spark.read.parquet(f"{folder}/data")
    ranges = cut(range_digests(spark, f"{folder}/data"))
    ranges.write.parquet(f"{folder}/ranges")
    text = lambda *names: [F.col(c).cast("string").alias(c) for c in names]
    none = lambda kind, *names: [F.lit(None).cast(kind).alias(c) for c in names]
    batches = batch_summary(written, key, columns).join(batch_digest(written, key, columns), "batch_seq").select("batch_seq", "n_rows", "n_bytes", *text("first_key", "last_key", "digest"), *none("string", "name"))
    files = file_fingerprints(ranges).select(*none("long", "batch_seq", "n_rows"), "n_bytes", *none("string", "first_key", "last_key"), F.col("sha256").alias("digest"), "name")
    batches.unionByName(files).write.parquet(f"{folder}/objects")
    sums = spark.read.parquet(f"{folder}/objects").where("batch_seq is not null").agg(F.count("*").alias("batches"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("rows")).first()
    return {"batches": sums.batches, "rows": sums.rows, "schema": schema_text(written)}


def publish(spark: SparkSession, folder: str, uri: str, prefix: str, at: Step = _nothing) -> None:
    """Moves the staged files to uri/data under the prefix. One that is there already was moved by an earlier try; if it is still staged as well, the two must be equal."""
    staged = {r.name: r.digest for r in spark.read.parquet(f"{folder}/objects").where("name is not null").select("name", "digest").collect()}
    for name in sorted(staged):
        source, target = f"{folder}/data/{name}", f"{uri}/data/{prefix}{name}"
        if store.exists(spark, source) and not store.move_once(spark, source, target):
            there = file_fingerprints(range_digests(spark, target)).first()
            if there.sha256 != staged[name]:
                raise FileExistsError(f"{target} is there with other content")
        elif not store.exists(spark, target):
            raise FileNotFoundError(f"{source} and {target} are both gone")
        at("moved")


def _entries(spark: SparkSession, uri: str) -> dict[int, dict]:
    """round -> its prepared entry, with committed added."""
    names = store.names(spark, f"{uri}/journal")
    out = {int(n[:6]): json.loads(store.read_text(spark, f"{uri}/journal/{n}")) for n in names if n.endswith("-prepared.json")}
    for n in names:
        if n.endswith("-committed.json"):
            out[int(n[:6])]["committed"] = True
    return out


def journal(spark: SparkSession, uri: str) -> DataFrame:
    """(round, batch_seq, state): every batch of the journal, prepared or committed."""
    out = spark.createDataFrame([], "round int, batch_seq long, state string")
    for k, e in _entries(spark, uri).items():
        rows = spark.read.parquet(f"{e['folder']}/objects").where("batch_seq is not null")
        out = out.unionByName(rows.select(F.lit(k).alias("round"), "batch_seq", F.lit("committed" if e.get("committed") else "prepared").alias("state")))
    return out


def _round(spark: SparkSession, uri: str, k: int, batched, key: str, columns: list[str], native, at: Step) -> dict:
    """Carries round k to its end from wherever it is; batched is called only if the round must be exported."""
    entry = _entries(spark, uri).get(k)
    if entry is None:
        folder = f"{uri}/staging/{k:06d}-{uuid.uuid4().hex}"
        entry = {"folder": folder, **stage(batched(), folder, key, columns, native)}
        at("staged")
        store.create_once(spark, f"{uri}/journal/{k:06d}-prepared.json", json.dumps(entry))
        at("prepared")
    if not entry.get("committed"):
        publish(spark, entry["folder"], uri, f"{k:06d}-", at)
        at("published")
        store.create_once(spark, f"{uri}/journal/{k:06d}-committed.json", "{}")
        at("committed")
    return entry


def _finish(spark: SparkSession, uri: str, job_id: str, batch_size: int, entries: dict[int, dict], at: Step) -> None:
    """The manifest and the leaves of all rounds, each renamed into place at once."""
    if store.exists(spark, f"{uri}/manifest"):
        return
    objects, ranges = None, None
    for k, e in entries.items():
        named = F.when(F.col("name").isNotNull(), F.concat(F.lit(f"{k:06d}-"), "name")).alias("name")
        head = [F.lit(job_id).alias("job_id"), F.lit(4).alias("version"), F.lit(e["schema"]).alias("schema"), F.lit(batch_size).alias("batch_size")]
        o = spark.read.parquet(f"{e['folder']}/objects").select(*head, "batch_seq", "n_rows", "n_bytes", "first_key", "last_key", "digest", named)
        r = spark.read.parquet(f"{e['folder']}/ranges").withColumn("name", F.concat(F.lit(f"{k:06d}-"), "name"))
        objects, ranges = (o, r) if objects is None else (objects.unionByName(o), ranges.unionByName(r))
    batches = objects.where("batch_seq is not null")
    last = F.max_by("last_key", "batch_seq").alias("last_key")
    sums = batches.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_rows", "n_bytes")), last)
    text = [F.lit(job_id).alias("job_id"), F.lit(4).alias("version"), F.lit(entries[max(entries)]["schema"]).alias("schema"), F.lit(batch_size).alias("batch_size")]
    objects = objects.unionByName(sums.select(*text, "n_rows", "n_bytes", "last_key"), allowMissingColumns=True)
    for name, rows in (("ranges", ranges), ("manifest", objects)):
        staged = f"{uri}/staging/{name}-{uuid.uuid4().hex}"
        (rows.write.json if name == "manifest" else rows.write.parquet)(staged)
        at(f"{name} staged")
        store.move_once(spark, staged, f"{uri}/{name}")
        at(name)


def write_archive(batched: DataFrame, uri: str, job_id: str, key: str, columns: list[str], native: dict[str, str] | None = None, at: Step = _nothing) -> None:
    """batched (with batch_seq) as one round and the manifest after it; a finished archive is refused, an unfinished one of the same job taken up from where its journal ends."""
    spark = batched.sparkSession
    if store.exists(spark, f"{uri}/manifest"):
        raise FileExistsError(f"{uri} is a finished archive")
    frozen = json.dumps({"job_id": job_id, "key": key, "columns": columns})
    if not store.create_once(spark, f"{uri}/plan.json", frozen) and store.read_text(spark, f"{uri}/plan.json") != frozen:
        raise FileExistsError(f"{uri} was begun by another job")
    entry = _round(spark, uri, 1, lambda: batched, key, columns, native, at)
    _finish(spark, uri, job_id, 1000, {1: entry}, at)


def publish_archive(batched: DataFrame, uri: str, job_id: str, key: str, columns: list[str], native: dict[str, str] | None = None) -> str:
    """write_archive() that may be repeated: 'created', or 'same' where an archive with this job's batches and digests is there already. Nothing is ever overwritten: an archive of other content is refused."""
    spark = batched.sparkSession
    if not store.exists(spark, f"{uri}/manifest"):
        write_archive(batched, uri, job_id, key, columns, native)
        outcome = "created"
    else:
        outcome = "same"
    there = read_manifest(spark, uri).where("batch_seq is not null").select("job_id", "batch_seq", "digest")
    own = batch_digest(batched, key, columns).select(F.lit(job_id).alias("job_id"), "batch_seq", "digest")
    if not there.unionByName(own).groupBy("job_id", "batch_seq", "digest").count().where("count <> 2").isEmpty():
        raise FileExistsError(f"{uri} holds another archive")
    return outcome


def round_ends(rows: DataFrame, key: str, upper, round_rows: int) -> list:
    """The greatest keys of rounds of about round_rows rows, the last being upper; from a bounded sample of keys by their hash, the same on every try."""
    n = rows.count()
    count = -(-n // round_rows)
    if count <= 1:
        return [upper]
    sample = sorted(r[0] for r in rows.select(key).orderBy(F.xxhash64(key)).limit(_SAMPLED).collect())
    return sorted({sample[i * len(sample) // count] for i in range(1, count)} - {upper}) + [upper]


def export(source: DataFrame, plan: Plan, uri: str, job_id: str, columns: list[str], native: dict[str, str] | None = None, max_rounds: int | None = None, round_rows: int = ROUND_ROWS, at: Step = _nothing) -> str:
    """Archives the plan's rows of source at uri: 'finished', or 'unfinished' after max_rounds rounds. Called again, it goes on with the cutoff and upper key that the job began with; another plan is refused.

    The upper key is frozen over the whole table. No row makes a finished archive of no batches. Batches have the plan's size in key order but for the last of a round.
    """
    spark, key = source.sparkSession, plan.policy.key
    frozen = {"job_id": job_id, "policy": plan.policy.name, "table": plan.policy.table, "key": key, "columns": columns, "cutoff": plan.cutoff.isoformat(), "batch_size": plan.policy.batch_size, "schema": schema_text(source.select(columns))}
    if not store.exists(spark, f"{uri}/plan.json"):
        upper = plan.upper_key if plan.upper_key is not None else upper_key(source, key)
        ends = round_ends(eligible(source, plan.below(upper)), key, upper, round_rows)
        store.create_once(spark, f"{uri}/plan.json", json.dumps({**frozen, "ends": ends}))
        at("planned")
    begun = json.loads(store.read_text(spark, f"{uri}/plan.json"))
    ends = begun.pop("ends")
    if begun != frozen or plan.upper_key not in (None, ends[-1]):
        raise ValueError(f"{uri} was begun with another plan")
    done, entries, low = 0, {}, None
    for k, high in enumerate(ends, 1):
        known = _entries(spark, uri).get(k)
        if not (known and known.get("committed")) and max_rounds is not None and done >= max_rounds:
            return "unfinished"
        before = sum(e["batches"] for e in entries.values())

        def batched(low=low, high=high, before=before) -> DataFrame:
            rows = eligible(source, plan).select(columns)
            rows = rows.where(F.lit(False)) if high is None else rows.where(F.col(key) <= high)
            rows = rows if low is None else rows.where(F.col(key) > low)
            return assign_batches(rows, key, plan.policy.batch_size).withColumn("batch_seq", F.col("batch_seq") + before)

        done += not (known and known.get("committed"))
        entries[k] = _round(spark, uri, k, batched, key, columns, native, at)
        low = high
    _finish(spark, uri, job_id, plan.policy.batch_size, entries, at)
    return "finished"


def restore(spark: SparkSession, uri: str, target: str, source: str | None = None, kinds: dict[str, str] | None = None, batches: int = 10_000, at: Step = _nothing) -> str:
    """The archive as a table at target, columns cast to kinds: 'restored', or 'same' if this archive's restore had ended there. So many batches to a round; after a crash it goes on with the rounds that are not there yet.

    The source, and a target that is no restore of this archive, are refused.
    """
    if source is not None and target.rstrip("/") == source.rstrip("/"):
        raise ValueError("a restore goes to a target of its own")
    digest = read_manifest(spark, uri).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("digest")), ""), 256)).first()[0] if store.exists(spark, f"{uri}/manifest") else None
    began = json.dumps({"archive": uri, "digest": digest, "kinds": kinds})
    if store.exists(spark, target) and not store.exists(spark, f"{target}/_restore/began.json"):
        raise FileExistsError(f"{target} is there and no restore")
    if not store.create_once(spark, f"{target}/_restore/began.json", began) and store.read_text(spark, f"{target}/_restore/began.json") != began:
        raise FileExistsError(f"{target} is the restore of another archive")
    if store.exists(spark, f"{target}/_restore/done.json"):
        return "same"
    rows = read_archive(spark, uri)
    typed = rows.select("batch_seq", *(F.col(c).cast((kinds or {}).get(c, t)).alias(c) for c, t in rows.drop("batch_seq").dtypes))
    last = rows.agg(F.max("batch_seq")).first()[0] or 1
    for first in range(1, last + 1, batches):
        name = f"{first:012d}"
        if store.exists(spark, f"{target}/{name}"):
            continue
        staged = f"{target}/_restore/{name}-{uuid.uuid4().hex}"
        typed.where(F.col("batch_seq").between(first, first + batches - 1)).drop("batch_seq").write.parquet(staged)
        at("staged")
        store.move_once(spark, staged, f"{target}/{name}")
        at("moved")
    store.create_once(spark, f"{target}/_restore/done.json", "{}")
    return "restored"


def restored(spark: SparkSession, target: str) -> DataFrame:
    """The rows of a finished restore."""
    if not store.exists(spark, f"{target}/_restore/done.json"):
        raise FileNotFoundError(f"{target} is no finished restore")
    return spark.read.option("recursiveFileLookup", "true").parquet(*[f"{target}/{n}" for n in store.names(spark, target)])


