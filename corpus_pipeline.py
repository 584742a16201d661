"""A corpus from raw documents to packed sequences, one Spark job after the other.

Every stage takes what the stage before it kept, as (spark, docs, sf_dir), and returns a DataFrame. For all of them: columns beside doc_id, text, source and
n_chars pass through whatever their names (the last stage returns pieces instead), no rows give no rows, texts are read whole however long, rows that repeat an id are
judged each on its own text, and which row of a group stays is told by ids and places, not by the order of rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from frostline.llm import decontaminate, line_dedup, packing, quality_rules, simhash
from frostline.llm.lineage import ensure_checkpoint_dir
from frostline.llm.queries import tokenizer_path


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the document rules or their host's verdict reject go; null and empty texts fail the rules, a null source is not judged."""
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are copies of an earlier line, or like it, go; documents that lose every word go with them.

    Earlier is by doc_id, null first, then line number; n_chars is counted anew; a null text stays.
    """
    return line_dedup.keep_first_lines(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component over five-word shingles stays: the one of the least doc_id. Texts without words are copies of each other; rows without an id stay."""
    return simhash.keep_one(docs, size=5)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold half of a benchmark item's words in shared passages go; null and short texts hold none."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the sequences that the documents are packed into; a null text is one end mark."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality_rules", rules),
    ("line_dedup", lines),
    ("near_copies", near_copies),
    ("decontamination", clean),
    ("packing", packed),
]

#: The fingerprints are XXH64 and the packing needs token ids: SQL cannot express these stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as Parquet in the shared checkpoint folder and read again."""
    ensure_checkpoint_dir(spark)
    top = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{name}")
        docs = spark.read.parquet(f"{top}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
