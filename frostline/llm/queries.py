"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frostline.llm import chat_format, decontaminate, html_extract, langid, line_dedup, packing, quality_net, quality_rules, simhash, spelling, structure, token_files, url_filter

Query = Callable[[SparkSession, str], DataFrame]
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(k: int):
    """crc32 of the id as text, modulo k; a null id counts as 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % k, F.lit(0))


def op1_quality_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    net = quality_net.fit(docs, labels, remainder(5) != 0)
    return quality_net.score_documents(docs, net).select("doc_id", (remainder(5) == 0).alias("held_out"), "score", "predicted")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), url_filter.parse_rules(URL_RULES)).select(
        "page_id", "host", "path", "rule", "verdict"
    )


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    models = langid.fit(docs, remainder(4) != 2)
    return langid.predict(docs, models).select("doc_id", (remainder(4) == 2).alias("held_out"), "lang_pred", "score", "cross_entropy", "accepted")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = F.array_join(F.transform("runs", lambda r: F.concat_ws(":", r["skip"], r["train"])), " ")
    return chat_format.rotate(table(spark, sf_dir, "conversations")).withColumn("runs", runs)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op11_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.repair(structure.damaged(table(spark, sf_dir, "conversations")))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(table(spark, sf_dir, "documents"))


def word_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_files.write_tokens(table(spark, sf_dir, "documents"), word_tokenizer_path(), token_files.new_folder(spark), end_id=2)
    return token_files.summaries(files)


def _url_sql() -> str:
    lit = lambda x: "'" + x.replace("'", "''") + "'"
    hit = lambda t: f"regexp_matches(low, '(^|[^\\p{{L}}\\p{{N}}]){t}([^\\p{{L}}\\p{{N}}]|$)')"
    v = url_filter.Vocabulary()
    cases = sorted(url_filter.parse_rules(URL_RULES), key=lambda r: -len(r.name))
    fits = lambda r: f"(host = {lit(r.host)} OR ends_with(host, {lit('.' + r.host)})) AND starts_with(path, {lit(r.path)})"
    pick = lambda f: "CASE " + " ".join(f"WHEN {fits(r)} THEN {lit(f(r))}" for r in cases) + " END"
    return f"""
WITH u AS (SELECT page_id, lower(coalesce(url, '')) AS low, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1) AS h,
                  regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
t AS (SELECT page_id, low, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM u),
r AS (SELECT *, {pick(lambda r: r.name)} AS rule, {pick(lambda r: r.verdict)} AS ruled,
  {" OR ".join(hit(x) for x in v.strict)} AS strict,
  {" + ".join(f"CASE WHEN {hit(x)} THEN 1 ELSE 0 END" for x in v.soft)} AS n_soft,
  {" + ".join(f"CASE WHEN {hit(x)} THEN CAST({w} AS DECIMAL(9, 3)) ELSE 0 END" for x, w in v.soft.items())} AS w_soft FROM t)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN strict OR (n_soft >= {v.reject_distinct} AND w_soft >= {v.reject_weight})
  THEN 'block' ELSE 'allow' END) AS verdict FROM r
"""


def queries() -> dict[str, Query]:
    return {
        "op1_quality_net": op1_quality_net,
        "op2_url_filter": op2_url_filter,
        "op3_simhash": op3_simhash,
        "op4_line_dedup": op4_line_dedup,
        "op5_langid": op5_langid,
        "op6_quality_rules": op6_quality_rules,
        "op7_decontaminate": op7_decontaminate,
        "op8_html_extract": op8_html_extract,
        "op9_chat_format": op9_chat_format,
        "op10_packing": op10_packing,
        "op11_structure": op11_structure,
        "op12_spelling": op12_spelling,
        "op13_token_files": op13_token_files,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filter": _url_sql(), "op6_quality_rules": quality_rules.JUDGE_SQL, "op9_chat_format": chat_format.ROTATE_SQL}
