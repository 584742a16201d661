"""Document rules, and a verdict on each host from how often its documents fail them.

All of it is Spark expressions. Words, lines and windows live in arrays of their own row, so the
rules need no shuffle; only (host, failed) pairs are aggregated, which combines map-side however large
a host is. Host rates are shrunk by a beta prior fitted to the hosts by moments, so a host with few
documents is judged mostly by the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frostline.llm.lineage import cut

WINDOW = 8
#: Hosts of some 100 bytes each: ten megabytes at most.
MAX_BROADCAST_HOSTS = 100_000
_SPACE = r"[\x20\x09-\x0D]+"
_WORD = r"[^\x20\x09-\x0D]"


def once(x: Column, f) -> Column:
    """f(x), with x evaluated once wherever the optimizer moves the expression."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def repeated_words(hashes: Column) -> Column:
    """Words under windows whose hash occurs twice or more: the union of [p, p + WINDOW) over their places p."""

    def places(s: Column) -> Column:  # s: (hash, place) structs in order
        same = lambda i, j: F.coalesce(F.get(s, i)["h"] == F.get(s, j)["h"], F.lit(False))
        twins = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: same(i, i - 1) | same(i, i + 1))
        return F.sort_array(F.transform(twins, lambda i: F.get(s, i)["p"]))

    def covered(p: Column) -> Column:
        gaps = F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

    pairs = F.sort_array(F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
    return once(once(pairs, places), covered)


def statistics(text: Column) -> Column:
    """A struct of n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words (long) of a text.

    Words, lines and window hashes are bound to lambda variables, so a filter over the struct that the optimizer pushes into the scan
    still splits each text once, and the work stays in proportion to the text.
    """
    long = lambda x: x.cast("long")

    def repeats(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (WINDOW - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, WINDOW)))
        counted = lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), repeated_words(h)).otherwise(long(F.lit(0)))
        return F.when(F.size(w) >= WINDOW, once(hashes, counted)).otherwise(long(F.lit(0)))

    of_words = lambda w: F.struct(
        long(F.size(w)).alias("n_words"), long(F.length(F.array_join(w, ""))).alias("word_chars"), repeats(w).alias("n_repeat_words")
    )
    of_lines = lambda x: F.struct(long(F.size(x)).alias("n_lines"), long(F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"))

    def all_of(t: Column) -> Column:
        words = once(F.array_remove(F.split(t, _SPACE), ""), of_words)
        lines = once(F.filter(F.split(t, "\n"), lambda x: x.rlike(_WORD)), of_lines)
        whole = F.struct(words.alias("w"), lines.alias("l"), long(F.regexp_count(t, F.lit(r"[#*$%&|<>]"))).alias("n_symbols"))
        return once(whole, lambda s: F.struct(*(s["w"][c].alias(c) for c in ("n_words", "word_chars", "n_repeat_words")), s["n_symbols"].alias("n_symbols"), *(s["l"][c].alias(c) for c in ("n_lines", "n_dup_lines"))))

    return once(F.coalesce(text.cast("string"), F.lit("")), all_of)


def base_failed(s: Column) -> Column:
    """Fewer than 20 words, or over 30 % of the words in repeated windows; s: a struct of statistics."""
    return (s["n_words"] < 20) | (100 * s["n_repeat_words"] > 30 * s["n_words"])


def rule_failed(s: Column) -> Column:
    """What counts against a host: the base rules, over one symbol in ten words, over 30 % repeated lines, or words
    of odd mean length (under 2 or over 14 characters)."""
    odd = (s["word_chars"] < 2 * s["n_words"]) | (s["word_chars"] > 14 * s["n_words"])
    return base_failed(s) | (10 * s["n_symbols"] > s["n_words"]) | (100 * s["n_dup_lines"] > 30 * s["n_lines"]) | odd


def host_verdicts(flags: DataFrame, host_col: str = "host", failed_col: str = "failed", max_rate: float = 0.5) -> DataFrame:
    """(host, n, failures, host_failed): a host fails if its shrunk failure rate is over max_rate.

    The prior Beta(a, b) comes from one row of sums over the hosts: mean m = sum k / sum n, intra-host
    correlation r = (sum n (k/n - m)^2 - m (1 - m) H) / (m (1 - m) sum (n - 1)), kept within 0.0001 to 0.9999,
    a + b = 1/r - 1. The shrunk rate is (k + a) / (n + a + b). Rows with a null host are not judged.
    """
    hosts = cut(
        flags.where(F.col(host_col).isNotNull())
        .groupBy(F.col(host_col).alias("host"))
        .agg(F.count("*").alias("n"), F.count_if(failed_col).alias("failures"))
    )
    total, failures, count, squares = hosts.agg(
        F.sum("n"), F.sum("failures"), F.count("*"), F.sum(F.col("failures") * F.col("failures") / F.col("n"))
    ).first()
    m = failures / total if total else 0.0
    spread = m * (1 - m)
    between = squares - m * failures if total else 0.0  # sum n (k/n - m)^2
    r = (between - spread * count) / (spread * (total - count)) if spread and total > count else 0.0
    strength = 1 / min(max(r, 0.0001), 0.9999) - 1
    rate = (F.col("failures") + F.lit(m * strength)) / (F.col("n") + F.lit(strength))
    return hosts.withColumn("host_failed", rate > max_rate)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_rate: float = 0.5) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    kept is false if the base rules fail or the document's host does. Null and empty texts have no words, so they
    fail; very long texts are counted whole; a null host is not judged; null ids and repeated rows stay, each judged on its own, so equal texts of a host are judged alike; no rows give no rows;
    other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("host"), statistics(F.col(text_col)).alias("s"))
    stats = cut(rows.select("doc_id", "host", "s.*", base_failed(F.col("s")).alias("base_failed"), rule_failed(F.col("s")).alias("failed")))
    bad = host_verdicts(stats.select("host", "failed"), max_rate=max_rate).where("host_failed")
    return stats.join(bad.select("host", "host_failed"), "host", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.col("host_failed").isNull()).alias("kept"),
    )


def keep_good(docs: DataFrame, text_col: str = "text", host_col: str = "source", max_rate: float = 0.5) -> DataFrame:
    """docs without those that judge() does not keep, columns as they are.

    The hosts' verdicts need a first pass, which keeps only flags; the second filters the documents as they are read, so no text is shuffled
    or written in between. Rejected hosts are broadcast after they were counted, and joined otherwise if they are over MAX_BROADCAST_HOSTS.
    Null and empty texts go, a null host is not judged, repeated rows and null ids stay or go each on its own text, a very long text costs in
    proportion to its length, no rows give no rows, and columns of any other name pass through.
    """
    text = F.col(text_col)
    flags = docs.select(F.col(host_col).cast("string").alias("host"), once(statistics(text), rule_failed).alias("failed"))
    bad = cut(host_verdicts(flags, max_rate=max_rate).where("host_failed").select("host"))
    good = docs.where(~once(statistics(text), base_failed))
    n = bad.count()
    if not n:
        return good
    return good.join(F.broadcast(bad) if n <= MAX_BROADCAST_HOSTS else bad, good[host_col].cast("string") == bad["host"], "left_anti")


#: The same in DuckDB's SQL.
JUDGE_SQL = r"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
places AS (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS p FROM w),
windows AS (SELECT doc_id, p, list_slice(words, p, p + 7) AS win FROM places),
twins AS (SELECT doc_id, win FROM windows GROUP BY doc_id, win HAVING count(*) > 1),
covered AS (SELECT doc_id, count(DISTINCT q) AS n FROM
  (SELECT doc_id, unnest(range(p, p + 8)) AS q FROM windows JOIN twins USING (doc_id, win)) GROUP BY doc_id),
stats AS (
  SELECT w.doc_id, w.source, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, len(lines) AS n_lines,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN covered USING (doc_id)),
flags AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM stats),
rules AS (SELECT *, base_failed OR 10 * n_symbols > n_words OR 100 * n_dup_lines > 30 * n_lines
                 OR word_chars < 2 * n_words OR word_chars > 14 * n_words AS failed FROM flags),
hosts AS (SELECT source, count(*) AS n, count(*) FILTER (failed) AS k FROM rules WHERE source IS NOT NULL GROUP BY source),
sums AS (SELECT sum(n) AS n, sum(k) AS k, count(*) AS h, sum(k * k / n) AS sq, sum(k) / sum(n) AS m FROM hosts),
prior AS (SELECT m, 1 / least(greatest(CASE WHEN m * (1 - m) > 0 AND n > h
                 THEN (sq - m * k - m * (1 - m) * h) / (m * (1 - m) * (n - h)) ELSE 0 END, 0.0001), 0.9999) - 1 AS s FROM sums),
bad AS (SELECT source FROM hosts, prior WHERE (k + m * s) / (n + s) > 0.5)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND (source IS NULL OR source NOT IN (SELECT source FROM bad)) AS kept
FROM rules
"""
