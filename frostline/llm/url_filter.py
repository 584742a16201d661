"""URL filter: host and path rules first, then a weighted vocabulary found by Aho-Corasick.

The automaton is built once per Python worker from the vocabulary (a parameter of at most MAX_TERMS
terms, which may come from a table) and reads every url once, whatever the number of terms. A hit counts only
between boundaries: the characters before and after it must not be letters or digits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frostline.llm.lineage import extended

# Strict terms reject a url alone.
STRICT = tuple(
    "porn porno xxx hentai camgirl camgirls sexcam sexcams livesex milf escort escorts callgirls bdsm fetish upskirt gangbang blowjob nudes onlyfans-leaks rule34 redtube"
    " warez torrent torrents magnet-links nulled cracked-apks serial-keys"
    " casino casinos online-casino roulette baccarat sportsbook slot-machines"
    " viagra cialis levitra tramadol xanax-online steroids-shop payday-loan payday-loans".split()
)
# Soft terms and their weights; one alone never rejects.
SOFT = {
    **dict.fromkeys("keygen keygens".split(), 0.7),
    **dict.fromkeys("nude naked sexy erotic poker betting bookmaker stripper".split(), 0.6),
    **dict.fromkeys("adult slots jackpot pills pharmacy crack cracked free-download full-download mp3-download serial hookup".split(), 0.5),
    **dict.fromkeys("bet bets odds dating singles loan loans bonus bonuses lottery forex crypto-signals proxy unblocked weight-loss".split(), 0.4),
    **dict.fromkeys("hot cheap discount replica deals click earn-money win".split(), 0.3),
}
MAX_TERMS = 10_000


@dataclass(frozen=True)
class Vocabulary:
    strict: tuple[str, ...] = STRICT
    soft: dict[str, float] = field(default_factory=lambda: dict(SOFT))
    reject_weight: float = 1.0
    reject_distinct: int = 2

    def __post_init__(self) -> None:
        terms = [*self.strict, *self.soft]
        if len(terms) > MAX_TERMS:
            raise ValueError(f"the vocabulary is shipped to every worker; {len(terms)} terms exceed {MAX_TERMS}")
        if any(not t or t != t.lower() for t in terms):
            raise ValueError("terms are non-empty and lower case")


def vocabulary_of(terms: DataFrame, reject_weight: float = 1.0, reject_distinct: int = 2) -> Vocabulary:
    """A Vocabulary from rows (term, weight), a null weight being strict; terms are trimmed and lower-cased, repeats count once with their greatest weight.

    At most MAX_TERMS + 1 rows come to the driver; a larger table is refused.
    """
    term = F.lower(F.trim("term"))
    rows = terms.where(F.col("term").isNotNull()).groupBy(term.alias("term")).agg(F.max("weight").alias("weight"), F.bool_or(F.col("weight").isNull()).alias("strict"))
    got = rows.where("term <> ''").orderBy("term").limit(MAX_TERMS + 1).collect()
    return Vocabulary(tuple(r.term for r in got if r.strict), {r.term: float(r.weight) for r in got if not r.strict}, reject_weight, reject_distinct)


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def parse_rules(lines: list[tuple[str, str]]) -> list[Rule]:
    """(verdict, 'host/path') pairs."""
    return [Rule(v, *((h := r.partition("/"))[0], "/" + h[2])) for v, r in lines]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first '://' (A-Z lower-cased) and path up to '?' or '#'; empty without '://' or for null."""
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    u = F.coalesce(url.cast("string"), F.lit(""))
    return F.translate(F.regexp_extract(u, parts, 1), upper, upper.lower()), F.regexp_extract(u, parts, 2)


def rule_columns(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; nulls where none does. Equal rules: the first one given."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(enumerate(rules), key=lambda x: (len(x[1].name), -x[0])):
        fits = ((host == r[1].host) | host.endswith("." + r[1].host)) & path.startswith(r[1].path)
        rule, verdict = F.when(fits, F.lit(r[1].name)).otherwise(rule), F.when(fits, F.lit(r[1].verdict)).otherwise(verdict)
    return rule, verdict


def count_terms(url: str | None, automaton) -> tuple[int, int, float]:
    """Strict hits, distinct soft terms, and the soft terms' weight."""
    if not url:
        return 0, 0, 0.0
    low, strict, soft = url.lower(), 0, {}
    for end, (term, weight) in automaton.iter(low):
        start = end - len(term) + 1
        if (start and low[start - 1].isalnum()) or (end + 1 < len(low) and low[end + 1].isalnum()):
            continue
        if weight is None:
            strict += 1
        else:
            soft[term] = weight
    return strict, len(soft), float(sum(soft.values()))


def _scan(vocabulary: Vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for t in vocabulary.strict:
            automaton.add_word(t, (t, None))
        for t, w in vocabulary.soft.items():
            if t not in automaton:
                automaton.add_word(t, (t, w))
        if len(automaton):
            automaton.make_automaton()
        for b in batches:
            urls = b.column(b.schema.get_field_index("url"))
            found = [count_terms(u.as_py(), automaton) if len(automaton) else (0, 0, 0.0) for u in urls]
            strict, soft, weight = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(strict, pa.int32()), pa.array(soft, pa.int32()), pa.array(weight, pa.float64())],
                names=[*b.schema.names, "strict_hits", "soft_hits", "soft_weight"],
            )

    return run


def filter_urls(
    pages: DataFrame, rules: list[Rule], vocabulary: Vocabulary | None = None, id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, strict_hits, soft_hits, soft_weight.

    verdict is the longest fitting rule's; without one, 'block' for a strict term or for at least
    reject_distinct different soft terms that weigh reject_weight together, else 'allow'.
    Ties between rules of one length go to the first given; a very long url is read once, whatever the number of terms.
    A null or empty url has empty host and path, no rule and no hits: 'allow'. Null ids stay; repeated
    rows are judged each on their own; no rows give no rows; other columns are not read.
    """
    v = vocabulary or Vocabulary()
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    scanned = rows.mapInArrow(_scan(v), extended(rows, "strict_hits int, soft_hits int, soft_weight double"))
    host, path = host_and_path(F.col("url"))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    # the half unit in the last place keeps sums like 0.3 + 0.7 at their decimal meaning
    bad = (F.col("strict_hits") > 0) | (
        (F.col("soft_hits") >= v.reject_distinct) & (F.round("soft_weight", 6) >= F.lit(float(v.reject_weight)))
    )
    return (
        scanned.withColumns({"host": host, "path": path})
        .withColumns({"rule": rule, "verdict": F.coalesce(verdict, F.when(bad, F.lit("block")).otherwise(F.lit("allow")))})
        .select("page_id", "host", "path", "rule", "verdict", "strict_hits", "soft_hits", "soft_weight")
    )
