"""Language identification by interpolated Kneser-Ney models over characters.

A text is its words (runs of letters, lower-cased), a word is its characters between a start and an
end mark, and a character's context is at most ORDER - 1 characters of its own word. Spark counts the
character sequences of all training texts by language, and makes continuation counts, context totals and interpolated probabilities
from the counts, order by order, by grouping and joining. What comes out is one table for
all languages: for each order, the sorted 64-bit hashes of the sequences that any language has seen, with each
language's interpolated log probability, and the sorted hashes of the contexts with each language's
log weight of the lower order. Scoring looks characters up in these arrays by binary search, only once
for each distinct word of a block of texts.

The language is the one of least cross-entropy per character. A text whose best cross-entropy is beyond what is
usual for training texts of that language (mean + REJECT_SIGMAS standard deviations over all of them) is marked as not accepted.

The tables hold every sequence of the training texts: what the driver gathers, as arrays of numbers, and tasks are sent grows with the different sequences.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frostline.llm.lineage import cut, extended

ORDER = 5
DISCOUNT = 0.75
REJECT_SIGMAS = 4.0
SHARPNESS = 6.0
UNDETERMINED = "und"
_WORDS = re.compile(r"[^\W\d_]+")
_START, _END = "\x02", "\x03"
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_CACHE = 150_000
_BLOCK_CHARS = 1 << 20
_FLUSH = 400_000


def words_of(text: str | None) -> list[str]:
    """Runs of letters; digits and numbers of other kinds, such as fractions, part them."""
    words = _WORDS.findall(text.lower()) if text else []
    if all(map(str.isalpha, words)):
        return words
    return [x for w in words for x in ([w] if w.isalpha() else "".join(c if c.isalpha() else " " for c in w).split())]


def sequences(word: str, order: int = ORDER) -> list[str]:
    """Each character of the word and its end with its context; those near the start are shorter and begin with the start mark."""
    w = f"{_START}{word}{_END}"
    return [w[max(0, i - order + 1) : i + 1] for i in range(1, len(w))]


def sequence_counts(docs: DataFrame, text_col: str, lang_col: str, order: int = ORDER) -> DataFrame:
    """(lang, seq, n) over all rows of docs; tasks send counts, not texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = defaultdict(Counter)

        def flush() -> pa.RecordBatch:
            rows = [(lang, s, n) for lang, c in counts.items() for s, n in c.items()]
            counts.clear()
            cols = list(zip(*rows)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64())], names=["lang", "seq", "n"])

        for b in batches:
            words: dict[str, Counter] = defaultdict(Counter)
            for lang, text in zip(b.column(0), b.column(1)):
                words[lang.as_py()].update(words_of(text.as_py()))
                if len(words[lang.as_py()]) > _FLUSH:
                    _add(counts, words, order)
            _add(counts, words, order)
            if sum(map(len, counts.values())) > _FLUSH:
                yield flush()
        yield flush()

    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null")
    return rows.mapInArrow(run, "lang string, seq string, n long").groupBy("lang", "seq").agg(F.sum("n").alias("n"))


def _add(counts: dict[str, Counter], words: dict[str, Counter], order: int) -> None:
    for lang, c in words.items():
        own = counts[lang]
        for w, n in c.items():
            for s in sequences(w, order):
                own[s] += n
    words.clear()


def _hashes(points: np.ndarray, order: int) -> list[np.ndarray]:
    """For n = 1..order the hash of the n characters that end at each place (of fewer than n characters: meaningless)."""
    x = points.astype(np.uint64) + np.uint64(1)
    out = [x]
    for _ in range(order - 1):
        out.append(np.r_[np.zeros(1, np.uint64), out[-1][:-1]] * _MULTIPLIER + x)
    # the last character weighs 1 in every order: h(context + c) = h(context) * multiplier + c + 1
    return [(h ^ (h >> np.uint64(29))) * _MULTIPLIER for h in out]


def _hash(seqs: list[str]) -> np.ndarray:
    """Hashes of sequences of one length."""
    if not seqs:
        return np.empty(0, np.uint64)
    n = len(seqs[0])
    x = np.frombuffer("".join(seqs).encode("utf-32-le"), np.uint32).reshape(-1, n).astype(np.uint64) + np.uint64(1)
    h = x[:, 0]
    for j in range(1, n):
        h = h * _MULTIPLIER + x[:, j]
    return (h ^ (h >> np.uint64(29))) * _MULTIPLIER


@dataclass
class Models:
    langs: list[str]
    #: By order - 1: sorted hashes and (sequences, languages) log probabilities; of contexts, log weights.
    seq: list[tuple[np.ndarray, np.ndarray]]
    context: list[tuple[np.ndarray, np.ndarray]]
    unseen: np.ndarray  # log probability of a character that no model has seen
    limits: dict[str, float] = field(default_factory=dict)


def estimate(counts: DataFrame, order: int = ORDER, discount: float = DISCOUNT) -> Models:
    """Interpolated Kneser-Ney from counts (lang, seq, n) as sequence_counts() makes them.

    Sequences of full length and those that begin with the start mark have their counts; others count the different
    characters seen before them. Each order is one row per sequence, with an array of a number for every language.
    """
    counts = cut(counts)
    langs = [r.lang for r in counts.select("lang").distinct().orderBy("lang").collect()]
    if not langs:
        none = (np.empty(0, np.uint64), np.zeros((0, 0), np.float32))
        return Models([], [none] * order, [none] * order, np.zeros(0, np.float32))
    each = range(len(langs))
    levels: list[DataFrame] = []  # longest first
    for k in range(order, 0, -1):
        own = counts.where(F.length("seq") == k)
        if levels:  # the start mark is a left neighbour like any other
            own = own.unionByName(levels[-1].select("lang", F.substring("seq", 2, k).alias("seq"), F.lit(1).cast("long").alias("n")))
        levels.append(cut(own.groupBy("lang", "seq").agg(F.sum("n").alias("n"))))
    wide = [x.groupBy("seq").agg(*(F.sum(F.when(F.col("lang") == g, F.col("n")).otherwise(0)).alias(f"n{i}") for i, g in enumerate(langs))) for x in levels[::-1]]
    floor = 1.0 / (wide[0].count() + 1)
    below: DataFrame | None = None
    kind = "part int, k int, h long, p array<float>"
    tables = []
    for k, seqs in enumerate(wide):
        context = F.substring("seq", 1, k)
        sums = [f(i) for i in each for f in (lambda i: F.sum(f"n{i}").alias(f"t{i}"), lambda i: F.count_if(F.col(f"n{i}") > 0).alias(f"d{i}"))]
        contexts = seqs.groupBy(context.alias("context")).agg(*sums)
        weight = [F.when(F.col(f"t{i}") > 0, F.lit(discount) * F.col(f"d{i}") / F.col(f"t{i}")).otherwise(F.lit(1.0)) for i in each]
        contexts = contexts.select("context", *(F.col(f"t{i}") for i in each), *(w.alias(f"w{i}") for i, w in enumerate(weight)))
        both = seqs.withColumn("context", context).join(contexts, "context")
        if below is None:
            both = both.select("*", *(F.lit(floor).alias(f"b{i}") for i in each))
            unseen = np.log(np.array([contexts.first()[f"w{i}"] for i in each]) * floor).astype(np.float32)
        else:
            both = both.join(below.select(F.col("seq").alias("rest"), *(F.col(f"p{i}").alias(f"b{i}") for i in each)), F.substring("seq", 2, k) == F.col("rest"))
        share = lambda i: F.greatest(F.col(f"n{i}") - F.lit(discount), F.lit(0.0)) / F.greatest(F.col(f"t{i}"), F.lit(1)) + F.col(f"w{i}") * F.col(f"b{i}")
        below = cut(both.select("seq", *(share(i).alias(f"p{i}") for i in each)))
        tables.append(below.select(F.lit(0).alias("part"), F.lit(k).alias("k"), "seq", F.array(*(F.log(f"p{i}").cast("float") for i in each)).alias("p")))
        if k:
            tables.append(contexts.select(F.lit(1).alias("part"), F.lit(k).alias("k"), F.col("context").alias("seq"), F.array(*(F.log(f"w{i}").cast("float") for i in each)).alias("p")))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:  # a batch's sequences are of one length, as it is of one table
            seqs = b.column(2).to_pylist()
            sizes = np.fromiter(map(len, seqs), np.int64, len(seqs))
            h = np.empty(len(seqs), np.uint64)
            for n in set(sizes.tolist()):
                own = np.flatnonzero(sizes == n)
                h[own] = _hash([seqs[i] for i in own.tolist()])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(h.view(np.int64)), b.column(3)], names=["part", "k", "h", "p"])

    every = tables[0]
    for t in tables[1:]:
        every = every.unionByName(t)
    got = every.mapInArrow(hashed, kind).toArrow().combine_chunks()
    part, level, h = (got[c].to_numpy() for c in ("part", "k", "h"))
    p = got["p"].combine_chunks().flatten().to_numpy().reshape(-1, len(langs)) if len(got) else np.zeros((0, len(langs)), np.float32)

    def table(a: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        own = np.flatnonzero((part == a) & (level == k))
        own = own[np.argsort(h[own].view(np.uint64))]
        return h[own].view(np.uint64), p[own]

    return Models(langs, [table(0, k) for k in range(order)], [table(1, k) for k in range(order)], unseen)


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def score_words(words: list[str], m: Models) -> np.ndarray:
    """(words, languages): log probability of each word with its end."""
    order, L = len(m.seq), len(m.langs)
    joined = "".join(f"{_START}{w}{_END}" for w in words)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(w) + 2 for w in words])
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    place = np.arange(len(points)) - np.repeat(starts, sizes)  # in its word; the start mark is 0
    h = _hashes(points, order)
    total = np.zeros((len(points), L), np.float32)
    left = np.flatnonzero(place > 0)
    for k in range(order - 1, -1, -1):
        fits = place[left] >= k  # k characters of context are there
        now = left[fits]
        at, hit = _find(m.seq[k][0], h[k][now])
        done = now[hit]
        total[done] += m.seq[k][1][at[hit]]
        miss = now[~hit]
        if k:
            at, hit = _find(m.context[k][0], h[k - 1][miss - 1])
            total[miss[hit]] += m.context[k][1][at[hit]]
        else:
            total[miss] += m.unseen
        left = np.r_[left[~fits], miss]
    return np.add.reduceat(total, starts) if len(words) else np.zeros((0, L), np.float32)


class Scorer:
    """Scores texts in blocks; keeps the scores of up to _CACHE words between blocks."""

    def __init__(self, m: Models):
        self.m, self.at, self.scores = m, {}, np.zeros((0, len(m.langs)), np.float32)

    def cross_entropy(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(texts, languages) nats per character, and the characters (word ends included)."""
        tokens = [words_of(t) for t in texts]
        sizes = np.array([len(t) for t in tokens], np.int64)
        flat = [w for t in tokens for w in t]
        out = np.zeros((len(texts), len(self.m.langs)))
        chars = np.zeros(len(texts), np.int64)
        if not flat or not self.m.langs:
            return out, chars
        if len(self.at) > _CACHE:
            self.at, self.scores = {}, self.scores[:0]
        fresh = [w for w in dict.fromkeys(flat) if w not in self.at]
        if fresh:
            self.at.update(zip(fresh, range(len(self.at), len(self.at) + len(fresh))))
            self.scores = np.concatenate([self.scores, score_words(fresh, self.m)])
        ids = np.fromiter((self.at[w] for w in flat), np.int64, len(flat))
        lengths = np.fromiter(map(len, flat), np.int64, len(flat)) + 1
        some = np.flatnonzero(sizes)
        starts = (np.cumsum(sizes) - sizes)[some]
        chars[some] = np.add.reduceat(lengths, starts)
        out[some] = -np.add.reduceat(self.scores[ids].astype(np.float64), starts) / chars[some][:, None]
        return out, chars


def fit(docs: DataFrame, may_learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Models:
    """Models from all rows of which may_learn (over doc_id) holds and lang is not null."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(
        F.col("lang").isNotNull() & may_learn
    )
    models = estimate(sequence_counts(rows, "text", "lang"))
    if models.langs:
        scored = predict(rows.withColumn("l", F.col("lang").cast("string")), models, keep=("l",))
        stats = scored.where("lang_pred = l").groupBy("lang_pred").agg(F.avg("cross_entropy").alias("m"), F.stddev_pop("cross_entropy").alias("s"))
        models.limits = {r.lang_pred: r.m + REJECT_SIGMAS * max(r.s, 0.02) for r in stats.collect()}
    return models


def predict(docs: DataFrame, models: Models, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, lang_pred, score, cross_entropy, accepted.

    score is the languages' soft-max of minus SHARPNESS times the cross-entropy per character. A text that is null or has no letter, and any text
    if no language was learned, is 'und' with score 0, null cross_entropy, not accepted. Equal scores: the first language by name. A very long text is read whole. Null ids
    and repeated rows stay; no rows give no rows; other columns are not read.
    """
    names = np.array([*models.langs, UNDETERMINED], dtype=object)
    limits = np.array([models.limits.get(x, np.inf) for x in models.langs])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(models)
        for b in batches:
            texts, parts, block, size = b.column(0), [], [], 0
            for t in texts:
                block.append(t.as_py())
                size += len(block[-1] or "")
                if size >= _BLOCK_CHARS:
                    parts.append(scorer.cross_entropy(block))
                    block, size = [], 0
            parts.append(scorer.cross_entropy(block))
            h, chars = (np.concatenate(x) for x in zip(*parts))
            none = chars == 0
            if models.langs:
                best = h.argmin(axis=1)
                least = h[np.arange(len(h)), best]
                score = 1 / np.exp(-SHARPNESS * (h - least[:, None])).sum(axis=1)
                ok = ~none & (least <= limits[best])
            else:
                best, least, score, ok = np.zeros(len(h), int), np.zeros(len(h)), np.zeros(len(h)), np.zeros(len(h), bool)
            out = [pa.array(names[np.where(none, len(models.langs), best)], pa.string()), pa.array(np.where(none, 0.0, score)), pa.array(least, mask=none), pa.array(ok)]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *out], names=[*b.schema.names[1:], "lang_pred", "score", "cross_entropy", "accepted"])

    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("doc_id"), *keep)
    return rows.mapInArrow(run, extended(rows.drop("text"), "lang_pred string, score double, cross_entropy double, accepted boolean"))
