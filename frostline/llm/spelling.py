"""Spelling variants: words that differ by one character, grouped under the form that is far more frequent.

Neighbours are found exactly by a dictionary of trie-node pairs. The nodes of the trie of all words and of the trie of all reversed words
get numbers, so a prefix and a suffix are one integer each. Leaving out place i of a word gives the pair (node of the prefix before i, node of the suffix after i), and
inserting at place i the pair (node before i, node from i on). Words with the same left-out pair differ in that one character; a word whose insertion pair equals another's
left-out pair is that word less one character. No two words share a pair otherwise, so a pair has at most one word for each character of the alphabet and one shorter word: no
group grows with the input, and neighbours are counted from the groups' sizes without writing a row for any pair of words.

Numbering the nodes needs no walk level by level. Words are ranged and sorted; a node that crosses a border between two partitions is a prefix of the separator of the two,
so the tries of the separators (one per partition, each cut as short as it can be) are numbered once and told to all tasks, and every other node belongs to one partition, which numbers it in
one pass over its sorted words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostline.llm.lineage import cut, written
from frostline.llm.packing import blocks_of

MIN_LENGTH, MIN_COUNT, RATIO = 7, 2, 10
#: One run in so many, told by its checksum, loses one character.
DAMAGED = 31
#: The letters of words.
LETTERS = "A-Za-zÀ-ÿ"
#: Words of a task's table before it is sent on, words of a partition, and places of a batch of pairs.
_HELD, _PART_WORDS, _BATCH = 400_000, 100_000, 200_000


def damaged(word: str, h: int) -> str:
    """The word without the character at place h modulo its length."""
    i = h % len(word)
    return word[:i] + word[i + 1 :]


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = MIN_LENGTH, rate: int = DAMAGED) -> DataFrame:
    """(word, n): how often each word of at least that many characters stands in all texts, once the damage is done.

    A word is a longest run of LETTERS, with A-Z in lower case; all occurrences of a run in a document are damaged alike. A null text has no words, a null id counts as empty text.
    """
    runs = re.compile(f"[{LETTERS.replace('A-Z', '')}]{{{least},}}").findall

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, int] = {}

        def full() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])
            total.clear()
            return out

        for b in batches:
            ids = iter(b.column(0).to_pylist())
            for text in chain.from_iterable(blocks_of(b.column(1))):
                head = zlib.crc32(f"{next(ids) or ''}:".encode())
                # bytes.lower() is that of A-Z alone
                for word, n in Counter(runs(text.encode().lower().decode())).items():
                    h = zlib.crc32(word.encode(), head)
                    if h % rate == 0:
                        word = damaged(word, h)
                        if len(word) < least:
                            continue
                    total[word] = total.get(word, 0) + n
                if len(total) >= _HELD:
                    yield full()
        if total:
            yield full()

    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def separator(before: str, after: str) -> str:
    """The shortest prefix of after that is over before; before < after."""
    i = next((i for i, (x, y) in enumerate(zip(before, after)) if x != y), len(before))
    return after[: i + 1]


def spine_of(separators: list[str]) -> dict[str, int]:
    """Numbers for the nodes that several partitions may share: all prefixes of the separators, the empty one first."""
    return {p: i for i, p in enumerate(sorted({""}.union(*({s[:d] for d in range(1, len(s) + 1)} for s in separators))))}


class Numbering:
    """The trie nodes along each word of one partition, words given in ascending order."""

    def __init__(self, spine: dict[str, int], part: int):
        self.spine, self.next = spine, (part + 1) << 40
        self.last, self.path = "", [spine[""]]

    def nodes(self, word: str) -> list[int]:
        """The numbers of the word's prefixes, the empty one first."""
        same = next((i for i, (x, y) in enumerate(zip(self.last, word)) if x != y), min(len(self.last), len(word)))
        del self.path[same + 1 :]
        for d in range(same + 1, len(word) + 1):
            shared = self.spine.get(word[:d]) if self.path[-1] < 1 << 40 else None
            if shared is None:
                shared, self.next = self.next, self.next + 1
            self.path.append(shared)
        self.last = word
        return self.path


def ranged(words: DataFrame, by: str, parts: int) -> tuple[DataFrame, dict[str, int]]:
    """words in partitions by ranges of the column, each sorted, and the numbers of the nodes that partitions share. One row per partition comes to the driver."""
    rows = cut(words.repartitionByRange(parts, by).sortWithinPartitions(by))
    ends = rows.groupBy(F.spark_partition_id().alias("part")).agg(F.min(by).alias("a"), F.max(by).alias("z")).orderBy("part").collect()
    return rows, spine_of([separator(x.z, y.a) for x, y in zip(ends, ends[1:])])


def with_prefix_nodes(rows: DataFrame, spine: dict[str, int]) -> DataFrame:
    """(rank, word, n, nodes); ranks ascend as words do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        trie = Numbering(spine, part)
        for b in batches:
            nodes = [list(trie.nodes(w)) for w in b.column(0).to_pylist()]
            rank = pa.array(np.arange(at, at + len(nodes)) + (part << 40))
            at += len(nodes)
            yield pa.RecordBatch.from_arrays([rank, b.column(0), b.column(1), pa.array(nodes, pa.list_(pa.int64()))], names=["rank", "word", "n", "nodes"])

    return rows.select("word", "n").mapInArrow(run, "rank long, word string, n long, nodes array<long>")


SPLIT, SKIP, FIRST_SKIP = 0, 1, 2


def pairs(rows: DataFrame, spine: dict[str, int]) -> DataFrame:
    """(p, s, rank, n, kind): the pairs of every word; rows has rank, n, nodes (of its prefixes) and drow, the reversed word.

    kind is SPLIT for the pair that inserting uses, and SKIP for a left-out place; leaving out any of a run of equal characters gives the same shorter word, so the first of them is FIRST_SKIP.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        trie = Numbering(spine, TaskContext.get().partitionId())
        out: list[list[np.ndarray]] = []
        held = 0

        def full() -> pa.RecordBatch:
            p, s, rank, n, kind = (np.concatenate(x) for x in zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(p), pa.array(s), pa.array(rank), pa.array(n), pa.array(kind)], names=["p", "s", "rank", "n", "kind"])

        for b in batches:
            for drow, rank, n, before in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3)):
                size = len(drow)
                after = np.array(trie.nodes(drow)[::-1])  # after[i] is the node of the suffix from i on
                pre = before.values.to_numpy()
                letters = np.frombuffer(drow.encode("utf-32-le"), np.uint32)[::-1]
                skip = np.full(size, SKIP, np.int8)
                skip[np.flatnonzero(np.diff(letters, prepend=0))] = FIRST_SKIP
                p, s = np.concatenate([pre[:-1], pre]), np.concatenate([after[1:], after])
                out.append([p, s, np.full(2 * size + 1, rank), np.full(2 * size + 1, n), np.concatenate([skip, np.full(size + 1, SPLIT, np.int8)])])
                held += 2 * size + 1
                if held >= _BATCH:
                    held = 0
                    yield full()
        if out:
            yield full()

    return rows.select("drow", "rank", "n", "nodes").mapInArrow(run, "p long, s long, rank long, n long, kind byte")


def near_words(dictionary: DataFrame) -> DataFrame:
    """(rank, n_near, best): how many words of the dictionary are near each that has any, and struct(n, -rank) of the most frequent of them, of equals the first."""
    shared = dictionary.groupBy("p", "s").agg(F.collect_list(F.struct("n", (-F.col("rank")).alias("back"), "kind")).alias("m")).where("size(m) > 1")
    words = lambda f: F.transform(F.filter("m", f), lambda x: F.struct(x["n"], x["back"]))
    sets = shared.select("m", words(lambda x: x["kind"] != SPLIT).alias("skips"), words(lambda x: x["kind"] == SPLIT).alias("shorter"), words(lambda x: x["kind"] == FIRST_SKIP).alias("longer"))
    tops = sets.withColumn("top", F.array_max("skips")).withColumn("second", F.array_max(F.filter("skips", lambda x: x != F.col("top")))).select("*", F.array_max("longer").alias("long_top"), F.array_max("shorter").alias("short"))

    def given(x):
        own = F.struct(x["n"], x["back"])
        replaced = F.when(own == F.col("top"), F.col("second")).otherwise(F.col("top"))
        less = F.when(x["kind"] == FIRST_SKIP, F.col("short"))
        n = F.when(x["kind"] == SPLIT, F.size("longer")).otherwise(F.size("skips") - 1 + F.when(less.isNotNull(), 1).otherwise(0))
        best = F.when(x["kind"] == SPLIT, F.col("long_top")).otherwise(F.greatest(replaced, less))
        return F.struct((-x["back"]).alias("rank"), n.cast("long").alias("n_near"), best.alias("best"))

    each = tops.select(F.explode(F.transform("m", given)).alias("g")).select("g.*").where("n_near > 0")
    return each.groupBy("rank").agg(F.sum("n_near").alias("n_near"), F.max("best").alias("best"))


def roots_of(forms: DataFrame) -> DataFrame:
    """(rank, root) of (rank, form): forms followed to the last, doubling the steps each round. A form is over the word in count, so there are no cycles."""
    at = cut(forms.select("rank", F.col("form").alias("root")))
    while True:
        onward = at.select(F.col("rank").alias("root"), F.col("root").alias("further"))
        more = cut(at.join(onward, "root", "left").select("rank", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        at = more.select("rank", "root")
        if more.where("moved").isEmpty():
            return at


def group_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = MIN_LENGTH, rate: int = DAMAGED, min_count: int = MIN_COUNT, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of at least that many characters that occurs min_count times.

    Two words are near if one character inserted, deleted or replaced makes one of the other. form is the near word of largest n, of equals the first in code-point order, if its n is ratio times
    the word's own, else null; root is where following forms ends, the word itself if it has none. Texts are read whole, null and empty ones have no words; rows that repeat an id or a text count
    each; no rows, or no such words, give no rows; other columns are not read. The length of a word is bounded only by its text.
    """
    words = written(count_words(docs, id_col, text_col, least, rate).where(F.col("n") >= min_count))
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, -(-words.count() // _PART_WORDS))
    rows, spine = ranged(words, "word", parts)
    numbered = written(with_prefix_nodes(rows, spine))
    reverse, spine = ranged(numbered.select(F.reverse("word").alias("drow"), "rank", "n", "nodes"), "drow", parts)
    near = cut(near_words(pairs(reverse, spine)))
    best = numbered.select("rank", "word", "n").join(near, "rank", "left")
    chosen = F.col("best.n") >= ratio * F.col("n")
    best = best.select("rank", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(chosen, -F.col("best.back")).alias("form_rank"), F.when(chosen, F.col("best.n")).alias("form_n"))
    roots = roots_of(best.where("form_rank is not null").select("rank", F.col("form_rank").alias("form")))
    name = lambda rank, word: numbered.select(F.col("rank").alias(rank), F.col("word").alias(word))
    out = best.join(roots.select("rank", F.col("root").alias("root_rank")), "rank", "left").join(name("form_rank", "form"), "form_rank", "left").join(name("root_rank", "root"), "root_rank", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
