"""Benchmark decontamination by greedy string tiling.

A seed is SEED words (lower-cased runs of word characters) that a document and a benchmark item share, found
by one rolling Karp-Rabin hash. The documents' windows are first tested against a bitmap of fixed size
made from the benchmark's seeds, so only windows that may be seeds leave the scan; an equi-join on the
hash finds the items. Per document and item, runs of seeds on one diagonal are the maximal matches, and
tiling takes the longest match whose words are still unmarked on both sides, again and again. Tiles count wherever they
stand, so reordered passages are caught. An item is leaked if the tiles cover COVERAGE of its words.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostline.llm.lineage import cut, extended

SEED = 5
COVERAGE = 0.5
#: Bits of the bitmap: 512 KB whatever the benchmark's size.
BITMAP_BITS = 22
_WORDS = re.compile(r"\w+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_CACHE = 300_000
#: Pairs of places over which a document and an item are tiled without making them.
PAIRS = 1_000_000
_BLOCK_CHARS = 1 << 20


def words_of(text: str | None) -> list[str]:
    return _WORDS.findall(text.lower()) if text else []


class WordHashes(dict):
    """64-bit hashes of words; keeps those of the first _CACHE words."""

    def __missing__(self, word: str) -> int:
        from xxhash import xxh64_intdigest

        h = xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 7)
        if len(self) < _CACHE:
            self[word] = h
        return h


def window_hashes(words: np.ndarray, size: int = SEED) -> np.ndarray:
    """Karp-Rabin hashes of every size words in a row, mixed."""
    n = len(words) - size + 1
    if n < 1:
        return np.empty(0, np.uint64)
    h = words[:n].copy()
    for j in range(1, size):
        h = h * _BASE + words[j : j + n]
    return (h ^ (h >> np.uint64(31))) * _BASE


def _windows(texts, hashes: WordHashes, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For blocks of texts: each window's hash, its text's row, its first word's place, and each row's number of words."""

    def done(rows: list[list[str]], first: int):
        flat = [w for r in rows for w in r]
        sizes = np.array([len(r) for r in rows], np.int64)
        words = np.fromiter(map(hashes.__getitem__, flat), np.uint64, len(flat))
        h = window_hashes(words, size)
        row = np.repeat(np.arange(len(rows)), sizes)
        start = np.repeat(np.cumsum(sizes) - sizes, sizes)
        place = np.arange(len(flat)) - start
        own = (place + size <= sizes[row])[: len(h)] if len(h) else np.zeros(0, bool)
        return h[own], row[: len(h)][own] + first, place[: len(h)][own], sizes

    rows, size_now, first = [], 0, 0
    for i, t in enumerate(texts):
        text = t.as_py()
        rows.append(words_of(text))
        size_now += len(text or "")
        if size_now >= _BLOCK_CHARS:
            yield done(rows, first)
            rows, size_now, first = [], 0, i + 1
    if rows:
        yield done(rows, first)


def seeds_of(items: DataFrame, size: int = SEED) -> DataFrame:
    """(seed, item_id, item_key, item_words, item_at) of every window of every different (item_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            at = 0
            for h, row, place, sizes in _windows(b.column(2), hashes, size):
                pick = pa.array(row, pa.int64())
                out = [pa.array(h.view(np.int64)), b.column(0).take(pick), b.column(1).take(pick), pa.array(sizes[row - at], pa.int32()), pa.array(place, pa.int32())]
                at += len(sizes)
                yield pa.RecordBatch.from_arrays(out, names=["seed", "item_id", "item_key", "item_words", "item_at"])

    return items.mapInArrow(run, "seed long, item_id " + items.schema["item_id"].dataType.simpleString() + ", item_key long, item_words int, item_at int")


def seed_bitmap(seeds: DataFrame, bits: int = BITMAP_BITS) -> np.ndarray:
    """Bit s is set if a seed's top bits are s: at most 2**bits / 64 longs come to the driver."""
    slot = F.shiftrightunsigned("seed", 64 - bits)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))
    words = seeds.select(F.shiftright(slot, 6).alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("set")).collect()
    out = np.zeros(1 << (bits - 6), np.int64)
    for r in words:
        out[r.word] = r["set"]
    return out.view(np.uint64)


def candidate_windows(docs: DataFrame, bitmap: np.ndarray, size: int = SEED) -> DataFrame:
    """(doc_id, doc_key, seed, doc_at) of the windows whose hash the bitmap knows; docs: doc_id, doc_key, text."""
    bits = int(np.log2(len(bitmap))) + 6

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            for h, row, place, _ in _windows(b.column(2), hashes, size):
                slot = (h >> np.uint64(64 - bits)).astype(np.int64)
                on = (bitmap[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1) > 0
                pick = pa.array(row[on], pa.int64())
                out = [b.column(0).take(pick), b.column(1).take(pick), pa.array(h[on].view(np.int64)), pa.array(place[on], pa.int32())]
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "doc_key", "seed", "doc_at"])

    return docs.mapInArrow(run, extended(docs.select("doc_id"), "doc_key long, seed long, doc_at int"))


def pairs_of(doc: list[tuple[int, int]], item: list[tuple[int, int]]) -> np.ndarray:
    """(n, 2) places in document and item that have a seed in common, from the (seed, place) of either."""
    (ds, dp), (ks, kp) = (np.array(sorted(set(x)), np.int64).reshape(-1, 2).T for x in (doc, item))
    lo, hi = np.searchsorted(ks, ds, "left"), np.searchsorted(ks, ds, "right")
    n = hi - lo
    at = np.arange(n.sum()) - np.repeat(n.cumsum() - n, n) + np.repeat(lo, n)
    return np.stack([np.repeat(dp, n), kp[at]], axis=1)


def runs_of(pairs: np.ndarray, size: int = SEED) -> list[tuple[int, int, int]]:
    """Maximal matches (place in document, place in item, words): neighbours on one diagonal, each a word further."""
    if not len(pairs):
        return []
    d, i = pairs[np.lexsort((pairs[:, 0], pairs[:, 0] - pairs[:, 1]))].T
    new = np.flatnonzero(np.r_[True, (np.diff(d) != 1) | (np.diff(i) != 1)])
    return list(zip(d[new].tolist(), i[new].tolist(), (np.diff(np.r_[new, len(d)]) + size - 1).tolist()))


def tile(pairs: np.ndarray | list[tuple[int, int]], size: int = SEED) -> list[tuple[int, int, int]]:
    """Greedy string tiling of the matches that seeds (place in document, place in item) make: (document, item, words) tiles."""
    runs = runs_of(np.array(sorted(set(map(tuple, pairs))) if isinstance(pairs, list) else pairs, np.int64).reshape(-1, 2), size)
    heap = [(-n, d, i) for d, i, n in runs]
    heapq.heapify(heap)
    in_doc: set[int] = set()
    in_item: set[int] = set()
    tiles = []
    while heap:
        n, d, i = heapq.heappop(heap)
        free = [d + k not in in_doc and i + k not in in_item for k in range(-n)]
        if all(free):
            tiles.append((d, i, -n))
            in_doc.update(range(d, d - n))
            in_item.update(range(i, i - n))
            continue
        k = 0
        while k < -n:  # the unmarked stretches that are long enough compete again
            e = k
            while e < -n and free[e]:
                e += 1
            if e - k >= size:
                heapq.heappush(heap, (-(e - k), d + k, i + k))
            k = e + 1
    return sorted(tiles)


def _joined(doc: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(ranks, places, n): document and item in one sequence of seeds' numbers with a number of its own wherever places do not go on; the first n entries are the document's."""
    parts, at = [], []
    for seeds, places in (doc, item):
        order = np.argsort(places)
        seeds, places = seeds[order], places[order]
        gap = np.flatnonzero(np.diff(places) != 1) + 1
        ends = np.r_[gap, len(places)]
        parts.append(np.insert(seeds, ends, 0))
        at.append(np.insert(places, ends, -1))
    places = np.concatenate(at)
    ranks = np.unique(np.concatenate(parts), return_inverse=True)[1]
    stops = places < 0
    ranks[stops] = len(ranks) + np.arange(stops.sum())
    return ranks, places, len(at[0])


def tile_long(doc: np.ndarray, item: np.ndarray, size: int = SEED) -> list[tuple[int, int, int]]:
    """tile() of the pairs that doc and item, each (seeds, places), make, without making them: memory grows with the places of both, not with their product.

    Windows of so many seeds are equal if their halves are, so numbers for windows of 1, 2, 4, .. seeds tell any two windows apart exactly. The longest length with two equal unmarked windows is found by bisection; all tiles of
    that length are marked in order, and the next length follows.
    """
    ranks, places, n_doc = _joined(doc, item)
    levels = [ranks]
    while 2 ** len(levels) < len(ranks):
        half, step = levels[-1], 2 ** (len(levels) - 1)
        pair = half[:-step].astype(np.int64) * (len(ranks) * 2 + 1) + half[step:]
        levels.append(np.unique(pair, return_inverse=True)[1])
    marked = [np.zeros(int(p.max()) + size + 1, bool) for p in (places[:n_doc], places[n_doc:])]

    def free(q: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of document and item: (window numbers, places) of the windows of q seeds whose words are all unmarked."""
        k = q.bit_length() - 1
        level, last = levels[k], len(ranks) - q + 1
        number = level[:last].astype(np.int64) * (len(ranks) * 2 + 1) + level[q - 2**k : q - 2**k + last]
        out = []
        for side, used in ((slice(0, max(0, min(n_doc, last))), marked[0]), (slice(min(n_doc, last), last), marked[1])):
            at, own = places[:last][side], number[side]
            # a window that holds a break is equal to none, but must not run out of the words' array
            at = np.where((at >= 0) & (at + q + size - 1 < len(used)), at, -1)
            count = np.concatenate([[0], used.cumsum()])
            ok = (at >= 0) & (count[np.maximum(at, 0) + np.where(at >= 0, q + size - 1, 0)] == count[np.maximum(at, 0)])
            out.append((own[ok], at[ok]))
        return out

    def matches(q: int) -> bool:
        (d, _), (i, _) = free(q)
        return len(np.intersect1d(d, i)) > 0

    tiles, high = [], len(ranks)
    while True:
        low = 0  # the longest length of at most high seeds that has a match
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if matches(mid) else (low, mid - 1)
        if not low:
            return sorted(tiles)
        (dn, dp), (kn, kp) = free(low)
        common = np.intersect1d(dn, kn)
        waiting: dict[int, list[int]] = {}
        for number, at in sorted(zip(kn[np.isin(kn, common)].tolist(), kp[np.isin(kn, common)].tolist()), reverse=True):
            waiting.setdefault(number, []).append(at)  # the least place last
        words = low + size - 1
        for at, number in sorted(zip(dp[np.isin(dn, common)].tolist(), dn[np.isin(dn, common)].tolist())):
            if marked[0][at : at + words].any():
                continue
            own = waiting[number]
            while own and marked[1][own[-1] : own[-1] + words].any():
                own.pop()
            if own:
                tiles.append((at, own[-1], words))
                marked[0][at : at + words] = marked[1][own[-1] : own[-1] + words] = True
        high = low - 1


def tile_places(doc: tuple[np.ndarray, np.ndarray], item: tuple[np.ndarray, np.ndarray], size: int = SEED) -> list[tuple[int, int, int]]:
    """The tiles of a document and an item, each (seeds, places); where both repeat seeds so that over PAIRS pairs would meet, by tile_long(), which gives the same."""
    known, count = np.unique(item[0], return_counts=True)
    at = np.minimum(np.searchsorted(known, doc[0]), len(known) - 1)
    if int(np.where(known[at] == doc[0], count[at], 0).sum()) > PAIRS:
        return tile_long(doc, item, size)
    return tile(pairs_of(*(list(zip(s.tolist(), p.tolist())) for s, p in (doc, item))), size)


def tilings(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
            item_text_col: str = "text", size: int = SEED) -> DataFrame:
    """One row for each document and item that share a seed: doc_id, doc_key, item_id, item_words, covered, tiles (array of
    doc_at, item_at, words)."""
    key = F.xxhash64(F.col("text"))
    own = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).cast("string").alias("text"))
    own = own.where("text is not null").distinct().select("item_id", key.alias("item_key"), "text")
    seeds = cut(seeds_of(own, size))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    found = candidate_windows(rows.select("doc_id", key.alias("doc_key"), "text"), seed_bitmap(seeds), size)
    # a document's places and an item's travel side by side, not in pairs: where both repeat a passage, rows grow with their lengths and not with the product
    item = ["item_id", "item_key"]
    of_item = seeds.groupBy(*item).agg(F.first("item_words").alias("item_words"), F.collect_set(F.struct("seed", "item_at")).alias("item_places"))
    met = found.join(seeds.select("seed", *item).distinct(), "seed").groupBy("doc_id", "doc_key", *item).agg(F.collect_set(F.struct("seed", "doc_at")).alias("doc_places"))
    both = met.join(of_item, met["item_id"].eqNullSafe(of_item["item_id"]) & (met["item_key"] == of_item["item_key"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("doc_at", pa.int32()), ("item_at", pa.int32()), ("words", pa.int32())]))

        def places(column: pa.Array, name: str):
            for x in column:
                yield x.values.field("seed").to_numpy(), x.values.field(name).to_numpy().astype(np.int64)

        for b in batches:
            tiles = [tile_places(d, i, size) for d, i in zip(places(b.column(4), "doc_at"), places(b.column(5), "item_at"))]
            out = [pa.array([sum(t[2] for t in ts) for ts in tiles], pa.int32()), pa.array([[{"doc_at": d, "item_at": i, "words": n} for d, i, n in ts] for ts in tiles], kind)]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], *out], names=["doc_id", "doc_key", "item_id", "item_words", "covered", "tiles"])

    rows = both.select("doc_id", "doc_key", met["item_id"], "item_words", "doc_places", "item_places")
    return rows.mapInArrow(run, extended(rows.drop("doc_places", "item_places"), "covered int, tiles array<struct<doc_at: int, item_at: int, words: int>>"))


def worst(tiled: DataFrame) -> DataFrame:
    """(doc_id, doc_key, item_id, coverage, n_tiles) of the item that each document covers most (ties: the least item_id, of whatever type, null first)."""
    share = F.col("covered") / F.col("item_words")
    top = F.min(F.struct((-share).alias("turned"), "item_id", F.size("tiles").alias("n_tiles")))
    best = tiled.groupBy("doc_id", "doc_key").agg(top.alias("b"))
    return best.select("doc_id", "doc_key", "b.item_id", (-F.col("b.turned")).alias("coverage"), "b.n_tiles")


def leaks(docs: DataFrame, items: DataFrame, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text",
          item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, leaked, item_id and coverage of the worst item (null without a shared seed), n_tiles.

    Ids may be of any type that has an order. Items of fewer than SEED words and null texts share nothing. Repeated items count once;
    repeated documents and null ids stay, each judged on its text; no documents give no rows; without items
    nothing leaks; a very long text is read whole, block by block; of items covered alike the least id is named, null before others; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("doc_key"))
    top = worst(tilings(docs, items, id_col, text_col, item_col, item_text_col)).withColumnsRenamed({"doc_id": "d", "doc_key": "k"})
    met = rows.join(top, rows.doc_id.eqNullSafe(top.d) & (rows.doc_key == top.k), "left")
    return met.select("doc_id", (F.coalesce("coverage", F.lit(0.0)) >= coverage).alias("leaked"), "item_id", "coverage", "n_tiles")


def keep_clean(docs: DataFrame, items: DataFrame, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text",
               item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """docs without those that leak, columns as they are.

    Null, empty and short texts share nothing and stay; a very long text is read whole, block by block; rows that repeat an id go or stay each on its own text, and
    null ids like others; of items covered alike the least id counts, which changes nothing here; no documents give no rows, without items all stay; columns of any other name pass through.
    """
    top = worst(tilings(docs, items, id_col, text_col, item_col, item_text_col)).where(F.col("coverage") >= coverage)
    bad = top.select("doc_id", "doc_key")
    same = docs[id_col].eqNullSafe(bad["doc_id"]) & (F.xxhash64(docs[text_col].cast("string")) == bad["doc_key"])
    return docs.join(bad, same, "left_anti")
