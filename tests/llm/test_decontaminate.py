import random
import re

import numpy as np

from frostline.llm import decontaminate as dc
from frostline.llm.queries import op7_decontaminate
from frostline.llm.decontaminate import pairs_of, runs_of, tilings


def words(t):
    return re.findall(r"\w+", (t or "").lower())


def naive_tiles(a, b, size=dc.SEED):
    """Greedy string tiling as published: look for the longest common unmarked stretches, mark them, go on until none is long enough."""
    in_a, in_b, tiles = [False] * len(a), [False] * len(b), []
    while True:
        best, found = size, []
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and not in_a[i + k] and not in_b[j + k]:
                    k += 1
                if k > best:
                    best, found = k, [(i, j)]
                elif k == best:
                    found.append((i, j))
        if not found:
            return tiles
        for i, j in found:
            if not any(in_a[i : i + best]) and not any(in_b[j : j + best]):
                tiles.append((i, j, best))
                in_a[i : i + best] = in_b[j : j + best] = [True] * best


def seeds(a, b, size=dc.SEED):
    at = {}
    for j in range(len(b) - size + 1):
        at.setdefault(tuple(b[j : j + size]), []).append(j)
    return [(i, j) for i in range(len(a) - size + 1) for j in at.get(tuple(a[i : i + size]), [])]


def test_tiling_is_the_published_one():
    rng = random.Random(5)
    for _ in range(60):
        b = [rng.choice("abcdefghij") for _ in range(rng.randrange(5, 40))]
        a = [rng.choice("abcdefghij") for _ in range(30)]
        for _ in range(rng.randrange(4)):
            i, n = rng.randrange(len(b)), rng.randrange(5, 15)
            a[rng.randrange(len(a)) : 0] = b[i : i + n]
        got, want = dc.tile(seeds(a, b)), naive_tiles(a, b)
        assert sum(t[2] for t in got) == sum(t[2] for t in want)
        assert sorted(t[2] for t in got) == sorted(t[2] for t in want)
    assert dc.tile([(i, j) for i in range(40) for j in range(10)]) and sum(t[2] for t in dc.tile([(i, j) for i in range(40) for j in range(10)])) <= 14


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs, items = spark.read.parquet(f"{sf}/documents.parquet").collect(), spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    own = {i.item_id: words(i.text) for i in items}
    grams = {k: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for k, w in own.items()}
    got = {r.doc_id: r for r in op7_decontaminate(spark, sf).collect()}
    assert len(got) == len(docs)
    leaked = 0
    for d in docs:
        a = words(d.text)
        mine = {tuple(a[j : j + 5]) for j in range(len(a) - 4)}
        share = {k: sum(t[2] for t in dc.tile(seeds(a, w))) / len(w) for k, w in own.items() if grams[k] & mine}
        top = max(share.values(), default=None)
        assert got[d.doc_id].coverage == top and got[d.doc_id].leaked == ((top or 0) >= dc.COVERAGE)
        leaked += got[d.doc_id].leaked
    assert leaked


def test_reordered_passages_are_caught_and_clean_ones_stay(spark, text_rows):
    item = [f"term{i}" for i in range(40)]
    mixed = " ".join([*item[20:32], "between", *item[0:14], "and", *item[32:40], *item[14:20]])
    rows = [(1, f"before {mixed} after"), (2, " ".join(item).upper().replace(" ", ", ")), (3, " ".join(item[:19])), (4, "term1 term2 term3 term4"), (5, None), (6, ""), (6, " ".join(item)), (6, "clean"), (None, " ".join(item))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as seed", "'x' as item_id", "2 as d", "3 as k")
    items = spark.createDataFrame([(7, " ".join(item)), (7, " ".join(item)), (8, "term1 term2"), (9, None), (None, "")], "item_id long, text string")
    got = sorted(((r.doc_id, r.leaked, r.item_id) for r in dc.leaks(docs, items).collect()), key=str)
    assert got == sorted([(1, True, 7), (2, True, 7), (3, False, 7), (4, False, None), (5, False, None), (6, False, None), (6, False, None), (6, True, 7), (None, True, 7)], key=str)
    kept = dc.keep_clean(docs, items)
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6, 6] and kept.columns == docs.columns
    assert dc.leaks(docs.limit(0), items).count() == 0
    assert not any(r.leaked for r in dc.leaks(text_rows, items.limit(0)).collect()) and dc.leaks(text_rows, items).count() == 9


def test_long_texts_go_in_blocks(spark):
    item = [f"term{i}" for i in range(12)]
    text = " ".join(f"w{i}" for i in range(200_000)) + " " + " ".join(item)
    docs = spark.createDataFrame([(1, text), (2, text[: len(text) // 2])], "doc_id long, text string")
    got = {r.doc_id: r.leaked for r in dc.leaks(docs, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()}
    assert got == {1: True, 2: False}


def test_repeats_on_both_sides(spark):
    """A long repetitive document against a repetitive item: rows carry both sides' places, not their product, and the tiles are those of the definition."""
    import time

    docs = spark.createDataFrame([(1, "a " * 60_000), (2, "a b " * 500), (3, "c d e f g h")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a " * 40), (2, "a b " * 20)], "item_id long, text string")
    start = time.time()
    got = {(r.doc_id, r.item_id): r.covered for r in tilings(docs, items).collect()}
    assert got == {(1, 1): 40, (2, 2): 40} and time.time() - start < 90
    pairs = pairs_of([(7, 0), (7, 1), (9, 2)], [(7, 5), (7, 6), (8, 1)])
    assert sorted(map(tuple, pairs.tolist())) == [(0, 5), (0, 6), (1, 5), (1, 6)]
    assert sorted(runs_of(pairs)) == [(0, 5, 6), (0, 6, 5), (1, 5, 5)]


def test_tiling_without_pairs_is_the_same():
    """Few different seeds, gaps and long repeats: the tiles of all pairs, and of none."""
    rng = np.random.default_rng(6)
    for trial in range(150):
        size, kinds = int(rng.integers(1, 4)), int(rng.integers(1, 5))
        sides = []
        for _ in range(2):
            places = np.flatnonzero(rng.random(int(rng.integers(1, 60))) < rng.choice([0.5, 0.9, 1.0]))
            places = places if len(places) else np.array([0])
            seeds = np.repeat(rng.integers(0, kinds, len(places)), rng.integers(1, 4, len(places)))[: len(places)]
            sides.append((seeds.astype(np.int64), places.astype(np.int64)))
        pairs = dc.pairs_of(*(list(zip(s.tolist(), p.tolist())) for s, p in sides))
        assert dc.tile_long(*sides, size) == dc.tile(pairs, size), trial


def test_one_word_repeated(spark):
    """100,000 equal words and an item of 10,000: a billion pairs that are never made."""
    import resource

    seeds = lambda n: (np.zeros(n, np.int64), np.arange(n))
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert dc.tile_places(seeds(99_996), seeds(9_996)) == [(0, 0, 10_000)]
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 300_000  # kB
    docs = spark.createDataFrame([(1, "ja " * 30_000), (2, "ja nein " * 3000)], "doc_id long, text string")
    items = spark.createDataFrame([("b", "ja " * 2000), ("a", "ja " * 2000), ("c", "nein ja " * 500), (None, "x y z")], "item_id string, text string")
    got = {r.doc_id: (r.leaked, r.item_id, r.coverage) for r in dc.leaks(docs, items).collect()}
    assert got == {1: (True, "a", 1.0), 2: (True, "c", 1.0)}
