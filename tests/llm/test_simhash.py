import random

import numpy as np
import pytest
import xxhash

from frostline.llm import simhash
from frostline.llm.components import connected_components


def brute_fingerprint(text, size=4):
    words = [w for w in (text or "").translate({i: i + 32 for i in range(65, 91)}).replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    sh = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprint_is_the_majority():
    rng = random.Random(1)
    texts = [None, "", "  ", "A", "a B c", "É a b c d", "a\u00a0b c\td\ne", *(" ".join(rng.choice("abcdefgh") for _ in range(n)) for n in (4, 5, 50, 3000))]
    assert [simhash.fingerprint(t) for t in texts] == [brute_fingerprint(t) for t in texts]


def union(n, edges):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, x) for x in range(101, 160)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(80)] + [(5, 5)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = union(300, edges)
    assert all(want[k] == v for k, v in got.items()) and set(got) == {x for a, b in edges if a != b for x in (a, b)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_anchors_meet_every_near_pair(spark):
    """Random clusters with 0 to 6 flipped bits: the links connect what brute force connects, and nothing else."""
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(60)] + [0, 2**64 - 1, 1 << 63]
    fps = set(base)
    for b in base:
        x = b
        for _ in range(8):
            y = x
            for bit in rng.sample(range(64), rng.randrange(1, 7)):
                y ^= 1 << bit
            fps.add(y)
            x = rng.choice([x, y])
    fps = sorted(fps)
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    links = simhash.near_pairs(spark.createDataFrame([(s,) for s in signed], "fp long")).collect()
    place = {s: i for i, s in enumerate(signed)}
    near = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    met = [(place[r.a], place[r.b]) for r in links]
    assert all((fps[i] ^ fps[j]).bit_count() <= 4 for i, j in met)
    assert union(len(fps), met) == union(len(fps), near) and len(near) > 100
    with pytest.raises(ValueError):
        simhash.near_pairs(spark.createDataFrame([(1,)], "fp long"), 5)


def test_a_large_bucket_gives_a_forest():
    fps = np.array([1 << i | 1 << j for i in range(30) for j in range(i)], dtype=np.uint64)
    links = simhash._bucket_links(fps, 4)
    assert len(links) == len(fps) - 1


def test_rows(spark, text_rows):
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.simhash_components(text_rows).collect()), key=str)
    assert len(got) == 9
    by = {d: c for d, _, c in got}
    assert by[1] == by[2] == by[7] == 1 and by[3] == by[4] == by[6] == 3 and by[None] is None and by[5] == 5
    assert {f for d, f, _ in got if d in (3, 4, 6)} == {"0" * 16}
    assert simhash.simhash_components(text_rows.limit(0)).count() == 0
    kept = simhash.keep_one(text_rows)
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 3, 5, None] and kept.columns == text_rows.columns


def test_query_against_brute_force(spark):
    from frostline.llm.queries import op3_simhash

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    fps = [brute_fingerprint(d.text) for d in docs]
    ids = [d.doc_id for d in docs]
    roots = union(len(docs), [(i, j) for i in range(len(docs)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    least = {r: min(ids[i] for i in range(len(docs)) if roots[i] == r) for r in set(roots)}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op3_simhash(spark, sf).collect()}
    assert got == {ids[i]: (f"{fps[i]:016x}", least[roots[i]]) for i in range(len(docs))}
