"""Spelling variants against a comparison of all pairs of words."""

import random
import re
import zlib
from collections import Counter

from frostline.llm import spelling


def one_apart(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows: list[tuple]) -> dict[str, tuple]:
    """word -> (form, root, n, n_near, form_n)."""
    count = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{low}".encode())
            count[low[: h % len(low)] + low[h % len(low) + 1 :] if h % 31 == 0 else low] += 1
    words = {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}
    near = {w: [v for v in words if one_apart(v, w)] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {w: (form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()}


def got(df) -> dict[str, tuple]:
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def made(rng: random.Random, docs: int) -> list[tuple]:
    """Words of few letters with long runs of equal ones, so that prefixes and suffixes are shared and chains of forms arise."""
    stems = ["".join(rng.choice("aabé") for _ in range(rng.randint(6, 9))) for _ in range(25)]
    weights = [10 ** rng.uniform(0, 3.5) for _ in stems]

    def word():
        w = rng.choices(stems, weights)[0]
        if rng.random() < 0.06:
            i, c = rng.randrange(len(w)), rng.choice("abéÿ")
            w = rng.choice([w[:i] + c + w[i:], w[:i] + w[i + 1 :], w[:i] + c + w[i + 1 :]])
        return w.upper() if rng.random() < 0.1 else w

    chain = " ".join(["ccccccc"] * 3 + ["ccccccd"] * 45 + ["ccccdccd"] * 600)
    return [(docs, chain)] + [(i, rng.choice(["; ", " ", "1"]).join(word() for _ in range(rng.randint(1, 120)))) for i in range(docs)]


def test_same_as_all_pairs(spark):
    rows = made(random.Random(5), 150)
    want = brute(rows)
    assert len(want) > 60 and any(f for f, *_ in want.values()) and any(r != f and f for f, r, *_ in want.values())
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(spelling.group_variants(df)) == want


def test_many_partitions_share_nodes(spark, monkeypatch):
    monkeypatch.setattr(spelling, "_PART_WORDS", 7)
    rows = made(random.Random(8), 120)
    assert got(spelling.group_variants(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_nodes_name_prefixes():
    """Over any cut of the sorted words, equal prefixes have equal numbers and others different ones."""
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abü") for _ in range(rng.randint(1, 9))) for _ in range(300)})
    for parts in (1, 2, 7, 40):
        ends = sorted({0, len(words), *(rng.randrange(1, len(words)) for _ in range(parts - 1))})
        spine = spelling.spine_of([spelling.separator(words[i - 1], words[i]) for i in ends[1:-1]])
        number = {}
        for k, (a, z) in enumerate(zip(ends, ends[1:])):
            trie = spelling.Numbering(spine, k)
            for w in words[a:z]:
                for d, x in enumerate(trie.nodes(w)):
                    assert number.setdefault(w[:d], x) == x
        assert len(set(number.values())) == len(number)


def test_edges(spark, text_rows):
    """Nulls, empty, long and repeated texts, an id that is null or repeated, clashing columns, ties and no rows."""
    rows = [(r.doc_id, r.text) for r in text_rows.collect()]
    assert got(spelling.group_variants(text_rows)) == brute(rows)
    long = "x" * 30_000
    rows = [(None, f"{long} {long} abcdefg abcdefg abcdefh ABCDEFH"), (1, None), (1, ""), (2, "ABCDEFi abcdefi " * 30), (2, "abcdefj " * 60), (2, f"{long}x {long}x {long[1:]} {long[1:]}"), (3, "×÷Ààzzz ×÷Ààzzz"), (5, f"{long} {long}")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n", "'w' as word", "2 as rank")
    found = got(spelling.group_variants(df))
    assert found == brute(rows) and max(v[3] for w, v in found.items() if len(w) > 29_000) == 2
    assert spelling.group_variants(df.limit(0)).count() == 0
