import random
from collections import defaultdict

from pyspark.sql import functions as F

from frostline.llm import line_dedup
from frostline.llm.lineage import written

K = line_dedup.SHINGLE


def shingles(line):
    return {line[i : i + K] for i in range(max(1, len(line) - K + 1))}


def brute_classes(lines, similarity=0.8):
    """Components of the different lines by exact Jaccard over all pairs that share a shingle."""
    sets = {x: shingles(x) for x in lines}
    by = defaultdict(list)
    for x, s in sets.items():
        for g in s:
            by[g].append(x)
    parent = {x: x for x in lines}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, s in sets.items():
        for y in {y for g in s for y in by[g] if y > x}:
            c = len(s & sets[y])
            if c >= similarity * (len(s) + len(sets[y]) - c):
                parent[max(find(x), find(y))] = min(find(x), find(y))
    return {x: find(x) for x in lines}


def brute(docs, classes):
    """Texts after keeping each class's first line by (doc_id, number)."""
    seen, out = set(), {}
    for d, text in sorted(docs, key=lambda r: r[0]):
        keep = []
        for line in (text or "").split("\n"):
            if not line.strip(" \t\r\x0b\x0c"):
                keep.append(line)
            elif classes[line] not in seen:
                seen.add(classes[line])
                keep.append(line)
        out[d] = "\n".join(keep)
    return out


def test_whole_table_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    lines = {x for _, t in rows for x in t.split("\n") if x.strip(" \t\r\x0b\x0c")}
    want = brute(rows, brute_classes(lines))
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()}
    assert set(got) == set(want) and sum(got[d] == want[d] for d in want) >= 0.99 * len(want)


def test_recall_at_the_threshold(spark):
    """Pairs of similarity 0.8 to 0.9 are found, pairs below never."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(rng.randrange(2, 9)))
    docs, above, below = [], [], []
    for i in range(400):
        w = [word() for _ in range(rng.randrange(12, 60))]
        v = list(w)
        for k in rng.sample(range(len(w)), max(1, len(w) // 25)):
            v[k] = word()
        a, b = " ".join(w), " ".join(v)
        x, y = shingles(a), shingles(b)
        (above if len(x & y) / len(x | y) >= 0.8 else below).append(2 * i + 1)
        docs += [(2 * i, a), (2 * i + 1, b)]
    got = {r.doc_id: r.n_dropped for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert sum(got[d] for d in above) >= 0.97 * len(above) and len(above) > 100
    assert not any(got[d] for d in below) and len(below) > 50 and not any(got[2 * i] for i in range(400))


def test_recall_by_line_length(spark):
    """Short lines whose last character or last word differs: 99 of 100 pairs are found at every length."""
    rng = random.Random(6)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    docs, above = [], defaultdict(list)
    for size in (16, 17, 20, 24, 30, 36, 44, 56, 70):
        for _ in range(200):
            a = letters(size)
            b = a[:-1] + "!" if rng.random() < 0.5 or size < 30 else a[:-2] + "!?"
            i = len(docs)
            docs += [(i, a), (i + 1, b)]
            if len(shingles(a) & shingles(b)) >= 0.8 * len(shingles(a) | shingles(b)):
                above[size].append(i + 1)
    got = {r.doc_id: r.n_dropped for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    found = {n: sum(got[d] for d in ds) / len(ds) for n, ds in above.items()}
    assert len(found) == 9 and min(found.values()) >= 0.99, found


def edited(rng, line, share):
    """line with single letters changed until the similarity is just above share."""
    best = line
    for _ in range(len(line)):
        k = rng.randrange(len(best))
        new = best[:k] + rng.choice("abcdefghijklmnopqrstuvwxyz") + best[k + 1 :]
        x, y = shingles(line), shingles(new)
        if len(x & y) < share * len(x | y):
            break
        best = new
    return best


def test_recall_by_length_and_similarity(spark):
    """Lines of 8 to 1,500 characters, in words or none, at the threshold and above: of each length 95 of 100 pairs are found at least, and 98 of 100 of all."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(1, 10)))
    docs, above = [], defaultdict(list)
    for size in (8, 14, 20, 30, 45, 60, 80, 100, 130, 160, 200, 300, 600, 1500):
        for n in range(60):
            text, share = "", (0.8, 0.8, 0.85, 0.9)[n % 4]
            while len(text) < size:
                text += word() + ("" if n % 5 == 0 else " ")
            a = text[:size].strip() or "a"
            b = edited(rng, a, share)
            if a != b:
                above[size].append(len(docs) + 1)
                docs += [(len(docs), a), (len(docs) + 1, b)]
    got = {r.doc_id: r.n_dropped for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    found = {n: round(sum(got[d] for d in ds) / len(ds), 3) for n, ds in above.items()}
    print(found)
    every = [got[d] for ds in above.values() for d in ds]
    assert min(found.values()) >= 0.95 and sum(every) >= 0.98 * len(every), found


def test_recall_of_edits_at_word_borders(spark):
    """Edits at the start or end of words, in their case, or of a prefix: pairs of a similarity of 0.8 and more are found as those edited anywhere, whatever the words' length."""
    rng = random.Random(12)
    letters = "abcdefghijklmnopqrstuvwxyz"
    other = lambda c: rng.choice(letters.replace(c.lower(), ""))
    how = {
        "start": lambda w: other(w[0]) + w[1:], "end": lambda w: w[:-1] + other(w[-1]), "case": lambda w: w[0].upper() + w[1:], "inner": lambda w: w[:1] + other(w[1]) + w[2:],
    }
    docs, above = [], defaultdict(list)
    for count, length, share in ((40, 40, 0.5), (30, 60, 0.7), (40, 20, 0.25), (40, 20, 0.2), (60, 8, 0.05), (12, 30, 0.3)):
        for kind, change in how.items():
            for _ in range(60):
                words = ["".join(rng.choice(letters) for _ in range(length)) for _ in range(count)]
                new = [change(w) if rng.random() < share else w for w in words]
                a, b = " ".join(words), " ".join(new)
                x, y = shingles(a), shingles(b)
                if a != b and 5 * len(x & y) >= 4 * len(x | y):
                    above[(count, length, kind)].append(len(docs) + 1)
                    docs += [(len(docs), a), (len(docs) + 1, b)]
    for _ in range(120):  # a prefix as of log lines
        body = " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 9))) for _ in range(30))
        a, b = (f"{rng.randrange(10**8):08d} {body}" for _ in "ab")
        above["prefix"].append(len(docs) + 1)
        docs += [(len(docs), a), (len(docs) + 1, b)]
    got = {r.doc_id: r.n_dropped for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    found = {n: round(sum(got[d] for d in ds) / len(ds), 3) for n, ds in above.items() if len(ds) >= 15}
    print(found)
    every = [got[d] for ds in above.values() for d in ds]
    assert len(found) >= 16 and min(found.values()) >= 0.93 and sum(every) >= 0.97 * len(every), found


def test_wide_bands_lose_no_like(spark, monkeypatch):
    """Prefix filtering and comparing all pairs of a band give the same classes, and unlike lines of one frame meet rarely."""
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    frame = [word() for _ in range(20)]
    rows = []
    for i in range(150):
        tail = [word() for _ in range(9)]
        rows.append(" ".join(frame + tail))
        if i % 3 == 0:
            rows.append(" ".join(frame + tail[:-1] + [word()]))
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    lines = line_dedup.cut(line_dedup.sketched(df, "doc_id", "text"))
    classes = []
    for wide in (1, 10**6):
        monkeypatch.setattr(line_dedup, "WIDE", wide)
        classes.append(sorted(tuple(r) for r in line_dedup.fuzzy_components(df, "doc_id", "text", lines).collect()))
    assert set(classes[1]) == set(classes[0]) and len(classes[0]) >= 90
    texts = lines.select("h1", "doc_id").join(df, "doc_id").select("h1", line_dedup.F.col("text").alias("line"))
    pairs = line_dedup._prefix_pairs(texts.select("h1", line_dedup.F.col("h1").alias("c")), texts, 0.8)
    assert pairs.count() < 0.05 * len(rows) ** 2 / 2


def test_scripts_without_spaces(spark):
    rng = random.Random(9)
    letters = lambda n: "".join(chr(rng.randrange(0x4E00, 0x4F00)) for _ in range(n))
    docs = []
    for _ in range(60):
        a = letters(120)
        docs += [(len(docs), a), (len(docs) + 1, a[:60] + "x" + a[61:])]
    got = {r.doc_id: r.n_dropped for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert sum(got.values()) >= 59 and not any(got[2 * i] for i in range(60))


def test_parity_bitmaps_rule_out_no_like(spark):
    """All pairs of many lines around the threshold that share a band are what exact comparison says."""
    rng = random.Random(10)
    base = "".join(rng.choice("abcdefghijklmnop ") for _ in range(220))
    rows = []
    for i in range(80):
        line = base
        for _ in range(rng.randrange(1, 5)):
            k = rng.randrange(len(line) - 3)
            line = line[:k] + "".join(rng.choice("qrstuvwxyz") for _ in range(3)) + line[k + 3 :]
        rows.append((i, line))
    texts = spark.createDataFrame([(i, x) for i, x in rows], "h1 long, line string")
    rest = texts.selectExpr("1L as band", "h1", "h1 as c")
    kept = {tuple(r) for r in line_dedup._unlinked_pairs(rest, texts, 0.8).collect()}
    like = {(i, j) for i, x in rows for j, y in rows if i < j and len(shingles(x) & shingles(y)) >= 0.8 * len(shingles(x) | shingles(y))}
    pairs = spark.createDataFrame(sorted(kept), "a long, b long")
    assert like and like <= kept and len(kept) < 80 * 79 // 2
    assert {tuple(r) for r in line_dedup._verified(pairs, texts, 0.8).collect()} == like


def test_repeated_shingles(spark):
    """A line and the same twice in one line, and rulers of different length, are pairs like others."""
    rng = random.Random(5)
    letters = lambda n: "".join(rng.choice("abcdefghijkl ") for _ in range(n)).strip() + "."
    pairs = [(x, f"{x}{x}") for n in (80, 120, 200) for x in (letters(n) for _ in range(30))]
    pairs += [(c * 10, c * 14) for c in "-=*_#~+.oX"]
    docs = [(2 * i + k, x) for i, p in enumerate(pairs) for k, x in enumerate(p)]
    above = [2 * i + 1 for i, (a, b) in enumerate(pairs) if len(shingles(a) & shingles(b)) >= 0.8 * len(shingles(a) | shingles(b))]
    got = {r.doc_id: r.n_dropped for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert len(above) == len(pairs) and sum(got[d] for d in above) >= 0.97 * len(above) and not any(got[2 * i] for i in range(len(pairs)))


def test_many_likes_cost_no_square(spark):
    base = " ".join(f"token{i}" for i in range(60))
    rows = [(i, base.replace("token7 ", f"tok{i} ")) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    parts = line_dedup.fuzzy_components(docs, "doc_id", "text", written(line_dedup.sketched(docs, "doc_id", "text")))
    assert parts.select("component").distinct().count() == 1 and parts.count() == 300
    assert [r.doc_id for r in line_dedup.keep_first_lines(docs, chars_col="none").collect()] == [0]


def test_rows(spark, text_rows):
    got = sorted(((r.doc_id, r.text, r.n_dropped) for r in line_dedup.dedup_lines(text_rows).collect()), key=str)
    assert len(got) == 9
    by = {d: (t, k) for d, t, k in got}
    assert by[1][1] == 0 and by[2] == ("", 1) and by[7][1] == 1 and by[3][1] == 0 and by[6] == (" \t\n", 0) and by[5][1] == 0
    assert line_dedup.dedup_lines(text_rows.limit(0)).count() == 0
    kept = line_dedup.keep_first_lines(text_rows)
    assert kept.columns == text_rows.columns and 2 not in {r.doc_id for r in kept.collect()}
    two = spark.createDataFrame([(1, "A line\nB line"), (1, "C line\nA line"), (None, "B line")], "doc_id long, text string")
    texts = sorted(r.text for r in line_dedup.dedup_lines(two).collect())
    assert texts in (["A line", "B line", "C line"], ["A line", "B line", "C line\nA line"])


def test_text_is_native(spark):
    plan = line_dedup.dedup_lines(spark.createDataFrame([(1, "a\nb")], "doc_id long, text string"))
    text = plan._jdf.queryExecution().toString()
    assert not any(x in text for x in ("Python", "Pandas", "Arrow"))
    assert plan.select(F.col("text")).first().text == "a\nb"


def test_parity_words_are_never_null(spark):
    """Null tests at every word made the comparison of a pair of lines many times slower."""
    fields = line_dedup.parities(spark.createDataFrame([(1, "a line"), (2, "b")], "h1 long, line string")).schema
    assert [f.name for f in fields if f.nullable] == ["h1"] and len(fields) == 2 + line_dedup.PARITY


def test_anchored_shingles_of_odd_lines(spark):
    """All shingles after a character of the residue or beyond Latin, by code points: line ends, wide characters and overlaps among them."""
    rng = random.Random(15)
    lines = ["", "e", "e1234567", "e12345678", "eeeeeeeeeeee", "\U0001f600" * 12, "éɏɐabcdefgh", "z" * 50_000, "\n".join("emu emu emu")]
    lines += ["".join(rng.choice("aemu =-åɐ中\U0001f600\n") for _ in range(60)) for _ in range(100)]
    own = lambda c: ord(c) >= 0x250 or ord(c) < 256 and ord(c) % line_dedup.STEP == line_dedup.RESIDUE
    df = spark.createDataFrame(list(enumerate(lines)), "i long, line string").select("i", line_dedup.anchored(F.col("line")).alias("a"))
    got = {r.i: r.a for r in df.collect()}
    for i, x in enumerate(lines):
        assert got[i] == [x[k + 1 : k + 1 + K] for k, c in enumerate(x) if own(c) and len(x) - k > K], x
