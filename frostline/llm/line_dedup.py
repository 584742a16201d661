"""Fuzzy line deduplication by MinHash, in Spark expressions only.

1. Every line with a word gets a 128-bit identity (two hashes of the line) and MinHash bands of its SHINGLE-character shingles. A line of
   at least ANCHORED different anchored shingles is sketched by those, a line of fewer by all its shingles, and one near that border by both, so that likes on its two sides meet. A shingle is
   anchored if the character before it has a code that is STEP's residue (one in eight, whatever it means: a sample of all places, in which an edit at the start or end of words weighs as much as in the whole),
   or is beyond Latin. The sketch is the SKETCH least hashes; the first BANDS of them whose low two bits are 0 start a band each, and a band is ROWS neighbours of the sketch. Where those
   are fewer, the first even hashes are starts, or every hash. Two lines of similarity s share a band that starts at a common hash with probability s ** ROWS at least.
   Identities and bands are written once; no text is shuffled.
2. Lines that share a band are candidates, verified by the exact Jaccard similarity of all their shingles. In each band the lines are first compared with the one
   that has most copies (an original more often than not); then only pairs of one band that are still in different components are left. In a band of up to WIDE lines, each line has a parity
   bitmap of its shingles: the bits in which two bitmaps differ are at most as many as the shingles that only one line has, so a pair whose bitmaps differ in more
   bits than the similarity allows is unlike for certain, and all other pairs are compared exactly. Lines of wider bands (a frame that many lines fill in otherwise) meet by prefix filtering, which is exact too: with
   shingles ordered by how few lines have them, two like lines share one of the rarest fifth of each. So neither many like lines nor many unlike ones of one frame cost their pairs.
3. Components (distributed union-find) and equal lines keep the line that comes first by (document, line number); documents are put
   together again without the others.
"""

from __future__ import annotations

from fractions import Fraction
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from frostline.llm.components import connected_components
from frostline.llm.lineage import cut, own_prefix, written

SHINGLE = 8
BANDS = 9
EVEN_BANDS = 12
ROWS = 4
SKETCH = 56
SIMILARITY = 0.8
#: Different anchored shingles from which on a line is sketched by those, and up to which it is sketched by all shingles.
ANCHORED, DENSE = 14, 24
#: Shingles are anchored after characters of the first 256 whose code is this residue of this modulus.
STEP, RESIDUE = 8, 5
#: Lines of a band over which its pairs are found by prefix filtering, which costs a row for each shingle.
WIDE = 2000
#: 64-bit words of a parity bitmap.
PARITY = 32
#: Bits of the filter that picks candidates' texts: 1 MB whatever the corpus; more candidates let more other texts through.
FILTER_BITS = 23
_WORD = r"[^\x20\x09-\x0D]"


def once(x: Column, f) -> Column:
    """f(x), with x evaluated once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def shingle_hashes(line: Column, size: int = SHINGLE) -> Column:
    """Hashes of all size-character shingles (UTF-16 units), in order; a shorter line is one shingle."""
    hashes = lambda p: F.transform(  # noqa: E731  two bytes a character: a shingle is a slice
        F.sequence(F.lit(1), F.greatest(F.octet_length(p) - (2 * size - 1), F.lit(1)), F.lit(2)), lambda i: F.xxhash64(F.substring(p, i, 2 * size))
    )
    # bound to a variable, the bytes are not copied out of the row for every shingle
    return once(F.encode(line, "UTF-16BE"), hashes)


def with_shingle_set(df: DataFrame, line: str, out: str) -> DataFrame:
    """df with the different hashes of a line's shingles in place of the line."""
    return df.withColumn(out, F.array_distinct(shingle_hashes(F.col(line)))).drop(line)


def anchored(line: Column, size: int = SHINGLE) -> Column:
    """The size-character shingles that begin after a character of RESIDUE modulo STEP or after one beyond Latin, in order, in one pass over the line."""
    codes = "".join(rf"\x{{{c:X}}}" for c in range(RESIDUE, 256, STEP))
    # one class tried at every place, with nothing that repeats: faster than to run over the others, and linear whatever the line
    return F.regexp_extract_all(line, F.lit(rf"(?s)[{codes}\x{{250}}-\x{{10FFFF}}](?=(.{{{size}}}))"), F.lit(1))


def sketch(hashes: Column) -> Column:
    """The SKETCH least different hashes, in order."""
    return F.slice(F.array_distinct(F.sort_array(hashes)), 1, SKETCH)


def _with_bands(df: DataFrame, least: str, out: str) -> DataFrame:
    """df with the bands of the sketch in column least, none where it is null.

    Sets of c common and d other hashes have at most d runs on the ring, one of c / d at least: with every start, all
    pairs of similarity ROWS / (ROWS + 1) and more meet. Every step is a column of its own, so that none is computed twice.
    """
    h, ring = F.col(least), F.col("_ring")

    def runs(mask: int) -> Column:
        """What ROWS neighbours from each hash on make whose masked bits are 0."""
        mixed = lambda i: reduce(lambda x, k: x.bitwiseXOR(F.shiftleft(F.get(ring, i + k), 7 * k)), range(1, ROWS), F.get(ring, i))
        return F.array_compact(F.transform(h, lambda x, i: F.when(x.bitwiseAND(F.lit(mask)) == 0, mixed(i))))

    # a sketch that is a whole set is a ring; the last hashes of a longer one start no run
    df = df.withColumn("_ring", F.when(F.size(h) < SKETCH, F.concat(h, F.slice(h, 1, ROWS - 1))).otherwise(h))
    df = df.withColumn("_runs", runs(3)).withColumn("_more", F.when(F.size("_runs") < BANDS, runs(1)))
    every = F.when(F.size(h) < ROWS, F.array(F.xxhash64(h))).otherwise(runs(0))
    fewer = F.when(F.size("_more") >= EVEN_BANDS, F.slice("_more", 1, EVEN_BANDS)).otherwise(every)
    found = F.when(F.size("_runs") >= BANDS, F.slice("_runs", 1, BANDS)).when(h.isNotNull(), fewer)
    return df.withColumn(out, F.coalesce(found, F.array().cast("array<bigint>"))).drop("_ring", "_runs", "_more")


def with_line_bands(lines: DataFrame) -> DataFrame:
    """lines with bands in place of line."""
    df = lines.withColumn("_anchors", sketch(F.transform(anchored(F.col("line")), lambda x: F.xxhash64(x))))
    df = df.withColumns({
        "_few": F.when(F.size("_anchors") >= ANCHORED, F.col("_anchors")),
        "_all": sketch(F.when(F.size("_anchors") < DENSE, shingle_hashes(F.col("line")))),
    }).drop("line", "_anchors")
    df = _with_bands(_with_bands(df, "_few", "_b1"), "_all", "_b2")
    return df.withColumn("bands", F.concat("_b1", "_b2")).drop("_few", "_all", "_b1", "_b2")


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, doc_key, line_no, line) of the lines that have a word; doc_key is a hash of the text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("doc_key"), F.split(text, "\n").alias("lines"))
    # a split has one part at least; the outer form keeps the optimizer from splitting once more to test that
    exploded = keyed.select("doc_id", "doc_key", F.posexplode_outer("lines").alias("line_no", "line"))
    return exploded.where(F.col("line").rlike(_WORD))


def _second(line: str) -> Column:
    return F.xxhash64(F.lit("second"), F.col(line))


def sketched(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, doc_key, line_no, h1, h2, bands) of every line that has a word."""
    line = F.col("line")
    ids = F.xxhash64(line).alias("h1"), _second("line").alias("h2")
    return with_line_bands(lines_of(docs, id_col, text_col).select("doc_id", "doc_key", "line_no", *ids, "line"))


def _place(lines: DataFrame) -> Column:
    """A line's place, in order of document and number: one number if doc_id is one, so that minima are hashed and not sorted."""
    if isinstance(lines.schema["doc_id"].dataType, IntegralType):
        low = F.lit(str(-(1 << 64))).cast("decimal(20,0)")  # null documents come first
        return (F.coalesce(F.col("doc_id").cast("decimal(20,0)"), low) * F.lit(1 << 31).cast("decimal(10,0)") + F.col("line_no")).cast("decimal(38,0)")
    return F.struct("doc_id", "line_no")


def _bitmap(ids: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """One row and column: an array of 2**(bits - 6) longs in which bit s is set if the top bits of an id are s."""
    slot = F.shiftrightunsigned(F.col(ids.columns[0]), 64 - bits)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))
    words = ids.select(F.shiftright(slot, 6).alias("id"), bit.alias("bit")).groupBy("id").agg(F.bit_or("bit").alias("set"))
    every = ids.sparkSession.range(1 << (bits - 6)).join(words, "id", "left").select(F.struct("id", F.coalesce("set", F.lit(0)).alias("set")).alias("w"))
    return every.agg(F.transform(F.sort_array(F.collect_list("w")), lambda w: w["set"]).alias("bits"))


def _may_be_in(h: Column, wanted: DataFrame) -> Column:
    """False only for hashes that wanted, of one column, does not have: a bitmap of fixed size keeps most other rows out of a shuffle."""
    slot = F.shiftrightunsigned(h, 64 - FILTER_BITS)
    word = F.get(cut(_bitmap(wanted)).scalar(), F.shiftright(slot, 6).cast("int"))
    return F.call_function("shiftrightunsigned", word, slot.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1


def _texts(docs: DataFrame, id_col: str, text_col: str, lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """(h1, line) of the wanted h1, read from as few documents as one place of each needs."""
    among = _may_be_in(F.col("h1"), wanted)
    spots = lines.where(among).join(wanted, "h1", "left_semi").groupBy("h1").agg(F.min("doc_key").alias("doc_key"))
    key = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    own = lines_of(docs.where(_may_be_in(key, spots.select("doc_key"))), id_col, text_col).select(F.xxhash64("line").alias("h1"), "line")
    return own.where(among).join(wanted, "h1", "left_semi").groupBy("h1").agg(F.first("line").alias("line"))


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) whose lines' shingle sets have that Jaccard similarity."""
    a, b = (texts.select(F.col("h1").alias(x), F.col("line").alias(f"line_{x}")) for x in "ab")
    both = with_shingle_set(with_shingle_set(pairs.join(a, "a").join(b, "b"), "line_a", "x"), "line_b", "y")
    share = Fraction(similarity).limit_denominator(1000)
    # c / (x + y - c) >= share, in whole numbers
    like = F.size(F.array_intersect("x", "y")) * (share.numerator + share.denominator) >= (F.size("x") + F.size("y")) * share.numerator
    # an outer generator, unlike a filter, is not moved to where the sets would be made once for each mention
    return both.select("a", "b", F.explode_outer(F.when(like, F.array(F.lit(1)))).alias("_like")).where("_like is not null").select("a", "b")


def parities(texts: DataFrame) -> DataFrame:
    """(h1, n, x0, x1, ..): number of different shingles, and a bitmap in which each shingle flips one bit."""
    each = with_shingle_set(texts.select("h1", "line"), "line", "set").select("h1", F.explode_outer("set").alias("h"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("h").bitwiseAND(F.lit(63)).cast("int"))
    word = F.pmod(F.shiftright("h", 6), F.lit(PARITY))
    # none is null: with a test for null at every word, the comparison of a pair is code so long that it runs many times slower
    flips = (F.coalesce(F.bit_xor(F.when(word == k, bit).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long")).alias(f"x{k}") for k in range(PARITY))
    return each.groupBy("h1").agg(F.count("*").alias("n"), *flips)


def _ordered(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _unlinked_pairs(rest: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of different components in one band of rest (band, h1, c) that their parity bitmaps do not rule out."""
    p = cut(rest.join(parities(texts.join(rest.select("h1").distinct(), "h1", "left_semi")), "h1"))
    words = [f"x{k}" for k in range(PARITY)]
    left, right = (p.select("band", F.col("h1").alias(x), *(F.col(c).alias(f"{c}{x}") for c in ("c", "n", *words))) for x in "ab")
    share = Fraction(similarity).limit_denominator(1000)
    odd = sum((F.bit_count(F.col(f"{w}a").bitwiseXOR(F.col(f"{w}b"))) for w in words), F.lit(0))
    # similarity s allows sizes of ratio s, and (1 - s) / (1 + s) of both sizes to differ
    sizes = F.least("na", "nb") * share.denominator >= F.greatest("na", "nb") * share.numerator
    may = odd * (share.denominator + share.numerator) <= (F.col("na") + F.col("nb")) * (share.denominator - share.numerator)
    met = (left.band == right.band) & (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & sizes & may
    return left.join(right, met).select("a", "b").distinct()


def _prefix_pairs(lines: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of different components among lines (h1, c) that share one of the rarest shingles of each, so many that no pair of that similarity is missed."""
    each = cut(with_shingle_set(texts.join(lines, "h1").select("h1", "c", "line"), "line", "set").select("h1", "c", F.explode_outer("set").alias("h")))
    counted = each.join(each.groupBy("h").agg(F.count("*").alias("f")), "h")
    ranked = counted.groupBy("h1", "c").agg(F.sort_array(F.collect_list(F.struct("f", "h"))).alias("s"))
    share = Fraction(similarity).limit_denominator(1000)
    n = F.size("s")
    need = F.ceil(n * share.numerator / F.lit(share.denominator))
    rare = F.filter(F.slice("s", F.lit(1), (n - need + 1).cast("int")), lambda x: x["f"] > 1)
    firsts = cut(ranked.select("h1", "c", n.alias("n"), F.explode(rare).alias("x")).select("h1", "c", "n", "x.h"))
    left, right = (firsts.select("h", F.col("h1").alias(x), F.col("c").alias(f"c{x}"), F.col("n").alias(f"n{x}")) for x in "ab")
    sizes = F.least("na", "nb") * share.denominator >= F.greatest("na", "nb") * share.numerator
    return left.join(right, "h").where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & sizes).select("a", "b").distinct()


def fuzzy_components(docs: DataFrame, id_col: str, text_col: str, lines: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(h1, h2, component) of the different lines that are like another one; lines is sketched(docs), written. h2 is of the text that was compared: another line of the same h1 is not meant."""
    keyed = lines.select(F.explode("bands").alias("band"), "h1")
    shared = cut(keyed.groupBy("band").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo < hi").select("band"))
    members = cut(keyed.where(_may_be_in(F.col("band"), shared)).join(shared, "band").groupBy("band", "h1").agg(F.count("*").alias("n")))
    texts = cut(_texts(docs, id_col, text_col, lines, cut(members.select("h1").distinct())))
    top = members.groupBy("band").agg(F.max("n").alias("n"))
    centre = members.join(top, ["band", "n"]).groupBy("band").agg(F.min("h1").alias("centre"))
    tried = cut(members.join(centre, "band").where("h1 <> centre").select(*_ordered("h1", "centre")).distinct())
    linked = cut(_verified(tried, texts, similarity))
    parts = connected_components(linked)
    labelled = cut(members.join(parts, members.h1 == parts.node, "left").select("band", "h1", F.coalesce("component", "h1").alias("c")))
    mixed = labelled.groupBy("band").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("band")
    rest = cut(labelled.join(mixed, "band", "left_semi"))
    wide = cut(rest.groupBy("band").count().where(F.col("count") > WIDE).select("band"))
    pairs = _unlinked_pairs(rest.join(wide, "band", "left_anti"), texts, similarity)
    if not wide.isEmpty():
        pairs = pairs.unionByName(_prefix_pairs(rest.join(wide, "band", "left_semi").select("h1", "c").distinct(), texts, similarity)).distinct()
    left = cut(pairs.join(tried, ["a", "b"], "left_anti"))
    parts = connected_components(linked.unionByName(_verified(left, texts, similarity))).withColumnRenamed("node", "h1")
    return parts.join(texts.select("h1", _second("line").alias("h2")), "h1")


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, doc_key, line_no) of the lines that go: those that have a copy or a like at an earlier place."""
    lines = written(sketched(docs, id_col, text_col))
    parts = cut(fuzzy_components(docs, id_col, text_col, lines, similarity))
    place = _place(lines)
    ids = ["doc_id", "doc_key", "line_no"]
    like = cut(lines.where(_may_be_in(F.col("h1"), parts.select("h1"))).join(parts, ["h1", "h2"]).select(*ids, place.alias("at"), "component"))
    firsts = like.groupBy("component").agg(F.min("at").alias("stay"))
    fuzzy = like.join(firsts, "component").where("at <> stay").select(*ids)
    alone = lines.select(*ids, place.alias("at"), "h1", "h2")
    copies = alone.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("at").alias("stay")).where("n > 1")
    copies = cut(copies.join(parts, ["h1", "h2"], "left_anti").select("h1", "h2", "stay"))
    exact = alone.where(_may_be_in(F.col("h1"), copies.select("h1"))).join(copies, ["h1", "h2"]).where("at <> stay").select(*ids)
    return fuzzy.unionByName(exact)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per document: doc_id, text (without the lines that are copies of an earlier one or like it), n_dropped.

    Earlier is by doc_id (null first), then line number. Lines without a word stay. A null text is empty. Rows that repeat a
    doc_id are judged each on its own text; where both have the first copy of a line at the same number, both keep it. A very long text is many lines, and
    a very long line has no more bands than others. No rows give no rows; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    done, n_dropped, _ = _apply(rows, "doc_id", "text", similarity)
    return done.select("doc_id", "text", F.col(n_dropped).alias("n_dropped"))


def _apply(docs: DataFrame, id_col: str, text_col: str, similarity: float) -> tuple[DataFrame, str, str]:
    """docs with text_col rewritten, and the names of two more columns: lines that went, and whether a line with a word went and none is left."""
    p = own_prefix(docs)
    drops = cut(dropped_lines(docs, id_col, text_col, similarity).groupBy("doc_id", "doc_key").agg(F.collect_set("line_no").alias(f"{p}drop")))
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    touched = _may_be_in(F.xxhash64(text), drops.select("doc_key"))
    some = docs.where(touched)
    same = some[id_col].eqNullSafe(drops["doc_id"]) & (F.xxhash64(F.coalesce(some[text_col].cast("string"), F.lit(""))) == drops["doc_key"])
    joined = some.join(drops, same, "left").select(*(some[c] for c in docs.columns), drops[f"{p}drop"])

    def without(x: Column) -> Column:  # x: the text's lines
        left = F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col(f"{p}drop"))
        return F.array_join(F.transform(left, lambda i: F.get(x, i)), "\n")

    kept = F.when(F.col(f"{p}drop").isNull(), F.col(text_col)).otherwise(once(F.split(F.col(text_col).cast("string"), "\n"), without))
    changed = joined.withColumn(text_col, kept).withColumn(f"{p}gone", F.coalesce(F.size(F.col(f"{p}drop")), F.lit(0)))
    changed = changed.withColumn(f"{p}empty", (F.col(f"{p}gone") > 0) & ~F.col(text_col).rlike(_WORD)).drop(f"{p}drop")
    # texts that lose no line are not shuffled
    same = docs.where(~touched).withColumns({f"{p}gone": F.lit(0), f"{p}empty": F.lit(False)})
    return changed.unionByName(same), f"{p}gone", f"{p}empty"


def keep_first_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars", similarity: float = SIMILARITY) -> DataFrame:
    """docs with the lines dropped and chars_col counted anew; a document all of whose words are gone goes, too.

    Texts without a word, null ones among them, lose no line and stay as they are. Nulls, repeated rows, ties and long texts as in dedup_lines; columns
    of any other name pass through; without chars_col nothing is counted; no rows give no rows.
    """
    names = docs.columns
    done, _, empty = _apply(docs, id_col, text_col, similarity)
    done = done.where(~F.col(empty))
    if chars_col in names:
        done = done.withColumn(chars_col, F.length(text_col).cast(docs.schema[chars_col].dataType))
    return done.select(*names)
