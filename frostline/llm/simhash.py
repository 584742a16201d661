"""SimHash near-duplicates by anchor points of a covering code.

A fingerprint's two 32-bit halves are each covered by the code {Hamming [31,26]} x {free bit}:
every half lies within R = 1 of an anchor. Two fingerprints at distance 4 or less differ in at most
2 bits of one half; some half value lies at most 1 bit from both, and its anchor is within
R + 1 = 2 of both. So replicating each distinct fingerprint to the anchors within 2 of each half (at
most 17 of 2^27) makes every linked pair meet at an anchor, where the full 64 bits are compared.
Nothing is dropped: an anchor's bucket is searched breadth first, so copies of copies leave it as a
spanning forest of links instead of all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frostline.llm.components import connected_components
from frostline.llm.lineage import cut, extended

BITS = 64
_BLOCK = 1 << 15


def shingle_hashes(text: str | None, size: int = 4, seed: int = 42) -> list[int]:
    """XXH64 of every space-joined shingle of A-Z-lower-cased words; fewer words than size: of all of them."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(words) <= size:
        return [xxh64_intdigest(b" ".join(words), seed)] if words else []
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    return [xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())]


def fingerprint(text: str | None, size: int = 4, seed: int = 42) -> int:
    """64 majority bits over the shingle hashes, unsigned; 0 for a text without words."""
    h = np.array(shingle_hashes(text, size, seed), dtype="<u8")
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(h), _BLOCK):
        part = h[i : i + _BLOCK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, size: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), size, seed) for t in b.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, extended(rows.select("doc_id"), "fp long"))


def anchors(half: Column) -> Column:
    """Codewords within 2 of a 32-bit value (in a long): bits 0-30 are the Hamming coordinates 1-31, bit 31 is free."""
    coordinate_masks = [sum(1 << (i - 1) for i in range(1, 32) if i >> b & 1) for b in range(5)]
    syndrome = sum(
        (F.shiftleft(F.bit_count(half.bitwiseAND(F.lit(m))).bitwiseAND(F.lit(1)), b) for b, m in enumerate(coordinate_masks)),
        F.lit(0),
    )
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i - F.lit(1))
    free = F.lit(1 << 31)

    def near(s: Column) -> Column:
        nearest = F.when(s == 0, half).otherwise(half.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(s - 1, F.lit(0)))))
        two_off = F.transform(
            F.filter(F.sequence(F.lit(1), F.lit(31)), lambda i: i < i.bitwiseXOR(s)),
            lambda i: half.bitwiseXOR(bit(i)).bitwiseXOR(bit(i.bitwiseXOR(s))),
        )
        return F.concat(F.array(nearest, nearest.bitwiseXOR(free)), two_off)

    return F.flatten(F.transform(F.array(syndrome), near))


def anchored(fps: DataFrame) -> DataFrame:
    """(anchor, fp): every distinct fp at its anchors; the half's number is bit 32 of the anchor."""
    low, high = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32)
    return fps.select(
        F.explode(
            F.concat(anchors(low), F.transform(anchors(high), lambda a: a.bitwiseOR(F.lit(1 << 32))))
        ).alias("anchor"),
        "fp",
    )


def _bucket_links(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among one anchor's fingerprints, breadth first over what is still unreached."""
    left, links = fps, []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            hit = np.bitwise_count(left ^ x) <= distance
            if hit.any():
                found = left[hit]
                links += [(int(x), int(y)) for y in found]
                queue += list(found)
                left = left[~hit]
    return links


def _compare(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        rest_k, rest_f = np.empty(0, np.int64), np.empty(0, np.uint64)

        def links(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            out: list[tuple[int, int]] = []
            if len(keys):
                at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
                sizes = np.diff(np.r_[at, len(keys)])
                pairs = at[sizes == 2]  # most shared buckets hold two
                close = pairs[np.bitwise_count(fps[pairs] ^ fps[pairs + 1]) <= distance]
                out += zip(fps[close].tolist(), fps[close + 1].tolist())
                for i, n in zip(at[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
                    out += _bucket_links(fps[i : i + n], distance)
            fresh = {(min(p), max(p)) for p in out} - seen
            if len(seen) < 200_000:  # a pair meets at several anchors; forgetting one only repeats a link
                seen.update(fresh)
            ends = np.array(sorted(fresh), dtype=np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["a", "b"])

        for b in batches:
            keys = np.r_[rest_k, b.column(0).to_numpy()]
            fps = np.r_[rest_f, b.column(1).to_numpy().view(np.uint64)]
            if not len(keys):
                continue
            cut_at = int(np.searchsorted(keys, keys[-1]))  # the last anchor may go on in the next batch
            rest_k, rest_f = keys[cut_at:], fps[cut_at:]
            yield links(keys[:cut_at], fps[:cut_at])
        yield links(rest_k, rest_f)

    return run


def near_pairs(fps: DataFrame, distance: int = 4) -> DataFrame:
    """Links (a, b) among distinct fingerprints fp that connect all those within distance bits (at most 4)."""
    if not 0 <= distance <= 4:
        raise ValueError("the anchors cover distances from 0 to 4")
    at = anchored(fps.select("fp").distinct()).repartition("anchor").sortWithinPartitions("anchor")
    return at.mapInArrow(_compare(distance), "a long, b long").distinct()


def simhash_components(
    docs: DataFrame, distance: int = 4, id_col: str = "doc_id", text_col: str = "text", size: int = 4, seed: int = 42
) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable).

    Null and empty texts and texts without words have fingerprint zero and link like any other. Rows with
    a null id are linked but never name a component (which is null where only they are in it). Repeated
    rows stay. Of equal ids the component has one name; a very long text is read whole, its shingles counted block by block. No rows give no rows; other columns are not read.
    """
    rows = cut(fingerprints(docs, id_col, text_col, size, seed))
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    parts = connected_components(near_pairs(distinct, distance)).withColumnRenamed("node", "fp")
    reach = distinct.join(parts, "fp").groupBy("component").agg(F.min("least").alias("reached"))
    linked = parts.join(reach, "component").select("fp", "reached")
    classes = distinct.join(linked, "fp", "left").select("fp", F.coalesce("reached", "least").alias("component_id"))
    return rows.join(classes, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 4, size: int = 4) -> DataFrame:
    """docs without the near copies: of each component the document whose id names it stays, with every row that
    repeats this id; rows without an id stay.

    Null and empty texts and texts without words are copies of each other. Ties do not arise, as ids name components. A very long text is read whole. No
    rows give no rows, and columns of any other name pass through.
    """
    named = simhash_components(docs.where(F.col(id_col).isNotNull()), distance, id_col, text_col, size)
    stay = named.where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(stay, docs[id_col] == stay["doc_id"], "left_semi").unionByName(docs.where(F.col(id_col).isNull()))
