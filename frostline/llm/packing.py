"""Packing tokenized documents into fixed-length sequences, with certified bin counts.

Documents are tokenized and cut in one pass; full pieces are sequences of their own. The other pieces are dealt
over groups of about GROUP pieces. Each group is packed by best-fit decreasing and certified by the
best of many dual-feasible-function lower bounds on its bins. Groups whose count is over the bound keep their
full bins and give the documents of the others to a pool, certified groups only those of their emptiest bin. The pool is dealt
over new groups and packed again, until a round saves no bin (then the bins before it stand) or MAX_ROUNDS are done: what the limit
can leave is bins over the sum of the last round's bounds, never rows. Every step is a grouped Spark job over (length, id) rows; the token
ids never move.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from itertools import chain, repeat
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostline.llm.lineage import cut, extended

LENGTH = 2048
END_ID = 0
GROUP = 40_000
MAX_ROUNDS = 6
_CACHE = 500_000
_BLOCK_CHARS = 1 << 21
#: Where a text may be cut without changing its tokens: before one space between two other characters.
_SAFE = re.compile(r"(?<=\S) (?=\S)")
#: Fixed value: how byte-level BPE of this kind cuts text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _bytes_of_marks() -> dict[str, int]:
    """The characters by which byte-level BPE files write bytes: printable Latin-1 for itself, the rest from U+0100 up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def fast_twin(path: str):
    """tiktoken's encoder with the same ids, made from the tokenizer file; None unless the file's merges are numbered in
    their order after the 256 bytes, when merging by rank and by merge list are the same."""
    import tiktoken

    model = json.loads(Path(path).read_text())["model"]
    vocab = model["vocab"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if model.get("type", "BPE") != "BPE" or any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(pairs)):
        return None
    marks = _bytes_of_marks()
    ranks = {bytes(marks[c] for c in t): i for t, i in vocab.items() if i < 256 + len(pairs)}
    return tiktoken.Encoding("twin", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """ids of a byte-level BPE tokenizer file, with the ids of space-led units kept between texts.

    A byte-level BPE never merges across the border before a single space that stands between two other
    characters, so a text's ids are the ids of its units between such borders, one after the other. The units of a block of texts
    are looked up in one table, those that it lacks are encoded in one call, and the texts' ids are gathered by numpy. Texts with other
    white space beside a space are split by a pattern instead; texts with a special token's string go through the tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.twin = fast_twin(path)
        if self.twin:
            self.n_bytes = np.array([len(self.twin.decode_single_token_bytes(i)) for i in range(self.twin.n_vocab)])
        # row 0 is for units that white space borders on
        self.row: dict[str, int] = {}
        self.ids, self.sizes = np.empty(0, np.uint32), np.zeros(1, np.int64)

    def unit(self, text: str) -> list[int]:
        return self.twin.encode_ordinary(text) if self.twin else self.whole.encode(text, add_special_tokens=False).ids

    def units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all units, each led by a space, and how many each has."""
        if not self.twin:
            each = [self.unit(f" {u}") for u in units]
            return np.fromiter(chain.from_iterable(each), np.uint32), np.fromiter(map(len, each), np.int64, len(each))
        ids = np.array(self.twin.encode_ordinary("".join(f" {u}" for u in units)), np.uint32)
        ends = np.searchsorted(self.n_bytes[ids].cumsum(), np.cumsum([len(u.encode()) + 1 for u in units])) + 1
        return ids, np.diff(ends, prepend=0)

    def encode(self, text: str) -> list[int]:
        """ids of one text."""
        if not text:
            return []
        if any(s in text for s in self.special):
            return self.whole.encode(text, add_special_tokens=False).ids
        first, *rest = _SAFE.split(text)
        return self.unit(first) + (self.units(rest)[0].tolist() if rest else [])

    def encode_block(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): the ids of all texts, one after the other, and where each text's end."""
        split = [t.split(" ") for t in texts]
        words = list(chain.from_iterable(split))
        starts = np.cumsum([0, *map(len, split[:-1])])
        at = np.fromiter(map(self.row.get, words, repeat(-1)), np.int64, len(words))
        ids, sizes = self.ids, self.sizes
        missing = np.flatnonzero(at < 0).tolist()
        if missing:
            fresh = dict.fromkeys((words[i] for i in missing), 0)
            plain = [u for u in fresh if u and not u[0].isspace() and not u[-1].isspace()]
            more, n = self.units(plain) if plain else (ids[:0], sizes[:0])
            fresh.update(zip(plain, range(len(sizes), len(sizes) + len(plain))))
            ids, sizes = np.concatenate([ids, more]), np.concatenate([sizes, n])
            at[missing] = [fresh[words[i]] for i in missing]
            if len(self.row) + len(fresh) <= _CACHE:  # the first units seen are mostly the frequent ones
                self.row.update(fresh)
                self.ids, self.sizes = ids, sizes
        odd = np.logical_or.reduceat(at == 0, starts)
        for s in self.special:
            odd |= np.fromiter((s in t for t in texts), bool, len(texts))
        # a text's first unit has ids of its own, and an odd text all its ids in place of it
        heads = [self.encode(t) if o else self.unit(u[0]) for t, u, o in zip(texts, split, odd.tolist())]
        at[starts] = np.arange(len(sizes), len(sizes) + len(texts))
        ids = np.concatenate([ids, np.fromiter(chain.from_iterable(heads), np.uint32)])
        sizes = np.concatenate([sizes, np.fromiter(map(len, heads), np.int64, len(heads))])
        count = sizes[at]
        if odd.any():
            rest = np.repeat(odd, np.diff(np.r_[starts, len(at)]))
            rest[starts] = False
            count[rest] = 0
        shift = (sizes.cumsum() - sizes)[at] - (count.cumsum() - count)
        return ids[np.repeat(shift, count) + np.arange(count.sum())], np.add.reduceat(count, starts).cumsum()


def blocks_of(texts: pa.Array, chars: int = _BLOCK_CHARS) -> Iterator[list[str]]:
    """texts in lists of about that many bytes, one text at least; a null text is empty."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy())
    i = 0
    while i < len(texts):
        k = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + chars, "right")))
        yield texts.slice(i, k - i).fill_null("").to_pylist()
        i = k


def pieces_of(n: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """(start, length) of a document of n ids: one piece if it fits, else full pieces after a first one that may be shorter."""
    if n <= length:
        return [(0, n)]
    first = n % length or length
    return [(0, first), *((s, length) for s in range(first, n, length))]


def tokenized(docs: DataFrame, path: str, id_col: str, text_col: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        enc = Encoder(path)
        for b in batches:
            rows, i = [], 0
            for block in blocks_of(b.column(1)):
                ids, ends = enc.encode_block(block)
                begin = 0
                for end in ends.tolist():
                    a = np.empty(end - begin + 1, dtype="<u4")
                    a[:-1], a[-1] = ids[begin:end], end_id
                    rows.extend((i, p, s, n, zlib.crc32(a[s : s + n].data)) for p, (s, n) in enumerate(pieces_of(len(a), length)))
                    begin, i = end, i + 1
            row, piece, start, n, crc = (np.array(x) for x in zip(*rows)) if rows else [np.empty(0, np.int64)] * 5
            out = [b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, extended(rows.select("doc_id"), "piece int, start long, length long, ids_crc32 long"))


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The most bins that any of the dual-feasible functions proves necessary.

    Martello and Toth's family: for each t up to half the capacity, items over capacity - t fill a bin and items under t count nothing.
    Fekete and Schepers' family: for k = 1..20, an item x counts x (k + 1) / capacity if that is whole, else
    floor(x (k + 1) / capacity) * (capacity / k), in parts of the capacity.
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = count * np.arange(capacity + 1)
    n_upto, s_upto = np.cumsum(count), np.cumsum(size)
    t = np.arange(0, capacity // 2 + 1)
    full = n_upto[capacity] - n_upto[capacity - t]
    middle = s_upto[capacity - t] - np.where(t > 0, s_upto[np.maximum(t - 1, 0)], 0)
    best = int((full + -(-middle // capacity)).max())
    x = np.arange(capacity + 1, dtype=np.int64)
    for k in range(1, 21):
        whole = (x * (k + 1)) % capacity == 0
        twice = np.where(whole, x * k, (x * (k + 1)) // capacity * capacity)  # in 1 / (k * capacity)
        best = max(best, int(-(-(count * twice).sum() // (k * capacity))))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each item, and the number of bins; longest first (ties as given), each into the fullest bin with room."""
    order = np.argsort(-lengths, kind="stable")
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms = 0  # bit r is set if a bin with room r is open
    bins, offsets, n = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i, x in zip(order.tolist(), lengths[order].tolist()):
        fits = open_rooms >> x
        if fits:
            room = x + ((fits & -fits).bit_length() - 1)
            k = by_room[room].pop()
            if not by_room[room]:
                open_rooms &= ~(1 << room)
        else:
            room, k, n = capacity, n, n + 1
        bins[i], offsets[i] = k, capacity - room
        if room > x:
            by_room[room - x].append(k)
            open_rooms |= 1 << (room - x)
    return bins, offsets, n


def _packed(capacity: int):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), *((c, "ascending") for c in ("doc_id", "piece", "ids_crc32"))])
        lengths = group["length"].to_numpy()
        bins, offsets, n = best_fit_decreasing(lengths, capacity)
        room = capacity - np.bincount(bins, weights=lengths, minlength=n).astype(np.int64)
        bound = lower_bound(lengths, capacity)
        # of a certified group only the emptiest bin may still be of use to others
        loose = room > 0 if n > bound else (room > 0) & (np.arange(n) == room.argmax())
        same = lambda x: np.full(len(lengths), x)
        more = {"bin": bins, "offset": offsets, "loose": loose[bins], "bins": same(n), "bound": same(bound), "loose_bins": same(int(loose.sum()))}
        for name, values in more.items():
            group = group.append_column(name, pa.array(values))
        return group

    return run


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
         end_id: int = END_ID, group: int = GROUP) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text is empty: its only id is end_id. Null ids and repeated rows are packed like others; a very long text is read whole and
    cut into pieces; of equal lengths the one of the lesser doc_id, piece and checksum is packed first; no rows give no rows; other columns are not read. tokenizer is the path of a byte-level BPE file that every
    executor has.
    """
    pieces = cut(tokenized(docs, tokenizer, id_col, text_col, length, end_id))
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    short = pieces.where(F.col("length") < length)
    full = pieces.where(F.col("length") == length).select(
        *cols, F.lit(0).alias("round"), F.lit(-1).cast("long").alias("grp"), F.monotonically_increasing_id().alias("bin"), F.lit(0).cast("long").alias("offset")
    )
    done = [full]
    n = short.count()
    groups = max(1, -(-n // group))
    names = [*cols, "round", "grp", "bin", "offset"]
    now, pool, pooled = short, None, 0
    for k in range(1, MAX_ROUNDS + 1):
        dealt = now.select(*cols, F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32", F.lit(k)), F.lit(groups)).alias("grp"))
        kind = extended(dealt, "bin long, offset long, loose boolean, bins long, bound long, loose_bins long")
        fitted = cut(dealt.groupBy("grp").applyInArrow(_packed(length), kind)).withColumn("round", F.lit(k))
        by_group = fitted.groupBy("grp").agg(*(F.first(c).alias(c) for c in ("bins", "loose_bins")), F.count_if("loose").alias("rows"))
        used, loose, rows = by_group.agg(F.sum("bins"), F.sum("loose_bins"), F.sum("rows")).first()
        if pool is not None and used >= pooled:  # dealing them anew saved nothing: they stay as they were
            done.append(pool.select(*names))
            break
        if k == MAX_ROUNDS or not loose or loose < 2:
            done.append(fitted.select(*names))
            break
        done.append(fitted.where("not loose").select(*names))
        now = pool = fitted.where("loose")
        pooled, groups = loose, max(1, -(-rows // group))
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    # full pieces count up within their partition already; groups lie below them, by round and group
    number = F.when(F.col("grp") < 0, F.col("bin") * 2).otherwise(
        (((F.col("round") * (1 << 26) + F.col("grp")) * (1 << 27)) + F.col("bin")) * 2 + 1
    )
    return out.select(*cols, number.alias("sequence_id"), "offset")
