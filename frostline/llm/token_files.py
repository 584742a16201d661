"""Token ids in binary files that a reader can enter at any document.

A file is a row of independent zstandard frames, so that any zstandard tool unpacks it to the ids of its documents, one after the other, each id in `width` bytes, little-endian:

    frames      a document's ids, with the end id last; a document of over FRAME_IDS ids takes several frames of its own
    index       a skippable frame: INDEX_HEAD, then an Arrow stream of the documents (doc_id, n_tokens) in the file's order
    seek table  a skippable frame: for each frame before it the packed and unpacked bytes and the low 32 bits of the unpacked bytes' XXH64, and a footer

The footer's nine bytes at the end lead to the seek table, the table's last entry to the index, and sums of entries to any frame; a reader of some documents unpacks their frames and checks those sums only.

Documents are ranged by id over Spark's tasks, each of which writes its own files in order to the shared folder and names them in the rows it returns. Those rows, written as Parquet
after all files are there, are the list of what counts: a lost or repeated task leaves a file that no list names.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain, repeat
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from frostline.llm.lineage import ensure_checkpoint_dir, extended
from frostline.llm.packing import _bytes_of_marks, blocks_of

#: Fixed values of zstandard's skippable frames and of the seekable format.
INDEX_MAGIC, TABLE_MAGIC, SEEKABLE_MAGIC, CHECKSUMS = 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1, 0x80
INDEX_HEAD = struct.Struct("<4sHH")  # b"TOKS", version, width
ENTRY, FOOTER, SKIPPABLE = np.dtype([("packed", "<u4"), ("unpacked", "<u4"), ("check", "<u4")]), struct.Struct("<IBI"), struct.Struct("<II")
FRAME_IDS = 1 << 18
FILE_BYTES = 128 << 20
LEVEL = 3
TILE = 1000
_CACHE = 800_000
#: Marks that never join what stands before them.
MARKS = ".,;:!?"


class Corrupt(ValueError):
    """A token file whose bytes are not what its seek table says."""


def checksum(data: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


def store(uri: str):
    """(file system, path) for a folder or file of any store that pyarrow knows by its URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class Writer:
    """One file, written front to back; holds the table of its frames and the ids of its documents."""

    def __init__(self, out, width: int):
        import zstandard

        self.out, self.width = out, width
        self.pack = zstandard.ZstdCompressor(level=LEVEL, write_checksum=False).compress
        self.entries: list[tuple[int, int, int]] = []
        self.ids: list = []
        self.sizes: list[int] = []
        self.n_bytes = self.n_tokens = 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        for i in range(0, len(ids), FRAME_IDS):
            raw = ids[i : i + FRAME_IDS].astype(f"<u{self.width}").tobytes()
            self._put(self.pack(raw), len(raw), checksum(raw))
        self.ids.append(doc_id)
        self.sizes.append(len(ids))
        self.n_tokens += len(ids)

    def _put(self, packed: bytes, unpacked: int, check: int) -> None:
        self.out.write(packed)
        self.entries.append((len(packed), unpacked, check))
        self.n_bytes += len(packed)

    def close(self, id_type: pa.DataType) -> None:
        sink = pa.BufferOutputStream()
        batch = pa.RecordBatch.from_arrays([pa.array(self.ids, id_type), pa.array(self.sizes, pa.int64())], names=["doc_id", "n_tokens"])
        with pa.ipc.new_stream(sink, batch.schema) as stream:
            stream.write_batch(batch)
        index = INDEX_HEAD.pack(b"TOKS", 1, self.width) + sink.getvalue().to_pybytes()
        self._put(SKIPPABLE.pack(INDEX_MAGIC, len(index)) + index, 0, checksum(index))
        table = np.array(self.entries, ENTRY).tobytes() + FOOTER.pack(len(self.entries), CHECKSUMS, SEEKABLE_MAGIC)
        self.out.write(SKIPPABLE.pack(TABLE_MAGIC, len(table)) + table)
        self.out.close()


@dataclass
class Reader:
    """A file by its seek table; `file` reads at places (pyarrow's open_input_file)."""

    file: object

    def __post_init__(self) -> None:
        import zstandard

        self.unpack = zstandard.ZstdDecompressor().decompress
        size = self.file.size()
        tail = FOOTER.size
        if size < tail + SKIPPABLE.size:
            raise Corrupt("too short for a seek table")
        n, flags, magic = FOOTER.unpack(self._at(size - tail, tail))
        length = n * ENTRY.itemsize + tail
        if magic != SEEKABLE_MAGIC or flags != CHECKSUMS or size < length + SKIPPABLE.size or SKIPPABLE.unpack(self._at(size - length - SKIPPABLE.size, SKIPPABLE.size)) != (TABLE_MAGIC, length):
            raise Corrupt("no seek table at the end")
        self.table = np.frombuffer(self._at(size - length, length - tail), ENTRY)
        self.begin = np.cumsum(self.table["packed"].astype(np.int64)) - self.table["packed"]
        if not n or int(self.begin[-1]) + int(self.table["packed"][-1]) + SKIPPABLE.size + length != size:
            raise Corrupt("the frames do not fill the file")
        index = self._at(int(self.begin[-1]), int(self.table["packed"][-1]))[SKIPPABLE.size :]
        if checksum(index) != self.table["check"][-1]:
            raise Corrupt("the index is not the one that was written")
        mark, version, self.width = INDEX_HEAD.unpack(index[: INDEX_HEAD.size])
        if mark != b"TOKS" or version != 1 or self.width not in (2, 4):
            raise Corrupt("another kind of index")
        self.docs = pa.ipc.open_stream(index[INDEX_HEAD.size :]).read_all()
        self.sizes = self.docs.column(1).to_numpy()
        frames = -(-self.sizes // FRAME_IDS)
        if frames.sum() != n - 1:
            raise Corrupt("frames without a document")
        self.first = np.cumsum(frames) - frames
        self.frames = frames

    def _at(self, place: int, n: int) -> bytes:
        self.file.seek(place)
        data = self.file.read(n)
        if len(data) != n:
            raise Corrupt(f"ends within {n} bytes at {place}")
        return data

    def document(self, k: int) -> np.ndarray:
        """The ids of the file's k-th document; only its frames are read and unpacked."""
        import zstandard

        parts = []
        for f in range(int(self.first[k]), int(self.first[k] + self.frames[k])):
            try:
                raw = self.unpack(self._at(int(self.begin[f]), int(self.table["packed"][f])))
            except zstandard.ZstdError as e:
                raise Corrupt(f"frame {f}: {e}") from e
            if len(raw) != self.table["unpacked"][f] or checksum(raw) != self.table["check"][f]:
                raise Corrupt(f"frame {f} has another checksum")
            parts.append(np.frombuffer(raw, f"<u{self.width}"))
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


def word_twin(path: str):
    """(tiktoken's encoder, its marks' ids and whether they end a word) for words of letters that end in a zero byte; None unless the file's vocabulary is
    256 bytes, the same with a word's end, and one token for each merge in their order: merging by rank and by merge list are the same then.

    A word's last byte joins the zero byte before all else, since those 256 pairs rank first; what follows are the file's merges.
    """
    import tiktoken

    model = json.loads(Path(path).read_text())["model"]
    vocab, end, byte_of = model["vocab"], model.get("end_of_word_suffix"), _bytes_of_marks()
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if not end or any(vocab.get(a + b) != 512 + i for i, (a, b) in enumerate(pairs)) or {vocab.get(c + e) for c in byte_of for e in ("", end)} != set(range(512)):
        return None
    plain = lambda t: bytes(byte_of[c] for c in t.removesuffix(end)) + (b"\0" if t.endswith(end) else b"")
    lasts = [c + end for c in byte_of]
    order = [*lasts, *(a + b for a, b in pairs), *byte_of]  # the rank of a token is its place
    ranks = {plain(t): i for i, t in enumerate(order)}
    if len(ranks) != len(order):
        return None
    id_of = np.array([vocab[t] for t in order]), np.array([t.endswith(end) for t in order])
    return tiktoken.Encoding("words", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={}), id_of


class WordEncoder:
    """ids of a tokenizer that drops white space, so that a text's ids are those of its units between white space, which are kept between texts.

    Nothing merges, composes or matches across white space there; that the file at hand is of this kind is tested when it is opened, else every text is a unit of its own.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.top = max(self.whole.get_vocab(with_added_tokens=True).values())
        ids = lambda t: self.whole.encode(t, add_special_tokens=False).ids
        a, b, special = ids("Ab1'"), ids("é.x"), [t for t in self.whole.get_added_tokens_decoder().values()]
        white = [chr(c) for c in range(0x3001) if chr(c).isspace()]
        kept = [w for w in white if ids(f"Ab1'{w}é.x") != a + b]  # white space to Python, but not to the tokenizer
        self.by_units = " " not in kept and not any(w in t.content for t in special for w in white) and not any(t.lstrip or t.rstrip for t in special)
        self.kept = "".join(kept)
        self.twin = self.by_units and word_twin(path)
        probe = ["ab", "résumé", "zyzzyva", "x"]
        self.by_words = bool(self.twin) and self._joined(probe) == [ids(w) for w in probe] and all(ids(f"Résumé{t}") == ids("résumé") + ids(t) for t in (".", "?!", ",;", ":"))
        self.row: dict[str, int] = {}
        self.ids, self.begin, self.sizes = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _joined(self, words: list[str]) -> list[list[int]]:
        """The ids of words of letters, which the twin merges in one call."""
        encoding, id_of = self.twin
        marks = np.array(encoding.encode_ordinary("".join(f"{w}\0" for w in words)), np.int64)
        cuts = np.flatnonzero(id_of[1][marks]) + 1
        ids = id_of[0][marks].tolist()
        return [ids[a:z] for a, z in zip([0, *cuts.tolist()], cuts.tolist())]

    def units(self, text: str) -> list[str]:
        if not self.by_units:
            return [text]
        return text.split(" ") if any(w in text for w in self.kept) else text.split()

    def fresh(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of units that are not kept yet: a Latin word and the marks after it are looked up by themselves, in lower case."""
        word, marks, table = [], [], {}
        for u in units:
            w = u.rstrip(MARKS)
            if self.by_words and w.isalpha() and (w.isascii() or max(w) < "\u0100"):
                word.append(w.lower())
                marks.append(u[len(w) :])
            else:
                word.append(u)
                marks.append("")
        need = [x for x in dict.fromkeys(chain(word, marks)) if x not in self.row]
        plain = [x for x in need if self.by_words and x.isalpha() and max(x) < "\u0100" and x == x.lower()]
        table = dict(zip(plain, self._joined(plain))) if plain else {}
        odd = [x for x in need if x not in table]
        table |= {x: e.ids for x, e in zip(odd, self.whole.encode_batch_fast(odd, add_special_tokens=False))}
        for x in {*word, *marks} - table.keys():
            i = self.row[x]
            table[x] = self.ids[self.begin[i] : self.begin[i] + self.sizes[i]].tolist()
        each = [table[w] + table[m] for w, m in zip(word, marks)]
        return np.fromiter(chain.from_iterable(each), np.uint32), np.fromiter(map(len, each), np.int64, len(each))

    def encode_block(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): the ids of all texts, one after the other, and where each text's end."""
        split = [self.units(t) for t in texts]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        units = list(chain.from_iterable(split))
        at = np.fromiter(map(self.row.get, units, repeat(-1)), np.int64, len(units))
        ids, begin, sizes = self.ids, self.begin, self.sizes
        missing = np.flatnonzero(at < 0).tolist()
        if missing:
            fresh = {u: len(sizes) + i for i, u in enumerate(dict.fromkeys(units[i] for i in missing))}
            more, n = self.fresh(list(fresh))
            begin = np.concatenate([begin, len(ids) + n.cumsum() - n])
            ids, sizes = np.concatenate([ids, more]), np.concatenate([sizes, n])
            at[missing] = [fresh[units[i]] for i in missing]
            if len(self.row) + len(fresh) <= _CACHE and sum(map(len, fresh)) < 32 * _CACHE:  # the first units seen are mostly the frequent ones
                self.row.update(fresh)
                self.ids, self.begin, self.sizes = ids, begin, sizes
        count = sizes[at]
        shift = begin[at] - (count.cumsum() - count)
        return ids[np.repeat(shift, count) + np.arange(count.sum())], np.r_[0, count.cumsum()][counts.cumsum()]


@cache
def encoder_of(path: str) -> WordEncoder:
    """One to a worker process, for all of its tasks."""
    return WordEncoder(path)


def new_folder(spark: SparkSession) -> str:
    """A folder that is not there yet, under the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/tokens-{uuid.uuid4().hex}"


FILES = "name string, part int, seq int, n_docs long, n_tokens long, n_bytes long"


def write_tokens(docs: DataFrame, tokenizer: str, uri: str, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes docs as token files under uri, a new folder of a store that all executors and pyarrow reach, and returns their list (FILES, first_id, last_id), read back from uri/list.

    Documents are in ascending order of id, nulls first; rows that repeat an id are all kept, in the order of their texts' hashes. A null text is empty; an empty one is its end id alone, or no ids and no frame without end_id.
    Texts are read whole, their ids take frames of at most FRAME_IDS ids and files of about file_bytes. No rows give an empty list; other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # the last keys let rows of one id, even all alike, go to several tasks
    rows = rows.repartitionByRange("doc_id", F.xxhash64("text"), F.monotonically_increasing_id()).sortWithinPartitions("doc_id", F.xxhash64("text"))
    id_type = spark.createDataFrame([], rows.select("doc_id").schema).toArrow().schema.field(0).type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from pyspark import TaskContext

        part, writer, done, enc = TaskContext.get().partitionId(), None, 0, None

        def finish() -> pa.RecordBatch:
            nonlocal writer, done
            writer.close(id_type)
            row = [name, part, done, len(writer.ids), writer.n_tokens, writer.n_bytes]
            ends = [pa.array([writer.ids[i]], id_type) for i in (0, -1)]
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            writer, done = None, done + 1
            return pa.RecordBatch.from_arrays([*(pa.array([v], k) for v, k in zip(row, kinds)), *ends], names=["name", "part", "seq", "n_docs", "n_tokens", "n_bytes", "first_id", "last_id"])

        for b in batches:
            enc = enc or encoder_of(tokenizer)
            doc_ids = iter(b.column(0).to_pylist())
            for block in blocks_of(b.column(1)):
                ids, ends = enc.encode_block(block)
                begin = 0
                for end in ends.tolist():
                    if writer is None:
                        name = f"{part:06d}-{done:04d}-{uuid.uuid4().hex}.zst"  # another attempt writes another file
                        fs, path = store(f"{uri}/data")
                        fs.create_dir(path, recursive=True)
                        writer = Writer(fs.open_output_stream(f"{path}/{name}", compression=None), 2 if max(enc.top, end_id or 0) < 1 << 16 else 4)
                    own = ids[begin:end]
                    writer.add(next(doc_ids), own if end_id is None else np.append(own, np.uint32(end_id)))
                    begin = end
                    if writer.n_bytes >= file_bytes:
                        yield finish()
        if writer is not None:
            yield finish()

    kind = rows.schema["doc_id"].dataType.simpleString()
    rows.mapInArrow(run, f"{FILES}, first_id {kind}, last_id {kind}").write.mode("errorifexists").parquet(f"{uri}/list")
    return list_files(spark, uri)


def list_files(spark: SparkSession, uri: str) -> DataFrame:
    """The files of a finished folder: (uri, FILES, first_id, last_id, start), start being the tokens of all files before."""
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    files = spark.read.parquet(f"{uri}/list")
    return files.withColumns({"uri": F.concat(F.lit(f"{uri}/data/"), "name"), "start": F.coalesce(F.sum("n_tokens").over(before), F.lit(0))})


def _spread(files: DataFrame) -> DataFrame:
    """One file to a task, as far as there are tasks."""
    return files.repartition(max(1, min(files.count(), 100_000)))


def _read(files: DataFrame, schema, rows_of) -> DataFrame:
    """rows_of(reader, row) gives record batches for each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in chain.from_iterable(b.to_pylist() for b in batches):
            fs, path = store(row["uri"])
            with fs.open_input_file(path) as file:
                try:
                    yield from rows_of(Reader(file), row)
                except Corrupt as e:
                    raise Corrupt(f"{row['uri']}: {e}") from e

    return files.mapInArrow(run, schema)


def summaries(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files: start counts the tokens of all documents before it, ids_crc32 is over its ids as little-endian unsigned 32-bit integers."""

    def rows_of(reader: Reader, row: dict) -> Iterator[pa.RecordBatch]:
        start = row["start"] + reader.sizes.cumsum() - reader.sizes
        for i in range(0, reader.docs.num_rows, 10_000):
            docs = reader.docs.slice(i, 10_000).combine_chunks()
            crc = [zlib.crc32(reader.document(k).astype("<u4").tobytes()) if reader.sizes[k] else 0 for k in range(i, i + docs.num_rows)]
            yield pa.RecordBatch.from_arrays([docs.column(0).combine_chunks(), pa.array(start[i : i + docs.num_rows]), docs.column(1).combine_chunks(), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    ids = files.select(F.col("first_id").alias("doc_id"))
    return _read(_spread(files.select("uri", "start")), extended(ids, "start long, n_tokens long, ids_crc32 long"), rows_of)


def read_documents(files: DataFrame, wanted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, ids) of the documents whose id is in wanted; files that cannot hold one are not opened, of the others only the wanted documents' frames are unpacked.

    A null id is found by a null in wanted. Every row of a repeated id is returned, an id that is in no file gives no row.
    """
    kind = files.schema["first_id"].dataType
    # as structs, nulls compare as the least; the first look is at tiles of TILE files, so that what is broadcast has one row for so many files
    keys = wanted.select(F.struct(F.col(id_col).cast(kind).alias("id")).alias("key")).distinct()
    ends = files.select("uri", F.struct(F.col("first_id").alias("id")).alias("low"), F.struct(F.col("last_id").alias("id")).alias("high"), (F.row_number().over(Window.orderBy("part", "seq")) / TILE).cast("int").alias("tile"))
    tiles = ends.groupBy("tile").agg(F.min("low").alias("tile_low"), F.max("high").alias("tile_high"))
    near = keys.join(F.broadcast(tiles), F.col("key").between(F.col("tile_low"), F.col("tile_high"))).select("key", "tile")
    held = near.join(ends, "tile").where(F.col("key").between(F.col("low"), F.col("high")))
    # a file's wanted ids travel in groups of a bounded number
    groups = held.withColumn("g", F.abs(F.xxhash64("key")) % 16).groupBy("uri", "g").agg(F.collect_list("key").alias("keys"))

    def rows_of(reader: Reader, row: dict) -> Iterator[pa.RecordBatch]:
        want = {k["id"] for k in row["keys"]}
        for k in (k for k, d in enumerate(reader.docs.column(0).to_pylist()) if d in want):
            ids = reader.document(k).astype(np.int64) if reader.sizes[k] else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([reader.docs.column(0).slice(k, 1).combine_chunks(), pa.array([ids], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return _read(groups.select("uri", "keys"), extended(files.select(F.col("first_id").alias("doc_id")), "ids array<long>"), rows_of)
