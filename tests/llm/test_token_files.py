"""Token files against the tokenizer itself and zstandard's own reader."""

import io
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import zstandard
from tokenizers import Tokenizer

from frostline.llm import token_files
from frostline.llm.token_files import Corrupt, Reader, WordEncoder, Writer

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", " ", "It's John's book here", "a\x1cb\x1dc d", "x\u0085y z", "é ́e", "A<|endoftext|>B <|startoftext|>", "ﬁ Å ΑΣ ΑΣ' σς", "１２ ½ 123 4", "​zero​ width", "emoji 👩‍👩‍👧 \U0001f1e9\U0001f1ea",
    "line\r\nline\tx\x0by\x0cz", "don't DON'T won''t 's", "ｆｕｌｌ　ｗｉｄｔｈ", "\x00nul\x00", "日本語 テキスト", "İstanbul Iİıi",
]


def file_of(docs: list, width: int = 2) -> bytes:
    out = io.BytesIO()
    close, out.close = out.close, lambda: None
    w = Writer(out, width)
    for k, ids in docs:
        w.add(k, np.array(ids, np.uint32))
    w.close(pa.int64())
    return out.getvalue()


def reader(data: bytes) -> Reader:
    return Reader(pa.BufferReader(data))


def test_units_give_the_texts_ids():
    whole, enc = Tokenizer.from_file(PATH), WordEncoder(PATH)
    assert enc.by_units and enc.by_words and set("\x1c\x1d\x1e\x1f") <= set(enc.kept) | {"\x1c"}
    texts = [*ODD, "\n".join(ODD), *(a + b for a in ODD for b in ODD[::3])]
    for _ in range(2):  # with and without the units kept
        ids, ends = enc.encode_block(texts)
        for t, a, z in zip(texts, [0, *ends], ends):
            assert ids[a:z].tolist() == whole.encode(t, add_special_tokens=False).ids, t
    # a tokenizer that keeps white space gets whole texts
    other = WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    ids, ends = other.encode_block(ODD)
    assert not other.by_units and ids.tolist() == [i for t in ODD for i in other.whole.encode(t, add_special_tokens=False).ids]


def test_file_is_plain_zstandard(monkeypatch):
    monkeypatch.setattr(token_files, "FRAME_IDS", 100)
    docs = [(None, [1, 2]), (3, []), (4, list(range(1000))), (4, [65535] * 100), (9, [7])]
    for width in (2, 4):
        data = file_of(docs, width)
        plain = b"".join(zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read(1 << 20) for _ in range(1))
        assert np.frombuffer(plain, f"<u{width}").tolist() == [i for _, ids in docs for i in ids]
        r = reader(data)
        assert r.docs.column(0).to_pylist() == [k for k, _ in docs] and r.frames.tolist() == [1, 0, 10, 1, 1]
        assert [r.document(k).tolist() for k in (4, 2, 0, 3)] == [docs[k][1] for k in (4, 2, 0, 3)]
    assert reader(file_of([])).docs.num_rows == 0


def test_only_what_is_asked_for_is_read():
    data = file_of([(k, np.random.default_rng(k).integers(0, 49_000, 5000)) for k in range(40)])

    class Counting:
        def __init__(self, data):
            self.file, self.n = pa.BufferReader(data), 0
            self.size, self.seek = self.file.size, self.file.seek

        def read(self, n):
            self.n += n
            return self.file.read(n)

    file = Counting(data)
    r = Reader(file)
    file.n = 0
    r.document(17)
    assert 0 < file.n < len(data) / 30


def test_every_flipped_byte_is_found():
    """A flip in a frame spoils that document alone; one in the index or the tables spoils the file."""
    docs = [(1, [5, 6, 7] * 40), (2, list(range(300))), (3, [9])]
    data = file_of(docs)
    sound = reader(data)
    end = int(sound.begin[-1])
    for place in range(len(data)):
        bad = bytearray(data)
        bad[place] ^= 0x41
        try:
            r = reader(bytes(bad))
        except (Corrupt, pa.ArrowInvalid, OSError):
            assert place >= end
            continue
        wrong = []
        for k, (_, ids) in enumerate(docs):
            try:
                same = r.document(k).tolist() == ids
            except Corrupt:
                wrong.append(k)
                continue
            assert same  # never wrong ids without an error
        own = [k for k in range(3) if int(sound.begin[k]) <= place < int(sound.begin[k] + sound.table["packed"][k])]
        assert set(wrong) <= set(own) if place < end else True
    for cut in (0, 5, len(data) // 2, len(data) - 1):
        with pytest.raises(Corrupt):
            reader(data[:cut])


def want(rows: list[tuple], end_id: int) -> list[tuple]:
    whole, start, out = Tokenizer.from_file(PATH), 0, []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, end_id], "<u4")
        out.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def written(spark, df, **more):
    return token_files.write_tokens(df, PATH, token_files.new_folder(spark), end_id=2, **more)


def test_round_trip(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(5)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    files = written(spark, docs, file_bytes=20_000)
    assert files.count() > 8
    got = sorted(map(tuple, token_files.summaries(files).collect()))
    assert got == want(rows, 2)
    ids = {r.doc_id: zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in token_files.read_documents(files, docs.where("doc_id % 7 = 0").select("doc_id")).collect()}
    assert ids == {d: c for d, _, _, c in got if d % 7 == 0}


def test_edges(spark, text_rows):
    """Nulls, empty, long and repeated rows, an id that is null, clashing columns, no rows, and ids that are text."""
    df = text_rows.selectExpr("*", "1 as start", "2 as n_tokens", "'u' as uri")
    files = written(spark, df)
    got = token_files.summaries(files).orderBy("start").collect()
    expected = want([(r.doc_id, r.text) for r in df.collect()], 2)
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_crc32) for r in got) == sorted((d or -1, n, c) for d, _, n, c in expected)
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1]] and [r.doc_id for r in got] == [e[0] for e in expected]
    asked = spark.createDataFrame([(None,), (2,), (2,), (99,)], "doc_id long")
    found = token_files.read_documents(files, asked).collect()
    assert sorted(str(r.doc_id) for r in found) == ["2", "2", "None"]
    none = written(spark, df.limit(0))
    assert none.count() == 0 and token_files.summaries(none).count() == 0 and token_files.read_documents(none, asked).count() == 0
    named = written(spark, df.selectExpr("concat('d', doc_id) as doc_id", "text"))
    assert {r.doc_id for r in token_files.read_documents(named, spark.createDataFrame([("d7",)], "doc_id string")).collect()} == {"d7"}


def test_one_id_for_all_rows_takes_several_files(spark):
    df = spark.range(4000).selectExpr("7L as doc_id", "'the same words in each of them' as text")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        files = written(spark, df)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert files.select("part").distinct().count() > 1
    got = token_files.summaries(files).orderBy("start").collect()
    assert len(got) == 4000 and len({(r.n_tokens, r.ids_crc32) for r in got}) == 1 and got[-1].start == got[-1].n_tokens * 3999
    with pytest.raises(Exception, match="(?i)exists"):
        token_files.write_tokens(df, PATH, files.first().uri.rpartition("/data/")[0])
