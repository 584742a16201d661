"""Every stage over nulls, empty and long texts, ties, repeated rows, empty tables and extra columns of clashing names."""

import corpus_pipeline as cp
import pytest

SF = "/root/testdata/sf0.001"


def prose(seed, n):
    return " ".join(f"w{(seed * 7919 + i * i * 31 + i) % 99991}" for i in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    long = prose(1, 60_000)
    leak = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    rows = [
        (1, prose(2, 60), "en", "a", 1), (2, prose(2, 60), "en", "a", 1), (2, prose(2, 60), "en", "a", 1), (3, None, None, None, None), (4, "", "en", "b", 0),
        (5, long, "en", None, 1), (None, prose(3, 50), "en", "c", 1), (6, " \t\n ", "en", "c", 1), (7, prose(4, 40) + "\n" + prose(5, 40), None, None, 7),
        (8, prose(5, 40) + "\n" + prose(6, 40), "de", "d", 8), (9, prose(7, 30) + " " + leak + " " + prose(8, 30), "en", "e", 9),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.selectExpr("*", "1 as fp", "'x' as line", "2 as h1", "'y' as host", "3 as band", "'z' as `__d`", "4 as piece", "5 as doc_key", "true as stay")


def test_stages_over_odd_rows(spark, docs, tmp_path):
    kept = {}
    now = docs
    for name, stage in cp.STAGES:
        stage(spark, now, SF).write.parquet(str(tmp_path / name))
        before, now = now, spark.read.parquet(str(tmp_path / name))
        kept[name] = [r.doc_id for r in now.select("doc_id").collect()]
        if name != cp.STAGES[-1][0]:
            assert now.columns == before.columns
    ids = lambda n: sorted(set(kept[n]), key=str)
    assert ids("quality_rules") == sorted([1, 2, 5, 7, 8, 9, None], key=str) and kept["quality_rules"].count(2) == 2
    lines = {r.doc_id: (r.text, r.n_chars) for r in spark.read.parquet(str(tmp_path / "line_dedup")).collect()}
    assert set(lines) == {1, 5, 7, 8, 9, None} and lines[8] == (prose(6, 40), len(prose(6, 40))) and len(lines[5][0].split()) == 60_000
    assert ids("near_copies") == sorted([1, 5, 7, 8, 9, None], key=str) and ids("decontamination") == sorted([1, 5, 7, 8, None], key=str)
    assert ids("packing") == ids("decontamination")


def test_stages_over_no_rows(spark, docs):
    for name, stage in cp.STAGES:
        out = stage(spark, docs.limit(0), SF)
        assert out.count() == 0 and (name == cp.STAGES[-1][0] or out.columns == docs.columns), name


def test_keep_forms_repeat_nothing(spark, docs):
    """What a stage keeps it keeps again, whatever the order of the rows."""
    for name, stage in cp.STAGES[:-1]:
        once = stage(spark, docs, SF)
        turned = stage(spark, docs.orderBy("n_chars", ascending=False), SF)
        texts = lambda d: sorted(map(str, d.select("doc_id", "text").collect()))
        assert texts(once) == texts(turned), name
