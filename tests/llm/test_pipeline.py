import re

import corpus_pipeline as cp
import pytest

from test_html_chat_packing import check_packing

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    top, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in cp.STAGES:
        stage(spark, docs, SF).write.parquet(str(top / name))
        before, docs = docs, spark.read.parquet(str(top / name))
        out.append((name, before, docs))
    return out


def test_columns_stay(stages):
    for name, before, after in stages[:-1]:
        assert after.columns == before.columns, name
        assert after.count() <= before.count()


def test_every_stage_does_its_part(stages):
    by = {name: (before, after) for name, before, after in stages}
    assert by["quality_rules"][1].count() < by["quality_rules"][0].count()
    before, after = ({r.doc_id: r.text for r in x.collect()} for x in by["line_dedup"])
    lines = [x for t in after.values() for x in t.split("\n") if x.strip(" \t\r\x0b\x0c")]
    assert len(lines) == len(set(lines)) and set(before) - set(after)
    assert all(r.n_chars == len(r.text) for r in by["line_dedup"][1].collect())
    items = [" ".join(re.findall(r"\w+", r.text.lower())) for r in stages[0][1].sparkSession.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = lambda t: any(i in " ".join(re.findall(r"\w+", t.lower())) for i in items)
    assert not any(leaks(r.text) for r in by["decontamination"][1].collect())
    clean = [r.doc_id for r in by["decontamination"][0].collect() if not any(" ".join(i.split()[:5]) in " ".join(re.findall(r"\w+", r.text.lower())) for i in items)]
    assert set(clean) <= {r.doc_id for r in by["decontamination"][1].collect()}


def test_what_comes_out_is_what_was_kept(spark, stages):
    kept = {r.doc_id: r.text for r in stages[-1][1].collect()}
    check_packing(stages[-1][2].collect(), kept)
    run = cp.run(spark, SF).select("doc_id", "piece", "ids_crc32").collect()
    assert sorted(map(tuple, run)) == sorted(map(tuple, stages[-1][2].select("doc_id", "piece", "ids_crc32").collect()))
