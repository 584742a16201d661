"""Every query of the reference's operators against DuckDB's SQL on the smallest tables."""

import pytest

from compare import duck, rows
from frostline.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, con, name):
    got, want = QUERIES[name](spark, SF).toPandas(), con.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_file_statistics(spark):
    """Bytes are those of the files; SQL does not know them."""
    from pathlib import Path

    got = {r.table: (r.n_files, r.total_bytes) for r in QUERIES["table_statistics"](spark, SF).collect()}
    assert len(got) == 14 and all(v == (1, Path(f"{SF}/{t}.parquet").stat().st_size) for t, v in got.items())


def test_fields_with_odd_names(spark):
    from frostline.sources import catalog

    raw = """{"a'b": 1, "x.y": "2", "n": null, "o": {"k": 1}, "l": [1], "f": 1.5, "big": 123456789012345678901, "t": true}"""
    docs = spark.createDataFrame([(raw,), ("{broken",), (None,), ("[1]",), ("{}",)], "raw string")
    got = {r.field: (r.type, r.n) for r in catalog.profile_document_fields(docs, "raw").collect()}
    assert got == {"a'b": ("integer", 1), "x.y": ("string", 1), "n": ("null", 1), "o": ("object", 1), "l": ("array", 1), "f": ("number", 1), "big": ("integer", 1), "t": ("boolean", 1)}


def test_touched_files_when_rewritten_rows_are_mixed(spark, con):
    """Where the deleted keys are too many for a broadcast, the files written anew hold rows of several old ones."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = QUERIES["touched_files"](spark, SF).toPandas()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert rows(got) == rows(con.sql(SQL["touched_files"]).df())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 2
