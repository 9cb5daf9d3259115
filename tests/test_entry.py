"""The registry: every SQL has its query, and small queries agree with their SQL."""

import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", ["scan_plain", "where_left_assoc", "syllable_split", "merge_bar", "js_key_order", "ruby_parse"])
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in os.listdir(SF):
        con.sql(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{SF}/{t}'")
    df = entry.queries()[name](spark, SF)
    rel = con.sql(entry.oracle_sql()[name])
    cols = sorted(df.columns)
    assert sorted(rel.columns) == cols
    assert sorted(tuple(map(str, (r[c] for c in cols))) for r in df.collect()) == sorted(tuple(str(r[rel.columns.index(c)]) for c in cols) for r in rel.fetchall())
