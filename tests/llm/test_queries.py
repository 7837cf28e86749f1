"""The queries are registered; those with SQL agree with it."""

import glob
import os

import duckdb
import pytest

from corpuslens.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    want = con.execute(ORACLE[name])
    columns = sorted(c[0] for c in want.description)
    names = [c[0] for c in want.description]
    expected = sorted((tuple(r[names.index(c)] for c in columns) for r in want.fetchall()), key=str)
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == columns
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str) == expected
