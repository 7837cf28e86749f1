"""Bucketed state tables: touched buckets alone are rewritten, repeated changes, nulls, runs with odd names."""

import glob
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from corpuslens.operators import tables as B


def files(path):
    return {os.path.relpath(f, path) for f in glob.glob(f"{path}/run=*/bucket=*/*.parquet")}


def table(spark, n, said="old", step=1):
    return spark.range(0, n, step).select(F.col("id"), F.concat(F.lit("r"), (F.col("id") % 2).cast("string")).alias("run_id"), F.lit(said).alias("said"))


def state(spark, path):
    return {(r.id, r.run_id): r.said for r in B.read(spark, path).collect()}


def test_only_touched_buckets_are_rewritten(spark):
    path = tempfile.mkdtemp() + "/t"
    B.create(table(spark, 400), path, ["id"], 20, "run_id")
    before = files(path)
    new = table(spark, 3, "new")
    assert B.upsert(spark, path, new) <= 3
    after = files(path)
    gone = {f.rpartition("/")[0] for f in before - after}
    assert 0 < len(gone) <= 3 and {f.rpartition("/")[0] for f in after - before} == gone and len(before & after) >= len(before) - 3
    want = {(i, f"r{i % 2}"): "new" if i < 3 else "old" for i in range(400)}
    assert state(spark, path) == want
    B.upsert(spark, path, new)
    B.insert(spark, path, table(spark, 5, "never"))
    assert state(spark, path) == want


def test_deletes(spark):
    path = tempfile.mkdtemp() + "/t"
    B.create(table(spark, 60), path, ["id"], 4, "run_id")
    B.delete(spark, path, table(spark, 60).filter("run_id = 'r0' and id < 50"))
    assert state(spark, path) == {(i, f"r{i % 2}"): "old" for i in range(60) if i % 2 or i >= 50}
    B.delete(spark, path, table(spark, 60).filter("id >= 50"))
    assert {r for _, r in state(spark, path)} == {"r1"}
    assert not glob.glob(f"{path}/run=r0/bucket=*")
    B.delete_run(spark, path, "r1")
    assert B.read(spark, path).count() == 0 and B.read(spark, path).columns == ["id", "run_id", "said"]
    B.insert(spark, path, table(spark, 2))
    assert len(state(spark, path)) == 2


def test_odd_runs_repeated_rows_and_empty_changes(spark):
    path = tempfile.mkdtemp() + "/t"
    rows = [(1, "a/b=c %", "x"), (2, "", "x"), (3, None, "x"), (4, "é", None)]
    B.create(spark.createDataFrame(rows, "id int, run_id string, said string"), path, ["id"], 3, "run_id")
    assert state(spark, path) == {(i, r): s for i, r, s in rows}
    twice = spark.createDataFrame([(1, "a/b=c %", "y"), (1, "a/b=c %", "z"), (4, "é", "w")], "id int, run_id string, said string")
    B.upsert(spark, path, twice, order=["said"])
    assert state(spark, path) == {(1, "a/b=c %"): "z", (2, ""): "x", (3, None): "x", (4, "é"): "w"}
    before = files(path)
    assert B.upsert(spark, path, twice.limit(0)) == 0 and files(path) == before
    B.delete(spark, path, twice.filter("id = 1"))
    B.delete_run(spark, path, "é")
    assert state(spark, path) == {(2, ""): "x", (3, None): "x"}
    with pytest.raises(ValueError):
        B.create(twice.withColumn("bucket", F.lit(1)), path + "2", ["id"])


def test_a_table_without_runs_keeps_columns(spark):
    path = tempfile.mkdtemp() + "/t"
    old = spark.createDataFrame([("u", "first", 1), ("v", "first", 1)], "url string, first_run string, n int")
    B.create(old, path, ["url"], 2)
    B.upsert(spark, path, spark.createDataFrame([("u", "second", 2), ("w", "second", 2)], old.schema), keep=["first_run"])
    assert {tuple(r) for r in B.read(spark, path).collect()} == {("u", "first", 2), ("v", "first", 1), ("w", "second", 2)}
    with pytest.raises(ValueError):
        B.delete_run(spark, path, "x")
