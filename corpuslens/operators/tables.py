"""State tables on disk, in buckets of their key: a change rewrites the buckets that it touches, and no other file.

A table is a folder of Parquet files by run and bucket.  A change joins its rows with the touched buckets alone, writes the
result to a scratch table, and puts it in place by dynamic partition overwrite.  The same change again gives the same rows.
"""

from __future__ import annotations

import json
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..session import delete_path, materialize
from ..sources.sinks import get_text, put_bytes
from . import state as T

#: Columns that say where a row lies.
RUN, BUCKET = "run", "bucket"
SETTINGS = "_table.json"
#: Touched buckets up to which the scan is cut to them by name; a change that touches more reads the table and joins.
NAMED = 4096


def _settings(spark: SparkSession, path: str) -> dict:
    return json.loads(get_text(spark, f"{path}/{SETTINGS}"))


def _bucket(key: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def _placed(rows: DataFrame, s: dict) -> DataFrame:
    run = F.nullif(F.col(s["run"]).cast("string"), F.lit("")) if s["run"] else F.lit("all")
    return rows.withColumn(RUN, F.coalesce(run, F.lit("none"))).withColumn(BUCKET, _bucket(s["key"], s["buckets"]))


def _write(rows: DataFrame, path: str) -> None:
    # One task a bucket, or more where it is large: rows of a bucket are dealt by their key's hash.
    rows.repartition(RUN, BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(RUN, BUCKET).parquet(path)


def create(rows: DataFrame, path: str, key: list[str], buckets: int = 64, run: str | None = None) -> None:
    """A new table of ``rows``, by the column ``run`` (if given) and ``buckets`` shares of the key, which must be unique."""
    if {RUN, BUCKET} & set(rows.columns):
        raise ValueError(f"columns {RUN} and {BUCKET} are the table's own")
    s = {"key": key, "buckets": buckets, "run": run, "schema": rows.schema.json()}
    _write(_placed(rows, s), path)
    put_bytes(rows.sparkSession, f"{path}/{SETTINGS}", json.dumps(s).encode())


def _all(spark: SparkSession, path: str, s: dict) -> DataFrame:
    own = StructType.fromJson(json.loads(s["schema"])).add(RUN, "string").add(BUCKET, "integer")
    return spark.read.schema(own).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return _all(spark, path, _settings(spark, path)).drop(RUN, BUCKET)


def _touched(spark: SparkSession, path: str, s: dict, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The table's rows in the buckets of ``rows``, and those buckets."""
    places = materialize(rows.select(RUN, BUCKET).distinct(), "touched")
    table = _all(spark, path, s)
    named = places.limit(NAMED + 1).collect()
    if len(named) <= NAMED:
        buckets = defaultdict(list)
        for r in named:
            buckets[r[RUN]].append(r[BUCKET])
        cut = F.lit(False)
        for run, own in buckets.items():
            cut = cut | ((F.col(RUN) == run) & F.col(BUCKET).isin(own))
        table = table.filter(cut)
    return table.join(places, [RUN, BUCKET], "left_semi").select(*table.columns), places


def upsert(spark: SparkSession, path: str, new: DataFrame, keep: list[str] = (), order: list[str] | None = None) -> int:
    """New rows in the place of old ones (see ``state.upsert``); returns how many buckets were written.

    With a run column a key stays in its run; a row of the same key in another run is another row.
    """
    s = _settings(spark, path)
    rows = materialize(_placed(new, s), "new")
    old, places = _touched(spark, path, s, rows)
    merged = T.upsert(old, rows, [RUN, BUCKET, *s["key"]], list(keep), order or new.columns)
    _write(materialize(merged, "merged"), path)
    return places.count()


def insert(spark: SparkSession, path: str, new: DataFrame, order: list[str] | None = None) -> int:
    """New rows whose key the table hasn't (see ``state.insert_or_ignore``)."""
    s = _settings(spark, path)
    rows = materialize(_placed(new, s), "new")
    old, places = _touched(spark, path, s, rows)
    _write(materialize(T.insert_or_ignore(old, rows.select(*old.columns), [RUN, BUCKET, *s["key"]], order), "merged"), path)
    return places.count()


def _named(spark: SparkSession, run: str) -> str:
    """A run as it stands in a folder's name."""
    return spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(run)


def delete(spark: SparkSession, path: str, keys: DataFrame) -> int:
    """Rows of the keys in ``keys`` (with the run column, if the table has one) go; a bucket that loses all its rows goes too."""
    s = _settings(spark, path)
    rows = materialize(_placed(keys, s), "gone")
    old, places = _touched(spark, path, s, rows)
    at = [RUN, BUCKET, *s["key"]]
    left = materialize(old.join(rows.select(*at), at, "left_anti").select(*old.columns), "left")
    _write(left, path)
    emptied = places.join(left.select(RUN, BUCKET).distinct(), [RUN, BUCKET], "left_anti")
    for r in emptied.toLocalIterator():
        delete_path(spark, f"{path}/{RUN}={_named(spark, r[RUN])}/{BUCKET}={r[BUCKET]}")
    return places.count()


def delete_run(spark: SparkSession, path: str, run_id: str) -> None:
    """All of one run: its folder, no row is read."""
    if not _settings(spark, path)["run"]:
        raise ValueError("the table has no runs")
    delete_path(spark, f"{path}/{RUN}={_named(spark, run_id)}")
