"""Session defaults, and scratch tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import threading
import uuid
from collections.abc import Iterator

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
}
#: Drops the shuffle files of a query when it ends; a written table needs them no longer.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

class _Scopes(threading.local):
    """Scratch folders of the scopes that a thread has open, innermost last; another thread's queries keep their own."""

    def __init__(self):
        self.open: list[list[tuple[SparkSession, str]]] = []


_scopes = _Scopes()


def build_session(app: str = "corpuslens", master: str | None = None, **conf: str) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in (DEFAULTS | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only where it is unset on one machine (tests, a laptop) a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="corpuslens-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a scratch folder; a session that has ended has nothing left to ask."""
    if spark.sparkContext._jsc is None:
        return
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except (Py4JError, ConnectionError):  # at interpreter exit the JVM may be gone
        pass


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the scratch root, removed when its scope, or else the driver, ends."""
    path = f"{scratch_root(spark)}/corpuslens/{name}-{uuid.uuid4().hex}"
    if _scopes.open:
        _scopes.open[-1].append((spark, path))
    else:
        atexit.register(delete_path, spark, path)
    return path


@contextlib.contextmanager
def scratch_scope(keep: list[DataFrame]) -> Iterator[None]:
    """Delete the scratch tables written inside, but those that ``keep`` lists by then (they go with the outer scope or the driver)."""
    _scopes.open.append([])
    try:
        yield
    finally:
        own = _scopes.open.pop()
        kept = {path for df in keep if (path := getattr(df, "_scratch", None))}
        for spark, path in own:
            if path not in kept:
                delete_path(spark, path)
            elif _scopes.open:
                _scopes.open[-1].append((spark, path))
            else:
                atexit.register(delete_path, spark, path)


def drop(*tables: DataFrame) -> None:
    """Delete scratch tables whose last reader is done."""
    for df in tables:
        if path := getattr(df, "_scratch", None):
            delete_path(df.sparkSession, path)


@contextlib.contextmanager
def settings(spark: SparkSession, **conf: str) -> Iterator[None]:
    """Session settings for the jobs that run inside, as they were afterwards (``__`` in a name stands for a dot)."""
    names = {k.replace("__", "."): v for k, v in conf.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def materialize(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` once to the shared scratch folder and read it back.

    It cuts lineage like ``checkpoint()``, survives lost executors, and gives
    the planner real sizes, so a side is broadcast only below the threshold.
    The shuffle files of the query go when it ends.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with settings(spark, **{SHUFFLE_CLEANUP: "true"}):
        df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out
