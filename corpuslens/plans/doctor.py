"""Checks of the environment, an event log, and how both are shown."""

from __future__ import annotations

import json
import platform
import sys
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from ..operators.state import append_events
from ..schemas import LABELS, SCHEMA_VERSION, SEVERITIES, TABLES, schema
from ..session import delete_path, scratch_path

CHECK = "name string, status string, detail string, fix string, critical boolean"
PASS, WARN, FAIL = "pass", "warn", "fail"


def checks(spark: SparkSession, probes: dict[str, Callable[[], str]] | None = None) -> DataFrame:
    """One row a check: versions, whether the scratch folder takes writes, and ``probes``, functions that answer a detail or raise."""
    rows = [("runtime/python", PASS, sys.version.split()[0], "", False), ("runtime/spark", PASS, spark.version, "", False), ("runtime/os-arch", PASS, f"{platform.system().lower()}/{platform.machine()}", "", False)]
    path = scratch_path(spark, "probe")
    try:
        spark.range(1).write.parquet(path)
        rows.append(("scratch/write-access", PASS, path.rpartition("/corpuslens/")[0], "", True))
    except Exception as e:  # whatever a file system raises is the finding
        rows.append(("scratch/write-access", FAIL, str(e).splitlines()[0], "set spark.checkpoint.dir to a folder that all machines can write", True))
    finally:
        delete_path(spark, path)
    for name, probe in (probes or {}).items():
        try:
            rows.append((name, PASS, probe(), "", False))
        except Exception as e:  # as above
            rows.append((name, WARN, str(e), "", False))
    return spark.createDataFrame(rows, CHECK)


def critical_failures(found: DataFrame) -> DataFrame:
    return found.agg(F.count_if(F.col("critical") & (F.col("status") == FAIL)).alias("critical_failures"))


def check_lines(found: DataFrame) -> DataFrame:
    """A line of JSON a check."""
    return found.select(F.to_json(F.struct("name", "status", "detail", "fix", "critical"), {"ignoreNullFields": "false"}).alias("line"))


def check_table(rows: Iterable[Row]) -> str:
    rows = list(rows)
    out = [f"{r.name[:34]:<34} {r.status}" + (f"  ({r.detail})" if r.detail else "") + (f"\n{'':<35}fix: {r.fix}" if r.fix else "") for r in rows]
    bad = sum(r.critical and r.status == FAIL for r in rows)
    return "\n".join([f"{'Component':<34} Status", "-" * 41, *out, "-" * 41, f"Result: FAIL ({bad} critical)" if bad else "Result: PASS"]) + "\n"


def summary_table(summary: dict) -> str:
    """A scan's counters for people: labels in their usual order, then actions by name."""
    pairs = [("Pages", summary.get("pages_total", 0)), *((x, summary["by_label"][x]) for x in LABELS if summary["by_label"].get(x)), *sorted(summary["by_action"].items())]
    return "".join(f"{k:<24}{v:>8}\n" for k, v in pairs)


def inspection_line(inspection: DataFrame) -> DataFrame:
    """A run's inspection as one line of JSON, keys of its maps in order."""
    return inspection.select(F.to_json(F.struct(F.lit("run_inspection").alias("kind"), *inspection.columns), {"ignoreNullFields": "false"}).alias("line"))


def severe(events: DataFrame, least: str = "info") -> DataFrame:
    """Events of at least a severity; unknown severities stay."""
    below = SEVERITIES[: SEVERITIES.index(least)]
    return events.filter(~F.col("severity").isin(below)) if below else events


class EventSink:
    """A foreachBatch function, or a plain call, that appends events to a table in a folder; ``listeners`` see each batch too."""

    def __init__(self, path: str, least: str = "info", listeners: Iterable[Callable[[DataFrame], None]] = ()):
        self.path, self.least, self.listeners = path, least, tuple(listeners)

    def __call__(self, batch: DataFrame, batch_id: int = 0) -> None:
        own = severe(batch, self.least)
        own = append_events(batch.sparkSession.createDataFrame([], schema("events")), own) if "payload" in batch.columns else own
        own.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")
        for listen in self.listeners:
            listen(own)


def open_store(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The engine's tables in a folder; those that are missing are made, empty, and the schema's version is entered once."""
    out = {}
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for name in TABLES:
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        if not path.getFileSystem(conf).exists(path):
            rows = [(SCHEMA_VERSION,)] if name == "schema_migrations" else []
            first = spark.createDataFrame(rows, "version int").withColumn("applied_at", F.current_timestamp()) if rows else spark.createDataFrame([], schema(name))
            first.write.parquet(f"{folder}/{name}")
        out[name] = spark.read.schema(schema(name)).parquet(f"{folder}/{name}")
    newest = out["schema_migrations"].agg(F.max("version")).first()[0]
    if newest != SCHEMA_VERSION:
        raise ValueError(f"the tables are of version {newest}, this engine reads {SCHEMA_VERSION}")
    return out


def info() -> str:
    return json.dumps({"schema_version": SCHEMA_VERSION, "tables": sorted(TABLES)}, sort_keys=True)
