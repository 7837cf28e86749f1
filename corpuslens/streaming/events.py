"""Structured Streaming over event files: counts by window, sessions of life signs, first-seen rows, idempotent sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.query import StreamingQuery

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, schema: str = EVENTS, files_per_trigger: int | None = None, pattern: str | None = None) -> DataFrame:
    """Parquet files of ``folder`` as they appear, or those whose names meet ``pattern``; ``files_per_trigger`` limits the rate."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """``(start, event_type, n)`` by tumbling window; rows later than the watermark are left out."""
    w = F.window("ts", window)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def heartbeat_sessions(events: DataFrame, gap: str = "90 seconds", late: str = "1 hour") -> DataFrame:
    """``(run, start, last_beat, beats)``: a run's life signs without a gap; the last session tells whether it lives."""
    s = F.session_window("ts", gap)
    out = events.withWatermark("ts", late).groupBy(s.alias("s"), F.col("user_id").alias("run")).agg(F.count("*").alias("beats"), F.max("ts").alias("last_beat"))
    return out.select("run", F.col("s.start").alias("start"), "last_beat", "beats")


def first_seen(events: DataFrame, key: list[str], late: str = "1 hour") -> DataFrame:
    """Each key once within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(key)


def run_once(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """All that is there now into a table in memory; for tests and small reports."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def keyed_sink(path: str, key: list[str]):
    """A foreachBatch function: each batch goes to a folder of its own number, without keys that are there already.

    A repeated batch overwrites its own folder, so work done twice counts once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates(key)
        jvm = spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(path)
        fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(root):
            done = spark.read.option("basePath", path).parquet(path).filter(F.col("batch") != batch_id)
            new = new.join(done.select(*key), key, "left_anti")
        new.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write
