"""Leases as a stream: the state machine, batches of any cut, arrival out of order, kill and restart from the checkpoint."""

import datetime as dt
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from corpuslens.session import settings
from corpuslens.streaming import events as E, leases as L

EPOCH = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
SECONDS = lambda s: EPOCH + dt.timedelta(seconds=s)


def by_hand(signs, ttl, retry, end):
    """signs: (key, id, second, kind, worker) up to ``end``; follows one key after another."""
    out = []
    for key in sorted({s[0] for s in signs}):
        status, worker, until, n = None, None, 0, 0
        for _, _, at, kind, w in sorted((s for s in signs if s[0] == key and s[2] <= end), key=lambda s: (s[2], s[1])):
            if status == "claimed" and until <= at:
                out.append((key, "expired", until, worker, n))
                status = "discovered"
            mine = status == "claimed" and worker == w
            if kind == "discover" and status is None:
                status = "discovered"
                out.append((key, status, at, None, 0))
            elif kind == "claim" and (status == "discovered" or status == "failed" and until <= at):
                status, worker, until, n = "claimed", w, at + ttl, n + 1
                out.append((key, status, at, w, n))
            elif kind == "beat" and mine:
                until = max(until, at + ttl)
            elif kind in ("done", "fail") and mine:
                status, until = {"done": "fetched", "fail": "failed"}[kind], at + retry
                out.append((key, status, at, w, n))
        if status == "claimed" and until <= end:
            out.append((key, "expired", until, worker, n))
    return sorted(out, key=str)


def some_signs(seed, n=400, keys=6, span=3000):
    rng = random.Random(seed)
    kinds = ["discover", "claim", "claim", "beat", "beat", "done", "fail"]
    rows = [(f"k{k}", k, 0, "discover", None) for k in range(keys)]
    return rows + [(f"k{0 if rng.random() < 0.4 else rng.randrange(keys)}", 100 + i, rng.randrange(span), rng.choice(kinds[:6] if rng.random() < 0.8 else kinds), rng.choice("ab")) for i in range(n)]


def write(spark, folder, name, signs):
    rows = [(k, i, SECONDS(t), kind, w) for k, i, t, kind, w in signs]
    spark.createDataFrame(rows, L.SIGNS).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def drain(spark, folder, out, checkpoint, late, ttl=100, retry=30, stop_after=None):
    with settings(spark, **L.PROVIDER):
        signs = spark.readStream.schema(L.SIGNS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder)
        w = L.lease_changes(signs, ttl, retry, late).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        if stop_after is None:
            w.trigger(availableNow=True).start().awaitTermination()
        else:
            q = w.trigger(processingTime="0 seconds").start()
            while q.lastProgress is None or q.lastProgress["batchId"] < stop_after:
                q.awaitTermination(0.2)
            q.stop()
    got = spark.read.schema(L.CHANGES).parquet(out)
    return sorted(((r.key, r.what, round((r.at - dt.datetime(2024, 1, 1)).total_seconds()) if r.at.tzinfo is None else round((r.at - EPOCH).total_seconds()), r.worker, r.attempts) for r in got.collect()), key=str)


def test_one_batch(spark):
    folder = tempfile.mkdtemp()
    signs = some_signs(1)
    write(spark, folder, "all", signs)
    end = max(s[2] for s in signs)
    assert drain(spark, folder, f"{folder}-out", f"{folder}-at", "0 seconds") == by_hand(signs, 100, 30, end)


@pytest.mark.parametrize("stop_after", [None, 1])
def test_batches_out_of_order_and_a_restart(spark, stop_after):
    """Signs come up to 500 seconds late, one file a batch; the stream is stopped in between and goes on from its checkpoint."""
    folder = tempfile.mkdtemp()
    signs, rng = some_signs(2, n=300), random.Random(5)
    arrival = sorted(signs, key=lambda s: s[2] + rng.randrange(400))
    parts = [arrival[a : a + 77] for a in range(0, len(arrival), 77)]
    for i, part in enumerate(parts):
        write(spark, folder, f"part{i}", part)
        if stop_after is not None and i == 1:
            drain(spark, folder, f"{folder}-out", f"{folder}-at", "500 seconds", stop_after=stop_after)
    write(spark, folder, "last", [("end", 1, 9999, "discover", None)])
    got = drain(spark, folder, f"{folder}-out", f"{folder}-at", "500 seconds")
    assert got == by_hand(signs, 100, 30, 9999 - 500)
    assert len(got) == len(set(got))
    # What comes next finds the state where it was, and nothing twice.
    write(spark, folder, "more", [("k1", 5000, 10_000, "claim", "c"), ("end", 2, 10_700, "beat", "c")])
    again = drain(spark, folder, f"{folder}-out", f"{folder}-at", "500 seconds")
    want = by_hand([*signs, ("end", 1, 9999, "discover", None), ("k1", 5000, 10_000, "claim", "c")], 100, 30, 10_200)
    assert again == want


def test_a_claim_ends_at_the_very_moment(spark):
    folder = tempfile.mkdtemp()
    signs = [("a", 1, 0, "discover", None), ("a", 2, 5, "claim", "x"), ("a", 3, 105, "claim", "y"), ("a", 4, 105, "beat", "x"), ("a", 5, 205, "done", "y"), ("b", 6, 1, "claim", "x"), ("c", 7, 2, "discover", None), (None, 8, 3, "discover", None), ("c", 9, 210, None, None)]
    write(spark, folder, "one", signs)
    got = drain(spark, folder, f"{folder}-out", f"{folder}-at", "0 seconds")
    assert got == sorted([("a", "discovered", 0, None, 0), ("a", "claimed", 5, "x", 1), ("a", "expired", 105, "x", 1), ("a", "claimed", 105, "y", 2), ("a", "expired", 205, "y", 2), ("c", "discovered", 2, None, 0)], key=str)


def test_states(spark):
    rows = [("a", "discovered", 0, None, 0), ("a", "claimed", 5, "x", 1), ("a", "expired", 9, "x", 1), ("a", "claimed", 9, "y", 2), ("b", "discovered", 1, None, 0), ("c", "claimed", 4, "x", 1), ("c", "fetched", 4, "x", 1), ("d", "failed", 2, "x", 3)]
    changes = spark.createDataFrame([(k, w, SECONDS(t), x, n) for k, w, t, x, n in rows], L.CHANGES)
    got = {r.key: (r.status, r.worker, r.attempts) for r in L.lease_states(changes).collect()}
    assert got == {"a": ("claimed", "y", 2), "b": ("discovered", None, 0), "c": ("fetched", None, 1), "d": ("failed", None, 3)}
    assert L.lease_states(changes.limit(0)).count() == 0
    assert changes.select(F.count("*")).first()[0] == len(rows) and E.EVENTS
