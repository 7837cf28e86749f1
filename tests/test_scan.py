"""Prefix scans against loops: places, rate limits, running averages; hot groups, ties, nulls, empty tables."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from corpuslens.operators import scan as N
from corpuslens.operators.retry import TokenBucket

EPOCH = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def test_places(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.7 else rng.choice("abc"), rng.randrange(50), i) for i in range(4000)] + [(None, 3, -1), (None, None, -2)]
    got = {r.i: r.place for r in N.with_place(spark.createDataFrame(rows, "k string, x int, i int"), "k", ["x", "i"]).collect()}
    want = {}
    for k in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        want |= {r[2]: n for n, r in enumerate(own)}
    assert got == want
    assert N.with_place(spark.createDataFrame([], "k string, x int"), "k", ["x"]).count() == 0


@pytest.mark.parametrize("rate", [0.5, 3.0, 7.0, 0.0])
def test_starts_are_those_of_the_bucket(spark, rate):
    rng = random.Random(2)
    rows = []
    for i in range(3000):
        host = "hot" if rng.random() < 0.6 else rng.choice(["a", "b"])
        rows.append((host, i, EPOCH + dt.timedelta(microseconds=rng.randrange(900) * 1_000_000 + rng.choice([0, 0, 250_000, 1]))))
    rows += [(None, -1, EPOCH), ("a", -2, None)]
    df = spark.createDataFrame(rows, "host string, id int, arrival timestamp")
    got = {r.id: r.us for r in N.rate_limited(df, rate).select("id", F.unix_micros("start").alias("us")).collect()}
    micros = lambda t: (t - EPOCH) // dt.timedelta(microseconds=1) + 1_704_067_200_000_000
    want, gap = {-1: None, -2: None}, round(1e6 / rate) if rate else 0
    for host in ("hot", "a", "b"):
        free = 0
        for _, i, at in sorted((r for r in rows if r[0] == host and r[2]), key=lambda r: (r[2], r[1])):
            want[i] = max(micros(at), free)
            free = want[i] + gap
    assert got == want
    # The driver's own bucket waits as long.
    if rate == 0.5:
        clock = [0.0]
        bucket = TokenBucket(rate, clock=lambda: clock[0], sleep=lambda s: None)
        for _, i, at in sorted((r for r in rows if r[0] == "b" and r[2]), key=lambda r: (r[2], r[1])):
            clock[0] = (at - EPOCH).total_seconds()
            assert abs(bucket.wait() - (got[i] - micros(at)) / 1e6) < 1e-6


def fold(pairs):
    avg, members = 0.0, set()
    for a, b, s in sorted(pairs):
        avg = (avg * len(members) + s) / (len(members) + 1)
        members |= {a, b}
    return avg


@pytest.mark.parametrize("chunk", [2, 7, 4096])
def test_running_average_is_the_fold(spark, chunk):
    rng = random.Random(chunk)
    pairs = {f"c{k}": [(a := rng.randrange(40), a + 1 + rng.randrange(9), rng.random()) for _ in range(n)] for k, n in enumerate((1, 2, 30, 400))}
    rows = [(c, *p) for c, own in pairs.items() for p in own]
    got = {r.cluster_id: r.avg_similarity for r in N.running_average(spark.createDataFrame(rows, "cluster_id string, a int, b int, similarity double"), chunk=chunk).collect()}
    assert got.keys() == pairs.keys() and all(abs(got[c] - fold(own)) < 1e-12 for c, own in pairs.items())
    assert N.running_average(spark.createDataFrame([], "cluster_id string, a int, b int, similarity double")).count() == 0


def test_a_large_cluster_is_folded_in_chunks(spark):
    n = 200_000
    pairs = spark.range(n).select(F.lit("c").alias("cluster_id"), "id", (F.col("id") % 500).alias("a"), (F.col("id") % 500 + 1 + F.floor(F.col("id") / 500) % 300).alias("b"), (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000).alias("similarity"))
    got = N.running_average(pairs.drop("id")).first().avg_similarity
    assert abs(got - fold([(r.a, r.b, r.similarity) for r in pairs.collect()])) < 1e-9
