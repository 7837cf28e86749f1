"""Operator 3 against brute force, in several batches, with compaction."""

import random

import pytest

from corpuslens.llm import substrings as S

from . import brute
from .test_documents import frame


def invented(seed, n=120):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(12)] + ["a", "the", "x"]
    words = lambda k: [rng.choice(vocabulary) + (str(rng.randint(0, 400)) if rng.random() < 0.5 else "") for _ in range(k)]
    passages = [words(rng.randint(18, 70)) for _ in range(8)]
    out = []
    for _ in range(n):
        w = words(rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, 5)
            w[len(w) // 2 : len(w) // 2] = p[a : len(p) - rng.randint(0, 5)]
        if rng.random() < 0.15:
            w = ["a", "b"] * rng.randint(5, 40) + w
        if rng.random() < 0.1:
            w = ["same"] * rng.randint(15, 60)
        sep = rng.choice([" ", "\n", "  "])
        out.append(sep.join(w))
    for _ in range(n // 4):
        w = out[rng.randrange(len(out))].split()
        if w and rng.random() < 0.7:
            w[rng.randrange(len(w))] = "edited"
        out.append(" ".join(w))
    return out


def check(spark, rows, batches):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    docs = df.select("doc_id", "text")
    got = S.without(docs, S.repeated_windows(docs, batches))
    from pyspark.sql import functions as F

    got = got.select("doc_id", "__words", "__removed", F.sha2("__kept", 256)).collect()
    assert sorted(tuple(r) for r in got) == brute.substring_dedup(rows)


@pytest.mark.parametrize("seed, batches, chunk", [(1, 1, 4 << 20), (2, 2, 4 << 20), (3, 3, 2000), (4, 7, 500)])
def test_invented_texts(spark, monkeypatch, seed, batches, chunk):
    if chunk < 1 << 20:
        # Forked workers see the parent's default, so the function's own default is what has to change.
        monkeypatch.setattr(S, "chunks", lambda b, c, n=chunk: _small_chunks(b, c, n))
    texts = invented(seed)
    random.Random(seed).shuffle(texts)
    check(spark, [(i * 3 + 1, t) for i, t in enumerate(texts + brute.EDGE_TEXTS)], batches)


def _small_chunks(batch, column, limit):
    from corpuslens.llm.common import chunks

    return chunks(batch, column, limit)


def test_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert sorted(tuple(r) for r in S.substring_report(docs).collect()) == brute.substring_dedup(rows)


def test_repeated_rows_null_ids_and_empty(spark):
    long = " ".join(f"t{i}" for i in range(40))
    df = spark.createDataFrame([(1, long), (1, long), (2, long), (None, long), (3, None)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_words, r.n_removed) for r in S.substring_report(df).collect())
    assert got == [(-1, 40, 0), (1, 40, 0), (1, 40, 0), (2, 40, 40), (3, 0, 0)]
    assert S.substring_report(df.limit(0)).count() == 0


def test_dropping_keeps_columns_and_untouched_texts(spark):
    long = " ".join(f"t{i}" for i in range(30))
    docs = frame(spark, ["two  spaces\nkept", long, "head words " + long + " tail", long, None]).selectExpr("*", "1 as n", "2 as pos", "'k' as anchor")
    out = S.drop_repeats(docs)
    assert out.columns == docs.columns
    assert {r.doc_id: r.text for r in out.collect()} == {0: "two  spaces\nkept", 1: long, 2: "head words tail", 4: None}


def test_old_runs_are_merge_joined_as_they_lie(spark):
    docs = frame(spark, invented(9))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
    try:
        index = S.FingerprintIndex(spark, buckets=3)
        for a, b in ((0, 40), (41, 80)):
            index.add(docs.filter(f"doc_id between {a} and {b}"))
        for df in (index._merged_entries(S._batch_rows(docs)), index._merged_windows(index._run(S._windows(index.texts[0], index.entries[0]).repartition(3, "h1", "h2"), "x", "h1", "h2").filter("not again"))):
            lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
            count = lambda what, lines=lines: sum(what in x for x in lines)
            # The batch alone is shuffled and sorted.
            assert (count("SortMergeJoin"), count("Sort [")) == (2, 1) and count("Exchange") <= 1 and count("Bucketed: true") >= 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.unset("spark.sql.legacy.bucketedTableScan.outputOrdering")


def test_query_compacts(spark, monkeypatch):
    seen = []
    compact = S.FingerprintIndex.compact
    monkeypatch.setattr(S.FingerprintIndex, "compact", lambda self: (seen.append(len(self.entries)), compact(self)))
    texts = invented(11)
    docs = frame(spark, texts)
    got = sorted(tuple(r) for r in S.substring_report(docs).collect())
    assert got == brute.substring_dedup(list(enumerate(texts))) and seen == [2]


def test_one_very_long_text(spark):
    rng = random.Random(4)
    long = " ".join(f"w{rng.randint(0, 5000)}" for _ in range(400_000))
    rows = [(1, long), (2, "head " + long[50_000:60_000] + " tail")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in S.substring_report(docs).collect()) == brute.substring_dedup(rows)
