"""Operators 4, 5 and 6 against brute force, with edge cases."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from corpuslens.llm import quality, queries, simhash, tokens

from . import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], SCHEMA)


def test_fingerprints_and_components(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    texts = [r.text for r in rows] + brute.EDGE_TEXTS + [rows[0].text, rows[0].text + " more", None]
    got = {r.doc_id: r for r in simhash.simhash_report(frame(spark, texts)).collect()}
    prints = [brute.fingerprint(t) for t in texts]
    assert len(got) == len(texts)
    assert [got[i].fingerprint for i in range(len(texts))] == [f"{p:016x}" for p in prints]
    want = brute.component_ids(list(range(len(texts))), prints)
    assert {i: r.component_id for i, r in got.items()} == want


@pytest.mark.parametrize("radius", [1, 2, 3, 4])
def test_masks_cover_every_pair(radius):
    masks = simhash.covering_masks(radius)
    assert len(masks) == 2 ** (radius + 1) - 1
    rng = random.Random(radius)
    for _ in range(2000):
        differ = sum(1 << p for p in rng.sample(range(64), radius))
        assert any(m & differ == 0 for m in masks)


def test_large_buckets_lose_no_link(spark):
    rng = random.Random(7)
    base = [rng.getrandbits(64) for _ in range(6)]
    prints = set(base)
    for b in base:
        for _ in range(60):
            prints.add(b ^ sum(1 << p for p in rng.sample(range(16), rng.randint(1, 3))))
    ids = sorted(simhash._signed(p) for p in prints)
    fps = spark.createDataFrame([(0, p, p) for p in ids], "which int, fp long, node long")
    from corpuslens.operators.graph import components

    got = {r.node: r.root for r in components(simhash.links(fps, 3, bucket=8)).collect()}
    want = brute.component_ids(ids, [p & (2**64 - 1) for p in ids])
    assert {i: got.get(i, i) for i in ids} == want


def test_near_copies_are_found(spark):
    """Pairs of similarity 0.8 or more on five-word shingles, as few edits make them, and no others."""
    rng = random.Random(11)
    fresh = lambda n: [rng.choice(["the", "of", "and", "a"]) if rng.random() < 0.3 else f"w{rng.randint(0, 5000)}" for _ in range(n)]
    texts, copies = [], []
    for _ in range(60):
        w = fresh(rng.randint(120, 600))
        texts.append(" ".join(w))
        for _ in range(max(1, len(w) // 50)):
            w[rng.randrange(len(w))] = f"edit{rng.randint(0, 10**6)}"
        copies.append(" ".join(w))
    docs = frame(spark, texts + copies)
    kept = {r.doc_id for r in simhash.keep_first_copies(docs).collect()}
    assert kept >= set(range(60))
    assert len(kept) <= 60 + 4


def test_empty_and_clashing_columns(spark):
    empty = frame(spark, [])
    assert simhash.simhash_report(empty).count() == 0
    assert tokens.token_report(empty, public_tokenizers.path("byte_bpe_50k.json")).count() == 0
    more = frame(spark, ["same text here", "same text here", None]).selectExpr("*", "1 as fps", "2 as component_id", "3 as node")
    kept = simhash.keep_first_copies(more)
    assert kept.columns == more.columns and sorted(r.doc_id for r in kept.collect()) == [0, 2]


def test_token_counts_match_library(spark, sf):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(120).collect()] + brute.EDGE_TEXTS + [" lead nbsp", "end  ", "a  b", "a  b", "\n\n x", "x \n", "'s 't ' s"]
    got = {r.doc_id: r for r in tokens.token_report(frame(spark, texts), path).collect()}
    for i, t in enumerate(texts):
        assert got[i].n_bytes == len((t or "").encode())
        assert got[i].n_tokens == len(library.encode(t or "", add_special_tokens=False).ids), repr(t)[:60]
        assert got[i].over_limit == (got[i].n_tokens > 512)


def test_quality_statistics(spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + brute.EDGE_TEXTS
    got = {r.doc_id: r for r in quality.quality_stats(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert tuple(got[i]["__stat_" + s] for s in quality.STATS) == brute.stats(t), repr(t)[:60]


def test_rules_separate_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    train, test = labels.filter("doc_id % 2 = 0"), labels.filter("doc_id % 2 = 1")
    rules = quality.fit_rules(docs, train)
    assert rules and all(r.precision >= 0.9 for r in rules)
    rows = quality.quality_stats(docs.join(test, "doc_id")).select("quality", (~quality.base_failed() & (quality.verdict(rules) == 0)).alias("kept")).collect()
    good = [r.kept for r in rows if r.quality == 1]
    bad = [r.kept for r in rows if r.quality == 0]
    assert np.mean(good) >= 0.98
    assert np.mean(bad) <= 0.2


def test_rules_without_labels(spark):
    docs = frame(spark, ["some words " * 20, None, ""])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.fit_rules(docs, none) == []
    got = {r.doc_id: r for r in quality.quality_report(docs, none).collect()}
    assert got[1].base_failed and not got[1].kept and got[1].n_words == 0
    assert quality.keep_good(docs, none).columns == docs.columns


def test_queries_are_registered():
    assert {"op4_simhash_near_dedup", "op5_token_counts", "op6_quality_rules"} <= set(queries.QUERIES)
