"""The near-copy stage against brute force: what must go, and what must not."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from corpuslens.llm import shingles, simhash

from . import brute
from .test_documents import frame


def sets(text):
    w = brute.words((text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similarity(a, b):
    a, b = sets(a), sets(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def first_copies(texts):
    """Ids kept in order: those that are no near copy of a kept one."""
    kept = []
    for i, t in enumerate(texts):
        if not any(similarity(t, texts[k]) >= 0.8 for k in kept):
            kept.append(i)
    return set(kept)


def kept(spark, texts):
    return {r.doc_id for r in simhash.keep_first_copies(frame(spark, texts)).collect()}


def fresh(rng, n):
    return [f"w{rng.randint(0, 3000)}" for _ in range(n)]


def test_appended_and_truncated_copies_go(spark):
    rng = random.Random(5)
    texts, copies = [], []
    for k in range(80):
        w = fresh(rng, rng.randint(150, 500))
        share = rng.choice([0.05, 0.1, 0.15, 0.19])
        texts.append(" ".join(w))
        copies.append(" ".join(w + fresh(rng, int(share * len(w))) if k % 2 else w[int(share * len(w)) :] if k % 4 else w[: int((1 - share) * len(w))]))
    assert all(similarity(a, b) >= 0.8 for a, b in zip(texts, copies))
    assert kept(spark, texts + copies) == set(range(80))


def test_documents_below_the_threshold_stay(spark):
    rng = random.Random(6)
    texts = []
    for k in range(40):
        w = fresh(rng, 200)
        texts.append(" ".join(w))
        if k % 2:
            rng.shuffle(w)  # one vocabulary, another order
        else:
            for i in range(10, 200, 20):
                w[i] = f"edit{k}x{i}"  # ten words of 200: a similarity of about 0.6
        texts.append(" ".join(w))
    assert all(similarity(a, b) < 0.8 for a, b in zip(texts[::2], texts[1::2]))
    assert kept(spark, texts) == set(range(80))


def test_links_are_not_followed_beyond_the_threshold(spark):
    """Neighbours of a chain are near copies, others are not; every second one stays."""
    w = fresh(random.Random(7), 400)
    chain = [" ".join(w[25 * i : 25 * i + 250]) for i in range(7)]
    assert similarity(chain[0], chain[1]) >= 0.8 > similarity(chain[0], chain[2])
    assert kept(spark, chain) == {0, 2, 4, 6} == first_copies(chain)


def test_groups_match_brute_force(spark):
    rng = random.Random(8)
    texts = [None, "", "two words", "Two words", "a b c d e", "a b c d f"]
    base = fresh(rng, 150)
    for k in range(60):  # one large group of copies with one to six edits each, few of them alike enough
        w = list(base)
        for _ in range(rng.randint(1, 6)):
            w[rng.randrange(len(w))] = f"e{rng.randint(0, 10**6)}"
        texts.append(" ".join(w))
    rng.shuffle(texts)
    assert kept(spark, texts) == first_copies(texts)


def test_masks_find_copies_where_no_band_does(spark, monkeypatch):
    """Covering masks over fingerprints are a way of their own to candidates, and their sets decide."""
    rng = random.Random(9)
    texts = [" ".join(fresh(rng, 900)) for _ in range(30)]
    edited = [t.replace(" ", " edit ", 1) for t in texts[:20]]
    sketched = shingles.sketched
    monkeypatch.setattr(shingles, "sketched", lambda docs: sketched(docs).withColumn("keys", F.array(F.xxhash64("doc_id"))))
    prints = simhash._fingerprints(pa.array(texts + edited), 3)[0]
    near = {30 + k for k in range(20) if bin(int(prints[k]) ^ int(prints[30 + k])).count("1") <= 3}
    assert len(near) >= 5 and first_copies(texts + edited) == set(range(30))
    assert kept(spark, texts + edited) == set(range(50)) - near


def test_sets_and_bands():
    texts = ["a b c d e f", "A b c d e F", "one two", None, "x x x x x x x", "one two three four"]
    found, starts = shingles.shingle_sets(pa.array(texts))
    assert np.diff(starts).tolist() == [len(sets(t)) for t in texts]
    keys = shingles.band_keys(found, starts)
    assert (keys[0] == keys[1]).all() and (keys[0] != keys[2]).all()
