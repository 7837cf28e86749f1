"""The filters' audit: by brute force over documents and orders, edge cases, folding and chains."""

import re
from collections import Counter
from itertools import permutations

import pytest

from corpuslens.llm import interaction as N

from . import brute


def by_hand(docs, labels):
    """docs: (doc_id, text, lang); labels: (doc_id, quality, toxic)."""
    texts = {}
    for i, t, _ in docs:
        if i is not None:
            texts[t or ""] = min(i, texts.get(t or "", i))
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, x in labels if x == 1 and i is not None}
    rows = []
    for i, t, lang in docs:
        t = t or ""
        w = brute.words(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and texts[t] < i}
        rows.append((lang or "", {k for k, v in fails.items() if v}, i in good, i in toxic))
    out = []
    for part in {r[0] for r in rows}:
        own, shapley, some = [r for r in rows if r[0] == part], Counter(), []
        for order in permutations("ABCDE"):
            for step, x in enumerate(order, 1):
                before = set(order[: step - 1])
                here = [r for r in own if x in r[1] and not r[1] & before]
                shapley[x] += len(here)
                some.append((x, "".join(order), step, sum(not r[1] & (before | {x}) for r in own), len(here), sum(x in r[1] and bool(r[1] & before) for r in own), sum(r[1] == {x} for r in own), sum(r[2] for r in here), sum(r[3] for r in here)))
        out += [(part, *r[1:], shapley[r[0]]) for r in some]
    return sorted(out)


def frames(spark, docs, labels):
    return spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_by_brute_force(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    got = sorted(map(tuple, N.interaction_report(docs, labels).collect()))
    want = by_hand([(r.doc_id, r.text, r.lang) for r in docs.collect()], [(r.doc_id, r.quality, r.toxic) for r in labels.collect()])
    assert got == want and len(got) == 600 * 4


def test_edge_rows(spark):
    many = "Same text of many rows. " * 12
    docs = [(i, t, "en") for i, t in enumerate(brute.EDGE_TEXTS)] + [(100 + i, many, "en" if i % 3 else None) for i in range(90)]
    docs += [(100, many, "de"), (100, many, "de"), (7, many, "fr"), (None, many, "fr"), (None, None, None), (500, None, ""), (501, "long words " * 300_000, "en")]
    labels = [(7, 1, 0), (7, 0, 1), (120, 1, 1), (120, 1, 1), (130, None, None), (None, 1, 1), (999, 1, 1)]
    a, b = frames(spark, docs, labels)
    got = sorted(map(tuple, N.interaction_report(a.repartition(7).selectExpr("*", "1 as part", "2 as mask", "3 as n"), b.selectExpr("*", "4 as kind")).collect()))
    assert got == by_hand(docs, labels)
    assert N.interaction_report(*(x.limit(0) for x in (a, b))).count() == 0


@pytest.mark.parametrize("fold_bytes", [0, 40, 1 << 20])
def test_folding_settles_the_same_rows(fold_bytes):
    rows = [(i % 17, f"text {i % 5}", "ab"[i % 2]) for i in range(100, 0, -1)]
    got = Counter()
    for doc_id, part, mask, n in N.chained(N.routed(rows, fold_bytes)):
        got[doc_id, part, bool(mask & N.COPY)] += n
    least = {t: min(i for i, u, _ in rows if u == t) for _, t, _ in rows}
    assert got == Counter((i, p, i > least[t]) for i, t, p in rows)


def test_texts_of_one_fingerprint_are_told_apart():
    records = [(1, (b"a", 5, 0, Counter(x=1))), (1, (b"b", 3, 0, Counter(x=1))), (1, (b"a", 4, 0, Counter(x=2))), (1, (b"b", 9, 0, Counter(x=1)))]
    assert sorted(N.chained(records)) == [(3, "x", 0, 1), (4, "x", 0, 2), (5, "x", N.COPY, 1), (9, "x", N.COPY, 1)]
