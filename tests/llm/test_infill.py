"""Fill-in-the-middle: by brute force, exact round trips, edge cases."""

import hashlib

import pytest
from hypothesis import given, settings, strategies as st

from corpuslens.llm import infill as I

from . import brute


def by_hand(doc_id, text):
    """The contract, letter by letter."""
    text, n = text or "", len(text or "")
    digest = hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if n == 0 or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= 90:
        form, out = "plain", text
    elif h4 % 100 < 20:
        form, out = "spm", "<S>" + text[b:] + "<P>" + text[:a] + "<M>" + text[a:b]
    else:
        form, out = "psm", "<P>" + text[:a] + "<S>" + text[b:] + "<M>" + text[a:b]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, n, form, *((None, None) if form == "plain" else (a, b - a)), sha(out), sha(text))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_by_brute_force(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    got = sorted(map(tuple, I.infill_report(docs).collect()))
    assert got == sorted(by_hand(r.doc_id, r.text) for r in docs.collect())
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_edge_texts(spark):
    texts = [*brute.EDGE_TEXTS, "a<P>b", "<S>", "x<M>", "<P", "\U0001f600" * 7, "é‍", "\x00﻿", "y" * 2_000_000 + "é"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "again"), (3, "again"), (None, "no key"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n", "'f' as form", "'o' as output", "2 as prefix_chars")
    got = sorted(map(tuple, I.infill_report(docs).collect()), key=str)
    assert got == sorted((by_hand(i, t) if i is not None else (None, *by_hand("null", t)[1:]) for i, t in rows), key=str)
    assert I.infill_report(docs.limit(0)).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(), st.integers(), st.sampled_from(I.UNITS))
def test_round_trip(text, key, unit):
    n, form, a, m, out = I.cut(text, str(key), unit=unit)
    assert I.restored(out, form) == text
    if form != "plain":
        assert 0 <= a <= a + m <= len(text)
        edges = I.boundaries(I.code_points(text), unit)
        assert a in edges and a + m in edges and len(edges) == n + 1


def test_units_are_runs_of_one_class():
    text = "one two,\n\n three§"
    edges = I.boundaries(I.code_points(text), "runs").tolist()
    assert [text[a:b] for a, b in zip(edges, edges[1:])] == ["one", " ", "two", ",", "\n\n ", "three§"]
    with pytest.raises(ValueError):
        I.infilled(None, unit="sentence")


def test_texts_come_back_with_their_columns(spark):
    docs = spark.createDataFrame([(i, f"some text of row {i}") for i in range(50)], "doc_id long, text string")
    back = I.restored_texts(I.infilled(docs, unit="runs"))
    assert {(r.doc_id, r.text) for r in back.collect()} == {(r.doc_id, r.text) for r in docs.collect()}
