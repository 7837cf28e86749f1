"""Operator 8: lossless round trip, exact sampling shares, reproducibility."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from corpuslens.llm import lattice as L

from . import brute
from .test_documents import frame

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [*[t or "" for t in brute.EDGE_TEXTS], "a▁b ▁▁ c", "▁", "    many     spaces   ", "中文字符没有空格" * 50, "\x00\x01\U0010ffff", "tab\tand\nnewline\r\n"]


@pytest.fixture(scope="module")
def model():
    return L.Lattice(PATH)


def paths(model, unit):
    """All segmentations of one unit with their weights."""
    if not unit:
        return {(): 0.0}
    out = {}
    for k in range(1, min(len(unit), model.longest) + 1):
        piece = unit[-k:]
        w = model.weights.get(piece)
        if w is None and k == 1:
            w = model.byte_weight * len(piece.encode())
        if w is not None:
            for head, v in paths(model, unit[:-k]).items():
                out[(*head, piece)] = v + w
    return out


def test_forward_sums_match_enumeration(model):
    for unit in ["▁the", "▁▁▁ab", "▁naïve", "x", "▁\U0001f600a"]:
        codes = np.array([ord(c) for c in unit])
        total = model.filter(codes, np.array([len(unit)]))[1]
        all_ = paths(model, unit)
        assert total[-1] == pytest.approx(math.log(sum(map(math.exp, all_.values()))), abs=1e-5)


def test_samples_come_up_by_their_share(model):
    n = 20000
    ids, firsts = model.encode(["that one"] * n, np.arange(n, dtype=np.uint64))
    first = Counter(tuple(ids[a:b]) for a, b in zip(firsts, firsts[1:]))
    one, two = (paths(model, u) for u in ("▁that", "▁one"))
    pieces = {i: model.bytes_of[i].decode().replace(" ", "▁") for s in first for i in s}
    z = sum(map(math.exp, one.values())) * sum(map(math.exp, two.values()))
    share = {(*a, *b): math.exp(v + w) / z for a, v in one.items() for b, w in two.items()}
    got = Counter()
    for s, c in first.items():
        got[tuple(pieces[i] for i in s)] += c
    assert set(got) <= set(share)
    for s, p in share.items():
        assert abs(got[s] - n * p) <= 5 * math.sqrt(n * p * (1 - p)) + 1


def test_round_trip(model):
    keys = np.arange(len(TEXTS), dtype=np.uint64)
    ids, firsts = model.encode(TEXTS, keys)
    for i, t in enumerate(TEXTS):
        own = ids[firsts[i] : firsts[i + 1]].tolist()
        assert model.decode(own) == t
        assert bool(own) == bool(t)


def test_table_and_reproducibility(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + [(10**6 + i, t) for i, t in enumerate(brute.EDGE_TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    a = {r.doc_id: r for r in L.lattice_report(docs.repartition(7), PATH).collect()}
    b = {r.doc_id: r for r in L.lattice_report(docs.coalesce(1), PATH).collect()}
    assert a == b
    for i, t in rows:
        assert a[i].lossless and a[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    ids = {r.doc_id: r.ids for r in L.sampled(docs, PATH).collect()}
    assert all(len(ids[i]) == a[i].n_pieces and zlib.crc32(np.array(ids[i], "<u4").tobytes()) == a[i].ids_crc32 for i, _ in rows)
    back = {r.doc_id: r.text for r in L.decoded(L.sampled(docs, PATH), PATH).collect()}
    assert all(back[i] == (t or "") for i, t in rows)
    other = {r.doc_id: r.ids for r in L.sampled(docs, PATH, seed=7).collect()}
    assert sum(other[i] != ids[i] for i, t in rows if t and len(t) > 200) > 100


def test_empty_null_key_and_clashing_columns(spark):
    df = frame(spark, ["a b", None]).selectExpr("*", "1 as key", "2 as ids").unionAll(spark.createDataFrame([(None, "a b", "en", "s", 3, 1, 2)], "doc_id long, text string, lang string, source string, n_chars long, key int, ids int"))
    assert sorted((r.doc_id is None, r.lossless) for r in L.lattice_report(df, PATH).collect()) == [(False, True), (False, True), (True, True)]
    assert L.lattice_report(df.limit(0), PATH).count() == 0


def test_all_texts_are_decoded_at_once(model):
    keys = np.arange(len(TEXTS), dtype=np.uint64)
    ids, firsts = model.encode(TEXTS, keys)
    assert model.decode_all(ids, firsts) == [t.encode() for t in TEXTS] == [model.decode(ids[a:b]).encode() for a, b in zip(firsts, firsts[1:])]
    assert model.decode_all(ids[:0], np.zeros(3, np.int64)) == [b"", b""]
