"""Operator 7: exact round trip of ids, and the curve."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from corpuslens.llm import packing, queries

from . import brute
from .test_documents import frame


@pytest.mark.parametrize("d, order", [(2, 1), (2, 3), (3, 2), (3, 3), (4, 2)])
def test_curve_visits_all_cells_by_neighbours(d, order):
    cells = np.stack(np.meshgrid(*[np.arange(1 << order)] * d, indexing="ij"), -1).reshape(-1, d)
    place = packing.hilbert_index(cells, order)
    assert sorted(place.tolist()) == list(range(len(cells)))
    path = cells[np.argsort(place)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_pieces_hold_each_id_once(spark, sf):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + brute.EDGE_TEXTS
    docs = frame(spark, texts)
    rows = packing.packing_report(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), queries.SPECIAL).collect()
    ids = [[*library.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    assert len(by_doc) == len(texts)
    for i, own in by_doc.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids[i])
            assert r.ids_crc32 == zlib.crc32(np.array(ids[i][at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids[i])
    by_seq = {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append(r)
    sizes = []
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        sizes.append(at)
    assert all(s <= 2048 and s & (s - 1) == 0 for s in sizes)
    assert sum(s == 2048 for s in sizes) > 0.5 * len(sizes)


def test_hot_place_is_split_between_ranges(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANGE_BYTES", 20_000)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    texts = ["the same words of one place " * 40] * 200 + ["very long " * 40_000]
    placed = packing.tokenized(frame(spark, texts), path, queries.SPECIAL)
    assert placed.agg({"place": "approx_count_distinct"}).first()[0] == 2
    rows = packing.pack(placed).collect()
    tasks = {}
    for r in rows:
        tasks[r.sequence_id >> 40] = tasks.get(r.sequence_id >> 40, 0) + 2 * r.length
    total = sum(tasks.values())
    assert total >= 200_000 and len(tasks) >= 0.8 * total / 20_000 and max(tasks.values()) <= 80_000
    for i, n in ((7, None), (200, None)):
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        assert [r.start for r in own] == list(np.cumsum([0, *(r.length for r in own)])[:-1]) and sum(r.length for r in own) == own[0].doc_tokens


def test_empty_and_repeated(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    assert packing.packing_report(frame(spark, []), path, queries.SPECIAL).count() == 0
    df = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, None)], "doc_id long, text string").selectExpr("*", "0 as ids", "1 as place", "2 as start", "3 as length", "4 as total")
    got = packing.packing_report(df, path, queries.SPECIAL).groupBy("doc_id").sum("length").collect()
    assert {r[0]: r[1] for r in got} == {1: 8, None: 1}


SPACES = {"space": " ", "newline": "\n", "tab": "\t", "mixed": " \n\t", "wide": "　", "letter": "x"}


@pytest.mark.parametrize("name", SPACES)
@pytest.mark.parametrize("n", [40, 20_000, 300_000])
def test_ids_of_long_runs_are_the_librarys(name, n):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    enc = packing.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), queries.SPECIAL)
    run = (SPACES[name] * n)[:n]
    for text in (run, f"a{run}", f"{run}b", f"{run} b", f"one{run}two {run}\x1cthree", f"{run}<|endoftext|>{run}c", f"é{run}'s"):
        assert packing.encode(enc, text, queries.SPECIAL, 1000) == library.encode(text, add_special_tokens=False).ids


def test_cutting_runs_of_any_length_changes_no_id():
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    enc = packing.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), queries.SPECIAL)
    rng = random.Random(3)
    for _ in range(400):
        text = "".join(rng.choice([" ", "\n", "  ", "\t", "a", "b's", "12", "..", "\xa0", "\x1f", "<|endoftext|>"]) for _ in range(30))
        assert packing.encode(enc, text, queries.SPECIAL, 2) == library.encode(text, add_special_tokens=False).ids


def test_millions_of_spaces_go_through_a_job(spark):
    texts = [" " * 1_000_000, "\n" * 10_000_000, "some words" + " " * 3_000_000 + "more words", "\t" * 1_000_000 + "x" * 1_000_000]
    rows = packing.packing_report(frame(spark, texts), public_tokenizers.path("byte_bpe_50k.tiktoken"), queries.SPECIAL).groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    assert len(rows) == 4 and all(r["sum(length)"] == r["max(doc_tokens)"] for r in rows)
    assert {r.doc_id: r["max(doc_tokens)"] for r in rows}[0] == 1_000_001


def test_texts_of_one_id_are_never_one_piece(spark):
    texts = ["alpha beta " * 600, "alpha beta " * 599 + "beta alpha "]
    df = spark.createDataFrame([(1, t) for t in texts] * 3, "doc_id long, text string")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    enc = packing.encoder(path, queries.SPECIAL)
    ids = [np.array(packing.encode(enc, t, queries.SPECIAL) + [packing.CLOSING_ID], "<u4") for t in texts]
    for r in packing.pack_documents(df, path, queries.SPECIAL).collect():
        assert any(x[r.start : r.start + r.length].tobytes() == r.ids for x in ids)
