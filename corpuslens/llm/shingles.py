"""Near copies by their five-word shingles: candidates by min-hash bands, verified, one kept of each group.

A text is the set of its shingles of ``WIDTH`` words (a shorter one is one
shingle, one without words the empty set), ASCII case ignored.  Two texts are
near copies if their sets have a Jaccard similarity of ``LEAST`` or more.

Candidates are the groups that the caller knows (``simhash`` gives its
components, all links within three bits), and those that share a band:
``ROWS`` min-hashes of the set, of which there are ``BANDS``.  A pair of
similarity s shares one with 1 - (1 - s^5)^24, at 0.8 that is 0.9999, whatever
the kind of edit.  Fingerprints within three bits do not reach that far: such
pairs differ by ten bits of 64, so bands go on from there.

Each candidate is then decided by the sets themselves.  In the order of ids, a
text goes if it is a near copy of a smaller id that is kept; so a text that
goes is a near copy of one that stays, and no two that stay are.  Whoever is
smallest in all its buckets is kept for certain and meets its buckets' others
(a group of copies costs one comparison each).  After ``STARS`` such rounds the
rest meet pair by pair: their min-hashes leave out pairs that look like less
than ``LOOKS`` (4 deviations below 0.8), and the order is settled on the pairs
whose sets agree.

Defined results: null and empty texts, and those without words, are copies of
one another; rows that repeat a doc_id are one document and stay or go
together; rows of a null doc_id stay; a very long text is compared whole;
other columns pass untouched; an empty table gives no rows.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import bounded, chunks, inside, materialize, mix64, scratch_scope, split_words, window_hashes, word_hashes

WIDTH = 5
LEAST = 0.8
BANDS = 24
ROWS = 5
STARS = 2
LOOKS = 0.65
_MULTIPLIERS = mix64(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_WORD_SEED, _FOLD = 17, 0x9FB21C651E98DF25


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, ascending within each, and each text's first index (n + 1 values)."""
    words, firsts = split_words(pc.ascii_lower(pc.fill_null(texts, "")))
    h, lengths = word_hashes(words, _WORD_SEED), np.diff(firsts)
    windows = window_hashes(h, WIDTH, _FOLD)
    own = inside(firsts, WIDTH, len(windows))
    found = [windows[own]]
    owner = [np.repeat(np.arange(len(lengths)), np.maximum(lengths - WIDTH + 1, 0))]
    for n in range(1, WIDTH):
        at = np.flatnonzero(lengths == n)
        if len(at):
            found.append(window_hashes(h, n, _FOLD)[firsts[at]])
            owner.append(at)
    found, owner = np.concatenate(found), np.concatenate(owner)
    order = np.lexsort((found, owner))
    found, owner = found[order], owner[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    starts = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(np.bincount(owner[new], minlength=len(lengths)), out=starts[1:])
    return found[new], starts


def min_hashes(sets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """``(BANDS * ROWS, texts)``; zeros where the set is empty."""
    some = np.diff(starts) > 0
    out = np.zeros((BANDS * ROWS, len(some)), np.uint64)
    if len(sets):
        at = starts[:-1][some]
        for i, m in enumerate(_MULTIPLIERS):
            out[i, some] = np.minimum.reduceat(sets * m, at)
    return out


def band_keys(sets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """``(texts, BANDS)``: each band's hash, its number mixed in."""
    mins = min_hashes(sets, starts).reshape(BANDS, ROWS, -1)
    keys = np.repeat(mix64(np.arange(1, BANDS + 1, dtype=np.uint64))[:, None], mins.shape[2], 1)
    for i in range(ROWS):
        keys = mix64(keys * np.uint64(_FOLD) + mins[:, i])
    return np.ascontiguousarray(keys.T)


def _digests(sets: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """Two independent 64-bit hashes of each set."""
    n = np.diff(starts)
    out = []
    for salt in mix64(np.array([1, 2], np.uint64)):
        total = np.zeros(len(n), np.uint64)
        if len(sets):
            total[n > 0] = np.add.reduceat(mix64(sets ^ salt), starts[:-1][n > 0])
        out.append(mix64(total + n.astype(np.uint64)).view(np.int64))
    return out


def _lists(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(values.view(np.int64)))


def sketched(docs: DataFrame) -> DataFrame:
    """``(doc_id, d1, d2, keys)``: the digest of each text's set, and its bands."""

    def run(batches):
        for batch in batches:
            for part in chunks(batch, 1):
                sets, starts = shingle_sets(part.column(1))
                keys = band_keys(sets, starts)
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, _digests(sets, starts)), _lists(keys.ravel(), np.arange(len(keys) + 1) * BANDS)], ["doc_id", "d1", "d2", "keys"])

    return bounded(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, d1 long, d2 long, keys array<long>")


def _sets(docs: DataFrame) -> DataFrame:
    """``(node, shingles, sketch)``: the set itself, and 16 bits of each min-hash."""

    def run(batches):
        for batch in batches:
            for part in chunks(batch, 1):
                sets, starts = shingle_sets(part.column(1))
                sketch = (mix64(min_hashes(sets, starts)) >> np.uint64(48)).astype(np.uint16).T
                yield pa.RecordBatch.from_arrays([part.column(0), _lists(sets, starts), pa.array([x.tobytes() for x in sketch], pa.binary())], ["node", "shingles", "sketch"])

    return bounded(docs).mapInArrow(run, "node long, shingles array<long>, sketch binary")


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs(a, b)`` whose sets have a similarity of ``LEAST`` or more."""

    def run(batches):
        for batch in batches:
            hit = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                # The smaller set bounds the similarity.
                both = len(np.intersect1d(x, y, assume_unique=True)) if min(len(x), len(y)) >= LEAST * max(len(x), len(y)) - 1e-9 else 0
                hit.append(both > 0 and both >= LEAST * (len(x) + len(y) - both) - 1e-9)
            yield batch.select([0, 1]).filter(pa.array(hit, pa.bool_()))

    of = lambda end, name: sets.select(F.col("node").alias(end), F.col("shingles").alias(name))
    return bounded(pairs).join(of("a", "x"), "a").join(of("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long").distinct()


def _alike(buckets: DataFrame) -> DataFrame:
    """``(a, b)``, a < b: pairs within ``buckets(x)``, lists of (node, sketch), whose sketches look alike."""

    def run(batches):
        for batch in batches:
            for bucket in batch.column(0):
                nodes = bucket.values.field("node").to_numpy()
                order = np.argsort(nodes, kind="stable")
                nodes = nodes[order]
                sketch = np.frombuffer(b"".join(bucket.values.field("sketch").to_pylist()), np.uint16).reshape(len(nodes), -1)[order]
                for i in range(len(nodes) - 1):
                    alike = (sketch[i + 1 :] == sketch[i]).sum(1) >= LOOKS * BANDS * ROWS
                    b = nodes[i + 1 :][alike & (nodes[i + 1 :] != nodes[i])]
                    if len(b):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), nodes[i])), pa.array(b)], ["a", "b"])

    return buckets.select("x").mapInArrow(run, "a long, b long")


def _crowded(rows: DataFrame) -> DataFrame:
    """``(key, node, head)``: buckets of two nodes or more, with the smallest."""
    heads = rows.groupBy("key").agg(F.min("node").alias("head"), F.count("*").alias("n")).filter("n > 1").select("key", "head")
    return materialize(rows.select("key", "node").join(heads, "key"), "buckets")


def _without(df: DataFrame, nodes: DataFrame, *ends: str) -> DataFrame:
    for end in ends:
        df = df.join(nodes.select(F.col("node").alias(end)), end, "left_anti")
    return df


def copies(docs: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """``(doc_id)``: documents that are near copies of one of smaller id that is none itself; ``groups(doc_id, component_id)``
    are candidates besides those that share a band."""
    texts = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long"), "text")
    prints = materialize(sketched(texts), "sketches")
    # Equal sets are one node.
    nodes = materialize(prints.groupBy("d1", "d2", "keys").agg(F.min("doc_id").alias("node")), "nodes")
    own = prints.join(nodes.select("d1", "d2", "node"), ["d1", "d2"]).select("doc_id", "node")
    shared = nodes.select("node", F.explode("keys").alias("key"))
    if groups is not None:
        own = materialize(own, "own")
        shared = shared.unionAll(own.join(groups, "doc_id").select("node", F.xxhash64(F.lit("component"), "component_id").alias("key")))
    buckets = _crowded(shared.distinct())
    live = buckets.select("node").distinct()
    sets = materialize(_sets(texts.withColumnRenamed("doc_id", "node").join(live, "node", "left_semi").select("node", "text")), "sets")
    out: list[DataFrame] = []
    for _ in range(STARS):
        if buckets.isEmpty():
            break
        later = materialize(buckets.filter("node <> head").select("node").distinct(), "later")
        stars = _without(buckets.filter("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct(), later, "a")
        out.append(materialize(similar(stars, sets).select(F.col("b").alias("node")).distinct(), "gone"))
        # Those that are kept for certain leave as well: all their pairs are settled.
        rest = buckets.select("key", "node").join(later, "node", "left_semi")
        buckets = _crowded(_without(rest, out[-1], "node"))
    if not buckets.isEmpty():
        lists = buckets.select("key", "node").join(sets.select("node", "sketch"), "node").groupBy("key").agg(F.collect_list(F.struct("node", "sketch")).alias("x"))
        edges = materialize(similar(materialize(_alike(lists).distinct(), "alike"), sets), "edges")
        while not edges.isEmpty():
            later = edges.select(F.col("b").alias("node")).distinct()
            out.append(materialize(_without(edges, later, "a").select(F.col("b").alias("node")).distinct(), "gone"))
            # A first end that is kept for certain has lost all its edges by now: their other ends are gone.
            edges = materialize(_without(edges, out[-1], "a", "b"), "edges")
    gone = own.filter("doc_id <> node").select("doc_id")
    if out:
        near = functools.reduce(DataFrame.unionAll, out)
        gone = gone.unionAll(own.join(near, "node", "left_semi").select("doc_id"))
    return gone.distinct()


def keep_first_copies(docs: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Rows of ``docs`` without those that are near copies of a kept one of smaller id; rows of null id stay.

    Rows that repeat one doc_id are one document; all of them stay or go.
    """
    kept: list[DataFrame] = []
    with scratch_scope(kept):
        kept.append(materialize(copies(docs, groups), "gone"))
    gone = kept[0]
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
