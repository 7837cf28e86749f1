"""Operator 4: SimHash near duplicates by covering locality-sensitive hashing.

Every bit position gets a vector of ``radius + 1`` bits.  For each nonzero
vector v there is one table, keyed by the fingerprint's bits whose vectors have
an odd product with v.  Some v is orthogonal to the vectors of any ``radius``
positions, so two fingerprints that differ there agree on that table's key: no
pair within the radius is missed.

A text may get several fingerprints, by several seeds, and links to another
text where any of them is within the radius of the other's: words that few
edits leave alone then find each other with high probability, and the radius
stays small.  ``near_duplicates`` takes shingles in all their occurrences, or
(``width`` 0) each distinct word once.

Only distinct fingerprints enter the tables.  A bucket of up to ``BUCKET``
fingerprints is searched in blocks and yields a spanning set of its links, at
most one row per fingerprint; a larger one is dealt anew by masks over the
bits that its key leaves free.  Those halve each time, and eight free bits
hold 256 fingerprints, so this ends; no bucket is capped.

Defined results: a null or empty text has fingerprint zero and takes part like
any other; equal doc_ids are kept as separate rows of the same result; an
empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..operators.graph import components
from . import shingles
from .common import bounded, chunks, materialize, scratch_scope, split_words

BITS = 64
SEED = 42
#: Fingerprints that one task compares with one another at most.
BUCKET = 2048


def _majority(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each text, the bits that over half of its hashes have; zero for none."""
    out = np.zeros(len(counts), np.uint64)
    if not len(h):
        return out
    some = counts > 0
    at = (np.cumsum(counts) - counts)[some]
    for bit in range(BITS):
        ones = np.add.reduceat(((h >> np.uint64(bit)) & np.uint64(1)).astype(np.int32), at)
        out[some] |= (2 * ones > counts[some]).astype(np.uint64) << np.uint64(bit)
    return out


def _fingerprints(texts: pa.Array, width: int, seeds: tuple[int, ...] = (SEED,)) -> list[np.ndarray]:
    words, firsts = split_words(pc.ascii_lower(pc.fill_null(texts, "")))
    lengths = np.diff(firsts)
    if width == 0:
        coded = words.dictionary_encode()
        own = coded.dictionary.to_pylist()
        owner = np.repeat(np.arange(len(lengths)), lengths)
        pair = np.unique(owner * (len(own) + 1) + coded.indices.to_numpy(zero_copy_only=False))
        counts = np.bincount(pair // (len(own) + 1), minlength=len(lengths))
        code = pair % (len(own) + 1)
        return [_majority(np.fromiter((xxhash.xxh64_intdigest(w, s) for w in own), np.uint64, len(own))[code], counts) for s in seeds]
    # Words joined by one space: a shingle is then one slice of the joined bytes.
    joined = b" ".join(w.encode() for w in words.to_pylist())
    ends = np.cumsum(pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    counts = np.where(lengths == 0, 0, np.maximum(lengths - width + 1, 1))
    owner = np.repeat(np.arange(len(lengths)), counts)
    order = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    a = firsts[:-1][owner] + order
    b = a + np.minimum(width, lengths[owner]) - 1
    spans = list(zip(starts[a].tolist(), ends[b].tolist())) if len(a) else []
    digest = xxhash.xxh64_intdigest
    return [_majority(np.fromiter((digest(joined[i:j], s) for i, j in spans), np.uint64, len(spans)), counts) for s in seeds]


def fingerprints(docs: DataFrame, width: int = 3, seeds: tuple[int, ...] = (SEED,)) -> DataFrame:
    """``(doc_id, fps)``: for each seed the SimHash over XXH64 of the text's ``width``-word shingles
    (0: its distinct words), as signed longs."""

    def run(batches):
        for batch in batches:
            for part in chunks(batch, 1):
                prints = np.stack(_fingerprints(part.column(1), width, seeds), 1).view(np.int64)
                fps = pa.ListArray.from_arrays(pa.array(np.arange(len(prints) + 1, dtype=np.int32) * len(seeds)), pa.array(prints.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), fps], ["doc_id", "fps"])

    return bounded(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fps array<long>")


def covering_masks(radius: int, free: int = (1 << BITS) - 1, salt: int = 0) -> list[int]:
    """``2^(radius+1) - 1`` masks within ``free`` such that any ``radius`` bits miss one of them.

    Positions take the vectors in turn, so every mask keeps about half of the free bits.
    """
    size = 1 << (radius + 1)
    positions = [i for i in range(BITS) if free >> i & 1]
    vector = {p: (k + salt) % (size - 1) + 1 for k, p in enumerate(positions)}
    return [sum(1 << p for p in positions if bin(vector[p] & v).count("1") % 2) for v in range(1, size)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _tables(prints: DataFrame, radius: int) -> DataFrame:
    """A row for each of ``prints(which, fp, node)`` and table: the table's mask, and the bits under it."""
    masks = covering_masks(radius)
    rows = F.explode(F.array(*(F.struct(F.lit(_signed(m)).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for m in masks)))
    return prints.select("which", "fp", "node", rows.alias("t")).select("which", "t.mask", "t.key", "fp", "node")


BUCKETS = ["which", "mask", "key"]


def _finer(hot: DataFrame, level: int, radius: int) -> DataFrame:
    """Rows of oversized buckets, dealt anew by masks over the bits that are still free."""

    def run(batches):
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            which, mask, fp, node = (batch.column(i).to_numpy() for i in range(4))
            mask, fp = mask.view(np.uint64), fp.view(np.uint64)
            out = []
            for m in np.unique(mask):
                i = mask == m
                if int(m) not in known:
                    known[int(m)] = np.array(covering_masks(radius, ~int(m) & ((1 << BITS) - 1), level), np.uint64) | m
                out += [(which[i], np.full(i.sum(), x, np.uint64).view(np.int64), (fp[i] & x).view(np.int64), fp[i].view(np.int64), node[i]) for x in known[int(m)]]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], [*BUCKETS, "fp", "node"])

    return hot.select("which", "mask", "fp", "node").mapInArrow(run, "which int, mask long, key long, fp long, node long")


def spanning_links(fps: np.ndarray, radius: int, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """For each fingerprint that links to others here, the smallest index of its component."""
    n = len(fps)
    root = np.arange(n)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a in range(0, n, block):
        x = fps[a : a + block]
        for b in range(a, n, block):
            i, j = np.nonzero(np.bitwise_count(x[:, None] ^ fps[None, b : b + block]) <= radius)
            for p, q in zip((i + a).tolist(), (j + b).tolist()):
                if p < q:
                    p, q = find(p), find(q)
                    root[max(p, q)] = min(p, q)
    roots = np.array([find(i) for i in range(n)], np.int64)
    child = np.flatnonzero(roots != np.arange(n))
    return child, roots[child]


def _bucket_links(buckets: DataFrame, radius: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            a, b = [], []
            for bucket in batch.column(0):
                nodes = bucket.values.field("node").to_numpy()
                order = np.argsort(nodes, kind="stable")
                child, parent = spanning_links(bucket.values.field("fp").to_numpy().view(np.uint64)[order], radius)
                a.append(nodes[order[child]])
                b.append(nodes[order[parent]])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (a, b)], ["a", "b"])

    return buckets.select("x").mapInArrow(run, "a long, b long")


def links(prints: DataFrame, radius: int = 3, bucket: int = BUCKET) -> DataFrame:
    """Edges ``(a, b)`` between nodes of ``prints(which, fp, node)``, whose ``(which, fp)`` are distinct: they join every
    two of one ``which`` within ``radius`` bits, directly or by a chain of such pairs."""
    found, rows = None, _tables(prints, radius)
    for level in range(1, 8):
        sizes = rows.groupBy(BUCKETS).agg(F.count("*").alias("n")).filter("n > 1")
        small = rows.join(sizes, BUCKETS).filter(F.col("n") <= bucket).groupBy(BUCKETS).agg(F.collect_list(F.struct("fp", "node")).alias("x"))
        edges = materialize(_bucket_links(small, radius).filter("a <> b").distinct(), "links")
        found = edges if found is None else found.unionAll(edges)
        hot = materialize(sizes.filter(F.col("n") > bucket).select(BUCKETS), "hot")
        if hot.isEmpty():
            break
        rows = materialize(_finer(rows.join(hot, BUCKETS, "left_semi"), level, radius).distinct(), "finer")
    return found


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 3, seeds: tuple[int, ...] = (SEED,)) -> DataFrame:
    """``(doc_id, fps, component_id)``: the smallest id reachable over links of at most ``radius`` bits in some fingerprint."""
    prints = materialize(fingerprints(docs, width, seeds), "fingerprints")
    kept: list[DataFrame] = []
    with scratch_scope(kept):
        kept.append(_labels(prints, radius, len(seeds)))
    return prints.join(kept[0], "fps").select("doc_id", "fps", "component_id")


def _labels(prints: DataFrame, radius: int, n_seeds: int) -> DataFrame:
    """``(fps, component_id)`` of all distinct fingerprints."""
    nodes = materialize(prints.groupBy("fps").agg(F.min("doc_id").alias("node")), "nodes")
    each = nodes.select("node", F.posexplode("fps").alias("which", "fp"))
    # Texts that share one fingerprint but not all hang on the smallest of them.
    heads = materialize(each.groupBy("which", "fp").agg(F.min("node").alias("head")), "heads") if n_seeds > 1 else each.withColumnRenamed("node", "head")
    edges = links(heads.select("which", "fp", F.col("head").alias("node")), radius)
    if n_seeds > 1:
        edges = edges.unionAll(each.join(heads, ["which", "fp"]).filter("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b")))
    roots = materialize(components(edges), "roots").withColumnRenamed("node", "at")
    return materialize(nodes.join(roots, nodes["node"] == roots["at"], "left").select("fps", F.coalesce("root", "node").alias("component_id")), "labels")


def simhash_report(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex(F.col("fps")[0]), 16, "0")).alias("fingerprint"), "component_id")


def keep_first_copies(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` without near copies of kept rows of smaller id.

    Candidates are the components of fingerprints within three bits, by covering masks as in ``simhash_report``, and what is
    too far apart for masks by bands; all of them are decided by their exact sets of five-word shingles (see ``shingles``).
    """
    kept: list[DataFrame] = []
    with scratch_scope(kept):
        linked = near_duplicates(docs.filter("doc_id is not null").select("doc_id", "text")).select("doc_id", "component_id")
        # A component of one holds no candidates.
        some = linked.groupBy("component_id").agg(F.count("*").alias("n")).filter("n > 1").select("component_id")
        kept.append(materialize(linked.join(some, "component_id").select("doc_id", "component_id"), "linked"))
    return shingles.keep_first_copies(docs, kept[0])
