"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame

from ..functions.batches import bounded, give_back
from ..session import drop, materialize, scratch_path, scratch_scope, settings

__all__ = ["bounded", "chunks", "drop", "inside", "materialize", "mix64", "scratch_path", "scratch_scope", "settings", "split_words", "window_hashes", "word_hashes"]

#: Text bytes that one vectorised step works on; bounds the memory of a Python worker.
CHUNK_BYTES = 1 << 20


def chunks(batch: pa.RecordBatch, column: int, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` whose texts hold about ``limit`` bytes (a longer text comes alone)."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(sizes) - sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)
    give_back()


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of all texts in order, and each text's first index (n + 1 values)."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = lists.flatten()
    counts = np.diff(lists.offsets.to_numpy())
    keep = pc.not_equal(flat, "")
    mask = keep.to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(texts)), counts)[mask]
    firsts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.bincount(owner, minlength=len(texts)), out=firsts[1:])
    return flat.filter(keep), firsts


def word_hashes(words: pa.Array, seed: int = 0) -> np.ndarray:
    """XXH64 of each word, computed once per distinct word."""
    coded = words.dictionary_encode()
    if not len(words):
        return np.zeros(0, np.uint64)
    own = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    return own[coded.indices.to_numpy(zero_copy_only=False)]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: shift, multiply by odd constants, twice."""
    x = (x >> np.uint64(31)) ^ x
    x *= np.uint64(0x9FB21C651E98DF25)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def window_hashes(h: np.ndarray, width: int, multiplier: int) -> np.ndarray:
    """Polynomial hash of every ``width`` consecutive word hashes (as if the words were one sequence)."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    m, out = np.uint64(multiplier | 1), np.zeros(n, np.uint64)
    for i in range(width):
        out = out * m + h[i : i + n]
    return mix64(out)


def inside(firsts: np.ndarray, width: int, n_windows: int) -> np.ndarray:
    """Which windows over the joined words lie within one text."""
    ok = np.zeros(max(n_windows, 0), bool)
    lengths = np.diff(firsts)
    for a, n in zip(firsts[:-1][lengths >= width], lengths[lengths >= width]):
        ok[a : a + n - width + 1] = True
    return ok
