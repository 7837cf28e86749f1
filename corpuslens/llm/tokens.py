"""Operator 5: token counts by heap-and-linked-list byte-pair merging.

A text's pre-tokens never cross white space, but for one ASCII space that
leads a word.  So a chunk of texts is cut at spaces, each distinct piece is
counted once, and the counts are summed per text.  A pre-token is a doubly
linked list of byte symbols with a heap of adjacent pairs; the pair of lowest
rank is popped and merged until none is left, and the count is the number of
bytes minus the number of merges.  No identifiers are made.

Defined results: a null or empty text has no bytes and no tokens.  Strings of
added special tokens count one each, as the tokenizer's default has it.  Rows
that repeat a key, or have none, are counted each; a very long text is a chunk
of its own, and a long run without spaces takes some 40 bytes of memory a
byte; other columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import json
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F

from .common import bounded, chunks

#: Pre-token pattern of the byte-level vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Distinct pieces whose counts a Python worker remembers; it starts anew beyond.
CACHE = 400_000
#: Characters of a piece that is remembered at most, so what is remembered is bounded in bytes too.
REMEMBERED = 64
#: Bytes from which a pre-token's symbols are held in arrays instead of lists.
LONG = 1 << 12
PLACE = (1 << 40) - 1
#: Larger chunks hold more repetitions of a piece.
CHUNK = 4 << 20


def byte_letters() -> dict[int, str]:
    """The printable letter by which byte-level vocabularies write each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Merger:
    """Counts tokens of a byte-level BPE vocabulary file (the tokenizers library's .json)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        to_byte = {c: b for b, c in byte_letters().items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in file["model"]["merges"]]
        raw = lambda s: bytes(to_byte[c] for c in s)
        pairs = [(raw(a), raw(b)) for a, b in merges]
        # Symbols by number: single bytes are their own, what a merge makes follows.
        number = {bytes([b]): b for b in range(256)}
        for a, b in pairs:
            number.setdefault(a + b, len(number))
        self.ranks = {number[a] << 32 | number[b]: i for i, (a, b) in enumerate(pairs)}
        self.makes = array("i", [number[a + b] for a, b in pairs])
        self.first = np.full(1 << 16, -1, np.int32)
        for i, (a, b) in enumerate(pairs):
            if len(a) == len(b) == 1:
                self.first[a[0] << 8 | b[0]] = i
        self.special = [t["content"] for t in file.get("added_tokens", [])]
        self.find = regex.compile(PATTERN).finditer
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None
        self.known: dict[str, int] = {}

    def merged(self, symbols: bytes) -> int:
        """Tokens of one pre-token: its bytes minus its merges.

        The pairs there are at first lie sorted by rank and place in one array, those that merges make in a heap; the
        lower of both heads is next.  So a byte takes some tens of bytes of memory, however long the pre-token.
        """
        n = len(symbols)
        if n < 2:
            return n
        ranks, makes = self.ranks, self.makes
        if n < LONG:
            part, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
            start = sorted((r << 40) | i for i in range(n - 1) if (r := ranks.get(part[i] << 32 | part[i + 1])) is not None)
        else:
            raw = np.frombuffer(symbols, np.uint8).astype(np.int32)
            part, after, before = array("i", raw.tobytes()), array("i", np.arange(1, n + 1, dtype=np.int32).tobytes()), array("i", np.arange(-1, n - 1, dtype=np.int32).tobytes())
            rank = self.first[raw[:-1] << 8 | raw[1:]].astype(np.int64)
            at = np.flatnonzero(rank >= 0)
            start = array("q", np.sort(rank[at] << 40 | at).tobytes())
        left, k, end, heap = n, 0, len(start), []
        while k < end or heap:
            if heap and (k == end or heap[0] < start[k]):
                entry = heapq.heappop(heap)
            else:
                entry = start[k]
                k += 1
            r, i = entry >> 40, entry & PLACE
            # A stale entry: one of its ends was merged since, so the pair has another rank or is gone.
            if part[i] < 0 or (j := after[i]) == n or ranks.get(part[i] << 32 | part[j]) != r:
                continue
            made = part[i] = makes[r]
            part[j] = -1
            after[i] = j = after[j]
            left -= 1
            if j < n:
                before[j] = i
                if (q := ranks.get(made << 32 | part[j])) is not None:
                    heapq.heappush(heap, q << 40 | i)
            if (h := before[i]) >= 0 and (q := ranks.get(part[h] << 32 | made)) is not None:
                heapq.heappush(heap, q << 40 | h)
        return left

    def piece(self, text: str) -> int:
        if (n := self.known.get(text)) is None:
            n = sum(self.merged(m[0].encode()) for m in self.find(text))
            if len(text) <= REMEMBERED:
                if len(self.known) >= CACHE:
                    self.known.clear()
                self.known[text] = n
        return n

    def text(self, text: str) -> int:
        """Tokens of a whole text, without the shortcut over pieces."""
        if self.split_special is None:
            return sum(self.piece(m[0]) for m in self.find(text))
        special = set(self.special)
        return sum(1 if part in special else sum(self.piece(m[0]) for m in self.find(part)) for part in self.split_special(text))

    def texts(self, texts: pa.Array) -> np.ndarray:
        texts = pc.fill_null(texts, "")
        lists = pc.split_pattern(texts, " ")
        flat = lists.flatten()
        firsts = lists.offsets.to_numpy()
        coded = flat.dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        pieces = coded.dictionary.to_pylist()
        leading = np.zeros(len(flat), bool)
        leading[firsts[:-1]] = True
        # A piece that is empty or has white space at an end lets a run of spaces cross a cut: such texts are counted whole.
        odd = np.fromiter((not p or p[0].isspace() or p[-1].isspace() or "\x1c" <= p[0] <= "\x1f" or "\x1c" <= p[-1] <= "\x1f" for p in pieces), bool, len(pieces))
        for s in self.special:
            odd |= np.fromiter((s[:2] in p for p in pieces), bool, len(pieces))
        whole = np.add.reduceat(odd[codes].astype(np.int64), firsts[:-1]) > 0 if len(texts) else np.zeros(0, bool)
        size = np.zeros(len(pieces), np.int64)
        usual = np.zeros(len(pieces), bool)
        normal = ~np.repeat(whole, np.diff(firsts))
        usual[codes[normal & ~leading]] = True
        for i in np.flatnonzero(usual).tolist():
            size[i] = self.piece(" " + pieces[i])
        counts = size[codes]
        for i in np.flatnonzero(normal & leading).tolist():
            counts[i] = self.piece(pieces[codes[i]])
        out = np.add.reduceat(counts, firsts[:-1]) if len(texts) else np.zeros(0, np.int64)
        for i in np.flatnonzero(whole).tolist():
            out[i] = self.text(texts[i].as_py())
        return out


def token_counts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_tokens)`` of every whole text; ``path`` is the vocabulary file, which every executor has."""

    def run(batches):
        merger = Merger(path)
        for batch in batches:
            for part in chunks(batch, 1, CHUNK):
                size = pc.cast(pc.fill_null(pc.binary_length(part.column(1)), 0), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), size, pa.array(merger.texts(part.column(1)))], ["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema[key].dataType.simpleString()
    return bounded(docs).select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")


def token_report(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    return token_counts(docs, path).withColumn("over_limit", F.col("n_tokens") > limit)
