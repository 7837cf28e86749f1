"""Operator 7: packing along a space-filling curve.

Every document's tokens are hashed into a vector whose projections to
``DIMENSIONS`` dimensions give a place on a Hilbert curve.  A range sort by
that place brings similar documents together, and each range is packed along
the curve: documents follow one another, cut where a sequence is full.  What
remains at the end of a range is cut into powers of two, which need no
padding, so no sequence is padded.

Long documents lie in the curve's middle, close together, so documents are cut
into parts of at most ``PART`` ids before the sort: ranges of equally many parts
then hold about equally many bytes, and their number follows from the bytes
there are (``RANGE_BYTES`` each).

Defined results: a null or empty text is the closing id alone; equal places
are ordered by doc_id and start, and a hot place, or a very long text, is
split between ranges; rows that repeat a doc_id are packed each; columns
besides the key and the text are left out; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import bounded, chunks, materialize, mix64
from .tokens import PATTERN

LENGTH = 2048
CLOSING_ID = 1
DIMENSIONS, ORDER = 3, 10
#: Bytes of 16-bit ids that one range holds, about.
RANGE_BYTES = 16 << 20
#: Ids of a part that is sorted by itself at most; the smaller, the more evenly ranges of equally many parts fill.
PART = 512
#: The pattern's white space, and the characters from which a run of it is cut before the pattern sees it.
SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
LONG_RUN = 1 << 14


def encoder(ranks_path: str, special: dict[str, int]) -> tiktoken.Encoding:
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("local", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


def encode(enc: tiktoken.Encoding, text: str, special: dict[str, int], longest: int = LONG_RUN) -> list[int]:
    """Ids of a whole text.

    The pre-token pattern looks ahead at the end of white space and overflows the stack in runs of a million. Where a run
    is long it is cut as the pattern would: all but its last character, or all of it before a special string and at the
    end, is one pre-token, and goes to the merging of pairs without the pattern.
    """
    allowed = {s for s in special if s in text}
    # A long run holds eight of the characters at every eighth of its length, or all but one.
    if len(text) < longest or not any(m.end() - m.start() >= 7 for m in SPACE.finditer(text[:: max(longest // 8, 1)])):
        return enc.encode(text, allowed_special=allowed, disallowed_special=()) if allowed else enc.encode_ordinary(text)
    ids: list[int] = []
    for part in re.split("(" + "|".join(map(re.escape, sorted(allowed, key=len, reverse=True))) + ")", text) if allowed else [text]:
        if part in allowed:
            ids.append(special[part])
            continue
        at = 0
        for m in SPACE.finditer(part):
            if m.end() - m.start() >= longest:
                end = m.end() - (m.end() < len(part))
                ids += enc.encode_ordinary(part[at : m.start()])
                ids += enc._encode_single_piece(part[m.start() : end])
                at = end
        ids += enc.encode_ordinary(part[at:])
    return ids


def hilbert_index(points: np.ndarray, order: int) -> np.ndarray:
    """Place on the Hilbert curve of integer points (n, d) with ``order`` bits a coordinate."""
    x = points.astype(np.int64).T.copy()
    d = len(x)
    bit = 1 << (order - 1)
    # Undo, from the top bit down, the reflections and exchanges that each quadrant brings.
    while bit > 1:
        low = bit - 1
        for i in range(d):
            set_ = (x[i] & bit) > 0
            swap = np.where(set_, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(set_, low, swap)
            x[i] ^= swap
        bit >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    bit = 1 << (order - 1)
    while bit > 1:
        flip ^= np.where((x[d - 1] & bit) > 0, bit - 1, 0)
        bit >>= 1
    x ^= flip
    out = np.zeros_like(x[0])
    for b in range(order - 1, -1, -1):
        for i in range(d):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def curve_places(ids: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """The curve's place of each document, from its ids ``ids[firsts[i]:firsts[i+1]]``."""
    n = np.maximum(np.diff(firsts), 1)
    h = mix64(ids.astype(np.uint64) + np.uint64(0x51ED27))
    points = []
    for d in range(DIMENSIONS):
        # Each id has a fixed direction in every dimension; the mean over a document is its projection.
        sign = ((h >> np.uint64(16 * d)) & np.uint64(0xFFFF)).astype(np.float64) / 32767.5 - 1
        mean = np.diff(np.concatenate([[0.0], np.cumsum(sign)])[firsts]) / n
        points.append(np.clip((np.tanh(4 * mean) + 1) / 2 * (1 << ORDER), 0, (1 << ORDER) - 1).astype(np.int64))
    return hilbert_index(np.stack(points, 1), ORDER)


def tokenized(docs: DataFrame, ranks_path: str, special: dict[str, int], key: str = "doc_id", text: str = "text", length: int = PART) -> DataFrame:
    """``(doc_id, place, start, total, row, ids)``: 16-bit ids of every whole text with the closing id, in parts of at most ``length``;
    the document's place on the curve, the ids before a part, the document's number of ids, and a number of the row it came from."""

    def run(batches):
        enc = encoder(ranks_path, special)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in chunks(batch, 1):
                arrays = []
                for t in pc.fill_null(part.column(1), ""):
                    ids = encode(enc, t.as_py(), special)
                    ids.append(CLOSING_ID)
                    arrays.append(np.array(ids, "<u2"))
                size = np.array([len(x) for x in arrays], np.int64)
                firsts = np.concatenate([[0], np.cumsum(size)])
                places = curve_places(np.concatenate(arrays), firsts)
                parts = -(-size // length)
                doc = np.repeat(np.arange(len(size)), parts)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)) * length
                ids = pa.array([arrays[i][a : a + length].tobytes() for i, a in zip(doc.tolist(), start.tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(doc)), pa.array(places[doc]), pa.array(start), pa.array(size[doc]), pa.array(row + doc), ids], ["doc_id", "place", "start", "total", "row", "ids"])
                row += len(size)

    kind = docs.schema[key].dataType.simpleString()
    return bounded(docs).select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, place long, start long, total long, row long, ids binary")


PIECE = "doc_id {}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def pack(placed: DataFrame, length: int = LENGTH) -> DataFrame:
    """Pieces of ``placed(doc_id, place, start, total, row, ids)`` along the curve; ``ids`` are a piece's 32-bit little-endian ids."""

    def run(batches):
        base = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []
        state = {"sequence": 0}

        def emit(pieces: list[tuple]) -> None:
            at = 0
            for doc, start, ids, total, _ in pieces:
                n = len(ids) // 4
                rows.append((doc, start, n, zlib.crc32(ids), total, base + state["sequence"], at, ids))
                at += n
            state["sequence"] += 1

        def flush(kind) -> pa.RecordBatch:
            names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids")
            kinds = (kind, *[pa.int64()] * 6, pa.binary())
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], list(names))
            rows.clear()
            return out

        open_: list[tuple] = []
        size, kind = 0, pa.int64()
        for batch in batches:
            kind = batch.schema.field(0).type
            for doc, first, total, row, ids in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5))):
                wide = np.frombuffer(ids, "<u2").astype("<u4").tobytes()
                start = 0
                while start < len(wide) // 4:
                    n = min(length - size, len(wide) // 4 - start)
                    # Parts of one document that follow one another stay one piece.
                    if open_ and open_[-1][4] == row and open_[-1][1] + len(open_[-1][2]) // 4 == first + start:
                        open_[-1] = (doc, open_[-1][1], open_[-1][2] + wide[4 * start : 4 * (start + n)], total, row)
                    else:
                        open_.append((doc, first + start, wide[4 * start : 4 * (start + n)], total, row))
                    size, start = size + n, start + n
                    if size == length:
                        emit(open_)
                        open_, size = [], 0
                if len(rows) >= 4096:
                    yield flush(kind)
        # The rest of this range: one sequence for each power of two in its size.
        while size:
            n = 1 << (size.bit_length() - 1)
            full, room = [], n
            while room:
                doc, start, ids, total, row = open_.pop(0)
                m = min(room, len(ids) // 4)
                full.append((doc, start, ids[: 4 * m], total, row))
                if 4 * m < len(ids):
                    open_.insert(0, (doc, start + m, ids[4 * m :], total, row))
                room -= m
            emit(full)
            size -= n
        if rows:
            yield flush(kind)

    kind = placed.schema["doc_id"].dataType.simpleString()
    order = ("place", "doc_id", "row", "start")
    n_bytes = placed.agg(F.sum(F.length("ids").cast("long"))).first()[0] or 0
    ranged = placed.repartitionByRange(max(1, -(-n_bytes // RANGE_BYTES)), *order).sortWithinPartitions(*order)
    return bounded(ranged).mapInArrow(run, PIECE.format(kind))


def pack_documents(docs: DataFrame, ranks_path: str, special: dict[str, int]) -> DataFrame:
    return pack(materialize(tokenized(docs, ranks_path, special), "tokenized"))


def packing_report(docs: DataFrame, ranks_path: str, special: dict[str, int]) -> DataFrame:
    return pack_documents(docs, ranks_path, special).drop("ids")
