"""Operator 12: audit of how filters interact, over a fingerprint-routed RDD.

Five filters judge every whole text; a document's failures are a mask of five
bits.  Four of them need the text alone.  For the fifth, copies, texts are
routed to partitions by their XXH64.  A partition keeps a chain for each
fingerprint, with the full text and the smallest id so far of every different
text that has it, and puts out the documents that are not the smallest.

Before texts are routed each task folds the copies it meets itself, within
``FOLD_BYTES`` of texts, so a text that a third of all rows share travels once
a task, and rows that are known not to be the smallest travel without text.

Masks are counted by ``combineByKey``: a part's counts are one vector of 32
masks by four kinds of labels, summed within tasks first.  All 120 orders and
their steps follow from that vector.

Defined results: a null text is the empty one; a null lang is the part of the
empty string; rows that repeat a doc_id count each, and none of them is the
other's copy; rows of a null doc_id have no copies and are none; labels of one
doc_id count if any row of them says so; columns besides doc_id, text and lang
are left out; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from itertools import permutations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import materialize

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
#: Bytes of texts that a task folds before it sends them on.
FOLD_BYTES = 32 << 20
#: Bytes of texts that one partition of fingerprints holds at most, about: its chains are in memory.
ROUTE_BYTES = 32 << 20
UPPER = bytes(range(ord("A"), ord("Z") + 1))
SYMBOLS = (b"#", b"$", b"%", b"&", b"*", b"|")


def text_mask(raw: bytes, points: int) -> int:
    """Failures of filters A to D; ``bytes.split`` parts at 0x20 and 0x09 to 0x0D, no other."""
    words = raw.split()
    n = len(words)
    return (n < 200) | (100 * len(set(words)) < 50 * n) << 1 | (100 * (len(raw) - len(raw.translate(None, UPPER))) > 3 * points) << 2 | any(s in raw for s in SYMBOLS) << 3


def _fold(entry: list, doc_id: int, parts: Counter):
    """Take rows of the same text into ``entry = [text, smallest id, mask, its rows by part]``; what is left behind comes out."""
    if doc_id > entry[1]:
        return doc_id, parts
    if doc_id == entry[1]:
        entry[3] += parts
        return None
    behind = entry[1], entry[3]
    entry[1], entry[3] = doc_id, parts
    return behind


def routed(rows, fold_bytes: int = FOLD_BYTES):
    """``(fingerprint, record)`` of rows (doc_id, text, part): a record has a text, or is settled and has none."""
    held: dict[bytes, list] = {}
    size = 0
    for doc_id, text, part in rows:
        text = text or ""
        raw = text.encode()
        entry = held.get(raw)
        mask = text_mask(raw, len(text)) if entry is None else entry[2]
        if doc_id is None:
            yield xxhash.xxh64_intdigest(raw), (None, None, mask, Counter([part]))
        elif entry is None:
            held[raw] = [raw, doc_id, mask, Counter([part])]
            size += len(raw)
        elif behind := _fold(entry, doc_id, Counter([part])):
            yield xxhash.xxh64_intdigest(str(behind[0])), (None, behind[0], mask | COPY, behind[1])
        if size > fold_bytes:
            for e in held.values():
                yield xxhash.xxh64_intdigest(e[0]), tuple(e)
            held, size = {}, 0
    for e in held.values():
        yield xxhash.xxh64_intdigest(e[0]), tuple(e)


def chained(records):
    """``(doc_id, part, mask, n)``: settled records as they are, the others by chains of one fingerprint."""
    chains: dict[int, list[list]] = {}
    for print_, (raw, doc_id, mask, parts) in records:
        if raw is None:
            yield from ((doc_id, part, mask, n) for part, n in parts.items())
            continue
        chain = chains.setdefault(print_, [])
        entry = next((e for e in chain if e[0] == raw), None)
        if entry is None:
            chain.append([raw, doc_id, mask, parts])
        elif behind := _fold(entry, doc_id, parts):
            yield from ((behind[0], part, mask | COPY, n) for part, n in behind[1].items())
    for chain in chains.values():
        for _, doc_id, mask, parts in chain:
            yield from ((doc_id, part, mask, n) for part, n in parts.items())


def failures(docs: DataFrame) -> DataFrame:
    """``(doc_id, part, mask, n)``: ``n`` rows of a doc_id and part with these failures, bit i for the filter of letter i."""
    n_bytes = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    rows = docs.select("doc_id", "text", F.coalesce("lang", F.lit("")).alias("part")).rdd
    texts = rows.mapPartitions(routed).partitionBy(max(1, -(-n_bytes // ROUTE_BYTES)), int)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.sparkSession.createDataFrame(texts.mapPartitions(chained), f"doc_id {kind}, part string, mask int, n long")


def _vector(value: tuple[int, int, int]) -> np.ndarray:
    out = np.zeros((1 << len(FILTERS), 4), np.int64)
    return _count(out, value)


def _count(vector: np.ndarray, value: tuple[int, int, int]) -> np.ndarray:
    mask, kind, n = value
    vector[mask, kind] += n
    return vector


def _add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a += b
    return a


def order_rows(part: str, counts: np.ndarray, letters: str = FILTERS):
    """A row for every order and step of one part, from its counts of masks (rows) by kinds of labels (good + 2 toxic)."""
    masks = np.arange(len(counts))
    total = counts.sum(1)
    out, shapley = [], Counter()
    for order in permutations(letters):
        left = np.ones(len(masks), bool)
        for step, letter in enumerate(order, 1):
            bit = 1 << letters.index(letter)
            fails = (masks & bit) > 0
            here = fails & left
            lost = counts[here].sum(0)
            removed = int(lost.sum())
            shapley[letter] += removed
            redundant = int(total[fails & ~left].sum())
            left &= ~fails
            out.append((letter, ("".join(order), step, int(total[left].sum()), removed, redundant, int(total[bit]), int(lost[1] + lost[3]), int(lost[2] + lost[3]))))
    return [(part, *values, shapley[letter]) for letter, values in out]


RESULT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def interaction_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    said = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    failed = materialize(failures(docs), "failures")
    kinds = failed.join(said, "doc_id", "left").select("part", "mask", (F.coalesce("good", F.lit(0)) + 2 * F.coalesce("toxic", F.lit(0))).alias("kind"), "n")
    counts = kinds.rdd.map(lambda r: (r[0], (r[1], r[2], r[3]))).combineByKey(_vector, _count, _add)
    return docs.sparkSession.createDataFrame(counts.flatMap(lambda x: order_rows(*x)), RESULT)
