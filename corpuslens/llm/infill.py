"""Operator 13: fill-in-the-middle transformation of texts.

A text is decoded to an array of its code points in UTF-32.  Every code point
has a class, and a unit is a run of one class: boundaries lie where
neighbouring classes differ.  Two ranks drawn from the row's key choose two
boundaries; the code points before, between and after them are sliced, encoded
anew, and put together in the order prefix, suffix, middle or suffix, prefix,
middle, each after its mark.  ``restored`` undoes it from output and form alone.

Units are single code points (``points``: neighbours always differ), or runs
of white space, letters and digits, and all else (``runs``).

Defined results: a null or empty text is plain, with no units; a text that
holds a mark is plain, so output can always be undone; a text is a row of its
own, however long, and takes some nine bytes a code point; rows that repeat a
doc_id are cut at the same ranks of their own units, and a null doc_id is
drawn as ``null``; columns besides the key and the text are left out; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bounded, chunks

#: Marks of prefix, suffix and middle (fixed values of the contract).
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred texts those that stay plain, and of the others those that begin with the suffix.
PLAIN_PERCENT, SUFFIX_FIRST_PERCENT = 10, 20
UNITS = ("points", "runs")


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def encoded(points: np.ndarray) -> str:
    return points.tobytes().decode("utf-32-le")


def classes(points: np.ndarray, unit: str) -> np.ndarray:
    """The class of every code point; a unit is a run of one class."""
    if unit == "points":
        return np.arange(len(points)) & 1
    space = (points == 0x20) | ((points >= 0x09) & (points <= 0x0D))
    ascii_word = ((points >= 0x30) & (points <= 0x39)) | ((points | 0x20) >= 0x61) & ((points | 0x20) <= 0x7A)
    return np.where(space, 0, np.where(ascii_word | (points >= 0x80), 1, 2))


def boundaries(points: np.ndarray, unit: str) -> np.ndarray:
    """Where units begin, and the end: one more than there are units."""
    if not len(points):
        return np.zeros(1, np.int64)
    own = classes(points, unit)
    return np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1, [len(points)]])


def draws(key: str, seed: int = 1) -> list[int]:
    """Four numbers of 32 bits, the same for a key at all times."""
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]


def cut(text: str, key: str, seed: int = 1, unit: str = "points") -> tuple[int, str, int | None, int | None, str]:
    """``(units, form, prefix_chars, middle_chars, output)`` of one text."""
    points = code_points(text)
    edges = boundaries(points, unit)
    n = len(edges) - 1
    h1, h2, h3, h4 = draws(key, seed)
    if not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= 100 - PLAIN_PERCENT:
        return n, "plain", None, None, text
    a, b = edges[np.sort([h1 % (n + 1), h2 % (n + 1)])]
    prefix, middle, suffix = encoded(points[:a]), encoded(points[a:b]), encoded(points[b:])
    if h4 % 100 < SUFFIX_FIRST_PERCENT:
        return n, "spm", int(a), int(b - a), f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", int(a), int(b - a), f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restored(output: str, form: str) -> str:
    """The text that ``cut`` was given."""
    if form == "plain":
        return output
    first, middle = output.split(MIDDLE)
    if form == "psm":
        prefix, suffix = first.removeprefix(PREFIX).split(SUFFIX)
    else:
        suffix, prefix = first.removeprefix(SUFFIX).split(PREFIX)
    return prefix + middle + suffix


def infilled(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 1, unit: str = "points") -> DataFrame:
    """``(doc_id, n, form, prefix_chars, middle_chars, output)`` of every whole text."""
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {UNITS}")

    def run(batches):
        for batch in batches:
            for part in chunks(batch, 1):
                rows = [cut(t or "", "null" if k is None else str(k), seed, unit) for k, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist())]
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    kind = docs.schema[key].dataType.simpleString()
    return bounded(docs).select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored_texts(cuts: DataFrame) -> DataFrame:
    """``cuts(output, form, ...)`` with the ``text`` that each was made of."""
    at = [cuts.columns.index(c) for c in ("output", "form")]

    def run(batches):
        for batch in batches:
            for part in chunks(batch, at[0]):
                texts = [None if o is None else restored(o, f) for o, f in zip(*(part.column(i).to_pylist() for i in at))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, "text"])

    return bounded(cuts).mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cuts.schema) + ", text string")


def infill_report(docs: DataFrame) -> DataFrame:
    """The transformation's digests; the text is rebuilt from what was put out."""
    back = restored_texts(infilled(docs))
    return back.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("text", 256).alias("restored_sha256"))
