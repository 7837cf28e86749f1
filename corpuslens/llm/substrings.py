"""Operator 3: substring dedup over a log-structured index of window fingerprints.

A window is ``WIDTH`` consecutive words.  Neighbouring windows whose smallest
``GRAM``-word hash stands at the same place form one entry, keyed by that hash
(the anchor) with a digest of the entry's words (the body); equal windows
always have equal anchors, wherever they stand.  So one row in about eight
words stands for all windows.

The index is a list of immutable runs.  A run is a table of buckets by its
key, one file a bucket, sorted by that key, so a new batch alone is shuffled
and sorted and then merge-joined with every run, bucket by bucket:

* an anchor that is new, or whose body is the one on record, settles all of
  the entry's windows at once;
* where bodies differ, the entries share some windows or none.  These are
  verified: each of their windows is looked up by its own fingerprint and
  digest in the runs of single windows.  What an entry on record needs for
  that lies beside the runs, the texts of its batch by buckets of doc_id.

Fingerprints only find: what they find is verified by words.  Within a chunk
of texts the words themselves are compared, between chunks BLAKE2b digests of
them (128 bits for an entry; 64 for a window, beside its 64-bit fingerprint).

Runs are merged, two at a time by a merge join, when a batch would meet more
than ``MAX_RUNS``.  What repeats within a chunk of texts is settled there, so
a key shared by a third of all rows reaches the shuffle once for each chunk.

Defined results: null or empty texts, and texts of fewer than ``WIDTH`` words,
lose nothing; rows with a null doc_id take no part and lose nothing; a doc_id
names one text, and rows that repeat it get the same verdict; a very long text
is a chunk of its own; an empty table gives no rows.  Columns named ``__id``,
``__ranges``, ``__kept``, ``__words`` or ``__removed`` are the operator's own;
others pass untouched.
"""

from __future__ import annotations

import uuid
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..session import SHUFFLE_CLEANUP
from .common import bounded, chunks, materialize, mix64, scratch_path, scratch_scope, settings, split_words, window_hashes, word_hashes

WIDTH, GRAM = 20, 6
#: Runs that a batch is merge-joined with at most; they are merged into one before.
MAX_RUNS = 2
#: Batches that the query enters the table in, by ranges of doc_id.
BATCHES = 3

_M = 0x9E6C63D0876A9A35
_INVERSE = pow(_M | 1, -1, 1 << 64)

#: What a row of a batch's run says.
ENTRY, BEACON, MIXED, REPEAT = 0, 1, 2, 3


def _owner(firsts: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.searchsorted(firsts, at, "right") - 1


def _window_starts(firsts: np.ndarray, width: int) -> np.ndarray:
    """Starts of all windows that lie within one text."""
    counts = np.maximum(np.diff(firsts) - width + 1, 0)
    return np.repeat(firsts[:-1] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


def _entries(h: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Entries in text order: first window, number of windows, anchor and body."""
    at = _window_starts(firsts, WIDTH)
    if not len(at):
        return at, at, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    grams, span = window_hashes(h, GRAM, _M), WIDTH - GRAM + 1
    n = len(grams) - span + 1
    best, place = grams[span - 1 : span - 1 + n].copy(), np.full(n, span - 1)
    for j in range(span - 2, -1, -1):
        here = grams[j : j + n]
        low = here <= best
        np.copyto(best, here, where=low)
        place[low] = j
    anchor_at = at + place[at]
    opens = np.flatnonzero(np.concatenate([[True], anchor_at[1:] != anchor_at[:-1]]))
    start, count = at[opens], np.diff(np.concatenate([opens, [len(at)]]))
    # Fingerprint of words [start, start + count + WIDTH - 1) from prefix sums of a polynomial.
    power, undo = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(h), x, np.uint64)]), dtype=np.uint64) for x in (_M | 1, _INVERSE))
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(h + np.uint64(1)) * power[: len(h)], dtype=np.uint64)])
    stop = start + count + WIDTH - 1
    body = mix64((prefix[stop] - prefix[start]) * undo[start] + mix64(count.astype(np.uint64)))
    return start, count, grams[anchor_at[opens]], body


def _joined_ranges(start: np.ndarray, count: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges in text order, those that touch within one text made one."""
    if not len(start):
        return start, count, owner
    fresh = np.concatenate([[True], (start[1:] != start[:-1] + count[:-1]) | (owner[1:] != owner[:-1])])
    opens = np.flatnonzero(fresh)
    last = np.concatenate([opens[1:] - 1, [len(start) - 1]])
    return start[opens], start[last] + count[last] - start[opens], owner[opens]


def _by_id(part: pa.RecordBatch) -> pa.RecordBatch:
    """Rows in order of doc_id, each doc_id once."""
    ids = part.column(0).to_numpy(zero_copy_only=False)
    return part.take(pa.array(np.unique(ids, return_index=True)[1]))


class _Words:
    """A chunk's words: their hashes and codes, and where each stands in their joined bytes."""

    def __init__(self, texts: pa.Array):
        words, self.firsts = split_words(texts)
        coded = words.dictionary_encode()
        self.codes = coded.indices.to_numpy(zero_copy_only=False)
        self.hashes = word_hashes(coded.dictionary)[self.codes] if len(words) else np.zeros(0, np.uint64)
        self.joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), " ")[0].as_buffer().to_pybytes()
        self.ends = np.cumsum(pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + 1) - 1

    def digests(self, start: np.ndarray, count: np.ndarray, size: int) -> list[bytes]:
        """BLAKE2b of the words [start, start + count), joined by one space."""
        a = np.where(start > 0, self.ends[start - 1] + 1, 0).tolist()
        joined = self.joined
        return [blake2b(joined[i:j], digest_size=size).digest() for i, j in zip(a, self.ends[start + count - 1].tolist())]

    def equal(self, a: np.ndarray, b: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Whether the ``count`` words from ``a`` are those from ``b``."""
        step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        same = self.codes[np.repeat(a, count) + step] == self.codes[np.repeat(b, count) + step]
        return np.logical_and.reduceat(same, np.cumsum(count) - count) if len(count) else np.zeros(0, bool)


RUN = "kind byte, anchor long, body binary, doc_id long, pos int, n int"


def _batch_rows(docs: DataFrame) -> DataFrame:
    """ENTRY: the only body of an anchor in its chunk, where it comes first.  BEACON: an anchor with
    more bodies there; their first entries are MIXED.  REPEAT: windows that came earlier in the chunk."""

    def run(batches):
        for batch in batches:
            for part in chunks(batch, 1):
                part = _by_id(part)
                words = _Words(part.column(1))
                firsts = words.firsts
                start, count, anchor, body = _entries(words.hashes, firsts)
                if not len(start):
                    continue
                order = np.lexsort((body, anchor))
                a, b = anchor[order], body[order]
                new_anchor = np.concatenate([[True], a[1:] != a[:-1]])
                new_body = new_anchor | np.concatenate([[True], b[1:] != b[:-1]])
                # Entries of one body are compared, word by word, with the first of them.
                again = np.flatnonzero(~new_body)
                lead = order[np.flatnonzero(new_body)[np.cumsum(new_body)[again] - 1]]
                same = (count[order[again]] == count[lead]) & words.equal(start[order[again]], start[lead], np.minimum(count[order[again]], count[lead]) + WIDTH - 1)
                new_body[again[~same]] = True
                group = np.cumsum(new_anchor) - 1
                many = (np.bincount(group, weights=new_body) > 1)[group]
                doc = _owner(firsts, start)
                ids = part.column(0).to_numpy()
                repeat = np.sort(order[~new_body])
                out = []
                for kind, i in ((ENTRY, np.sort(order[new_body & ~many])), (BEACON, np.sort(order[new_anchor & many])), (MIXED, np.sort(order[new_body & many]))):
                    proof = words.digests(start[i], count[i] + WIDTH - 1, 16) if kind == ENTRY else [None] * len(i)
                    out.append((kind, anchor[i].view(np.int64), proof, ids[doc[i]], start[i] - firsts[doc[i]], count[i]))
                s, n, d = _joined_ranges(start[repeat], count[repeat], doc[repeat])
                spread = mix64(ids[d].astype(np.uint64) + (s << 20).astype(np.uint64)).view(np.int64)
                out.append((REPEAT, spread, [None] * len(d), ids[d], s - firsts[d], n))
                kinds = np.concatenate([np.full(len(x[1]), x[0], np.int8) for x in out])
                proofs = pa.array([y for x in out for y in x[2]], pa.binary())
                key, id_, pos, size = (np.concatenate([x[i] for x in out]) for i in (1, 3, 4, 5))
                yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(key), proofs, pa.array(id_), pa.array(pos.astype(np.int32)), pa.array(size.astype(np.int32))], ["kind", "anchor", "body", "doc_id", "pos", "n"])

    return bounded(docs).select("doc_id", "text").mapInArrow(run, RUN)


def _listed(ranges: DataFrame) -> DataFrame:
    return ranges.groupBy("doc_id").agg(F.collect_list(F.struct("pos", "n")).alias("__ranges"))


def _flat_ranges(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, pos and n of every range in a column of lists (null: none)."""
    lists = lists if isinstance(lists, pa.ListArray) else lists.combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    return np.repeat(np.arange(len(lists)), sizes), flat.field("pos").to_numpy(zero_copy_only=False).astype(np.int64), flat.field("n").to_numpy(zero_copy_only=False).astype(np.int64)


WINDOW = "h1 long, h2 long, doc_id long, pos int, again boolean"


def _windows(texts: DataFrame, ranges: DataFrame) -> DataFrame:
    """Fingerprint ``h1`` and digest ``h2`` of each listed window; ``again`` where the chunk has its words earlier."""

    def run(batches):
        for batch in batches:
            for part in chunks(batch, 1):
                part = _by_id(part)
                words = _Words(part.column(1))
                firsts = words.firsts
                row, pos, n = _flat_ranges(part.column(2))
                at = np.unique(np.repeat(firsts[row] + pos - (np.cumsum(n) - n), n) + np.arange(n.sum()))
                if not len(at):
                    continue
                h1 = window_hashes(words.hashes, WIDTH, _M)[at]
                order = np.argsort(h1, kind="stable")
                fresh = np.concatenate([[True], h1[order[1:]] != h1[order[:-1]]])
                lead = order[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
                again = np.zeros(len(at), bool)
                again[order] = ~fresh & words.equal(at[order], at[lead], np.full(len(at), WIDTH))
                h2 = np.zeros(len(at), np.int64)
                new = np.flatnonzero(~again)
                h2[new] = np.frombuffer(b"".join(words.digests(at[new], np.full(len(new), WIDTH), 8)), np.int64)
                doc = _owner(firsts, at)
                yield pa.RecordBatch.from_arrays([pa.array(h1.view(np.int64)), pa.array(h2), part.column(0).take(pa.array(doc)), pa.array((at - firsts[doc]).astype(np.int32)), pa.array(again)], ["h1", "h2", "doc_id", "pos", "again"])

    return bounded(texts).select("doc_id", "text").join(_listed(ranges), "doc_id").mapInArrow(run, WINDOW)


class FingerprintIndex:
    """Windows of the texts entered so far, as sorted immutable runs in the scratch folder.

    ``add`` enters a batch and returns its windows that came earlier: in this batch at a smaller
    ``(doc_id, pos)``, or in a batch before.  A batch must not repeat an id of an earlier batch.
    The number of ``buckets`` holds for all runs (the session's shuffle partitions, if not given).
    """

    def __init__(self, spark: SparkSession, max_runs: int = MAX_RUNS, buckets: int | None = None):
        self.spark, self.max_runs = spark, max_runs
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.entries: list[DataFrame] = []
        self.windows: list[DataFrame] = []
        self.texts: list[DataFrame] = []

    def _run(self, df: DataFrame, name: str, *keys: str) -> DataFrame:
        """``df``, whose partitions are the buckets of ``keys``, as a table of sorted buckets."""
        table = f"corpuslens_{name}_{uuid.uuid4().hex}"
        with settings(self.spark, **{SHUFFLE_CLEANUP: "true", "spark.sql.legacy.bucketedTableScan.outputOrdering": "true"}):
            df.write.format("parquet").option("compression", "zstd").option("path", scratch_path(self.spark, name)).bucketBy(self.buckets, *keys).sortBy(*keys).saveAsTable(table)
        out = self.spark.table(table)
        # The files stay; the catalog need not know of them any longer.
        self.spark.sql(f"drop table {table}")
        return out

    def add(self, docs: DataFrame) -> DataFrame:
        """Ranges ``(doc_id, pos, n)`` of the batch's windows that came earlier."""
        if len(self.entries) >= self.max_runs:
            self.compact()
        docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null")
        self.texts.append(self._run(docs.repartition(self.buckets, "doc_id"), "texts", "doc_id"))
        run = self._run(self._merged_entries(_batch_rows(self.texts[-1])), "entries", "anchor")
        settled = run.filter(F.col("verdict") == REPEAT).select("doc_id", "pos", "n")
        open_ = run.filter(F.col("verdict") == MIXED).select("doc_id", "pos", "n")
        # An entry on record whose anchor has a second body from now on: its windows are entered one by one too.
        old = run.filter("old_doc is not null").select(F.col("old_doc").alias("doc_id"), F.col("old_pos").alias("pos"), F.col("old_n").alias("n")).distinct()
        with settings(self.spark, **{"spark.sql.legacy.bucketedTableScan.outputOrdering": "true"}):
            found = _windows(self.texts[-1], open_)
            for texts in self.texts[:-1]:
                found = found.unionAll(_windows(texts, old))
            found = materialize(found, "found", "zstd")
        single = self._run(self._merged_windows(found.filter("not again")), "windows", "h1", "h2")
        lone = F.lit(1).alias("n")
        repeated = single.filter("earlier").select("doc_id", "pos", lone).unionAll(found.filter("again").select("doc_id", "pos", lone))
        self.entries.append(run.filter("lead").select("anchor", "body", "doc_id", "pos", "n", "mixed"))
        self.windows.append(single.filter("lead").select("h1", "h2", "doc_id", "pos"))
        return settled.unionAll(repeated)

    def _merged_entries(self, rows: DataFrame) -> DataFrame:
        """The batch's rows, sorted by anchor and judged against each other and every run."""
        told = F.col("kind").isin(ENTRY, BEACON)
        ordered = W.partitionBy("anchor", "told").orderBy(F.desc("kind"), "doc_id", "pos")
        group = ordered.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        first = F.row_number().over(ordered) == 1
        own = rows.repartition(self.buckets, "anchor").withColumn("told", told)
        body = F.when(F.col("kind") == ENTRY, F.col("body"))
        several = F.coalesce(F.min(body).over(group) < F.max(body).over(group), F.lit(False))
        own = own.withColumn("new_mixed", F.max(F.col("kind") == BEACON).over(group) | several).withColumn("first", first)
        # A row that repeats the first one's doc_id and place is that same entry.
        own = own.withColumn("head", F.first(F.struct("doc_id", "pos")).over(ordered) == F.struct("doc_id", "pos"))
        on_record, old_mixed = F.lit(False), F.lit(False)
        olds = []
        for i, r in enumerate(self.entries):
            r = r.select(F.col("anchor").alias("anchor"), *(F.col(c).alias(f"{c}{i}") for c in ("body", "doc_id", "pos", "n", "mixed")))
            own = own.join(r, "anchor", "left")
            hit = F.col("told") & F.col(f"mixed{i}").isNotNull()
            on_record, old_mixed = on_record | hit, old_mixed | (hit & F.col(f"mixed{i}"))
            olds.append(F.when(hit & ~F.col(f"mixed{i}"), F.struct(*(F.col(f"{c}{i}").alias(c) for c in ("body", "doc_id", "pos", "n")))))
        old = F.coalesce(*olds) if olds else F.lit(None).cast("struct<body:binary,doc_id:bigint,pos:int,n:int>")
        own = own.withColumn("old", old).withColumn("on_record", on_record).withColumn("old_mixed", old_mixed)
        # Bodies of one anchor in this batch are all equal or else mixed, so any entry's comparison with the record holds for all.
        mixed = F.coalesce(F.col("new_mixed") | F.col("old_mixed") | (F.col("old.body") != F.col("body")), F.lit(False))
        own = own.withColumn("is_mixed", F.when(F.col("told"), mixed).otherwise(False))
        verdict = (
            F.when(~F.col("told"), F.col("kind"))
            .when(F.col("kind") == BEACON, F.lit(BEACON))
            .when(F.col("is_mixed"), F.lit(MIXED))
            .when(F.col("on_record") | ~F.col("head"), F.lit(REPEAT))
            .otherwise(F.lit(ENTRY))
        ).cast("byte")
        lead = F.col("told") & F.col("first") & (~F.col("on_record") | (F.col("is_mixed") & ~F.col("old_mixed")))
        promoted = lambda c: F.when(F.col("told") & F.col("first") & F.col("is_mixed") & ~F.col("old_mixed"), F.col(f"old.{c}"))
        return own.select("anchor", "body", "doc_id", "pos", "n", verdict.alias("verdict"), lead.alias("lead"), F.col("is_mixed").alias("mixed"), promoted("doc_id").alias("old_doc"), promoted("pos").alias("old_pos"), promoted("n").alias("old_n"))

    def _merged_windows(self, rows: DataFrame) -> DataFrame:
        group = W.partitionBy("h1", "h2").orderBy("doc_id", "pos")
        # Entries of one text may be listed twice (once promoted); a window is never earlier than itself.
        head = F.first(F.struct("doc_id", "pos")).over(group)
        own = rows.repartition(self.buckets, "h1", "h2").select("h1", "h2", "doc_id", "pos", head.alias("head"), (F.row_number().over(group) == 1).alias("first"))
        known: Column = F.lit(False)
        for i, r in enumerate(self.windows):
            r = r.select("h1", "h2", F.struct("doc_id", "pos").alias(f"at{i}"))
            own = own.join(r, ["h1", "h2"], "left")
            known = known | F.col(f"at{i}").isNotNull()
        other = F.struct("doc_id", "pos") != F.col("head")
        return own.select("h1", "h2", "doc_id", "pos", (known | other).alias("earlier"), (~known & F.col("first")).alias("lead"))

    def compact(self) -> None:
        """Merge runs, two at a time, until one is left; an anchor that either run calls mixed stays so."""
        while len(self.entries) > 1:
            y, x = self.entries.pop(), self.entries.pop()
            v = lambda i: F.when(F.col(f"doc_id{i}").isNotNull(), F.struct(*(F.col(f"{c}{i}").alias(c) for c in ("doc_id", "pos", "n", "body"))))
            x, y = (r.select("anchor", *(F.col(c).alias(f"{c}{i}") for c in ("body", "doc_id", "pos", "n", "mixed"))) for i, r in enumerate((x, y)))
            both = x.join(y, "anchor", "full").withColumn("v", F.least(v(0), v(1)))
            self.entries.append(self._run(both.select("anchor", "v.body", "v.doc_id", "v.pos", "v.n", F.greatest("mixed0", "mixed1").alias("mixed")), "entries", "anchor"))
        while len(self.windows) > 1:
            y, x = self.windows.pop(), self.windows.pop()
            x, y = (r.select("h1", "h2", F.struct("doc_id", "pos").alias(f"at{i}")) for i, r in enumerate((x, y)))
            both = x.join(y, ["h1", "h2"], "full").withColumn("v", F.least("at0", "at1"))
            self.windows.append(self._run(both.select("h1", "h2", "v.doc_id", "v.pos"), "windows", "h1", "h2"))


def without(docs: DataFrame, ranges: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs`` with ``__kept`` (the words that no listed window covers, joined by one space; null where all
    words stay), ``__words`` and ``__removed``."""
    names = docs.columns
    at = names.index("text")

    def run(batches):
        for batch in batches:
            for part in chunks(batch, at):
                words, firsts = split_words(part.column(at))
                row, pos, n = _flat_ranges(part.column(len(names)))
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, np.minimum(firsts[row] + pos, firsts[row + 1]), 1)
                np.add.at(edge, np.minimum(firsts[row] + pos + n - 1 + width, firsts[row + 1]), -1)
                keep = np.cumsum(edge)[: len(words)] == 0
                counts = np.concatenate([[0], np.cumsum(keep)])[firsts]
                total, left = np.diff(firsts), np.diff(counts)
                kept = pc.binary_join(pa.ListArray.from_arrays(pa.array(counts.astype(np.int32)), words.filter(pa.array(keep))), " ")
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], kept, pa.array(total), pa.array(total - left)], [*names, "__kept", "__words", "__removed"])

    schema = docs.select(*names, F.lit("").alias("__kept"), F.lit(0).cast("long").alias("__words"), F.lit(0).cast("long").alias("__removed")).schema
    for f in schema.fields:
        f.nullable = True
    listed = _listed(ranges).withColumnRenamed("doc_id", "__id")
    return bounded(docs).join(listed, docs["doc_id"] == listed["__id"], "left").select(*names, "__ranges").mapInArrow(run, schema)


def repeated_windows(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """Ranges of all windows of ``docs`` that start earlier elsewhere, entered in ``batches`` ranges of doc_id into an index of its own."""
    kept: list[DataFrame] = []
    with scratch_scope(kept):
        kept.append(materialize(_entered(docs, batches), "ranges", "zstd"))
    return kept[0]


def _entered(docs: DataFrame, batches: int) -> DataFrame:
    index = FingerprintIndex(docs.sparkSession)
    known = docs.filter("doc_id is not null")
    cuts = known.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 10_000)).first()[0] or [] if batches > 1 else []
    edges = [None, *sorted(set(cuts)), None]
    out = None
    for low, high in zip(edges, edges[1:]):
        part = known if low is None else known.filter(F.col("doc_id") > low)
        part = part if high is None else part.filter(F.col("doc_id") <= high)
        found = index.add(part)
        out = found if out is None else out.unionAll(found)
    return out


def substring_report(docs: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", "text")
    got = without(docs, repeated_windows(docs))
    return got.select("doc_id", F.col("__words").alias("n_words"), F.col("__removed").alias("n_removed"), F.sha2("__kept", 256).alias("kept_sha256"))


def drop_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` whose texts lose their repeated words; texts that lose none stay as they are, and rows that lose all go."""
    got = without(docs, repeated_windows(docs))
    changed = F.col("__removed") > 0
    return got.filter(~changed | (F.col("__removed") < F.col("__words"))).withColumn("text", F.when(changed, F.col("__kept")).otherwise(F.col("text"))).select(*docs.columns)
