"""Pairs of similar vectors, duplicate clusters and the page to keep."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import materialize
from .graph import components, with_ordinal
from .scan import running_average

BLOCK = 1024
#: Blocks that meet in one task, squared.
GROUP = 16
#: Share of a block pair's pairs below which they are followed one by one.
FEW = 0.05
DEFAULT_THRESHOLD = 0.92


def similar_pairs(vectors: DataFrame, threshold: float = DEFAULT_THRESHOLD, key: str = "url", vector: str = "vector") -> DataFrame:
    """``(a, b, similarity)`` of all pairs a < b with cosine of at least ``threshold``; none is missed.

    By the triangle inequality of angles, two vectors within the threshold's angle lie within that angle
    of each other as seen from any pivot, so a row meets only its own band of pivot angles and the next.
    Bands are cut into blocks, and blocks meet by groups of blocks a task.  Where vectors lie all about, as random ones
    do, bands prune little; there the filter of ``near_in_blocks`` leaves few pairs to be compared in all their columns.
    Null, empty and zero vectors meet none, nor do those with null or non-finite components.
    """
    pairs, kind = _meetings(vectors, threshold, key, vector)

    def multiply(batches):
        for batch in batches:
            for d, same, ids1, flat1, ids2, flat2 in zip(*batch.columns):
                d, a, b = d.as_py(), ids1.values, ids2.values
                i, j, near, _ = near_in_blocks(flat1.values.to_numpy().reshape(-1, d), flat2.values.to_numpy().reshape(-1, d), threshold, same.as_py())
                yield pa.RecordBatch.from_arrays([a.take(pa.array(i)), b.take(pa.array(j)), pa.array(near)], ["a", "b", "similarity"])

    found = pairs.mapInArrow(multiply, f"a {kind}, b {kind}, similarity double")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity").filter("a < b")


def compared_pairs(vectors: DataFrame, threshold: float = DEFAULT_THRESHOLD, key: str = "url", vector: str = "vector") -> DataFrame:
    """``(met, compared)``, one row: pairs whose blocks meet, and those of them compared in all their columns by ``similar_pairs``."""
    pairs, _ = _meetings(vectors, threshold, key, vector)

    def count(batches):
        for batch in batches:
            for d, same, _, flat1, _, flat2 in zip(*batch.columns):
                x, y = (f.values.to_numpy().reshape(-1, d.as_py()) for f in (flat1, flat2))
                met = len(x) * (len(x) - 1) // 2 if same.as_py() else len(x) * len(y)
                yield pa.RecordBatch.from_arrays([pa.array([met]), pa.array([near_in_blocks(x, y, threshold, same.as_py())[3]])], ["met", "compared"])

    return pairs.mapInArrow(count, "met long, compared long").agg(F.coalesce(F.sum("met"), F.lit(0)).alias("met"), F.coalesce(F.sum("compared"), F.lit(0)).alias("compared"))


@lru_cache(8)
def _rotation(d: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(d).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def turned(x: np.ndarray) -> np.ndarray:
    """Rows as unit vectors under a fixed rotation, which changes no cosine; a row of length zero stays zero."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])
    return x / np.maximum(np.sqrt((x * x).sum(1)), 1e-300)[:, None] @ _rotation(x.shape[1])


def near_in_blocks(x: np.ndarray, y: np.ndarray, threshold: float, same: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Pairs ``(i, j)`` of rows with a cosine of at least ``threshold``, the cosines, and how many pairs were compared in full.

    Rows are ``turned``: unit vectors under a fixed rotation, so that any columns hold about their share of the length.
    What the columns seen so far can still become is bounded by the product of the lengths of the rest (Cauchy and
    Schwarz), so a pair whose bound stays below the threshold is left, and no other.  After an eighth, a quarter and a
    half of the columns the survivors are counted; once they are few they alone are followed, else all are multiplied.
    """
    d, i, j = x.shape[1], None, None
    for stop in sorted({max(d // 8, 1), d // 4, d // 2} - {0, d}):
        # The lengths of the rest go along as one more column.
        u, v = (np.concatenate([w[:, :stop], np.sqrt((w[:, stop:] ** 2).sum(1, keepdims=True))], 1) for w in (x, y))
        if i is None:
            may = u @ v.T >= threshold - 1e-9
            if np.count_nonzero(may) <= FEW * may.size:
                i, j = np.nonzero(np.triu(may, 1) if same else may)
        else:
            may = np.concatenate([np.zeros(0, bool), *((u[i[a : a + 65536]] * v[j[a : a + 65536]]).sum(1) >= threshold - 1e-9 for a in range(0, len(i), 65536))])
            i, j = i[may], j[may]
    if i is None:
        near = x @ y.T
        i, j = np.nonzero(np.triu(near >= threshold, 1) if same else near >= threshold)
        return i, j, near[i, j], len(x) * (len(x) - 1) // 2 if same else near.size
    near = np.concatenate([np.zeros(0), *((x[i[a : a + 65536]] * y[j[a : a + 65536]]).sum(1) for a in range(0, len(i), 65536))])
    keep = near >= threshold
    return i[keep], j[keep], near[keep], len(i)


def _meetings(vectors: DataFrame, threshold: float, key: str, vector: str) -> tuple[DataFrame, str]:
    """``(d, same, ids1, flat1, ids2, flat2)``: pairs of blocks that meet, and the type of ids."""
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")).filter("id is not null and v is not null and size(v) > 0 and not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity'))")
    kind = rows.schema["id"].dataType.simpleString()
    width = max(math.acos(min(1.0, max(-1.0, threshold))), 1e-3) + 1e-6

    def banded(batches):
        for batch in batches:
            sizes = np.diff(batch.column(1).offsets.to_numpy())
            for d in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == d)
                x = turned(batch.column(1).take(pa.array(at)).flatten().to_numpy().reshape(-1, d))
                pivot = np.cos(np.arange(d) * 2.399963 + 0.5)
                sound = (x * x).sum(1) > 0.5
                bands = np.arccos(np.clip(x @ pivot / math.sqrt(float(pivot @ pivot)), -1, 1)) // width
                v = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * d), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), v, pa.array(bands.astype(np.int32), mask=~sound)], ["id", "v", "band"])

    placed = materialize(rows.mapInArrow(banded, f"id {kind}, v array<double>, band int").filter("band is not null"), "banded")
    sizes = placed.groupBy("band", F.size("v").alias("d")).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    dealt = placed.withColumn("d", F.size("v")).join(sizes, ["band", "d"]).withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int"))
    blocks = materialize(dealt.groupBy("band", "d", "part", "parts").agg(F.collect_list("id").alias("ids"), F.flatten(F.collect_list("v")).alias("flat")), "blocks")
    # Blocks meet by groups of GROUP, a key for each two groups, so that a band of any size is many tasks.
    group = F.floor(F.col("part") / GROUP).cast("int")
    groups = F.ceil(F.col("parts") / GROUP).cast("int")
    own = blocks.select("d", "band", "part", group.alias("group"), groups.alias("groups"), "ids", "flat")
    near = materialize(own.select("d", "band", "groups").distinct(), "groups")
    # The first of a pair lies in the same band or the one below; within a band in the same group or one before.
    left = own.join(near.select("d", F.explode(F.array("band", F.col("band") - 1)).alias("band"), F.col("band").alias("b2"), F.col("groups").alias("more")), ["d", "band"])
    left = left.withColumn("g2", F.explode(F.when(F.col("b2") == F.col("band"), F.sequence("group", F.col("more") - 1)).otherwise(F.sequence(F.lit(0), F.col("more") - 1))))
    left = left.select("d", "b2", "g2", F.col("band").alias("b1"), F.col("group").alias("g1"), F.col("part").alias("p1"), F.col("ids").alias("ids1"), F.col("flat").alias("flat1"))
    meet = left.select("d", "b2", "g2", "b1", "g1").distinct()
    right = own.select("d", F.col("band").alias("b2"), F.col("group").alias("g2"), F.col("part").alias("p2"), F.col("ids").alias("ids2"), F.col("flat").alias("flat2")).join(meet, ["d", "b2", "g2"])
    pairs = left.join(right, ["d", "b2", "g2", "b1", "g1"]).filter("b2 > b1 or p2 >= p1").select("d", F.expr("b1 = b2 and p1 = p2").alias("same"), "ids1", "flat1", "ids2", "flat2")

    return pairs, kind


def clusters(pairs: DataFrame) -> DataFrame:
    """``(member, root, cluster_id)``; ids follow the order of the smallest members."""
    members = materialize(components(pairs.select("a", "b")), "members")
    named = with_ordinal(members.select("root").distinct(), "root").select("root", F.format_string("cl_%03d", "ordinal").alias("cluster_id"))
    return members.join(named, "root").select(F.col("node").alias("member"), "root", "cluster_id")


def cluster_rollup(pairs: DataFrame, member_clusters: DataFrame) -> DataFrame:
    """``(cluster_id, member_urls, size, avg_similarity)``; the average runs over a cluster's pairs in order, in tasks of any number."""
    own = pairs.join(member_clusters.select(F.col("member").alias("a"), "cluster_id"), "a")
    averages = running_average(own)
    members = member_clusters.groupBy("cluster_id").agg(F.sort_array(F.collect_list("member")).alias("member_urls"), F.count("*").alias("size"))
    return members.join(averages, "cluster_id").select("cluster_id", "member_urls", "size", "avg_similarity")


def canonical_members(members: DataFrame) -> DataFrame:
    """``(cluster_id, canonical)`` of ``members(cluster_id, url, word_count, last_modified)``: most words; then, if the
    first by url among those has a date, the smallest date; then the smallest url."""
    group = W.partitionBy("cluster_id")
    top = members.withColumn("most", F.max("word_count").over(group)).filter("word_count = most")
    first = F.first(F.coalesce("last_modified", F.lit(""))).over(group.orderBy("url"))
    dated = F.when(F.coalesce("last_modified", F.lit("")) == "", None).otherwise(F.col("last_modified"))
    key = F.when(first == "", F.lit(None).cast("string")).otherwise(dated)
    rank = F.row_number().over(group.orderBy(F.col("key").asc_nulls_last(), "url"))
    return top.withColumn("key", key).withColumn("rank", rank).filter("rank = 1").select("cluster_id", F.col("url").alias("canonical"))


def report_canonical_members(members: DataFrame) -> DataFrame:
    """The report's own rule: most words, then the smallest url."""
    best = F.min_by(F.col("url"), F.struct(-F.col("word_count"), F.col("url")))
    return members.groupBy("cluster_id").agg(best.alias("canonical"))


def fake_embedding(text: str, dims: int = 8) -> list[float]:
    """Deterministic stand-in for a model: FNV-1a of (i, text) mod 1000, its sine, scaled to length one in 32 bits."""
    raw = text.encode()
    out = np.zeros(dims, np.float32)
    for i in range(dims):
        h = 14695981039346656037
        for b in bytes([i]) + raw:
            h = ((h ^ b) * 1099511628211) & 0xFFFFFFFFFFFFFFFF
        out[i] = np.float32(math.sin(float(h % 1000)))
    total = np.float32(0)
    for x in out:
        total = np.float32(total + x * x)
    return (out / np.float32(math.sqrt(float(total)))).tolist() if total else out.tolist()


_FNV_START, _FNV_PRIME = 14695981039346656037, 1099511628211
#: The sine of every number that a hash may leave.
_SINES = np.array([math.sin(float(i)) for i in range(1000)], np.float32)
#: Texts left at a byte's place from which they are hashed one by one.
_ONE_BY_ONE = 8


def fake_embeddings(texts: list[str], dims: int = 8) -> np.ndarray:
    """``fake_embedding`` of many texts at once: hashes of all texts and dimensions go on together, a byte's place at a time."""
    raw = [t.encode() for t in texts]
    order = sorted(range(len(raw)), key=lambda i: -len(raw[i]))
    sizes = np.array([len(raw[i]) for i in order], np.int64)
    flat = np.frombuffer(b"".join(raw[i] for i in order), np.uint8)
    firsts = np.cumsum(sizes) - sizes
    h = np.full((len(raw), dims), _FNV_START, np.uint64)
    h = (h ^ np.arange(dims, dtype=np.uint64)) * np.uint64(_FNV_PRIME)
    at, left = 0, len(raw)
    while True:
        # Texts come by length, so those that go on are the first ones.
        left = int(np.searchsorted(-sizes[:left], -at, "left"))
        if left < _ONE_BY_ONE:
            break
        h[:left] = (h[:left] ^ flat[firsts[:left] + at][:, None].astype(np.uint64)) * np.uint64(_FNV_PRIME)
        at += 1
    for k in range(left):
        rest = raw[order[k]][at:]
        for d in range(dims):
            x = int(h[k, d])
            for b in rest:
                x = ((x ^ b) * _FNV_PRIME) & 0xFFFFFFFFFFFFFFFF
            h[k, d] = x
    out = np.empty((len(raw), dims), np.float32)
    out[order] = _SINES[(h % np.uint64(1000)).astype(np.int64)]
    total = np.zeros(len(raw), np.float32)
    for d in range(dims):
        total = total + out[:, d] * out[:, d]
    length = np.sqrt(total.astype(np.float64)).astype(np.float32)
    return out / np.where(total > 0, length, np.float32(1))[:, None]


fake_embedding.batch = fake_embeddings


def embedded(pages: DataFrame, embed=fake_embedding, key: str = "url", text: str = "body_text") -> DataFrame:
    """``(url, vector)`` by any function of a text, in Arrow batches: its attribute ``batch``, a function of a list of texts
    to a matrix, is called once a batch if it has one, else the function once a row."""

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            if many := getattr(embed, "batch", None):
                x = np.ascontiguousarray(many(texts), np.float32)
                n, d = x.shape
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * d), pa.array(x.ravel()))
            else:
                vectors = pa.array([embed(t) for t in texts], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), vectors], ["url", "vector"])

    return pages.select(F.col(key).alias("url"), F.col(text)).mapInArrow(run, "url string, vector array<float>")


def packed(vector: Column) -> Column:
    """32-bit little-endian floats, one after another; null stays null."""

    @F.pandas_udf("binary")
    def run(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None else pack_vector(x))

    return run(vector)


def unpacked(raw: Column) -> Column:
    """The floats of ``packed`` bytes."""

    @F.pandas_udf("array<float>")
    def run(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None else np.frombuffer(x, "<f4"))

    return run(raw)


def pack_vector(v: list[float]) -> bytes:
    return np.asarray(v, "<f4").tobytes()


def unpack_vector(raw: bytes, dims: int) -> list[float]:
    if len(raw) != 4 * dims:
        raise ValueError(f"{len(raw)} bytes do not hold {dims} floats")
    return np.frombuffer(raw, "<f4").tolist()
