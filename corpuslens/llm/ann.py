"""Operator 2: approximate nearest neighbours by adaptive dimension scan.

Vectors are scaled to length one, dealt to inverted lists by their nearest
centre, and rotated by a fixed random orthogonal matrix, after which every
column block carries about the same share of a distance.  A query visits its
nearest lists.  Within a list its candidates' columns are summed block by
block; after each block a hypothesis test compares the partial distance,
scaled up, with the distance of the k-th best so far, and drops candidates
that are farther with high confidence.  Survivors are scored exactly.

Centres are fitted on a bounded sample, and so is the number of lists to
visit: the fewest that hold ``TARGET`` of the sample's true neighbours.  A
query whose lists hold fewer than ``k`` rows of other ids visits further ones.
Every row is indexed.  Lists are stored in blocks of about ``BLOCK`` rows and
joined by groups of blocks, so a value that many rows share makes more tasks,
not larger ones.

Defined results: vectors that are null, zero, or hold null or non-finite
components take no part, nor do those whose length is not the most frequent
one (of equals the smaller); components of any finite size are scored without
overflow; ties go to the smaller vec_id; rows that repeat a vec_id are
candidates each, but never of a query of that id, and as queries they are one,
to which a candidate's best score counts; other columns are left out; an empty
table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, Window as W

from .common import bounded, materialize

#: Rows that centres and the number of visited lists are fitted on at most, by smallest hash of vec_id.
SAMPLE = 20_000
#: Inverted lists at most, and rows a list for fewer.
LISTS, ROWS_A_LIST = 4096, 1000
BLOCK = 2048
QUERIES = 512
#: Blocks of a list that one task joins with the list's queries.
GROUP = 32
COLUMNS = 16
#: Share of pairs left below which they are followed one by one.
SPARSE = 0.1
#: Width of the test: a candidate goes where its scaled partial distance exceeds (1 + EPSILON / sqrt(columns seen)) times the k-th best.
EPSILON = 2.1
TARGET = 0.97
SEED = 20240607


def usable(vector: str) -> Column:
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def rotation(d: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def unit(x: np.ndarray) -> np.ndarray:
    # Scaling first keeps tiny and huge vectors from vanishing or overflowing.
    x = scaled(x.astype(np.float64))
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmax(x @ centres.T, 1)


def fit_centres(x: np.ndarray, n: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means on distinct unit vectors; a centre that loses all its rows takes the row farthest from its own."""
    x = np.unique(x, axis=0)
    rng = np.random.default_rng(SEED)
    centres = x[rng.choice(len(x), min(n, len(x)), replace=False)]
    for _ in range(rounds):
        own = _nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        norm = np.sqrt((sums * sums).sum(1, keepdims=True))
        empty = norm[:, 0] < 1e-12
        centres = np.where(empty[:, None], centres, sums / np.where(norm == 0, 1, norm))
        if empty.any():
            centres[empty] = x[np.argsort((x * centres[own]).sum(1))[: empty.sum()]]
    return centres


def fit_probes(x: np.ndarray, centres: np.ndarray, k: int, target: float = TARGET) -> int:
    """The fewest nearest lists that hold ``target`` of the ``k`` nearest neighbours of 400 of the sample's rows."""
    q = x[:: max(1, len(x) // 400)][:400]
    own = _nearest(x, centres)
    score = q @ x.T
    score[np.arange(len(q)), np.arange(0, len(x), max(1, len(x) // 400))[: len(q)]] = -2
    near = np.argsort(-score, 1)[:, : min(k, max(len(x) - 1, 1))]
    place = np.argsort(np.argsort(-(q @ centres.T), 1), 1)
    ranks = np.sort(np.take_along_axis(place, own[near], 1).ravel())
    return int(ranks[min(len(ranks) - 1, int(np.ceil(target * len(ranks))) - 1)]) + 1


def adaptive_scan(queries: np.ndarray, rotated: np.ndarray, k: int, first: int = 256, rows: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Pairs ``(query, row)`` that survive the tests, of rotated unit queries (q x d) and rows (n x d), in order of query.

    All queries go through a strip of rows together, a block of columns at a time as one matrix product; once few
    pairs are left, later blocks touch only those.
    """
    (m, d), n = queries.shape, len(rotated)
    near = queries @ rotated[:first].T
    at = [np.repeat(np.arange(m), near.shape[1])], [np.tile(np.arange(near.shape[1]), m)]
    best = -np.sort(-near, 1)[:, :k]
    for a in range(first, n, rows):
        strip = rotated[a : a + rows]
        # Squared distance of unit vectors from their cosine; the slack covers rounding.
        radius = 2 - 2 * best[:, -1] + 1e-9 if best.shape[1] >= k else np.full(m, np.inf)
        q = i = None
        table = np.zeros((m, len(strip)))
        partial = np.zeros(0)
        for c in range(0, d, COLUMNS):
            seen = min(c + COLUMNS, d)
            limit = radius * (1 + EPSILON / np.sqrt(seen)) ** 2 if seen < d else radius + 1e-9
            if q is None:
                x, y = queries[:, c:seen], strip[:, c:seen]
                table += (x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * (x @ y.T)
                alive = table * (d / seen) <= limit[:, None]
                # Dropped pairs stay dropped, also while most are left and all are summed on by products of blocks.
                table[~alive] = np.inf
                if seen == d or np.count_nonzero(alive) < SPARSE * alive.size:
                    q, i = np.nonzero(alive)
                    partial = table[q, i]
            else:
                diff = queries[q, c:seen] - strip[i, c:seen]
                partial += (diff * diff).sum(1)
                ok = partial * (d / seen) <= limit[q]
                q, i, partial = q[ok], i[ok], partial[ok]
            if q is not None and not len(q):
                break
        if len(q):
            at[0].append(q)
            at[1].append(i + a)
            # The k best of each query so far: survivors of this strip in a table as wide as the most of any query, k at most.
            order = np.lexsort((partial, q))
            q, cosine = q[order], 1 - partial[order] / 2
            place = np.arange(len(q)) - np.searchsorted(q, q)
            keep = place < k
            more = np.full((m, k), -2.0)
            more[q[keep], place[keep]] = cosine[keep]
            best = -np.sort(-np.concatenate([best, more], 1), 1)[:, :k]
    q, i = np.concatenate(at[0]), np.concatenate(at[1])
    order = np.argsort(q, kind="stable")
    return q[order], i[order]


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, so that the largest component lies in [0.5, 1): no product overflows, and no cosine changes."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])


def block_nearest(ids: np.ndarray, own: np.ndarray, query_ids: np.ndarray, asked: np.ndarray, turn: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every query the ``k`` nearest rows of one block by exact cosine: place of the query, place of the row, cosine."""
    own, asked = scaled(own), scaled(asked)
    norms, lengths = (np.sqrt((x * x).sum(1)) for x in (own, asked))
    # Each query's own rows stand in for none of the k: as many more are looked for.
    _, own_rows = np.unique(ids, return_counts=True)
    extra = int(own_rows.max()) if np.isin(query_ids, ids).any() else 0
    q, i = adaptive_scan((asked / lengths[:, None]) @ turn, (own / norms[:, None]) @ turn, k + extra)
    other = query_ids[q] != ids[i]
    q, i = q[other], i[other]
    score = np.concatenate([(own[j] * asked[p]).sum(1) / (norms[j] * lengths[p]) for p, j in ((q[a : a + 65536], i[a : a + 65536]) for a in range(0, max(len(q), 1), 65536))])
    order = np.lexsort((ids[i], -score, q))
    q, i, score = q[order], i[order], score[order]
    keep = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[keep], i[keep], score[keep]


def _matrix(cell: pa.ListScalar, d: int) -> np.ndarray:
    return cell.values.to_numpy(zero_copy_only=False).reshape(-1, d)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, target: float = TARGET) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest found of every vec_id of ``queries`` among ``vectors``, both ``(vec_id, embedding)``."""
    spark = vectors.sparkSession
    shape = "query_id long, rank int, vec_id long, score double"
    kind = lambda df: df.filter(F.col("vec_id").isNotNull() & usable("embedding")).select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows, asked = kind(vectors), kind(queries)
    sizes = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], shape)
    d, total = sizes[0].d, sizes[0]["count"]
    rows, asked = (x.filter(F.size("embedding") == d) for x in (rows, asked))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").toArrow().column(0)
    x = unit(np.concatenate([_matrix(c, d) for c in sample]))
    centres = fit_centres(x, max(1, min(LISTS, total // ROWS_A_LIST)))
    probes = fit_probes(x, centres, k, target)
    turn = rotation(d)

    def dealt(batches):
        """Every row with its nearest centre."""
        for batch in batches:
            if batch.num_rows:
                v = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                yield pa.RecordBatch.from_arrays([pa.array(_nearest(unit(v), centres).astype(np.int32)), batch.column(0), batch.column(1)], ["list", "vec_id", "embedding"])

    owned = materialize(bounded(rows).mapInArrow(dealt, "list int, vec_id long, embedding array<double>").withColumn("row", F.monotonically_increasing_id()), "dealt")
    # At most LISTS rows, here and where they are broadcast.
    counts = owned.groupBy("list").agg(F.count("*").alias("n")).collect()
    size_of = np.zeros(len(centres), np.int64)
    size_of[[r.list for r in counts]] = [r.n for r in counts]
    # A query's own rows are no candidates: lists are visited until they hold k others, or all lists are.
    repeats = asked.select("vec_id").distinct().join(rows.select("vec_id"), "vec_id").groupBy("vec_id").agg(F.count("*").alias("own"))
    repeated = materialize(asked.join(repeats, "vec_id", "left").select("vec_id", "embedding", F.coalesce("own", F.lit(0)).alias("own")), "asked")

    def visits(batches):
        """Every query with the lists it visits, nearest first."""
        for batch in batches:
            if batch.num_rows:
                v = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                near = np.argsort(-(unit(v) @ centres.T), 1, kind="stable")
                need = k + batch.column(2).to_numpy()
                held = np.cumsum(size_of[near], 1)
                stop = np.maximum((held < need[:, None]).sum(1) + 1, probes)
                at, place = np.nonzero(np.arange(near.shape[1]) < stop[:, None])
                lists = near[at, place]
                some = size_of[lists] > 0
                yield pa.RecordBatch.from_arrays([pa.array(lists[some].astype(np.int32)), *(batch.column(j).take(pa.array(at[some])) for j in (0, 1))], ["list", "vec_id", "embedding"])

    visited = materialize(bounded(repeated).mapInArrow(visits, "list int, vec_id long, embedding array<double>"), "visits")

    def blocks(df: DataFrame, size: int, names: list[str], parts: Column) -> DataFrame:
        one = df.withColumn("part", F.pmod(F.xxhash64(names[0], "list"), parts)).groupBy("list", "part").agg(F.collect_list(F.struct(*names, "embedding")).alias("x"))
        return one.select("list", "part", *(F.col(f"x.{n}").alias(n) for n in names), F.flatten("x.embedding").alias("flat"))

    asked_of = visited.groupBy("list").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("asked_parts"))
    lists = spark.createDataFrame([(int(r.list), int(-(-r.n // BLOCK)), int(-(-r.n // (BLOCK * GROUP)))) for r in counts], "list int, parts int, groups int")
    index = materialize(blocks(owned.join(F.broadcast(lists), "list"), BLOCK, ["row", "vec_id"], F.col("parts")), "index")
    looking = materialize(blocks(visited.join(F.broadcast(asked_of), "list"), QUERIES, ["vec_id"], F.col("asked_parts")), "queries")
    # A list of many rows is dealt to groups of GROUP blocks, each of which meets its queries in a task of its own.
    left = index.join(F.broadcast(lists), "list").select("list", F.pmod("part", "groups").cast("int").alias("group"), "row", F.col("vec_id").alias("ids"), "flat")
    right = looking.join(F.broadcast(lists), "list").select("list", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"), F.col("vec_id").alias("query_ids"), F.col("flat").alias("query_flat"))
    pairs = left.join(right, ["list", "group"]).select("row", "ids", "flat", "query_ids", "query_flat")

    def search(batches):
        for batch in batches:
            for row, ids, flat, qids, qflat in zip(*(batch.column(i) for i in range(5))):
                row, ids, qids = (x.values.to_numpy() for x in (row, ids, qids))
                q, i, score = block_nearest(ids, _matrix(flat, d), qids, _matrix(qflat, d), turn, k)
                yield pa.RecordBatch.from_arrays([pa.array(qids[q]), pa.array(row[i]), pa.array(ids[i]), pa.array(score)], ["query_id", "row", "vec_id", "score"])

    found = bounded(pairs).mapInArrow(search, "query_id long, row long, vec_id long, score double")
    # Rows that repeat a query's id are one query: a candidate counts once, by its best score.
    best = found.repartition("query_id").groupBy("query_id", "row", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id", "row"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest_report(embeddings: DataFrame, every: int = 50) -> DataFrame:
    return nearest(embeddings, embeddings.filter(F.col("vec_id") % every == 0))
