"""Operator 11: near duplicates of vectors by lattice hashing.

Unit vectors are projected at random to ``BLOCKS`` times eight dimensions, and
each eight are decoded to the nearest point of the lattice E8.  The points are
a vector's home cell in one of ``TABLES`` tables; the ``PROBES`` neighbouring
cells that cost least, by the distance to a neighbouring lattice point, are
probed too.  Two vectors meet where one's home is the other's home or probe,
and link if their cosine, in double precision, is at least the threshold.

Only different vectors enter the tables, with the number of rows that hold
them.  Near copies by the thousand are taken together first: in a cell of
``CROWD`` rows or more the row of the smallest hash is a pivot, and vectors
within half the threshold's angle of their pivot are a ball.  By the triangle
inequality all of a ball link with one another, so they are counted by the
ball's size and compared with the rest only.  Cells are cut into blocks of
about ``BLOCK`` rows, and rows of a ball that fill blocks lie in blocks of
their own, which never meet: a hot group costs what its rows cost.

A pair that meets in several cells is counted in the first of them, by the
order of tables: who meets where follows from the two vectors alone, so no
pairs are written.  Tasks put out, for each vector, its number of links found
there and one row that connects it with its component there.

At the defaults a pair of cosine 0.9 is found with a probability of some 0.99
in 64 dimensions (one of 0.92 with 0.998), by simulation; two unrelated
vectors meet in some 0.0013 of all cases.  One more block divides that by
hundreds, and asks for more tables.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components link with nothing and are components of their own; vectors of
different lengths never link; rows that repeat a vec_id are vectors each, and
one node of the components; rows of a null vec_id have no links and no
component; columns besides vec_id and embedding are left out; an empty table
gives no rows.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.graph import components
from .ann import scaled, usable
from .common import bounded, materialize, mix64, scratch_scope

THRESHOLD = 0.9
TABLES, BLOCKS, PROBES = 16, 2, 3
#: Width of a cell: what the lattice's unit is in standard deviations of a projected unit vector.
WIDTH = 2.0
SEED = 20250311
#: Rows of a cell from which it names a pivot, and rows of a block.
CROWD, BLOCK = 32, 1024
#: Rows of a cell up to which its pairs are listed together with those of other cells, and pairs compared at a time.
SMALL, PAIRS = 48, 1 << 15
#: Steps that components of unit vectors and of projections are rounded to: their products are whole numbers that doubles hold exactly.
STEPS = float(1 << 20)


def _neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of one, or eight of a half with an even number of minus signs."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) / 2 for s in product((1, -1), repeat=8) if s.count(-1) % 2 == 0]
    return np.array(out)


NEIGHBOURS = _neighbours()


def _even(x: np.ndarray) -> np.ndarray:
    """The nearest whole points of even sum: where the sum is odd, the worst rounded entry is rounded the other way."""
    whole = np.rint(x)
    off = x - whole
    odd = np.flatnonzero(whole.sum(1) % 2 != 0)
    worst = np.argmax(np.abs(off[odd]), 1)
    whole[odd, worst] += np.where(off[odd, worst] >= 0, 1, -1)
    return whole


def nearest_points(x: np.ndarray) -> np.ndarray:
    """The nearest points of E8, which is the whole points of even sum and those moved by a half in every entry."""
    a, b = _even(x), _even(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


def unit_steps(x: np.ndarray) -> np.ndarray:
    """Unit vectors in whole steps."""
    x = scaled(np.ascontiguousarray(x, np.float64))
    return np.rint(x / np.sqrt((x * x).sum(1, keepdims=True)) * STEPS)


@lru_cache(8)
def _projections(d: int) -> tuple[np.ndarray, np.ndarray]:
    """For each table ``8 * BLOCKS`` directions (orthogonal ones, where there are enough) in whole steps; odd numbers that cells are hashed by."""
    rng = np.random.default_rng([SEED, d])
    wide = 8 * BLOCKS
    turns = []
    for _ in range(TABLES):
        q = rng.standard_normal((d, wide))
        if d >= wide:
            q = np.linalg.qr(q)[0] * np.sqrt(d)
        turns.append(q)
    odd = rng.integers(0, 1 << 63, (TABLES, wide + 1), dtype=np.uint64) | np.uint64(1)
    return np.rint(np.stack(turns) / WIDTH * STEPS), odd


def cells(steps: np.ndarray) -> np.ndarray:
    """Keys (n, TABLES, 1 + PROBES): the home cell of each vector in each table, then its probes, nearest first."""
    n, d = steps.shape
    turns, odd = _projections(d)
    out = np.empty((n, TABLES, 1 + PROBES), np.uint64)
    for t in range(TABLES):
        # Whole numbers below 2^53, so no order of summation changes them.
        x = (steps @ turns[t]) / (STEPS * STEPS)
        homes, costs, moves = [], [np.zeros((n, 1))], [np.full((n, 1), -1)]
        for b in range(BLOCKS):
            own = x[:, 8 * b : 8 * b + 8]
            home = nearest_points(own)
            cost = 2 - 2 * ((own - home) @ NEIGHBOURS.T)
            near = np.sort(np.argpartition(cost, PROBES - 1, 1)[:, :PROBES], 1)
            homes.append(home)
            # All sums of one move, or none, in every block so far.
            more = np.concatenate([np.zeros((n, 1)), np.take_along_axis(cost, near, 1)], 1)
            which = np.concatenate([np.full((n, 1), -1), near], 1)
            base, back = costs[-1], moves[-1]
            costs.append((base[:, :, None] + more[:, None, :]).reshape(n, -1))
            moves.append(((back + 1)[:, :, None] * 256 + (which + 1)[:, None, :]).reshape(n, -1) - 1)
        best = np.argsort(costs[-1], 1, kind="stable")[:, : 1 + PROBES]
        chosen = np.take_along_axis(moves[-1], best, 1) + 1
        for p in range(1 + PROBES):
            key = np.full(n, odd[t, -1])
            for b in range(BLOCKS):
                move = (chosen[:, p] >> (8 * (BLOCKS - 1 - b))) & 255
                point = homes[b] + np.where((move > 0)[:, None], NEIGHBOURS[move - 1], 0)
                twice = np.rint(2 * point).astype(np.int64).view(np.uint64)
                key = key + (twice * odd[t, 8 * b : 8 * b + 8]).sum(1, dtype=np.uint64)
            out[:, t, p] = mix64(key)
    return out


def first_meeting(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The key of the first cell where pairs meet, of ``cells`` of both sides (n, TABLES, 1 + PROBES), who do meet."""
    top = np.uint64((1 << 64) - 1)
    at_a, at_b = (b == a[:, :, :1]).any(2), (a == b[:, :, :1]).any(2)
    key = np.minimum(np.where(at_a, a[:, :, 0], top), np.where(at_b, b[:, :, 0], top))
    table = np.argmax(at_a | at_b, 1)
    return key[np.arange(len(a)), table]


def _unit(x: np.ndarray) -> np.ndarray:
    x = scaled(np.ascontiguousarray(x, np.float64))
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _by_length(batch: pa.RecordBatch, column: int):
    """The batch by lengths of its vectors: rows of each, and their matrix."""
    sizes = np.diff(batch.column(column).offsets.to_numpy())
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        yield at, _matrix(batch.column(column).take(pa.array(at)), int(d))


def _placed(vectors: DataFrame) -> DataFrame:
    """``(node, key, home)``: the cells of every different vector, home or probe."""

    def run(batches):
        for batch in batches:
            for at, x in _by_length(batch, 1):
                for a in range(0, len(at), 512):
                    keys = cells(unit_steps(x[a : a + 512]))
                    n = len(keys)
                    node = batch.column(0).take(pa.array(np.repeat(at[a : a + n], TABLES * (1 + PROBES))))
                    home = np.tile(np.arange(1 + PROBES) == 0, n * TABLES)
                    yield pa.RecordBatch.from_arrays([node, pa.array(keys.reshape(-1).view(np.int64)), pa.array(home)], ["node", "key", "home"])

    return bounded(vectors.select("node", "embedding")).mapInArrow(run, "node long, key long, home boolean")


def _balls(vectors: DataFrame, placed: DataFrame, threshold: float) -> DataFrame:
    """``(node, ball)``: vectors within half the threshold's angle of the pivot of one of their crowded home cells."""
    crowd = placed.filter("home").groupBy("key").agg(F.min(F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("pivot"))).alias("p"), F.count("*").alias("n")).filter(F.col("n") >= CROWD)
    crowd = materialize(crowd.select("key", "p"), "pivots")
    asked = placed.filter("home").join(crowd, "key").groupBy("node").agg(F.min("p").alias("p")).select("node", F.col("p.pivot").alias("pivot"))
    asked = materialize(asked, "asked")
    centres = materialize(asked.select("pivot").distinct().join(vectors.select(F.col("node").alias("pivot"), F.col("embedding").alias("centre")), "pivot"), "centres")
    pairs = vectors.select("node", "embedding").join(asked, "node").join(centres, "pivot").select("node", "pivot", "embedding", "centre").filter("size(embedding) = size(centre)")
    # cos of half the angle; the slack keeps rounding from making a link of what is none.
    least = np.sqrt((1 + threshold) / 2) + 1e-9

    def run(batches):
        for batch in batches:
            for at, x in _by_length(batch, 2):
                y = _matrix(batch.column(3).take(pa.array(at)), x.shape[1])
                near = at[(_unit(x) * _unit(y)).sum(1) >= least]
                yield pa.RecordBatch.from_arrays([batch.column(i).take(pa.array(near)) for i in (0, 1)], ["node", "ball"])

    return bounded(pairs).mapInArrow(run, "node long, ball long")


def _listed(sizes: np.ndarray, offsets: np.ndarray):
    """Places ``(i, j, cell)``, i < j, of all pairs within cells of at most ``SMALL`` rows, some ``PAIRS`` at a time."""
    for s in np.unique(sizes[(sizes > 1) & (sizes <= SMALL)]).tolist():
        i, j = np.triu_indices(s, 1)
        own = np.flatnonzero(sizes == s)
        step = max(1, PAIRS // len(i))
        for a in range(0, len(own), step):
            base = offsets[own[a : a + step]]
            yield (base[:, None] + i).ravel(), (base[:, None] + j).ravel(), np.repeat(own[a : a + step], len(i))


class _Found:
    """Links found in one batch, kept if they are in the pair's first cell: counts for each row, and components."""

    def __init__(self, x: np.ndarray, node: np.ndarray, ball: np.ndarray, home: np.ndarray, rows: np.ndarray, threshold: float):
        self.u, self.node, self.ball, self.home, self.rows, self.threshold = _unit(x), node, ball, home, rows, threshold
        self.x = x
        self.links = np.zeros(len(node), np.int64)
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []
        self.known: np.ndarray = np.full(len(node), -1)
        self.cells: np.ndarray = np.zeros((0, TABLES, 1 + PROBES), np.uint64)

    def signs(self, at: np.ndarray) -> np.ndarray:
        new = np.unique(at[self.known[at] < 0])
        if len(new):
            self.known[new] = len(self.cells) + np.arange(len(new))
            self.cells = np.concatenate([self.cells, *(cells(unit_steps(self.x[new[a : a + 512]])) for a in range(0, len(new), 512))])
        return self.cells[self.known[at]]

    def take(self, i: np.ndarray, j: np.ndarray, key: np.ndarray, near: np.ndarray) -> None:
        """Pairs of rows that share the cell of ``key``, with their cosines."""
        ok = near >= self.threshold
        ok &= (self.home[i] | self.home[j]) & (self.node[i] != self.node[j]) & ((self.ball[i] != self.ball[j]) | (self.ball[i] < 0))
        i, j, key = i[ok], j[ok], key[ok]
        for a in range(0, len(i), PAIRS):
            p, q = i[a : a + PAIRS], j[a : a + PAIRS]
            first = first_meeting(self.signs(p), self.signs(q)) == key[a : a + PAIRS]
            p, q = p[first], q[first]
            np.add.at(self.links, p, self.rows[q])
            np.add.at(self.links, q, self.rows[p])
            if len(p):
                self.pairs.append((p, q))
        if sum(len(p) for p, _ in self.pairs) > 4 * PAIRS:
            self.pairs = [self.forest()]

    def forest(self) -> tuple[np.ndarray, np.ndarray]:
        """For each row that links, the first row of its component."""
        label = np.arange(len(self.node))
        if not self.pairs:
            return label[:0], label[:0]
        p, q = (np.concatenate(x) for x in zip(*self.pairs))
        while True:
            low = np.minimum(label[p], label[q])
            before = label.copy()
            for side in (p, q):
                np.minimum.at(label, label[side], low)
            label = label[label]
            if (before == label).all():
                break
        some = np.unique(np.concatenate([p, q]))
        return some, label[some]

    def batch(self, rep: np.ndarray) -> pa.RecordBatch:
        at, root = self.forest()
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (self.node[at], self.links[at], rep[at], rep[root])], ["node", "links", "a", "b"])


_MEMBER = ["node", "rep", "rows", "ball", "home"]


def _columns(batch: pa.RecordBatch, at: int) -> tuple[np.ndarray, ...]:
    """The members of cells held in list columns from ``at`` on, joined, and the vectors as a list array."""
    flat = [batch.column(at + i).flatten() for i in range(len(_MEMBER) + 1)]
    return tuple(f.to_numpy(zero_copy_only=False) for f in flat[:-1]), flat[-1]


FOUND = "node long, links long, a long, b long"


def _within(blocks: DataFrame, threshold: float) -> DataFrame:
    """Links within one block."""

    def one(batch: pa.RecordBatch, d: int) -> pa.RecordBatch:
        (node, rep, rows, ball, home), vectors = _columns(batch, 2)
        sizes = np.diff(batch.column(2).offsets.to_numpy())
        key = batch.column(0).to_numpy().view(np.uint64)
        offsets = np.cumsum(sizes) - sizes
        found = _Found(_matrix(vectors, d), node, ball, home, rows, threshold)
        for i, j, cell in _listed(sizes, offsets):
            found.take(i, j, key[cell], (found.u[i] * found.u[j]).sum(1))
        for c in np.flatnonzero(sizes > SMALL).tolist():
            a, b = offsets[c], offsets[c] + sizes[c]
            near = found.u[a:b] @ found.u[a:b].T
            i, j = np.nonzero(np.triu(near >= threshold, 1))
            found.take(i + a, j + a, np.full(len(i), key[c]), near[i, j])
        return found.batch(rep)

    def run(batches):
        for batch in batches:
            lengths = batch.column(1).to_numpy()
            for d in np.unique(lengths).tolist():
                yield one(batch.take(pa.array(np.flatnonzero(lengths == d))), d)

    return bounded(blocks.select("key", "d", *_MEMBER, "embedding")).mapInArrow(run, FOUND)


def _between(pairs: DataFrame, threshold: float) -> DataFrame:
    """Links of two blocks of one cell, a pair of blocks a row."""

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                one = batch.slice(r, 1)
                (left, v), (right, w) = _columns(one, 1), _columns(one, 2 + len(_MEMBER))
                node, rep, rows, ball, home = (np.concatenate(c) for c in zip(left, right))
                n, d = len(left[0]), len(v[0])
                found = _Found(np.concatenate([_matrix(v, d), _matrix(w, d)]), node, ball, home, rows, threshold)
                near = found.u[:n] @ found.u[n:].T
                i, j = np.nonzero(near >= threshold)
                found.take(i, j + n, np.full(len(i), one.column(0).to_numpy().view(np.uint64)[0]), near[i, j])
                yield found.batch(rep)

    return bounded(pairs).mapInArrow(run, FOUND)


def _blocks(vectors: DataFrame, placed: DataFrame, balls: DataFrame) -> DataFrame:
    """``(key, d, pure, part, block, members..., embedding)``: cells where something may be found, cut into blocks.

    ``pure`` is the ball whose rows alone a block holds, or -1.
    """
    marked = placed.join(balls, "node", "left").withColumn("ball", F.coalesce("ball", F.lit(-1)))
    worth = marked.groupBy("key").agg(F.count("*").alias("n"), F.max("home").alias("some"), F.min("ball").alias("lo"), F.max("ball").alias("hi"))
    worth = materialize(worth.filter("n > 1 and some and (lo <> hi or lo < 0)").select("key"), "cells")
    kept = materialize(marked.join(worth, "key"), "members")
    full = kept.filter("ball >= 0").groupBy("key", "ball").count().filter(F.col("count") >= BLOCK).select("key", "ball", F.col("ball").alias("pure"))
    own = kept.join(materialize(full, "full"), ["key", "ball"], "left").withColumn("pure", F.coalesce("pure", F.lit(-1)))
    own = own.join(vectors, "node").withColumn("d", F.size("embedding"))
    sizes = own.groupBy("key", "d", "pure").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    many = materialize(sizes.filter("parts > 1"), "parts")
    dealt = own.join(many, ["key", "d", "pure"], "left").withColumn("part", F.when(F.col("parts") > 1, F.pmod(F.xxhash64("node", "home"), "parts").cast("int")).otherwise(0))
    packed = dealt.groupBy("key", "d", "pure", "part").agg(F.collect_list(F.struct(*_MEMBER, "embedding")).alias("x"))
    out = packed.select("key", "d", "pure", "part", *(F.col(f"x.{c}").alias(c) for c in [*_MEMBER, "embedding"]))
    return materialize(out.withColumn("block", F.monotonically_increasing_id()), "blocks")


def _block_pairs(blocks: DataFrame) -> DataFrame:
    """``(x, y, key)``: blocks of one cell that meet; those of one ball never do."""
    light = blocks.select("key", "d", "pure", "block")
    several = light.groupBy("key", "d").count().filter("count > 1").drop("count")
    light = materialize(light.join(several, ["key", "d"], "left_semi"), "several")
    mixed, pure = light.filter("pure < 0"), light.filter("pure >= 0")
    left = mixed.select("key", "d", F.col("block").alias("x"))
    one = left.join(mixed.select("key", "d", F.col("block").alias("y")), ["key", "d"]).filter("x < y")
    two = left.join(pure.select("key", "d", F.col("block").alias("y")), ["key", "d"])
    # Blocks of different balls meet by pairs of balls.
    groups = materialize(pure.select("key", "d", "pure").distinct(), "groups")
    meet = groups.join(groups.select("key", "d", F.col("pure").alias("other")), ["key", "d"]).filter("pure < other")
    three = pure.withColumnRenamed("block", "x").join(meet, ["key", "d", "pure"]).join(pure.select("key", "d", F.col("pure").alias("other"), F.col("block").alias("y")), ["key", "d", "other"])
    return materialize(one.select("x", "y", "key").unionAll(two.select("x", "y", "key")).unionAll(three.select("x", "y", "key")), "meetings")


def _classes(rows: DataFrame) -> DataFrame:
    """``(node, embedding, rep, rows)``: every different vector once, with the smallest id of its rows and their number."""
    return materialize(rows.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("rows")).withColumn("node", F.monotonically_increasing_id()), "vectors")


def linked(vectors: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of ``vectors(node, embedding, rep, rows)``: ``(node, links)`` with rows of other vectors found, ``(a, b)`` with edges
    between their ``rep`` that connect what links, and ``(node, ball)``."""
    if not 0 < threshold < 1:
        raise ValueError("the threshold must lie between zero and one")
    placed = materialize(_placed(vectors), "placed")
    balls = materialize(_balls(vectors, placed, threshold), "balls")
    blocks = _blocks(vectors, placed, balls)
    sides = [blocks.select(F.col("block").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in [*_MEMBER, "embedding"])) for s in "xy"]
    pairs = _block_pairs(blocks).join(sides[0], "x").join(sides[1], "y")
    pairs = pairs.select("key", *(f"{c}_{s}" for s in "xy" for c in [*_MEMBER, "embedding"]))
    found = materialize(_within(blocks.filter("pure < 0"), threshold).unionAll(_between(pairs, threshold)), "found")
    near = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = balls.join(vectors.select("node", "rep", "rows"), "node")
    # A pivot may lie in the ball of another, so a ball hangs on its smallest member.
    centre = named.groupBy("ball").agg(F.min("rep").alias("b"))
    edges = found.select("a", "b").unionAll(named.join(centre, "ball").select(F.col("rep").alias("a"), "b")).filter("a <> b").distinct()
    return near, edges, balls


def near_duplicates(embeddings: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` of every row of ``embeddings(vec_id, embedding)``."""
    narrow = embeddings.schema["embedding"].dataType.simpleString() == "array<float>"
    all_ = embeddings.select("vec_id", F.col("embedding") if narrow else F.col("embedding").cast("array<double>").alias("embedding"))
    sound = usable("embedding") & F.col("vec_id").isNotNull()
    rows = all_.filter(sound)
    kept: list[DataFrame] = []
    with scratch_scope(kept):
        vectors = _classes(rows)
        near, edges, balls = linked(vectors, threshold)
        sizes = balls.join(vectors.select("node", "rows"), "node").groupBy("ball").agg(F.sum("rows").alias("whole"))
        own = vectors.join(near, "node", "left").join(balls.join(sizes, "ball"), "node", "left")
        counted = own.select("embedding", "rep", (F.coalesce("whole", "rows") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
        counted = materialize(counted, "counted")
        of_row = materialize(rows.join(counted, "embedding").select("vec_id", "rep", "n_links"), "rows")
        # An id whose rows hold several vectors ties their classes.
        several = of_row.groupBy("vec_id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).filter("lo <> hi")
        ties = of_row.join(several, "vec_id").filter("rep <> lo").select(F.col("rep").alias("a"), F.col("lo").alias("b"))
        roots = components(edges.unionAll(ties)).select(F.col("node").alias("rep"), "root")
        out = of_row.join(roots, "rep", "left").select("vec_id", "n_links", F.coalesce("root", "rep").alias("component_id"))
        rest = all_.filter(~sound).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
        kept.append(materialize(out.unionAll(rest), "components"))
    return kept[0].withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
