"""Lattice hashing: the decoder, recall and links by brute force, crowds, odd vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslens.llm import lattice_links as L

SCHEMA = "vec_id long, embedding array<float>"


def by_hand(rows, threshold=0.9):
    """rows: (vec_id, vector); all pairs in double precision."""
    sound = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    root = {i: i for i, _ in rows if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = []
    u = [v / np.abs(v).max() for _, v in sound]
    u = [v / np.sqrt(v @ v) for v in u]
    for a, (i, _) in enumerate(sound):
        n = 0
        for b, (j, _) in enumerate(sound):
            if a != b and len(u[a]) == len(u[b]) and u[a] @ u[b] >= threshold:
                n += 1
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
        links.append((i, n))
    odd = [(i, 0) for i, v in rows if not any(v is w for w in [v]) or not (i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v))]
    out = [(i, n, find(i), find(i) == i) for i, n in links] + [(i, 0, i, True) for i, _ in odd]
    return sorted(out, key=str)


def run(spark, rows, threshold=0.9):
    return sorted(map(tuple, L.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(5), threshold).collect()), key=str)


def near(rng, x, cosine):
    z = rng.standard_normal(len(x))
    z -= (z @ x) / (x @ x) * x
    return cosine * x / np.sqrt(x @ x) + np.sqrt(1 - cosine**2) * z / np.sqrt(z @ z)


def test_decoder_finds_the_nearest_point():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((2000, 8)) * 2
    p = L.nearest_points(x)
    assert ((2 * p == np.rint(2 * p)).all()) and ((p % 1 == p[:, :1] % 1).all()) and (p.sum(1) % 2 == 0).all()
    # No neighbour is nearer, and none is farther than the covering radius.
    own = ((x - p) ** 2).sum(1)
    assert (own <= 1 + 1e-9).all()
    for v in L.NEIGHBOURS:
        assert (own <= ((x - p - v) ** 2).sum(1) + 1e-9).all()
    assert len(L.NEIGHBOURS) == 240 and len({tuple(v) for v in L.NEIGHBOURS}) == 240 and np.allclose((L.NEIGHBOURS**2).sum(1), 2)


def test_probes_are_the_cheapest_neighbouring_cells():
    rng = np.random.default_rng(1)
    keys = L.cells(L.unit_steps(rng.standard_normal((50, 64))))
    assert keys.shape == (50, L.TABLES, 1 + L.PROBES)
    assert all(len(set(k)) == 1 + L.PROBES for row in keys.tolist() for k in row)
    # The same rows in other company have the same cells.
    x = rng.standard_normal((333, 20))
    assert (L.cells(L.unit_steps(x))[100:107] == L.cells(L.unit_steps(x[100:107].copy()))).all()


def test_recall_at_the_threshold():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((1500, 64))
    for cosine, least in ((0.9, 0.98), (0.93, 0.99), (0.97, 0.998)):
        y = np.stack([near(rng, v, cosine) for v in x])
        a, b = L.cells(L.unit_steps(x)), L.cells(L.unit_steps(y))
        met = ((b == a[:, :, :1]) | (a == b[:, :, :1])).any((1, 2)).mean()
        assert met >= least, (cosine, met)


def test_first_meeting_is_one_cell_of_both():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((400, 64))
    y = np.stack([near(rng, v, 0.95) for v in x])
    a, b = L.cells(L.unit_steps(x)), L.cells(L.unit_steps(y))
    met = ((b == a[:, :, :1]) | (a == b[:, :, :1])).any((1, 2))
    key, back = L.first_meeting(a[met], b[met]), L.first_meeting(b[met], a[met])
    assert (key == back).all()
    assert all(k in set(p.ravel().tolist()) & set(q.ravel().tolist()) for k, p, q in zip(key.tolist(), a[met], b[met]))


def test_chains_groups_and_copies_by_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [rng.standard_normal(64) for _ in range(120)]
    for v in rows[:30]:
        rows += [near(rng, v, c) for c in rng.uniform(0.93, 0.999, 3)]
    chain = rows[40]
    for _ in range(6):
        rows.append(chain := near(rng, chain, 0.96))
    rows += [near(rng, rows[50], 0.99) for _ in range(90)] + [rows[60]] * 45 + [rows[50]] * 5
    rows = [(int(i), np.float32(v).tolist()) for i, v in zip(rng.permutation(len(rows)), rows)]
    assert run(spark, rows) == by_hand(rows)


def test_crowds_are_cut_into_blocks_and_balls(spark, monkeypatch):
    rng = np.random.default_rng(5)
    monkeypatch.setattr(L, "BLOCK", 16)
    monkeypatch.setattr(L, "CROWD", 8)
    a, b, c = (rng.standard_normal(32) for _ in range(3))
    rows = [near(rng, a, 0.995) for _ in range(150)] + [near(rng, b, 0.97) for _ in range(80)] + [near(rng, c, 0.955) for _ in range(60)]
    # A second crowd beside the first, linked with only some of it.
    rows += [near(rng, near(np.random.default_rng(6), a, 0.93), 0.99) for _ in range(60)]
    rows = [(i, np.float32(v).tolist()) for i, v in enumerate(rows)]
    got, want = run(spark, rows), by_hand(rows)
    assert [r[0] for r in got] == [r[0] for r in want] and [r[2:] for r in got] == [r[2:] for r in want]
    found, there = sum(r[1] for r in got), sum(r[1] for r in want)
    assert 0.99 * there <= found <= there and all(g[1] <= w[1] for g, w in zip(got, want))
    vectors = L._classes(spark.createDataFrame(rows, SCHEMA))
    placed = L._placed(vectors)
    balls = L._balls(vectors, placed, 0.9)
    assert balls.count() >= 150
    blocks = L._blocks(vectors, placed, balls)
    assert blocks.filter("pure >= 0").count() > 0 and blocks.select(F.max(F.size("node"))).first()[0] <= 4 * L.BLOCK
    pairs = L._block_pairs(blocks)
    pure = {r.block: r.pure for r in blocks.collect()}
    assert all(pure[r.x] != pure[r.y] or pure[r.x] < 0 for r in pairs.collect())


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0] * 4), (4, [1.0, None, 0.0, 0.0]), (5, [nan, 1.0, 0.0, 0.0]), (6, [inf, 1.0, 0.0, 0.0]), (7, [1.0, 0.0, 0.0, 0.0]), (8, [2.0, 0.1, 0.0, 0.0]), (9, [1e-38, 0.0, 0.0, 0.0]), (10, [3e38, 0.0, 0.0, -0.0])]
    rows += [(11, [1.0, 0.0, 0.0]), (12, [1.0, 0.01, 0.0]), (13, [1.0]), (14, [-2.0]), (15, [3.0])]
    assert run(spark, rows) == by_hand(rows)
    # Rows of one id are one node; a null id takes no part.
    twice = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.01, 1.0]), (3, [1.0, 0.01]), (None, [1.0, 0.0])]
    got = run(spark, twice)
    assert got == sorted([(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (None, 0, None, True)], key=str)


def test_empty_tables_and_other_columns(spark):
    df = spark.createDataFrame([(5, [1.0, 0.0]), (3, [1.0, 0.1])], "vec_id long, embedding array<double>").selectExpr("*", "1 as node", "2 as rep", "3 as key", "4 as ball", "5 as d")
    assert sorted(map(tuple, L.near_duplicates(df).collect())) == [(3, 1, 3, True), (5, 1, 3, False)]
    assert L.near_duplicates(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        L.near_duplicates(df, 1.5)
