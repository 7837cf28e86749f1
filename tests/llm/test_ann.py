"""Operator 2: recall against brute force, exact scores, edge cases."""

import numpy as np

from corpuslens.llm import ann


def brute_force(rows, k=5, every=50):
    ok = [(i, np.array(v, float)) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v in ok:
        if i % every == 0:
            near = sorted((-float(np.dot(v, w) / (np.linalg.norm(v) * np.linalg.norm(w))), j) for j, w in ok if j != i)[:k]
            out[i] = [(j, -s) for s, j in near]
    return out


def grouped(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        own = out.setdefault(r.query_id, [])
        own.append((r.vec_id, r.score))
        assert r["rank"] == len(own)
    return out


def test_recall_and_scores(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    want, got = brute_force(rows), grouped(ann.nearest_report(table))
    assert set(got) == set(want)
    hits = sum(len({j for j, _ in want[q]} & {j for j, _ in got[q]}) for q in want)
    assert hits >= 0.95 * 5 * len(want)
    vectors = {i: np.array(v, float) for i, v in rows}
    for q, near in got.items():
        assert len(near) == 5 and near == sorted(near, key=lambda x: (-x[1], x[0]))
        for j, s in near:
            assert abs(s - vectors[q] @ vectors[j] / np.linalg.norm(vectors[q]) / np.linalg.norm(vectors[j])) < 1e-12


def test_many_lists_and_hot_vector(spark):
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((12, 24)) * 3
    rows = [(i, (centres[i % 12] + rng.standard_normal(24)).astype(np.float32).tolist()) for i in range(3000)]
    rows += [(10_000 + i, rows[0][1]) for i in range(1500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    old = ann.ROWS_A_LIST, ann.BLOCK, ann.QUERIES
    ann.ROWS_A_LIST, ann.BLOCK, ann.QUERIES = 100, 300, 16
    try:
        got = grouped(ann.nearest_report(df))
    finally:
        ann.ROWS_A_LIST, ann.BLOCK, ann.QUERIES = old
    want = brute_force(rows)
    assert set(got) == set(want)
    close = sum(abs(a[1] - b[1]) < 1e-9 for q in want for a, b in zip(got[q], want[q]))
    assert close >= 0.9 * 5 * len(want)
    assert [j for j, _ in got[0]] == [10_000, 10_001, 10_002, 10_003, 10_004]


def test_unusable_vectors_and_few_rows(spark):
    rows = [(0, [1.0, 0.0]), (50, [1.0, 1.0]), (1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, [float("inf"), 1.0]), (6, [1e-30, 1e-30]), (7, [1.0, 2.0, 3.0]), (100, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as list", "2 as score")
    got = grouped(ann.nearest_report(df))
    assert {q: [j for j, _ in v] for q, v in got.items()} == {0: [6, 50], 50: [6, 0]}
    assert ann.nearest_report(df.limit(0)).count() == 0
    assert ann.nearest_report(spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<double>")).count() == 0


def test_short_lists_are_filled_up(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i * 7 + 1, (np.r_[1, np.zeros(7)] + 0.01 * rng.standard_normal(8)).tolist()) for i in range(3000) if (i * 7 + 1) % 50]
    lone = rng.standard_normal((3, 8))
    lone[:, 0] = -9
    rows += [(50 * i, v.tolist()) for i, v in zip((1000, 2000, 3000), lone)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    # One list holds nothing but the three queries.
    monkeypatch.setattr(ann, "fit_centres", lambda x, n: np.eye(8)[[0, 0]] * [[1], [-1]])
    monkeypatch.setattr(ann, "fit_probes", lambda *_: 1)
    got, want = grouped(ann.nearest_report(df)), brute_force(rows)
    assert set(got) == set(want) == {50_000, 100_000, 150_000}
    for q in want:
        assert [j for j, _ in got[q]] == [j for j, _ in want[q]]


def test_repeated_queries_and_huge_components(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(6).tolist()) for i in range(40)]
    rows += [(50, rows[3][1]), (50, rows[8][1]), (20, rows[20][1]), (51, (np.array(rows[9][1]) * 1e160).tolist()), (52, (np.array(rows[9][1]) * 1e-170).tolist()), (100, (rng.standard_normal(6) * 1e300).tolist())]
    got = grouped(ann.nearest_report(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    unit = lambda v: np.array(v) / np.abs(v).max()
    cosine = lambda a, b: float(unit(a) @ unit(b) / np.linalg.norm(unit(a)) / np.linalg.norm(unit(b)))
    for q in (0, 50, 100):
        asked = [v for i, v in rows if i == q]
        want = sorted((-max(cosine(a, v) for a in asked), i) for i, v in rows if i != q)[:5]
        assert len(got[q]) == 5
        assert all(abs(s + w) < 1e-12 for (_, s), (w, _) in zip(got[q], want))
        assert sorted(j for j, _ in got[q]) == sorted(j for _, j in want)
