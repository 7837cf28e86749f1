"""State tables, crawl, judges, vectors, report and streams on fixtures of our own."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslens import schemas
from corpuslens.operators import crawl as C, graph, judge as J, state as T, vectors as V
from corpuslens.plans import audit as A, report as R
from corpuslens.streaming import events as E



def now():
    return F.expr("timestamp '2024-01-01 00:10:00'")


def test_schemas_parse(spark):
    for name in schemas.TABLES:
        assert len(schemas.schema(name)) > 1
        assert set(schemas.KEYS.get(name, [])) <= set(schemas.schema(name).names)


def test_components_match_union_find(spark):
    rng = random.Random(4)
    edges = [(f"n{rng.randint(0, 300)}", f"n{rng.randint(0, 300)}") for _ in range(220)] + [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(60)] + [("x", "x"), (None, "x")]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a and b and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {x: find(x) for x in root}
    assert graph.components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_ordinals(spark):
    df = spark.createDataFrame([(f"k{i:04d}",) for i in range(500)], "k string").repartition(7)
    assert [r.ordinal for r in graph.with_ordinal(df, "k").orderBy("k").collect()] == list(range(1, 501))


def test_pairs_and_clusters(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((30, 16))
    rows = [(f"u{i:03d}", (base[i % 30] + rng.standard_normal(16) * 0.25).tolist()) for i in range(150)] + [("z1", [0.0] * 16), ("z2", None), ("z3", [])]
    x = {k: np.array(v) for k, v in rows if v and any(v)}
    for t in (0.92, 0.5, -1.0):
        want = {(a, b): float(x[a] @ x[b] / np.linalg.norm(x[a]) / np.linalg.norm(x[b])) for a in x for b in x if a < b}
        want = {k: v for k, v in want.items() if v >= t}
        got = {(r.a, r.b): r.similarity for r in V.similar_pairs(spark.createDataFrame(rows, "url string, vector array<double>"), t).collect()}
        assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_running_average_and_cluster_ids(spark):
    pairs = spark.createDataFrame([("a", "b", 0.92), ("a", "c", 0.96), ("b", "c", 1.0), ("x", "y", 0.93)], "a string, b string, similarity double")
    got = {r.cluster_id: (r.member_urls, r.size, round(r.avg_similarity, 9)) for r in V.cluster_rollup(pairs, V.clusters(pairs)).collect()}
    first = (0.92 * 2 + 0.96) / 3
    assert got == {"cl_001": (["a", "b", "c"], 3, round((first * 3 + 1.0) / 4, 9)), "cl_002": (["x", "y"], 2, 0.93)}


@pytest.mark.parametrize("seed", range(3))
def test_page_to_keep(spark, seed):
    rng = random.Random(seed)
    rows = [(f"c{k}", f"u{i}", rng.choice([10, 20]), rng.choice(["", "2024-01-01", "2023-01-01", None])) for k in range(40) for i in range(rng.randint(1, 5))]

    def keep(own):
        own = sorted(own, key=lambda r: r[1])
        top = [r for r in own if r[2] == max(x[2] for x in own)]
        if not top[0][3]:
            return top[0][1]
        return min((r for r in top if r[3]), key=lambda r: (r[3], r[1]))[1]

    got = {r.cluster_id: r.canonical for r in V.canonical_members(spark.createDataFrame(rows, "cluster_id string, url string, word_count int, last_modified string")).collect()}
    assert got == {c: keep([r for r in rows if r[0] == c]) for c in {r[0] for r in rows}}


def test_vector_codec():
    v = [0.5, -1.25, 3.0]
    assert V.unpack_vector(V.pack_vector(v), 3) == v
    with pytest.raises(ValueError):
        V.unpack_vector(b"abc", 3)
    e = V.fake_embedding("text")
    assert len(e) == 8 and abs(sum(x * x for x in e) - 1) < 1e-5 and e == V.fake_embedding("text") != V.fake_embedding("other")


def test_inserts_and_upserts(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    new = spark.createDataFrame([("b", 2), ("c", 3), ("c", 2)], "k string, v int")
    assert sorted(map(tuple, T.insert_or_ignore(old, new, ["k"], ["v"]).collect())) == [("a", 1), ("b", 1), ("c", 2)]
    pages = spark.createDataFrame([("u", "r1", 1, 5), ("w", "r1", 1, 6)], "url string, first_run_id string, discovered_at int, fetched_at int")
    more = spark.createDataFrame([("u", "r2", 2, 7), ("x", "r2", 2, 8)], pages.schema)
    assert sorted(map(tuple, T.upsert_pages(pages, more).collect())) == [("u", "r1", 1, 7), ("w", "r1", 1, 6), ("x", "r2", 2, 8)]
    runs = spark.createDataFrame([("r", "s", "p", "running")], "id string, site_url string, prompts_sha256 string, status string")
    with pytest.raises(ValueError):
        T.insert_run(runs, spark.createDataFrame([("r2", "s", "p", "running")], runs.schema))
    assert T.insert_run(runs, spark.createDataFrame([("r2", "s", "q", "running")], runs.schema).select(*runs.columns)).count() == 2
    with pytest.raises(ValueError):
        T.assert_unique(runs.union(runs), "runs")


def _queue(spark, rows):
    t = spark.createDataFrame(rows, "url string, run_id string, depth int, status string, claimed_by string, attempt_count int, expires int, retry int")
    at = lambda c: F.when(F.col(c).isNotNull(), now() + F.make_dt_interval(secs=F.col(c)))
    return t.withColumn("claim_expires_at", at("expires")).withColumn("next_retry_at", at("retry")).withColumn("discovered_at", now()).drop("expires", "retry")


def test_claims_and_recovery(spark):
    rows = [
        ("u1", "r", 1, "discovered", None, 0, None, None), ("u2", "r", 0, "discovered", None, 0, None, None), ("u3", "r", 0, "fetched", None, 0, None, None), ("u4", "r", 2, "failed", None, 1, None, 0),
        ("u5", "s", 0, "claimed", "x", 1, -1, None), ("u6", "s", 0, "fetching", "x", 1, 0, None), ("u7", "s", 0, "claimed", "x", 1, 1, None), ("u8", "s", 0, "claimed", "x", 1, None, None),
        ("u9", "t", 0, "claimed", "x", 1, -9, None), ("u10", "t", 0, "failed", None, 1, None, 1), ("u11", "t", 0, "failed", None, 1, None, None), ("u12", None, 0, "discovered", None, 0, None, None), ("u13", "t", 0, None, None, 0, None, None),
    ]
    table = _queue(spark, rows)
    got = {r.url: (r.status, r.claimed_by, r.attempt_count) for r in T.claim(table, F.lit("w"), now(), 60, 2).collect()}
    kept = {r[0]: (r[3], r[4], r[5]) for r in rows}
    assert got == kept | {"u1": ("claimed", "w", 1), "u2": ("claimed", "w", 1), "u12": ("claimed", "w", 1)}
    third = {r.url: r.attempt_count for r in T.claims(table, F.lit("w"), now(), 60, 3).collect()}
    assert third == {"u1": 1, "u2": 1, "u4": 2, "u12": 1}  # a retry is due at the very moment
    open_ = lambda df: {r.url for r in df.filter("status = 'discovered'").collect()} - {"u1", "u2", "u12"}
    assert open_(T.recover_claims(table, "s", now())) == {"u5", "u6"}  # so does a claim end
    assert open_(T.recover_claims(table, None, now())) == {"u5", "u6", "u9"}
    assert T.claim(table.limit(0), F.lit("w"), now(), 60).count() == 0
    assert T.claim(table, F.lit("w"), now(), 60).columns == table.columns


def test_a_claim_shuffles_no_whole_run(spark):
    rows = [(f"u{i}", "r", i % 3, "discovered", None, 0, None, None) for i in range(3000)]
    table = _queue(spark, rows).repartition(6)
    held = T.claims(table, F.lit("w"), now(), 60, 5)
    assert "WindowGroupLimit" in held._jdf.queryExecution().executedPlan().toString()
    assert [r.url for r in held.orderBy("url").collect()] == sorted(sorted((r[0] for r in rows if r[2] == 0))[:5])


def test_judgements_have_a_queue_of_their_own(spark):
    rows = [("r", "p1", "pending", 0, None), ("r", "p2", "judging", 1, 0), ("r", "p3", "claimed", 1, 5), ("q", "p1", "judged", 1, None)]
    t = spark.createDataFrame(rows, "run_id string, page_url string, judge_status string, attempt_count int, e int").withColumn("claimed_by", F.lit(None).cast("string")).withColumn("claim_expires_at", F.when(F.col("e").isNotNull(), now() + F.make_dt_interval(secs=F.col("e")))).drop("e")
    again = T.recover_claims(t, "r", now(), "judge_status")
    got = {(r.run_id, r.page_url): r.judge_status for r in T.claim(again, F.lit("w"), now(), 60, 9, "judge_status", ["page_url"], ["run_id", "page_url"]).collect()}
    assert got == {("r", "p1"): "claimed", ("r", "p2"): "claimed", ("r", "p3"): "claimed", ("q", "p1"): "judged"}


def test_run_status(spark):
    runs = spark.createDataFrame([("r", "running", None, None), ("q", "running", None, "old")], "id string, status string, completed_at timestamp, error string")
    got = {r.id: r for r in T.apply_run_status(runs, "r", "completed", "", now()).collect()}
    assert got["r"].status == "completed" and got["r"].completed_at is not None and got["q"].status == "running"
    assert T.apply_run_status(runs, "q", "paused_user", None, now()).filter("id = 'q'").first().error == "old"


SITE = {
    "https://s.example/": '<main><h1>Home</h1><p>' + "word " * 150 + '</p></main><a href="/a">a</a><a href="/b/">b</a><a href="/tag/x">t</a><a href="https://o.example/">o</a>',
    "https://s.example/a": '<main>' + "alpha beta " * 80 + '</main><a href="/">home</a><a href="/c?utm_source=z">c</a>',
    "https://s.example/b": "<main>short page</main><a href='/'>home</a><a href=\"/\">home</a>",
    "https://s.example/c": '<main>' + "alpha beta " * 80 + '</main><a href="/gone">gone</a>',
    "https://s.example/island": "<main>never linked</main>",
}


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(list(SITE.items()), "url string, html string")


def test_crawl(corpus):
    got = {r.url: (r.depth, r.discovered_via, r.discovered_from, r.status) for r in C.crawl(corpus, "https://S.example").collect()}
    root = "https://s.example/"
    assert got == {root: (0, "homepage", None, "fetched"), root + "a": (1, "bfs_link", root, "fetched"), root + "b": (1, "bfs_link", root, "fetched"), root + "c": (2, "bfs_link", root + "a", "fetched"), root + "gone": (3, "bfs_link", root + "c", "failed")}
    assert [r.url for r in C.crawl(corpus, root, max_pages=2).collect()] == [root, root + "a"]
    assert C.crawl(corpus, root, max_depth=1).count() == 3
    assert C.crawl(corpus, root, seeds=[root + "island"], excludes=[r"/a$", r"/tag/"]).count() == 3


def test_audit(spark, corpus):
    out = A.audit(corpus, "https://s.example/", threshold=0.99)
    rows = {r.url.rpartition("/")[2]: r for r in out["entries"].collect()}
    assert rows["b"].primary_label == "Thin" and rows["b"].suggested_action == "DELETE" and rows["b"].confidence == 1.0
    assert rows[""].primary_label == "Aligned" and rows[""].priority == 0.0 and rows[""].inbound == 2
    assert rows["a"].cluster_id == rows["c"].cluster_id == "cl_001"
    assert rows["c"].primary_label == "Redundant" and rows["c"].findings[0].kind == "redundant_with_other_page" and rows["a"].primary_label == "Aligned"
    report = R.build(out["entries"], out["clusters"], R.failures(out["urls"].withColumn("attempt_count", F.lit(1)).withColumn("last_error", F.lit("404")), out["classifications"]), {"id": "r", "site_url": "s"})
    assert report["summary"]["pages_total"] == 4 and report["summary"]["by_label"]["Thin"] == 1 and report["summary"]["fetch_failures"] == 1
    assert [p["url"] for p in report["pages"]] == [r.url for r in R.ordered(out["entries"]).collect()]
    assert json.dumps(report)
    assert set(A.audit(corpus, "https://s.example/", dry_run=True)) == {"urls", "pages", "links", "aliases"}


def test_relabelling_is_idempotent(spark, corpus):
    c = A.audit(corpus, "https://s.example/", threshold=0.99)["classifications"]
    members = spark.createDataFrame([("https://s.example/c", "https://s.example/a", "cl_001", "", 160)], "page_url string, canonical string, cluster_id string, title string, canonical_words long")
    again = J.relabel_redundant(c, members)
    assert sorted(again.toJSON().collect()) == sorted(c.toJSON().collect())


def test_judges(spark):
    pages = spark.createDataFrame([("u1", "t", "body text"), ("u2", "t", "body"), ("u3", "t", "é" * 2000)], "url string, title string, body_text string")
    good = {"primary_label": "Stale", "confidence": 95, "suggested_action": "UPDATE", "edit_plan": {"summary": "s"}, "findings": [{"id": "f1", "quoted_text": "body"}, {"id": "f2", "quoted_text": "no"}], "affected_prompts": ["p1", "x"]}

    def judge(request):
        if request["url"] == "u2":
            raise J.AuthError("refused")
        if request["url"] == "u3":
            if request["attempt"] < 3:
                raise ValueError("bad")
            assert len(request["body_text"].encode()) <= 1000
            return {"primary_label": "Aligned", "confidence": 0.5, "suggested_action": "KEEP"}
        return good

    got = {r.page_url: r for r in J.judged(pages, judge, ["p1"]).collect()}
    assert got["u1"].confidence == 0.95 and [f.id for f in got["u1"].findings] == ["f1"] and got["u1"].affected_prompts == ["p1"] and got["u1"].attempts == 1
    assert (got["u2"].judge_status, got["u2"].attempts, got["u2"].primary_label) == ("failed", 1, "Unclear")
    assert (got["u3"].judge_status, got["u3"].attempts) == ("judged", 3)
    broken = {r.page_url: r.judge_status for r in J.judged(pages, J.TableJudge({"u1": {"primary_label": "Aligned", "confidence": 1, "suggested_action": "DELETE"}})).collect()}
    assert set(broken.values()) == {"failed_schema"}


def test_aliases(spark):
    pages = spark.createDataFrame([("http://h/a", "http://h/b", ""), ("http://h/c", "http://h/c", "http://h/d"), ("http://h/e", "http://h/e", "/rel"), ("http://h/f", "http://h/f", "http://o/x"), ("http://h/g", "http://h/g", "http://h/g/")], "url string, final_url string, canonical_url string")
    assert sorted(map(tuple, C.canonical_aliases(pages).collect())) == [("http://h/a", "http://h/b", "http_redirect"), ("http://h/c", "http://h/d", "canonical_tag")]


def test_inspection(spark):
    runs = spark.createDataFrame([("r", "running", None)], "id string, status string, error string").withColumn("last_heartbeat_at", now() - F.expr("INTERVAL 6 MINUTES"))
    urls = spark.createDataFrame([("r", "fetched"), ("r", "fetched"), ("q", "failed")], "run_id string, status string")
    cls = spark.createDataFrame([("r", "judged", "Thin"), ("r", "pending", None)], "run_id string, judge_status string, primary_label string")
    events = spark.createDataFrame([("r", "crawl.start")], "run_id string, event_type string")
    calls = spark.createDataFrame([("r", 1, 5, 0, 2), ("r", 2, 5, 1, 2)], "run_id string, attempt_number int, input_tokens long, cached_tokens long, output_tokens long")
    r = A.inspect(runs, urls, cls, events, calls, "r", now()).first()
    assert r.next_action == "resume_crashed" and r.urls == {"fetched": 2} and r.labels == {"Thin": 1} and (r.input_tokens, r.api_calls, r.retries) == (10, 2, 1)


def test_streams(spark, sf, tmp_path):
    src = tmp_path / "in"
    table = spark.read.parquet(f"{sf}/events.parquet")
    table.repartition(3).write.parquet(str(src))
    stream = E.event_stream(spark, str(src), files_per_trigger=1)
    E.run_once(E.windowed_counts(stream, "1 hour", "3650 days"), "win", str(tmp_path / "c1"), "complete")
    assert spark.table("win").agg(F.sum("n")).first()[0] == table.count()
    want = {tuple(r) for r in E.windowed_counts(table.withColumn("ts", F.col("ts").cast("timestamp"))).collect()}
    assert {tuple(r) for r in spark.table("win").collect()} == want
    E.run_once(E.first_seen(stream, ["user_id"], "3650 days").select("user_id"), "first", str(tmp_path / "c2"))
    assert spark.table("first").count() == table.select("user_id").distinct().count()
    out = str(tmp_path / "out")
    q = E.event_stream(spark, str(src), files_per_trigger=1).writeStream.foreachBatch(E.keyed_sink(out, ["user_id"])).option("checkpointLocation", str(tmp_path / "c3")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.read.parquet(out)
    assert got.count() == got.select("user_id").distinct().count() == table.select("user_id").distinct().count()
    E.keyed_sink(out, ["user_id"])(table, 0)
    assert spark.read.parquet(out).count() == table.select("user_id").distinct().count()


def test_similar_pairs_lose_none_and_compare_few(spark):
    rng = np.random.default_rng(3)
    for d, t in ((3, 0.92), (16, 0.8), (64, 0.92), (64, 0.4)):
        x = rng.standard_normal((400, d))
        x[200:260] = x[:60] + rng.uniform(0.01, 0.5, (60, 1)) * rng.standard_normal((60, d))
        x[300] = x[301]
        rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, []), (902, [0.0] * d), (903, [float("nan")] * d), (904, [1.0, None]), (905, [1.0] * (d + 1)), (None, [1.0] * d)]
        df = spark.createDataFrame(rows, "url long, vector array<double>")
        u = x / np.sqrt((x * x).sum(1))[:, None]
        near = u @ u.T
        want = {(i, j): near[i, j] for i, j in zip(*np.nonzero(np.triu(near >= t, 1)))}
        got = {(r.a, r.b): r.similarity for r in V.similar_pairs(df, t).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
        stats = V.compared_pairs(df, t).first()
        assert stats.compared >= 0 and stats.met <= 401 * 400
        if d == 64 and t == 0.92:
            assert stats.compared < 0.01 * stats.met
    assert V.similar_pairs(df.limit(0)).count() == 0 and tuple(V.compared_pairs(df.limit(0)).first()) == (0, 0)


def test_embeddings_of_many_texts_are_those_of_each(spark):
    rng = random.Random(4)
    texts = ["", "a", "é" * 50, "x" * 3000, *("".join(rng.choices("ab c\U0001f600", k=rng.randrange(60))) for _ in range(40))]
    assert [v.tolist() for v in V.fake_embeddings(texts)] == [V.fake_embedding(t) for t in texts]
    assert V.fake_embeddings([]).shape == (0, 8) and V.fake_embeddings(["q"], 3).tolist() == [V.fake_embedding("q", 3)]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)] + [("n", None)], "url string, body_text string")
    plain = lambda t: V.fake_embedding(t)
    assert sorted(map(tuple, V.embedded(df).collect())) == sorted(map(tuple, V.embedded(df, plain).collect()))


def test_scratch_scopes_of_threads_are_their_own(spark):
    import threading

    from corpuslens.session import materialize, scratch_scope

    inner, seen = threading.Event(), threading.Event()

    def other():
        with scratch_scope([]):
            inner.set()
            seen.wait(60)

    t = threading.Thread(target=other)
    t.start()
    inner.wait(60)
    kept = materialize(spark.range(3), "kept")  # belongs to no scope of this thread
    seen.set()
    t.join()
    assert kept.count() == 3
