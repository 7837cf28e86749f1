"""Queries that cover all of their tables."""

from corpuslens.plans.queries import ORACLE, QUERIES


def write_pages(spark, folder, pages):
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return str(folder)


def test_audit_covers_every_page_of_the_host(spark, tmp_path):
    page = lambda i: f"<html><body><article><p>Page {i} has its own words a{i} b{i} c{i}.</p></article></body></html>"
    d = write_pages(spark, tmp_path, [(i, f"https://big.example/p{i}", page(i)) for i in range(620)] + [(1000, "https://small.example/", page(1000))])
    assert QUERIES["audit_entries"](spark, d).count() == 620


def test_extract_covers_pages_with_any_reference(spark, tmp_path):
    texts = {1: ("Voil&agrave; &apos;x&apos;", "Voil\u00e0 'x'"), 2: ("Fish &amp<b>chips</b>", "Fish &chips"), 3: ("Half &am", "Half &am"), 4: ("A &amp; B", "A & B")}
    d = write_pages(spark, tmp_path, [(i, f"https://a.example/{i}", f"<html><body><article><p>{html}</p></article></body></html>") for i, (html, _) in texts.items()])
    got = {r.page_id: r.body_text for r in QUERIES["page_extract"](spark, d).collect()}
    assert got == {i: want for i, (_, want) in texts.items()}


CUT = ["token = &quot", "&quot;a&quot; &quot", "&quote &quot&quot;", "a&quot ", "A &amp; B &amp", "&am", "&amp;quot", "&a", "plain"]


def cut_pages(spark, folder):
    """Pages whose headings end within a reference, and DuckDB over them."""
    import duckdb

    page = lambda t: f"<html><head><title>{t}</title></head><body><article><h1>{t}</h1><p><b>{t};x&quot;<br><p>\u00e9 {t}</p><a href=\"/a?b&quot\">q</a></article></body></html>"
    d = write_pages(spark, folder, [(i, f"https://a.example/{i}", page(t)) for i, t in enumerate(CUT)])
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{d}/pages.parquet/*.parquet'")
    return d, con


def test_extract_leaves_cut_quotes_as_its_sql(spark, tmp_path):
    from corpuslens.functions.html import extract

    d, con = cut_pages(spark, tmp_path)
    columns = ["page_id", "body_text", "word_count", "n_links"]
    want = sorted(con.execute(f"select {', '.join(columns)} from ({ORACLE['page_extract']})").fetchall())
    assert sorted(map(tuple, QUERIES["page_extract"](spark, d).select(*columns).collect())) == want and len(want) == len(CUT)
    # The operator reads HTML.
    assert extract("<article>token = &quot</article>", "")[0] == 'token = "'


def test_metadata_leaves_cut_quotes_as_its_sql(spark, tmp_path):
    d, con = cut_pages(spark, tmp_path)
    columns = ["url", "title", "is_empty_shell", "body_size_bytes"]
    want = sorted(con.execute(f"select {', '.join(columns)} from ({ORACLE['page_metadata']})").fetchall())
    assert sorted(map(tuple, QUERIES["page_metadata"](spark, d).select(*columns).collect())) == want and len(want) == len(CUT)


def test_crawl_reaches_six_links_deep(spark, tmp_path):
    d = write_pages(spark, tmp_path, [(i, f"https://a.example/p{i}", f'<html><body><a href="/p{i + 1}">next</a></body></html>') for i in range(9)])
    got = {r.url: r.depth for r in QUERIES["crawl_levels"](spark, d).collect()}
    assert got == {f"https://a.example/p{i}": i for i in range(7)}


def test_audit_entries_by_brute_force(spark, tmp_path):
    import numpy as np

    from corpuslens.operators.vectors import fake_embedding

    words = lambda i, n: " ".join(f"w{i}x{k}" for k in range(n))
    bodies = {1: words(1, 130), 2: words(2, 130), 3: words(1, 130), 4: words(4, 60), 5: words(5, 10), 6: words(1, 130)}
    links = {1: [2, 3], 2: [3], 3: [3], 4: [1], 5: [], 6: [2]}
    url = lambda i: f"https://a.example/p{i}"
    page = lambda i: f"<html><head><title>T{i}</title></head><body>{''.join(f'<a href=/p{x}> </a>' for x in links[i])}<article>{bodies[i]}</article></body></html>"
    got = {r.url: r for r in QUERIES["audit_entries"](spark, write_pages(spark, tmp_path, [(i, url(i), page(i)) for i in bodies])).collect()}
    inbound = {i: sum(i in v for v in links.values()) for i in bodies}
    most = max(inbound.values())
    vectors = {i: np.array(fake_embedding(b), float) for i, b in bodies.items() if len(b.split()) >= 50}
    near = {(a, b) for a in vectors for b in vectors if a < b and vectors[a] @ vectors[b] >= 0.99}
    assert {(1, 3), (1, 6), (3, 6)} <= near
    group = {i: min(a for a in vectors if a == i or (a, i) in near) for p in near for i in p}
    assert set(got) == {url(i) for i in bodies}
    for i, b in bodies.items():
        n = len(b.split())
        label, action, sure = ("Thin", "DELETE", 1.0) if n < 50 else ("Unclear", "MANUAL_REVIEW", 0.5) if n < 120 else ("Aligned", "KEEP", 0.9)
        if i in group and i != group[i] and label in ("Aligned", "Unclear"):
            label, action = "Redundant", "DELETE" if action == "KEEP" else action
        weight = {"Thin": 0.35, "Unclear": 0.2, "Aligned": 0.0, "Redundant": 0.3}[label]
        r = got[url(i)]
        assert (r.primary_label, r.suggested_action, r.inbound_internal_links, r.word_count) == (label, action, str(inbound[i]), str(n))
        assert r.priority == f"{np.floor(weight * (0.5 + 0.5 * inbound[i] / most) * sure * 1000 + 0.5) / 10:.1f}"
        assert (r.duplicate_cluster_id is not None) == (i in group)


def test_alias_inserts_where_urls_repeat(spark, tmp_path):
    """A row for each odd page whose url no even page has, as the SQL gives them, and one for each url of even pages."""
    import duckdb

    urls = {1: "a", 3: "a", 5: "b", 2: "b", 4: "c", 12: "c", 7: "d", 9: "e", 11: "e", 13: "e"}
    d = write_pages(spark, tmp_path, [(i, u, "") for i, u in urls.items()])
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{d}/pages.parquet/*.parquet'")
    columns = ["alias_url", "canonical_url", "alias_type"]
    want = sorted(con.execute(f"select {', '.join(columns)} from ({ORACLE['alias_inserts']})").fetchall())
    assert sorted(map(tuple, QUERIES["alias_inserts"](spark, d).select(*columns).collect())) == want and len(want) == 8
