"""Functions, rules, sources and sinks on fixtures of our own."""

import json
import random

import pytest
from pyspark.sql import functions as F

from corpuslens.functions import html as H, scores as S, text as X, urls as U
from corpuslens.sources import sinks, web


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


CANONICAL = [
    ("HTTP://Example.COM:80/a/../b/./c/", "http://example.com/b/c"),
    ("https://example.com:443", "https://example.com/"),
    ("https://example.com:8443/x#frag", "https://example.com:8443/x"),
    ("https://example.com//a///b", "https://example.com/a/b"),
    ("https://example.com/?b=2&a=1&utm_source=x&GCLID=1&a=0", "https://example.com/?a=1&a=0&b=2"),
    ("https://example.com/?k=&z=a b", "https://example.com/?k&z=a+b"),
    ("https://example.com/x?ref=y", "https://example.com/x"),
    ("  https://example.com/../../up  ", "https://example.com/up"),
    ("/relative/only", None),
    ("mailto:a@b.c", None),
    ("", None),
    (None, None),
]


def test_canonical_urls(spark):
    df = spark.createDataFrame(CANONICAL, "raw string, want string").withColumn("got", U.canonicalize(F.col("raw")))
    for r in df.collect():
        assert r.got == r.want, r.raw


def test_canonical_form_is_a_fixed_point(spark, sf):
    urls = spark.read.parquet(f"{sf}/pages.parquet").select(U.canonicalize(F.col("url")).alias("u"))
    assert urls.filter(U.canonicalize(F.col("u")) != F.col("u")).count() == 0


def test_resolving(spark):
    base = F.lit("https://h.example/a/b/c?q=1")
    cases = {"../d": "https://h.example/a/d", "d?x#f": "https://h.example/a/b/d?x", "/r/./s": "https://h.example/r/s", "//o.example/p": "https://o.example/p", "http://o/p": "http://o/p", "": "https://h.example/a/b/c?q=1", "?z": "https://h.example/a/b/c?z", "#f": "https://h.example/a/b/c?q=1"}
    got = one(spark, *(U.resolve(base, F.lit(h)).alias(str(i)) for i, h in enumerate(cases)))
    assert list(got) == list(cases.values())


def test_hosts_paths_and_schemes(spark):
    u = lambda x: F.lit(x)
    got = one(spark, U.same_host(u("http://A.b:81/"), u("https://a.B:81/x")), U.same_host(u("http://a.b/"), u("http://a.b:80/")), U.admitted_path(u("http://a/x.PNG")), U.admitted_path(u("http://a/x.png")), U.admitted_path(u("http://a/tag/x")), U.admitted_path(u("http://a/p%61ge/3/"), None, [r"/page/\d+/?$"]), U.followed_scheme(u("mailto:x")), U.followed_scheme(u("#x")))
    assert list(got) == [True, False, True, False, False, False, False, True]
    assert one(spark, U.sitemap_candidates(u("http://a/"), F.array(F.lit("http://a/sitemap.xml"), F.lit("http://a/m.xml"))))[0][:3] == ["http://a/sitemap.xml", "http://a/m.xml", "http://a/sitemap_index.xml"]


def test_white_space_and_counts(spark):
    raw = "  a  b　\n c\u0085d​e "
    got = one(spark, X.collapse(F.lit(raw)), X.word_count(F.lit(raw)), X.word_count(F.lit(" \t")), X.word_count(F.lit(None).cast("string")))
    assert list(got) == ["a b c d​e", 4, 0, 0]


@pytest.mark.parametrize("n", range(1, 12))
def test_byte_prefix_never_cuts_a_character(spark, n):
    text = "aé中\U0001f600z"
    want = text.encode()[:n].decode(errors="ignore")
    assert one(spark, X.byte_prefix(F.lit(text), n))[0] == want


def test_fences_and_redaction(spark):
    cases = {'```json\n{"a":1}\n```': '{"a":1}', 'Sure: {"a":{"b":2}} ok?': '{"a":{"b":2}}', '{"a":1}': '{"a":1}', "none": "none", "```\n{}\n``` tail": "{}"}
    assert list(one(spark, *(X.strip_fences(F.lit(k)).alias(str(i)) for i, k in enumerate(cases)))) == list(cases.values())
    key = "sk-" + "a" * 24
    got = one(spark, X.redact(F.lit(f"x {key} y")), X.redact(F.lit("sk-short")), X.redact(F.lit("v"), F.lit("Authorization")), X.redact(F.lit("v"), F.lit("other")))
    assert list(got) == ["x REDACTED y", "sk-short", "REDACTED", "v"]


PAGE = """<!doctype html><html><head><title> T &amp; U </title><meta name="description" content="D"><link rel="canonical" href="/c">
<meta property="article:modified_time" content="2024-01-02"><base href="https://h.example/base/"></head><body><nav><a href="n">Nav</a></nav>
<main><h1>Head</h1><p>One<p>Two &lt;3<script>x</script><aside><a href="gone">Gone</a></aside><a href="k#f">Link  text</a><div aria-hidden="true">no</div></main>
<a href="k">again</a><a href="mailto:x">m</a><a href="https://o.example/">Out</a><time datetime="2023-05-05">d</time></body></html>"""


def test_html_page():
    body, title, description, canonical, modified, published, links = H.extract(PAGE, "https://h.example/x")
    assert (title, description, canonical, modified, published) == ("T & U", "D", "/c", "2024-01-02", "2023-05-05")
    assert body == "HeadOneTwo <3Link text"
    assert [(x["to_url"], x["anchor"], x["is_internal"]) for x in links] == [("https://h.example/base/n", "Nav", True), ("https://h.example/base/k", "Link text", True), ("https://o.example/", "Out", False)]


def test_html_fallbacks():
    assert H.extract("<body><nav>N</nav><p>A b</p><footer>F</footer><a href='/x'>L</a></body>", "http://h/")[0] == "A bL"
    assert H.extract("", "http://h/")[:2] == ("", "")
    assert H.extract("<h1>Only</h1>", "http://h/")[1] == "Only"
    rng = random.Random(2)
    for _ in range(300):
        H.extract("".join(rng.choice(["<", ">", "<p>", "</p>", "<main>", "</main>", "<a href='", "'", "&amp", "<!--", "x", " ", "<script>", "\x00", "<svg/>", "<base href=]>", "//["]) for _ in range(40)), "http://h/")


def test_scores(spark):
    lit = F.lit
    got = one(
        spark,
        *(S.repaired_confidence(lit(c)) for c in (95.0, -0.5, 1.7, 0.4)),
        S.capped_confidence(lit(0.9), lit("MANUAL_REVIEW")),
        S.priority(lit("Contradictory"), lit(1.0), lit(4), lit(4)), S.priority(lit("Stale"), lit(0.93), lit(1), lit(4)), S.priority(lit("Contradictory"), lit(0.9), lit(1), lit(4)),
        S.priority(lit("Nonsense"), lit(1.0), lit(1), lit(1)), S.priority(lit("Thin"), lit(1.0), lit(0), lit(0)),
        S.cosine(F.array(lit(1.0), lit(0.0)), F.array(lit(1.0), lit(1.0))), S.cosine(F.array(lit(1.0)), F.array(lit(0.0))),
    )
    assert list(got)[:10] == [0.95, 0.0, 1.0, 0.4, 0.59, 100.0, 40.7, 56.3, 0.0, 17.5]
    assert got[10] == pytest.approx(0.5**0.5) and got[11] == 0.0


def test_finding_and_label_order(spark):
    raw = json.dumps([{"id": "f10", "severity": "low"}, {"id": "f2", "severity": "high"}, {"id": "f10", "severity": "high"}, {"id": "f1", "severity": "odd"}])
    got = one(spark, F.transform(S.sort_findings(F.from_json(F.lit(raw), "array<struct<id:string,severity:string>>")), lambda f: F.concat(f["id"], f["severity"])), S.sort_labels(F.array(F.lit("Thin"), F.lit("Odd"), F.lit("Stale"))), S.sort_labels(F.lit(None).cast("array<string>")))
    assert got[0] == ["f1odd", "f10high", "f2high", "f10low"]
    assert got[1] == ["Odd", "Stale", "Thin"] and got[2] == []


def test_times_and_retries(spark):
    now = F.expr("timestamp '2024-05-01 00:00:00'")
    got = one(
        spark,
        S.rfc3339(S.http_date(F.lit("Tue, 30 Apr 2024 23:59:30 GMT"))), S.rfc3339(S.parse_time(F.lit("2024-04-30T10:00:00Z"))), S.parse_time(F.lit("nonsense")),
        S.retry_after_seconds(F.lit("120"), now), S.retry_after_seconds(F.lit("Wed, 01 May 2024 00:00:30 GMT"), now), S.retry_after_seconds(F.lit("x"), now),
        S.backoff_bound(0.5, 30.0, F.lit(3), F.lit(0)), S.backoff_bound(0.5, 30.0, F.lit(3), F.lit(99)), S.is_retryable_status(F.lit(503)), S.is_retryable_status(F.lit(404)), S.is_retryable_error(F.lit("read: Connection reset by peer")),
    )
    assert list(got) == ["2024-04-30T23:59:30Z", "2024-04-30T10:00:00Z", None, 120, 30, 0, 2.0, 30.0, True, False, True]


def test_sitemaps(spark):
    index = "<sitemapindex xmlns='http://www.sitemaps.org/schemas/sitemap/0.9'><sitemap><loc>s1</loc></sitemap><sitemap><loc> </loc></sitemap></sitemapindex>"
    pages = "<urlset><url><loc> u1 </loc><lastmod>2024</lastmod></url><url><loc>u2</loc></url><url></url><broken"
    docs = spark.createDataFrame([("root", index), ("s1", pages), ("other", pages)], "source string, xml string")
    assert sorted((r.loc, r.lastmod) for r in web.expand_sitemaps(docs, ["root"]).collect()) == [("u1", "2024"), ("u2", "")]


def test_robots(spark):
    rules = "User-agent: *\nDisallow: /private/\nSitemap: https://h/s.xml\n"
    df = spark.createDataFrame([("http://h/private/x",), ("http://h/open",)], "url string")
    assert [r[0] for r in df.select(web.robots_filter(rules)(F.col("url"))).collect()] == [False, True]
    assert web.robots_sitemaps(rules) == ["https://h/s.xml"]


GOOD = 'version: "1"\nprompts:\n  - {id: p1, text: "What is it?"}\n  - {id: p2, text: "Why?", weight: 2}\nseeds: ["https://h.example/x"]\n'


@pytest.mark.parametrize("bad", ['version: "2"\nprompts: [{id: a, text: b}]', 'version: "1"', 'version: "1"\nprompts: [{id: "A B", text: b}]', 'version: "1"\nprompts: [{id: a, text: b}, {id: a, text: c}]', 'version: "1"\nprompts: [{id: a, text: ""}]', 'version: "1"\nprompts: [{id: a, text: b, weight: 11}]', 'version: "1"\nprompts: [{id: a, text: b}]\nseeds: [x]', 'version: "1"\nprompts: [{id: a, text: b}]\nextra: 1', 'version: "1"\nprompts: [{id: a, text: b}]\ncanonical_messaging: [{body: x}]', "[", "- 1"])
def test_bad_configs(bad):
    with pytest.raises(web.ConfigError):
        web.load_config(bad)


def test_good_config(spark):
    c = web.load_config(GOOD, "https://H.example/")
    assert [p["weight"] for p in c["prompts"]] == [1.0, 2.0] and len(c["sha256"]) == 64
    assert web.prompts_frame(spark, c).count() == 2
    with pytest.raises(web.ConfigError):
        web.load_config(GOOD, "https://other.example/")


def test_report_writers(tmp_path):
    page = {"url": "u", "title": 'a "b", c', "primary_label": "Thin", "secondary_labels": ["Stale", "Thin"], "suggested_action": "DELETE", "priority": 17.5, "confidence": 1.0, "affected_prompts": None, "page_summary": None, "findings": [{"id": "f1", "kind": "thin_content", "severity": "high", "quoted_text": "x\ny", "location_hint": "l", "issue": "i", "suggested_fix": "s"}], "edit_plan": None, "rationale": "", "metadata": {"word_count": 3, "last_modified": None, "inbound_internal_links": 1, "duplicate_cluster_id": None}}
    report = {"site": "s", "run_id": "r", "completed_at": "", "duration_seconds": 0, "summary": {"by_action": {"DELETE": 1}, "by_label": {"Thin": 1}, "total_api_calls": 0, "pages_total": 2, "fetch_failures": 0, "judge_failures": 0, "retries_total": 0}, "pages": [page | {"primary_label": "Aligned"}, page], "duplicate_clusters": []}
    digests = sinks.write_files(report, str(tmp_path), ["JSON", "csv", "md"])
    assert set(digests) == {"json", "csv", "md"} and digests == sinks.write_files(report, str(tmp_path), ["json", "csv", "md"])
    rows = (tmp_path / "report.csv").read_bytes().split(b"\r\n")
    assert rows[0].decode().split(",") == sinks.CSV_COLUMNS and b'"a ""b"", c"' in rows[1] and rows[-1] == b""
    text = (tmp_path / "report.md").read_text()
    assert text.count("### 1. DELETE: u") == 1 and "> x\n> y" in text
    assert "### 1." not in sinks.to_markdown(report, top=1).decode()
