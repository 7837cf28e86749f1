"""Retry driver, token bucket, the page source, report files and checks."""

import gzip
import json

import pytest

from corpuslens.operators.retry import Action, ExhaustedError, Retry, TokenBucket
from corpuslens.plans import doctor as D
from corpuslens.sources import sinks
from corpuslens.sources.pages import PageSource


def test_retry_waits_and_gives_up():
    slept, seen = [], []
    r = Retry(attempts=4, base=1.0, cap=3.0, sleep=slept.append, draw=lambda: 0.5)
    answers = [(Action.RETRY, 0.0, OSError("a")), (Action.RETRY, 9.0, OSError("b")), (Action.RETRY, 2.0, OSError("c")), (Action.DONE, 0.0, None)]
    assert r.run(lambda n: answers[n - 1], lambda n, e: seen.append((n, str(e)))) == 4
    assert slept == [0.5, 3.0, 2.0] and seen == [(1, "a"), (2, "b"), (3, "c"), (4, "None")]
    with pytest.raises(ExhaustedError) as e:
        r.run(lambda n: (Action.RETRY, 0.0, OSError("x")))
    assert isinstance(e.value.__cause__, OSError)
    with pytest.raises(PermissionError):
        r.run(lambda n: (Action.ABORT, 0.0, PermissionError("no")))


def test_token_bucket_spaces_calls():
    now = [0.0]
    b = TokenBucket(4, lambda: now[0], lambda s: now.__setitem__(0, now[0] + s))
    assert [b.wait() for _ in range(3)] == [0.0, 0.25, 0.25]
    now[0] += 5
    assert b.wait() == 0.0


def test_page_source_reads_files(spark, tmp_path):
    (tmp_path / "a.html").write_text("<p>caf\u00e9</p>")
    (tmp_path / "b.xml.gz").write_bytes(gzip.compress(b"<urlset/>"))
    urls = [f"file://{tmp_path}/{n}" for n in ("a.html", "b.xml.gz", "missing.html")]
    spark.dataSource.register(PageSource)
    got = {r.url: r for r in spark.read.format("audit_pages").option("urls", " ".join(urls)).option("rate", "1000").load().collect()}
    assert got[urls[0]].html == "<p>caf\u00e9</p>" and got[urls[0]].status_code == 200 and not got[urls[0]].truncated
    assert got[urls[1]].html == "<urlset/>"
    assert got[urls[2]].html is None and got[urls[2]].error


def _report():
    finding = {"id": "f1", "kind": "stale_fact", "severity": "high", "quoted_text": "a\nb", "location_hint": "top", "issue": "<old> & wrong", "suggested_fix": "new"}
    plan = {"summary": "s", "preserve": ["p"], "remove": [], "add": ["q"], "rewrite": [{"element": "h1", "current_framing": "c", "new_framing": "n"}]}
    page = lambda u, label: {"url": u, "title": "t", "primary_label": label, "secondary_labels": ["Stale"], "confidence": 0.5, "suggested_action": "UPDATE", "priority": 12.5, "affected_prompts": ["p1", "p2"], "page_summary": {"current_focus": "x", "should_focus_on": "y"}, "findings": [finding], "edit_plan": plan, "rationale": "because", "metadata": {"word_count": 3, "last_modified": None, "inbound_internal_links": 1, "duplicate_cluster_id": None}}
    summary = {"by_label": {"Stale": 1, "Aligned": 1}, "by_action": {"UPDATE": 2}, "pages_total": 2, "fetch_failures": 0, "judge_failures": 0, "retries_total": 3, "total_api_calls": 4}
    return {"report_version": "1", "run_id": "r-77", "site": "https://s.example", "provider": {"judge": "rules", "embedding": "fake"}, "started_at": "2024-01-01T00:00:00Z", "completed_at": "2024-01-01T00:01:00Z", "duration_seconds": 60, "summary": summary, "pages": [page("https://s.example/a", "Aligned"), page("https://s.example/b", "Stale")], "duplicate_clusters": [{"cluster_id": "cl_001", "canonical_url": "u1", "member_urls": ["u1", "u2"], "size": 2, "avg_similarity": 0.955}], "failures": []}


def test_report_files(spark, tmp_path):
    report = _report()
    digests = sinks.write_files(report, f"file://{tmp_path}/out", ["JSON", "md", "csv"], spark=spark)
    raw = (tmp_path / "out" / "report.json").read_text()
    assert json.loads(raw) == report and raw.endswith("}\n") and not set("<>&") & set(raw)
    assert (tmp_path / "out" / "report.json.sha256").read_text() == f"{digests['json']}  report.json\n"
    text = (tmp_path / "out" / "report.md").read_text()
    for line in ("## How to use this report", "| UPDATE | 2 |", "**By primary label:** Aligned 1 Stale 1", "### 1. UPDATE: https://s.example/b", "#### Findings", "**Quoted text on page:**", "> b", "**Rewrite:**", "  - Replace with: n", "**Canonical (keep):** u1", "- u2"):
        assert line in text.split("\n"), line
    assert "https://s.example/a" not in text and "**Remove:**" not in text


def test_normalized_reports_are_equal(spark):
    other = _report() | {"run_id": "zz-1", "completed_at": "2025-02-02T01:01:01Z", "duration_seconds": 9}
    for make in (sinks.to_json, sinks.to_markdown):
        a, b = (make(r).decode() for r in (_report(), other))
        assert a != b and sinks.normalized(a) == sinks.normalized(b)


def test_checks_and_store(spark, tmp_path):
    def broken():
        raise OSError("no network")

    rows = D.checks(spark, {"network/dns": broken}).collect()
    assert {r.name: r.status for r in rows}["network/dns"] == "warn"
    text = D.check_table(rows)
    assert text.endswith("Result: PASS\n") and "no network" in text
    bad = spark.createDataFrame([("x", "fail", "d", "do this", True)], D.CHECK)
    assert D.critical_failures(bad).first()[0] == 1 and "Result: FAIL (1 critical)" in D.check_table(bad.collect())
    assert json.loads(D.check_lines(bad).first()[0]) == {"name": "x", "status": "fail", "detail": "d", "fix": "do this", "critical": True}
    for _ in range(2):
        tables = D.open_store(spark, f"file://{tmp_path}/store")
    assert tables["schema_migrations"].count() == 1 and tables["runs"].count() == 0
    assert "Pages" in D.summary_table({"pages_total": 2, "by_label": {"Stale": 1}, "by_action": {"UPDATE": 1}})
    assert json.loads(D.info())["schema_version"] == 1
