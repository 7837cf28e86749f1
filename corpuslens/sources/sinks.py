"""Report writers: JSON, Markdown, CSV, and files with their digests."""

from __future__ import annotations

import csv
import hashlib
import io
import json
import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import html_safe_json
from ..operators.state import stored_report
from ..schemas import ACTIONS, LABELS

CSV_COLUMNS = ["url", "primary_label", "secondary_labels", "suggested_action", "priority", "confidence", "affected_prompts", "rationale", "word_count", "last_modified", "inbound_internal_links", "duplicate_cluster_id", "title"]
FORMATS = ("json", "md", "csv")


def to_json(report: dict) -> bytes:
    """Fields in order of declaration, keys of counters in order, "<", ">" and "&" as escapes, a line feed at the end."""
    ordered = dict(report)
    for k in ("by_label", "by_action"):
        ordered["summary"] = ordered["summary"] | {k: dict(sorted(ordered["summary"][k].items()))}
    text = json.dumps(ordered, indent=2, ensure_ascii=False) + "\n"
    # These three stand in strings only.
    for c in "<>&":
        text = text.replace(c, f"\\u{ord(c):04x}")
    return text.encode()


def csv_frame(entries: DataFrame) -> DataFrame:
    """The 13 columns of the CSV report, as text."""
    joined = lambda c: F.concat_ws("|", c)
    return entries.select(
        "url", "primary_label", joined("secondary_labels").alias("secondary_labels"), "suggested_action",
        F.format_string("%.1f", "priority").alias("priority"), F.format_string("%.2f", "confidence").alias("confidence"),
        joined("affected_prompts").alias("affected_prompts"), "rationale", F.col("word_count").cast("string").alias("word_count"), "last_modified",
        F.col("inbound").cast("string").alias("inbound_internal_links"), F.col("cluster_id").alias("duplicate_cluster_id"), "title",
    )


def write_csv(entries: DataFrame, path: str) -> None:
    """The same, by Spark's own writer, at any size."""
    csv_frame(entries).write.option("header", True).option("lineSep", "\r\n").option("escape", '"').csv(path)


def to_csv(report: dict) -> bytes:
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\r\n")
    w.writerow(CSV_COLUMNS)
    for p in report["pages"]:
        m = p["metadata"]
        w.writerow([p["url"], p["primary_label"], "|".join(p["secondary_labels"]), p["suggested_action"], f"{p['priority']:.1f}", f"{p['confidence']:.2f}", "|".join(p["affected_prompts"] or []), p["rationale"] or "", m["word_count"], m["last_modified"] or "", m["inbound_internal_links"], m["duplicate_cluster_id"] or "", p["title"]])
    return out.getvalue().encode()


def _block(title: str, items: list[str] | None) -> list[str]:
    return [f"**{title}:**", *(f"- {x}" for x in items), ""] if items else []


def _finding_lines(f: dict) -> list[str]:
    quoted = (f"> {line}" for line in (f["quoted_text"] or "").split("\n"))
    return [f"##### Finding {f['id']}: {f['kind']} (severity: {(f['severity'] or '').upper()})", "", f"**Location:** {f['location_hint']}", "", "**Quoted text on page:**", "", *quoted, "", f"**Issue:** {f['issue']}", "", f"**Suggested fix:** {f['suggested_fix']}", ""]


def page_section(i: int, p: dict) -> list[str]:
    """The lines about one page that needs work, the ``i``-th of its report."""
    m, focus = p["metadata"], p["page_summary"] or {}
    out = [f"### {i}. {p['suggested_action']}: {p['url']}", "", f"**Priority:** {p['priority']:.1f} | **Confidence:** {p['confidence']:.2f} | **Word count:** {m['word_count']} | **Inbound internal links:** {m['inbound_internal_links']}", "", f"**Primary label:** {p['primary_label']}"]
    if p["secondary_labels"]:
        out.append(f"**Secondary labels:** {', '.join(p['secondary_labels'])}")
    if p["affected_prompts"]:
        out.append("**Affected prompts:** " + ", ".join(f"`{x}`" for x in p["affected_prompts"]))
    out += ["", "#### Page summary", "", f"- **Current focus:** {focus.get('current_focus') or ''}"]
    if focus.get("should_focus_on") is not None:
        out.append(f"- **Should focus on:** {focus['should_focus_on']}")
    out.append("")
    if p["findings"]:
        out += ["#### Findings", "", *(line for f in p["findings"] for line in _finding_lines(f))]
    if plan := p["edit_plan"]:
        out += ["#### Edit plan", "", f"**Summary:** {plan['summary']}", "", *_block("Preserve", plan["preserve"]), *_block("Remove", plan["remove"])]
        if plan["rewrite"]:
            out += ["**Rewrite:**", *(line for r in plan["rewrite"] for line in (f"- **{r['element']}**", f"  - Currently: {r['current_framing']}", f"  - Replace with: {r['new_framing']}")), ""]
        out += _block("Add", plan["add"])
    if p["rationale"]:
        out += ["#### Rationale", "", p["rationale"], ""]
    return [*out, "---", ""]


def to_markdown(report: dict, top: int = 0) -> bytes:
    """The limit counts pages before aligned ones are left out; a document without provider or version leaves these empty."""
    s, by = report["summary"], report.get("provider") or {}
    out = ["# Content report", "", f"**Site:** {report['site']}", f"**Run:** {report['run_id']}", f"**Judge:** {by.get('judge') or ''}"]
    out += [f"**Embeddings:** {by['embedding']}"] if by.get("embedding") else []
    out += [f"**Completed:** {report['completed_at']}", f"**Duration:** {report['duration_seconds']}s", f"**API calls:** {s['total_api_calls']}", f"**Report version:** {report.get('report_version') or ''}", ""]
    out += ["## How to use this report", "", "Each numbered section is one page that needs work, the most pressing first; the lists at the end name pages that repeat one another.", ""]
    out += ["## Summary", "", "| Action | Count |", "| --- | --- |", *(f"| {a} | {s['by_action'].get(a, 0)} |" for a in ACTIONS), ""]
    out += ["**By primary label:** " + " ".join(f"{x} {s['by_label'][x]}" for x in LABELS if s["by_label"].get(x)), ""]
    out += [f"**Run stats:** {s['pages_total']} pages, {s['fetch_failures']} fetch failures, {s['judge_failures']} judge failures, {s['retries_total']} retries.", "", "---", "", "## Top priority pages", ""]
    shown = [p for p in report["pages"][: top or None] if p["primary_label"] != "Aligned"]
    for i, p in enumerate(shown, 1):
        out += page_section(i, p)
    for i, c in enumerate(report["duplicate_clusters"]):
        out += ["## Duplicate clusters", ""] * (i == 0)
        out += [f"### Cluster `{c['cluster_id']}` ({c['size']} pages, avg similarity {c['avg_similarity']:.2f})", "", f"**Canonical (keep):** {c['canonical_url']}", "", "**Redundant:**", *(f"- {u}" for u in c["member_urls"] if u != c["canonical_url"]), ""]
    return ("\n".join(out) + "\n").encode()


def wants(formats: list[str], name: str) -> bool:
    return name.lower() in {f.lower() for f in formats}


def put_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """One file on any file system that Spark knows."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def get_text(spark: SparkSession, path: str) -> str:
    """A small file of any file system that Spark knows, also one whose name Spark's readers pass over."""
    jvm = spark.sparkContext._jvm
    source = jvm.org.apache.hadoop.fs.Path(path)
    f = source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(source)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(f, "utf-8")
    finally:
        f.close()


def write_files(report: dict, folder: str, formats: list[str] = FORMATS, top: int = 0, spark: SparkSession | None = None) -> dict[str, str]:
    """Writes the wanted formats of a report that fits the driver, each with a sidecar of its digest; returns the digests.

    A report of any size is written as tables instead: ``write_csv`` and ``write_json_lines``.
    """
    spark = spark or SparkSession.active()
    makers = {"json": to_json, "md": lambda r: to_markdown(r, top), "csv": to_csv}
    out = {}
    for name, make in makers.items():
        if wants(formats, name):
            data = make(report)
            out[name] = hashlib.sha256(data).hexdigest()
            put_bytes(spark, f"{folder}/report.{name}", data)
            put_bytes(spark, f"{folder}/report.{name}.sha256", f"{out[name]}  report.{name}\n".encode())
    return out


def write_json_lines(entries: DataFrame, path: str) -> None:
    """A line of JSON for each page, by Spark's own writer, at any size."""
    entries.select(html_safe_json(F.struct(*entries.columns)).alias("value")).write.text(path)


def reemit(reports: DataFrame, run_id: str, folder: str, formats: list[str] = ()) -> list[str]:
    """Stored renderings of a run written anew: those asked for, else JSON and Markdown; a missing one raises."""
    spark = reports.sparkSession
    asked = [f.lower() for f in formats if f.lower() in FORMATS] or ["json", "md"]
    for name in asked:
        data = stored_report(reports, run_id, name)
        if data is None:
            raise LookupError(f"no {name} report is stored for run {run_id}")
        put_bytes(spark, f"{folder}/report.{name}", data)
    return asked


#: Fields whose values differ from run to run, by what stands in their place.
VOLATILE_FIELDS = {
    "<TOKENS>": ["total_input_tokens", "total_cached_tokens", "total_output_tokens", "input_tokens", "output_tokens", "cache_hit_tokens"],
    "<COUNT>": ["retries_total", "fetch_failures", "judge_failures", "embed_failures", "total_api_calls"],
    "<DURATION>": ["duration_seconds"],
    "<ATTEMPTS>": ["judge_attempts"],
    "<LATENCY>": ["latency_ms"],
    "<RUN_ID>": ["run_id"],
    "<SHA256>": ["prompts_sha256"],
    "<VERSION>": ["tool_version"],
}
_MARKDOWN_LINES = {"Run": "<RUN_ID>", "Completed": "<TIMESTAMP>", "Duration": "<DURATION>", "API calls": "<COUNT>", "Report version": "<VERSION>"}


def volatile_rules() -> list[tuple[str, str]]:
    """``(pattern, replacement)`` for JSON, then for Markdown; both Python's and Spark's regular expressions take them."""
    out = [(r'"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?Z?"', '"<TIMESTAMP>"')]
    for mask, names in VOLATILE_FIELDS.items():
        out += [(rf'"{n}":\s*(?:-?\d+|"[^"]+")', f'"{n}": "{mask}"') for n in names]
    out += [(rf"\*\*{k}:\*\* [^\n]+", f"**{k}:** {v}") for k, v in _MARKDOWN_LINES.items()]
    return [*out, (r"\*\*Run stats:\*\* \d+ pages, \d+ fetch failures, \d+ judge failures, \d+ retries\.", "**Run stats:** <COUNT> pages, <COUNT> fetch failures, <COUNT> judge failures, <COUNT> retries.")]


def normalized(text: str) -> str:
    """A report with what differs from run to run masked, for comparison."""
    for pattern, to in volatile_rules():
        text = re.sub(pattern, lambda m, to=to: to, text)
    return text


def normalized_column(text: Column) -> Column:
    """The same for a column of reports."""
    for pattern, to in volatile_rules():
        text = F.regexp_replace(text, F.lit(pattern), F.lit(to))
    return text
