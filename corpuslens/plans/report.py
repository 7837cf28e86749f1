"""The report: pages joined with judgements, in-degrees and clusters, scored and ordered; summaries; one nested row."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Observation, functions as F

from ..functions.scores import priority, rfc3339, sort_findings, sort_labels
from ..schemas import ACTIONS, EDIT_PLAN, FINDING, LABELS, PAGE_SUMMARY

ENTRY_DEFAULTS = {"primary_label": "string", "secondary_labels": "array<string>", "confidence": "double", "affected_prompts": "array<string>", "suggested_action": "string", "page_summary": PAGE_SUMMARY, "findings": f"array<{FINDING}>", "edit_plan": EDIT_PLAN, "rationale": "string", "judge_status": "string", "attempt_count": "int", "input_tokens": "long", "cache_hit_tokens": "long", "output_tokens": "long", "latency_ms": "long", "judged_at": "timestamp"}


def max_inbound(inbound: DataFrame) -> DataFrame:
    """One row; the largest in-degree of any target, pages or not; 0 without links."""
    return inbound.agg(F.coalesce(F.max("inbound"), F.lit(0)).alias("max_inbound"))


def page_entries(pages: DataFrame, classifications: DataFrame, inbound: DataFrame, members: DataFrame) -> DataFrame:
    """A row for each of ``pages(url, title, word_count, ...)``, in no order.

    ``inbound(to_url, inbound)``, ``members(member, cluster_id)``; where members have their ``root``, entries tell a cluster's
    one ``cluster_head``.  A page without a judgement has empty label and
    action, confidence 0, no secondary labels, and null findings and prompts.
    """
    c = classifications
    for name, kind in ENTRY_DEFAULTS.items():
        if name not in c.columns:
            c = c.withColumn(name, F.lit(None).cast(kind))
    c = c.select(F.col("page_url").alias("url"), *ENTRY_DEFAULTS)
    heads = [(F.col("member") == F.col("root")).alias("cluster_head")] if "root" in members.columns else []
    joined = (
        pages.join(c, "url", "left")
        .join(inbound.select(F.col("to_url").alias("url"), "inbound"), "url", "left")
        .join(members.select(F.col("member").alias("url"), "cluster_id", *heads), "url", "left")
        # One row, from an aggregate without keys.
        .join(F.broadcast(max_inbound(inbound)))
    )
    confidence = F.coalesce("confidence", F.lit(0.0))
    count: Column = F.coalesce("inbound", F.lit(0))
    extra = [x for x in ("final_url", "last_modified", "published_date") if x in pages.columns]
    return joined.select(
        "url", "title", "word_count", *extra,
        F.coalesce("primary_label", F.lit("")).alias("primary_label"), sort_labels(F.col("secondary_labels")).alias("secondary_labels"), confidence.alias("confidence"),
        F.coalesce("suggested_action", F.lit("")).alias("suggested_action"), priority(F.coalesce("primary_label", F.lit("")), confidence, count, F.col("max_inbound")).alias("priority"),
        F.array_sort("affected_prompts").alias("affected_prompts"), "page_summary", sort_findings(F.col("findings")).alias("findings"), "edit_plan", "rationale",
        count.alias("inbound"), "cluster_id", "judge_status", *(F.coalesce(x, F.lit(0)).alias(x) for x in ("attempt_count", "input_tokens", "cache_hit_tokens", "output_tokens", "latency_ms")), "judged_at",
        *([F.coalesce("cluster_head", F.lit(False)).alias("cluster_head")] if heads else []),
    )


def ordered(entries: DataFrame) -> DataFrame:
    return entries.orderBy(F.desc("priority"), "url")


def summary(entries: DataFrame) -> DataFrame:
    """One row of counters."""
    return entries.agg(
        F.count("*").alias("pages_total"),
        F.count_if(F.col("judge_status") == "judged").alias("pages_judged"),
        F.count_if(F.col("judge_status").isin("failed", "failed_schema")).alias("pages_failed"),
        F.count_if(F.col("primary_label") == "Unclear").alias("pages_unclear"),
        F.countDistinct(F.when(F.col("cluster_id").isNotNull(), F.col("url"))).alias("pages_with_duplicates"),
        F.countDistinct("cluster_id").alias("duplicate_clusters_count"),
    )


def counters(entries: DataFrame, column: str) -> DataFrame:
    """``(column, count)``; empty values are not counted."""
    return entries.filter(F.col(column) != "").groupBy(column).agg(F.count("*").alias("count"))


def observed(entries: DataFrame) -> tuple[DataFrame, Observation]:
    """``entries`` that count themselves while they are written, and the counts, which the first action fills: those of
    ``summary`` and of ``counters``, without a pass of their own.  Entries need ``cluster_head``."""
    label, action = F.col("primary_label"), F.col("suggested_action")
    counts = [
        F.count(F.lit(1)).alias("pages_total"),
        F.count_if(F.col("judge_status") == "judged").alias("pages_judged"),
        F.count_if(F.col("judge_status").isin("failed", "failed_schema")).alias("pages_failed"),
        F.count_if(label == "Unclear").alias("pages_unclear"),
        F.count_if(F.col("cluster_id").isNotNull()).alias("pages_with_duplicates"),
        F.count_if("cluster_head").alias("duplicate_clusters_count"),
        *(F.count_if(label == x).alias(f"label {x}") for x in LABELS),
        *(F.count_if(action == x).alias(f"action {x}") for x in ACTIONS),
    ]
    seen = Observation()
    return entries.observe(seen, *counts), seen


def observed_summary(seen: Observation) -> dict:
    """The summary of a report from what a write has ``observed``; labels and actions without pages are left out."""
    out = {k: v for k, v in seen.get.items() if " " not in k}
    part = lambda kind: {k.partition(" ")[2]: v for k, v in sorted(seen.get.items()) if k.startswith(f"{kind} ") and v}
    return out | {"by_label": part("label"), "by_action": part("action")}


def failures(urls: DataFrame, classifications: DataFrame) -> DataFrame:
    """``(phase, url, attempts, last_error)`` of failed fetches and judgements, ordered."""
    fetch = urls.filter(F.col("status") == "failed").select(F.lit("crawl").alias("phase"), "url", F.col("attempt_count").alias("attempts"), "last_error")
    judge = classifications.filter(F.col("judge_status").isin("failed", "failed_schema")).select(F.lit("judge").alias("phase"), F.col("page_url").alias("url"), F.col("attempt_count").alias("attempts"), F.col("error").alias("last_error"))
    return fetch.unionByName(judge).orderBy("phase", "url")


def build(entries: DataFrame, clusters: DataFrame, failed: DataFrame, run: dict, calls: dict | None = None, top: int = 0) -> dict:
    """The whole report as one document for the writers; pages beyond ``top`` (0: all) stay in the table."""
    rows = ordered(entries) if not top else ordered(entries).limit(top)
    shown = []
    for r in rows.withColumn("judged_at", rfc3339(F.col("judged_at"))).toJSON().collect():
        p = json.loads(r)
        shown.append({
            "url": p["url"], "final_url": p.get("final_url") or p["url"], "title": p.get("title") or "", "primary_label": p["primary_label"], "secondary_labels": p["secondary_labels"], "confidence": p["confidence"],
            "suggested_action": p["suggested_action"], "priority": p["priority"], "affected_prompts": p.get("affected_prompts"), "page_summary": p.get("page_summary"), "findings": p.get("findings"), "edit_plan": p.get("edit_plan"), "rationale": p.get("rationale") or "",
            "metadata": {"word_count": p["word_count"], "last_modified": p.get("last_modified"), "published_date": p.get("published_date"), "inbound_internal_links": p["inbound"], "duplicate_cluster_id": p.get("cluster_id"), "judge_attempts": p["attempt_count"], "judged_at": p.get("judged_at"), "input_tokens": p["input_tokens"], "cache_hit_tokens": p["cache_hit_tokens"], "output_tokens": p["output_tokens"], "latency_ms": p["latency_ms"]},
        })
    s = summary(entries).first().asDict()
    failed_rows = [r.asDict() for r in failed.collect()]
    s |= {f"by_{k}": {r[0]: r[1] for r in counters(entries, c).collect()} for k, c in (("label", "primary_label"), ("action", "suggested_action"))}
    s |= {"total_api_calls": 0, "total_input_tokens": 0, "total_cached_tokens": 0, "total_output_tokens": 0, "retries_total": 0} | (calls or {})
    s |= {f"{k}_failures": sum(r["phase"] == p for r in failed_rows) for k, p in (("fetch", "crawl"), ("judge", "judge"), ("embed", "embed"))}
    head = {"report_version": "1", "run_id": run.get("id", ""), "site": run.get("site_url", ""), "provider": {"judge": run.get("llm_provider", "rules"), "embedding": run.get("embedding_provider")}, "started_at": run.get("started_at"), "completed_at": run.get("completed_at"), "duration_seconds": run.get("duration_seconds", 0)}
    return head | {"summary": s, "pages": shown, "duplicate_clusters": [r.asDict() for r in clusters.orderBy("cluster_id").collect()], "failures": failed_rows}
