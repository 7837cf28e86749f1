"""Page judgements: pluggable judges, repair and validation rules, thin pages, relabelling of duplicates."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scores import capped_confidence, judgement_violations, known_ids, quoted_findings, repaired_confidence
from ..functions.text import byte_prefix, list_json, title_or_url
from ..schemas import FINDING, JUDGEMENT

RETRIES = 3
#: From the second try on a judge sees this many bytes of the body.
SHORT_BODY = 1000


class AuthError(Exception):
    """The judge refused the credentials: no further try is made."""


def rule_judge(request: dict) -> dict:
    """Deterministic stand-in for a model: labels from the body's own signs."""
    body = request["body_text"]
    words = len(body.split())
    label, action = ("Unclear", "MANUAL_REVIEW") if words < 120 else ("Aligned", "KEEP")
    return {
        "primary_label": label, "secondary_labels": [], "confidence": 0.5 if label == "Unclear" else 0.9, "affected_prompts": [], "suggested_action": action,
        "page_summary": {"current_focus": request["title"] or request["url"], "should_focus_on": None}, "findings": [], "edit_plan": None, "rationale": f"{words} words",
    }


class TableJudge:
    """Canned answers by url, else a default, else an error."""

    def __init__(self, answers: dict[str, dict] | None = None, default: dict | None = None):
        self.answers, self.default = answers or {}, default

    def __call__(self, request: dict) -> dict:
        answer = self.answers.get(request["url"], self.default)
        if answer is None:
            raise LookupError(f"no answer for {request['url']}")
        return answer


def _check(answer: dict, body: str, known: set[str]) -> dict:
    """The rules of ``validated`` for one answer, raising where one is broken."""
    a = {"secondary_labels": [], "affected_prompts": [], "findings": [], "edit_plan": None, "page_summary": None, "rationale": ""} | answer
    c = float(a["confidence"])
    c = c / 100 if 10 < c <= 100 else min(max(c, 0.0), 1.0)
    findings, plan, action = a["findings"] or [], a["edit_plan"], a["suggested_action"]
    focus = (a["page_summary"] or {}).get("should_focus_on")
    if a["primary_label"] == "Aligned" and (findings or plan is not None or action != "KEEP" or focus is not None):
        raise ValueError("aligned")
    if action in ("UPDATE", "REWRITE") and (plan is None or not findings):
        raise ValueError("update_or_rewrite")
    if action == "DELETE" and (not findings or plan is not None):
        raise ValueError("delete")
    kept = [f for f in findings if not f.get("quoted_text") or f["quoted_text"] in body]
    if findings and not kept:
        raise ValueError("no quotation stands in the body")
    return a | {"confidence": 0.59 if action == "MANUAL_REVIEW" and c >= 0.6 else c, "findings": kept, "affected_prompts": [p for p in a["affected_prompts"] or [] if p in known]}


def judged(pages: DataFrame, judge: Callable[[dict], dict] = rule_judge, prompts: list[str] = ()) -> DataFrame:
    """``pages(url, title, body_text)`` with a judgement, its status and the number of tries.

    A broken rule or an error is tried again, with a shorter body; refused credentials end the row at once.
    """
    known = set(prompts)
    names = [x.split(" ")[0] for x in _top_level(JUDGEMENT)]

    def ask(url: str, title: str, body: str) -> dict:
        error = ""
        for attempt in range(1, RETRIES + 1):
            seen = body if attempt == 1 else body.encode()[:SHORT_BODY].decode(errors="ignore")
            try:
                return _check(judge({"url": url, "title": title, "body_text": seen, "attempt": attempt}), body, known) | {"judge_status": "judged", "attempts": attempt, "error": None}
            except AuthError as e:
                return {"judge_status": "failed", "attempts": attempt, "error": str(e)}
            except Exception as e:  # whatever a judge raises counts as a failed try
                error = str(e)
        return {"judge_status": "failed_schema", "attempts": RETRIES, "error": error}

    def run(frames):
        for f in frames:
            rows = [ask(u, t or "", b or "") for u, t, b in zip(f["url"], f["title"], f["body_text"])]
            for r in rows:
                if r["judge_status"] != "judged":
                    r |= {"primary_label": "Unclear", "confidence": 0.0, "suggested_action": "MANUAL_REVIEW"}
            out = pd.DataFrame([{k: json.dumps(r.get(k)) for k in names} | {"judge_status": r["judge_status"], "attempts": r["attempts"], "error": r["error"]} for r in rows], columns=[*names, "judge_status", "attempts", "error"])
            out.insert(0, "page_url", list(f["url"]))
            yield out

    raw = pages.select("url", "title", "body_text").mapInPandas(run, "page_url string, " + ", ".join(f"{n} string" for n in names) + ", judge_status string, attempts int, error string")
    kinds = dict(x.split(" ", 1) for x in _top_level(JUDGEMENT))
    nested = F.from_json(F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(F.lit(f'"{n}":'), F.col(n)) for n in names)), F.lit("}")), ", ".join(f"{n} {k}" for n, k in kinds.items()))
    return raw.select("page_url", nested.alias("j"), "judge_status", "attempts", "error").select("page_url", "j.*", "judge_status", "attempts", "error")


def encoded(*fields: str) -> Column:
    """A judgement's fields as one JSON object; missing lists are empty ones."""
    lists = {"secondary_labels", "affected_prompts", "findings"}
    parts = [F.concat(F.lit(f'"{n}":'), list_json(F.col(n)) if n in lists else F.regexp_extract(F.to_json(F.struct(F.col(n).alias("v")), {"ignoreNullFields": "false"}), r'(?s)^\{"v":(.*)\}$', 1)) for n in fields]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def _top_level(ddl: str) -> list[str]:
    out, depth, at = [], 0, 0
    for i, c in enumerate(ddl):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(ddl[at:i].strip())
            at = i + 1
    return [*out, ddl[at:].strip()]


def validated(judgements: DataFrame, known: Column) -> DataFrame:
    """Repairs and rules over columns: adds ``violations`` and, where there are none, the repaired columns.

    The structural rules see the findings before those without a standing quotation go.
    """
    c = repaired_confidence(F.col("confidence"))
    kept = quoted_findings(F.col("findings"), F.col("body_text"))
    broken = judgement_violations(F.col("primary_label"), F.col("suggested_action"), F.col("findings"), F.col("edit_plan"), F.col("page_summary.should_focus_on"))
    unquoted = (F.size("findings") > 0) & (F.size(kept) == 0)
    return judgements.withColumns(
        {
            "violations": F.when(F.size(broken) > 0, F.slice(broken, 1, 1)).when(unquoted, F.array(F.lit("quotation"))).otherwise(F.slice(broken, 1, 0)),
            "confidence": capped_confidence(c, F.col("suggested_action")),
            "findings": kept,
            "affected_prompts": known_ids(F.col("affected_prompts"), known),
        }
    )


def finding(i: Column, kind: str, quoted: Column, issue: Column, fix: Column) -> Column:
    return F.struct(F.format_string("f%d", i).alias("id"), F.lit(kind).alias("kind"), F.lit("high").alias("severity"), quoted.alias("quoted_text"), F.lit("entire page").alias("location_hint"), issue.alias("issue"), fix.alias("suggested_fix"))


def thin_judgements(pages: DataFrame, threshold: int = 50) -> DataFrame:
    """Judgements of thin pages, for which no judge is asked."""
    thin = pages.filter(F.col("is_empty_shell") | (F.col("word_count") < threshold))
    one = finding(F.lit(1), "thin_content", byte_prefix(F.col("body_text"), 100), F.lit(f"The page has fewer than {threshold} words of content."), F.lit("Delete the page or give it content."))
    return thin.select(F.col("url").alias("page_url"), F.lit("Thin").alias("primary_label"), F.array().cast("array<string>").alias("secondary_labels"), F.lit(1.0).alias("confidence"), F.lit("DELETE").alias("suggested_action"), F.array(one).alias("findings"))


def relabel_redundant(classifications: DataFrame, members: DataFrame) -> DataFrame:
    """Cluster members that are not kept become redundant.

    ``members(page_url, canonical, cluster_id, title, canonical_words)`` lists those.  A page that already has the
    finding gets no second one, so the step can be repeated.
    """
    m = members.select("page_url", F.col("canonical").alias("__to"), F.col("cluster_id").alias("__cluster"), F.col("title").alias("__title"), F.col("canonical_words").alias("__words"))
    joined = classifications.join(m, "page_url", "left")
    findings = F.coalesce("findings", F.array().cast(f"array<{FINDING}>"))
    hit = F.col("__to").isNotNull() & ~F.exists(findings, lambda f: F.coalesce(f["kind"], F.lit("")) == "redundant_with_other_page")
    hit = F.coalesce(hit, F.lit(False))
    primary = F.coalesce("primary_label", F.lit("")).isin("Aligned", "Unclear", "")
    labels = F.array_sort(F.array_distinct(F.array_append(F.coalesce("secondary_labels", F.array().cast("array<string>")), F.lit("Redundant"))))
    more = finding(F.size(findings) + 1, "redundant_with_other_page", title_or_url(F.col("__title"), F.col("page_url")), F.concat(F.lit("Near-duplicate of "), F.col("__to"), F.lit(" (cluster "), F.col("__cluster"), F.lit(").")), F.concat(F.lit("Delete and redirect to "), F.col("__to"), F.lit(", which has "), F.col("__words").cast("string"), F.lit(" words.")))
    drop = F.coalesce("suggested_action", F.lit("")).isin("", "KEEP")
    changed = {
        "primary_label": F.when(hit & primary, "Redundant").otherwise(F.col("primary_label")),
        "secondary_labels": F.when(hit & ~primary, labels).otherwise(F.col("secondary_labels")),
        "findings": F.when(hit, F.concat(findings, F.array(more))).otherwise(F.col("findings")),
        "suggested_action": F.when(hit & drop, "DELETE").otherwise(F.col("suggested_action")),
        "edit_plan": F.when(~(hit & drop), F.col("edit_plan")) if "edit_plan" in classifications.columns else None,
    }
    return joined.select(*(changed[c].alias(c) if changed.get(c) is not None else F.col(c) for c in classifications.columns))
