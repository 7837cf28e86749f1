"""Scores, vectors, times and rules as column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

from ..schemas import ACTIONS, DAMAGE, ERROR_EXIT_CODES, LABELS, RETRYABLE_STATUS, SEVERITY_RANK


def lookup(values: dict, key: Column, default) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for x in chain(*values.items())))[key], F.lit(default))


def damage(label: Column) -> Column:
    """Weight of a label; an unknown one weighs nothing."""
    return lookup(DAMAGE, label, 0.0)


def priority(label: Column, confidence: Column, inbound: Column, max_inbound: Column) -> Column:
    """Damage times reach times confidence, of 100, to one decimal."""
    reach = F.when(max_inbound > 0, 0.5 + 0.5 * inbound / max_inbound).otherwise(0.5)
    p = damage(label) * reach * confidence * 100.0
    return F.floor(p * 10 + 0.5) / 10.0


def repaired_confidence(c: Column) -> Column:
    """Percentages become shares; the rest is held within [0, 1]."""
    return F.when((c > 10) & (c <= 100), c / 100.0).when(c < 0, 0.0).when(c > 1, 1.0).otherwise(c)


def capped_confidence(c: Column, action: Column) -> Column:
    return F.when((action == "MANUAL_REVIEW") & (c >= 0.6), 0.59).otherwise(c)


def severity_rank(s: Column) -> Column:
    """0 is the gravest; an unknown severity counts as such."""
    return lookup(SEVERITY_RANK, s, 0)


def sort_findings(findings: Column) -> Column:
    """By severity, then id as a string; equal ones keep their order."""
    ranked = F.transform(findings, lambda f, i: F.struct(severity_rank(f["severity"]).alias("r"), F.coalesce(f["id"], F.lit("")).alias("id"), i.alias("i"), f.alias("f")))
    return F.transform(F.array_sort(ranked, lambda a, b: F.when(_less(a, b), -1).when(_less(b, a), 1).otherwise(0)), lambda x: x["f"])


def _less(a: Column, b: Column) -> Column:
    return (a["r"] < b["r"]) | ((a["r"] == b["r"]) & ((a["id"] < b["id"]) | ((a["id"] == b["id"]) & (a["i"] < b["i"]))))


def sort_labels(labels: Column) -> Column:
    """By the vocabulary's order, unknown ones as the first of it; equal ones keep their order; null becomes empty."""
    order = {name: i for i, name in enumerate(LABELS)}
    ranked = F.transform(F.coalesce(labels, F.array().cast("array<string>")), lambda x, i: F.struct(lookup(order, x, 0).alias("r"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(ranked), lambda y: y["x"])


def cosine(a: Column, b: Column) -> Column:
    """Of two arrays, in double precision; 0 where lengths differ, one is empty, or one has no length."""
    d = lambda v: F.transform(v, lambda x: x.cast("double"))
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    dot = total(F.zip_with(d(a), d(b), lambda x, y: x * y))
    na, nb = (total(F.transform(d(v), lambda x: x * x)) for v in (a, b))
    return F.when((F.size(a) != F.size(b)) | (F.size(a) == 0) | (na == 0) | (nb == 0), 0.0).otherwise(dot / (F.sqrt(na) * F.sqrt(nb)))


def l2_normalize(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0).cast("double"), lambda s, x: s + x.cast("double") * x.cast("double"))).cast("float")
    return F.when(norm == 0, v).otherwise(F.transform(v, lambda x: (x / norm).cast("float")))


def judgement_violations(label: Column, action: Column, findings: Column, edit_plan: Column, should_focus: Column) -> Column:
    """Structural rules that a judgement breaks, in order."""
    none = F.coalesce(F.size(findings), F.lit(0)) <= 0
    aligned = (label == "Aligned") & (~none | edit_plan.isNotNull() | (action != "KEEP") | should_focus.isNotNull())
    rewrite = action.isin("UPDATE", "REWRITE") & (edit_plan.isNull() | none)
    delete = (action == "DELETE") & (none | edit_plan.isNotNull())
    return F.array_compact(F.array(F.when(aligned, "aligned"), F.when(rewrite, "update_or_rewrite"), F.when(delete, "delete")))


def quoted_findings(findings: Column, body: Column) -> Column:
    """Findings whose quotation is empty or stands in the body."""
    return F.filter(findings, lambda f: (F.coalesce(f["quoted_text"], F.lit("")) == "") | F.contains(F.coalesce(body, F.lit("")), f["quoted_text"]))


def known_ids(ids: Column, known: Column) -> Column:
    """Order and repetitions stay."""
    return F.filter(ids, lambda x: F.array_contains(known, x))


def parse_time(text: Column) -> Column:
    """One of five layouts, as UTC; null where none fits."""
    layouts = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSS", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"]
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(x)) for x in layouts))


def http_date(text: Column) -> Column:
    """RFC 1123 dates; the weekday is not looked at."""
    return F.try_to_timestamp(F.substring(text, 6, 100), F.lit("dd MMM yyyy HH:mm:ss 'GMT'"))


def rfc3339(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def retry_after_seconds(header: Column, now: Column) -> Column:
    """Seconds from a number or a date; 0 for neither or the past."""
    number = F.when(header.rlike(r"^\s*\d{1,9}\s*$"), F.trim(header)).try_cast("long")
    date = F.unix_timestamp(http_date(header)) - F.unix_timestamp(now)
    return F.greatest(F.coalesce(number, date, F.lit(0)), F.lit(0)).cast("long")


def backoff_bound(base: float, cap: float, attempt: Column, retry_after: Column) -> Column:
    """The longest wait before a further attempt; what the server asks for wins, up to the cap."""
    own = F.least(F.lit(cap), F.lit(base) * F.pow(F.lit(2.0), F.least(attempt - 1, F.lit(60))))
    return F.when(retry_after > 0, F.least(retry_after.cast("double"), F.lit(cap))).otherwise(own)


def backoff_delay(base: float, cap: float, attempt: Column, retry_after: Column, seed: Column) -> Column:
    """A wait drawn evenly from zero to the bound, by a hash of ``seed`` and the attempt; what the server asks for is no draw."""
    bound = backoff_bound(base, cap, attempt, retry_after)
    share = F.pmod(F.xxhash64(seed, attempt), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return F.when(retry_after > 0, bound).otherwise(bound * share)


def now_utc() -> Column:
    """The query's own time, in whole seconds."""
    return F.date_trunc("second", F.current_timestamp())


def duration_seconds(started: Column, ended: Column) -> Column:
    """Whole seconds; 0 where an end is missing."""
    return F.coalesce(F.unix_timestamp(ended) - F.unix_timestamp(started), F.lit(0)).cast("long")


def time_ago(at: Column, now: Column) -> Column:
    """A time with its age in hours, minutes and seconds, as far as they count."""
    s = F.unix_timestamp(now) - F.unix_timestamp(at)
    h, m = F.floor(s / 3600).cast("long"), F.floor(F.pmod(s, F.lit(3600)) / 60).cast("long")
    parts = F.concat(F.when(h > 0, F.concat(h.cast("string"), F.lit("h"))).otherwise(""), F.when((h > 0) | (m > 0), F.concat(m.cast("string"), F.lit("m"))).otherwise(""), F.pmod(s, F.lit(60)).cast("string"), F.lit("s"))
    return F.when(at.isNull(), "(never)").otherwise(F.concat(F.date_format(at, "yyyy-MM-dd HH:mm:ss 'UTC ('"), parts, F.lit(" ago)")))


def exit_code(error: Column) -> Column:
    """A process's exit code for the kind of an error; 0 for none, 1 for an unknown one."""
    return F.when(error.isNull(), 0).otherwise(lookup(ERROR_EXIT_CODES, error, 1))


def is_retryable_status(code: Column) -> Column:
    return code.isin(RETRYABLE_STATUS)


def is_retryable_error(message: Column) -> Column:
    return F.lower(F.coalesce(message, F.lit(""))).rlike("timeout|timed out|deadline exceeded|connection reset|connection refused|broken pipe|unexpected eof|temporary failure|no such host")


def next_action(status: Column, error: Column, heartbeat: Column, now: Column) -> Column:
    """What to do about a run, from its status and its last sign of life."""
    stale = heartbeat < now - F.expr("INTERVAL 5 MINUTES")
    return (
        F.when(status.isNull(), "no_runs")
        .when(status == "completed", "render_report")
        .when((status == "failed") & (F.coalesce(error, F.lit("")) != ""), F.concat(F.lit("inspect_events: "), error))
        .when(status == "failed", "inspect_events")
        .when(status == "aborted", "resume")
        .when(status == "paused_budget", "raise_page_limit_and_resume")
        .when(status == "paused_user", "resume_after_pause")
        .when(status == "paused_provider_auth", "check_credentials_and_resume")
        .when((status == "running") & stale, "resume_crashed")
        .when(status == "running", "wait")
        .otherwise(F.concat(F.lit("inspect_state: "), status))
    )


def action_order(action: Column) -> Column:
    return lookup({a: i for i, a in enumerate(ACTIONS)}, action, len(ACTIONS))
