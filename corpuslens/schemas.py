"""Schemas of the twelve tables, and closed vocabularies (fixed values)."""

from __future__ import annotations

from pyspark.sql.types import StructType

FINDING = "struct<id:string,kind:string,severity:string,quoted_text:string,location_hint:string,issue:string,suggested_fix:string>"
EDIT_PLAN = "struct<summary:string,preserve:array<string>,remove:array<string>,rewrite:array<struct<element:string,current_framing:string,new_framing:string>>,add:array<string>>"
PAGE_SUMMARY = "struct<current_focus:string,should_focus_on:string>"
JUDGEMENT = (
    f"primary_label string, secondary_labels array<string>, confidence double, affected_prompts array<string>, suggested_action string, "
    f"page_summary {PAGE_SUMMARY}, findings array<{FINDING}>, edit_plan {EDIT_PLAN}, rationale string"
)

TABLES = {
    "schema_migrations": "version int, applied_at timestamp",
    "runs": "id string, started_at timestamp, completed_at timestamp, site_url string, prompts_sha256 string, config_json string, llm_provider string, llm_model string, embedding_provider string, embedding_model string, tool_version string, status string, error string, pid int, last_heartbeat_at timestamp",
    "urls": "url string, run_id string, discovered_via string, discovered_from string, depth int, status string, claimed_by string, claim_expires_at timestamp, attempt_count int, next_retry_at timestamp, last_error string, discovered_at timestamp, fetched_at timestamp, final_url string, status_code int",
    "url_aliases": "alias_url string, canonical_url string, alias_type string, created_at timestamp",
    "pages": "url string, first_run_id string, final_url string, title string, meta_description string, body_text string, word_count long, is_empty_shell boolean, truncated boolean, status_code int, content_type string, last_modified string, published_date string, discovered_at timestamp, fetched_at timestamp, raw_body_sha256 string, body_size_bytes long, fetch_error string",
    "links": "from_url string, to_url string, anchor string, is_internal boolean",
    "classifications": f"run_id string, page_url string, judge_status string, claimed_by string, claim_expires_at timestamp, attempt_count int, {JUDGEMENT}, input_tokens long, output_tokens long, cache_hit_tokens long, latency_ms long, raw_response string, error string, judged_at timestamp",
    "embeddings": "run_id string, page_url string, provider string, model string, dims int, vector array<float>, embed_status string, attempt_count int, error string, created_at timestamp",
    "duplicates": "run_id string, page_url_a string, page_url_b string, similarity double, cluster_id string",
    "api_calls": "id long, run_id string, provider string, operation string, model string, page_url string, attempt_number int, input_tokens long, cached_tokens long, output_tokens long, http_status int, succeeded boolean, error string, latency_ms long, request_id string, called_at timestamp",
    "events": "id long, run_id string, timestamp timestamp, phase string, severity string, event_type string, url string, message string, payload_json string, worker_id string",
    "reports": "run_id string, format string, rendered_at timestamp, sha256 string, content binary",
}
SCHEMA_VERSION = 1

#: Key columns that a writer asserts to be unique.
KEYS = {
    "runs": ["id"], "urls": ["url"], "url_aliases": ["alias_url"], "pages": ["url"], "links": ["from_url", "to_url"],
    "classifications": ["run_id", "page_url"], "embeddings": ["run_id", "page_url", "provider", "model"], "duplicates": ["run_id", "page_url_a", "page_url_b"], "reports": ["run_id", "format"],
}

LABELS = ["Aligned", "Stale", "OffBrand", "Contradictory", "Redundant", "Thin", "Zombie", "Unclear"]
DAMAGE = {"Contradictory": 1.00, "Stale": 0.70, "OffBrand": 0.55, "Thin": 0.35, "Redundant": 0.30, "Zombie": 0.25, "Unclear": 0.20, "Aligned": 0.0}
ACTIONS = ["REWRITE", "UPDATE", "DELETE", "MANUAL_REVIEW", "KEEP"]
SEVERITY_RANK = {"high": 0, "medium": 1, "low": 2}
RUN_STATUSES = ["running", "paused_budget", "paused_user", "paused_provider_auth", "completed", "failed", "aborted"]
ACTIVE_RUN_STATUSES = ["running", "paused_budget", "paused_user", "paused_provider_auth"]
URL_STATUSES = ["discovered", "claimed", "fetching", "fetched", "failed", "skipped"]
JUDGE_STATUSES = ["pending", "claimed", "judging", "judged", "failed", "failed_schema"]
EMBED_STATUSES = ["pending", "embedding", "done", "failed"]
#: Of each status column of a queue: the value of an open row, and those of a row that a worker holds (the first from its claim on).
QUEUES = {"status": ("discovered", ("claimed", "fetching")), "judge_status": ("pending", ("claimed", "judging"))}
SEVERITIES = ["debug", "info", "warn", "error"]
DISCOVERED_VIA = ["homepage", "seed", "sitemap_index", "bfs_link", "canonical_alias", "canonical_tag"]
ALIAS_TYPES = ["http_redirect", "canonical_tag"]
#: Settings of a scan that a run keeps.
CONFIG_KEYS = ["site", "prompts", "output", "formats", "llm_provider", "llm_model", "emb_provider", "emb_model", "max_pages", "max_depth", "concurrency", "judge_concurrency", "rate", "dry_run", "find_duplicates"]
EXIT_CODES = {"ok": 0, "failure": 1, "usage": 64, "data": 65, "no_input": 66, "unavailable": 69, "software": 70, "auth": 77, "config": 78}
ERROR_EXIT_CODES = {"invalid_config": 65, "prompts_not_found": 66, "auth_failed": 77, "judge_unavailable": 69, "api_unavailable": 69, "model_missing": 78, "duplicate_run": 64, "schema_version": 70, "panicked": 70}
RETRYABLE_STATUS = [408, 425, 429, 500, 502, 503, 504, 522, 524, 529]


def schema(table: str) -> StructType:
    return StructType.fromDDL(TABLES[table])
