"""State tables: insert-or-ignore, upserts, claims, leases and status changes as whole-table joins.

A table is a DataFrame; each function returns the table's next version.  ``now`` is a column, so a
replay is exact.  Where several new rows share a key, ``order`` says which is first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..schemas import ACTIVE_RUN_STATUSES, KEYS, QUEUES
from ..session import materialize


def insert_or_ignore(existing: DataFrame, new: DataFrame, key: list[str], order: list[str] | None = None, repeats: bool = False) -> DataFrame:
    """Rows whose key exists are ignored; of new rows with one key the first stays, or with ``repeats`` all of them."""
    first = new
    if not repeats:
        rank = F.row_number().over(W.partitionBy(*key).orderBy(*(order or new.columns)))
        first = new.withColumn("__n", rank).filter("__n = 1").drop("__n")
    return existing.unionByName(first.join(existing.select(*key), key, "left_anti").select(*existing.columns))


def upsert(existing: DataFrame, new: DataFrame, key: list[str], keep: list[str] = (), order: list[str] | None = None) -> DataFrame:
    """New rows replace old ones, but for the columns in ``keep``; of new rows with one key the last stays."""
    rank = F.row_number().over(W.partitionBy(*key).orderBy(*(F.desc(c) for c in order or new.columns)))
    last = new.withColumn("__n", rank).filter("__n = 1").drop("__n").withColumn("__new", F.lit(True))
    o, n = existing.alias("o"), last.alias("n")
    joined = o.join(n, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in key], "full_outer")
    cols = []
    for c in existing.columns:
        if c in key or c in keep:
            cols.append(F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c))
        else:
            cols.append(F.when(F.col("n.__new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
    return joined.select(*cols)


def upsert_pages(existing: DataFrame, new: DataFrame) -> DataFrame:
    return upsert(existing, new, ["url"], keep=["first_run_id", "discovered_at"], order=["fetched_at"])


def insert_run(runs: DataFrame, new: DataFrame) -> DataFrame:
    """One active run for each site and configuration; a second one raises."""
    active = runs.filter(F.col("status").isin(ACTIVE_RUN_STATUSES))
    clash = new.join(active, ["site_url", "prompts_sha256"], "left_semi")
    if not clash.isEmpty():
        raise ValueError("an active run exists for this site and configuration")
    return runs.unionByName(new)


def assert_unique(df: DataFrame, table: str) -> DataFrame:
    """Raises where the table's key repeats, else returns it."""
    if not df.groupBy(*KEYS[table]).count().filter("count > 1").isEmpty():
        raise ValueError(f"{table}: key repeats")
    return df


def insert_pairs(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Pairs must have a < b."""
    checked = new.withColumn("page_url_a", F.when(F.col("page_url_a") < F.col("page_url_b"), F.col("page_url_a")).otherwise(F.raise_error(F.lit("a pair's first page must come before its second")).cast("string")))
    return insert_or_ignore(existing, checked, ["run_id", "page_url_a", "page_url_b"], ["similarity"])


def upsert_embeddings(existing: DataFrame, new: DataFrame) -> DataFrame:
    checked = new.withColumn("dims", F.when(F.size("vector") == F.col("dims"), F.col("dims")).otherwise(F.raise_error(F.lit("dims differ from the vector's length")).cast("int")))
    return upsert(existing, checked, ["run_id", "page_url", "provider", "model"], order=["created_at"])


def _moment(table: DataFrame, status: str, now: Column) -> Column:
    """Whether a row may be claimed: it is open, or failed with a retry that is due at this very moment or was before."""
    due = F.col(status) == QUEUES[status][0]
    if "next_retry_at" in table.columns:
        due = due | ((F.col(status) == "failed") & F.col("next_retry_at").isNotNull() & (F.col("next_retry_at") <= now))
    return F.coalesce(due, F.lit(False))


def claims(table: DataFrame, worker: Column, now: Column, ttl_seconds: int, n: int = 1, status: str = "status", order: list[str] = ("depth", "discovered_at", "url"), key: list[str] = ("url",), runs: str = "run_id") -> DataFrame:
    """The rows that are claimed, as they are afterwards: of each run the first ``n`` that are due.

    Each task keeps its own first ``n`` of a run, and only those are shuffled by run (Spark does so for up to
    ``spark.sql.optimizer.windowGroupLimitThreshold`` rows), so a queue of any size in one run costs no shuffle of it.
    """
    rank = F.row_number().over(W.partitionBy(runs).orderBy(*order, *key))
    held = table.filter(_moment(table, status, now)).withColumn("__n", rank).filter(F.col("__n") <= n)
    changed = {
        status: F.lit(QUEUES[status][1][0]),
        "claimed_by": worker,
        "claim_expires_at": now + F.make_dt_interval(secs=F.lit(float(ttl_seconds))),
        "attempt_count": (F.col("attempt_count") + 1).cast("int"),
    }
    return held.select(*(changed[c].alias(c) if c in changed else F.col(c) for c in table.columns))


def put(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """The table with ``rows`` in the place of those of the same key; a written table of few rows is broadcast."""
    return table.join(rows.select(*key), list(key), "left_anti").select(*table.columns).unionByName(rows)


def claim(table: DataFrame, worker: Column, now: Column, ttl_seconds: int, n: int = 1, status: str = "status", order: list[str] = ("depth", "discovered_at", "url"), key: list[str] = ("url",), runs: str = "run_id") -> DataFrame:
    """The table after ``claims``: these are written once, and the table keeps its partitions."""
    return put(table, materialize(claims(table, worker, now, ttl_seconds, n, status, order, key, runs), "claims"), key)


def recover_claims(table: DataFrame, run_id: str | Column | None, now: Column, status: str = "status") -> DataFrame:
    """Claims of a run (of all runs, if none is given) whose time is over, also those that end at this very moment, are open again."""
    idle, busy = QUEUES[status]
    stale = F.col(status).isin(*busy) & F.col("claim_expires_at").isNotNull() & (F.col("claim_expires_at") <= now)
    if run_id is not None:
        stale = stale & (F.col("run_id") == run_id)
    stale = F.coalesce(stale, F.lit(False))
    changed = {status: F.when(stale, idle).otherwise(F.col(status)), "claimed_by": F.when(~stale, F.col("claimed_by")), "claim_expires_at": F.when(~stale, F.col("claim_expires_at"))}
    return table.select(*(changed[c].alias(c) if c in changed else F.col(c) for c in table.columns))


def apply_fetches(urls: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """``outcomes(url, outcome, final_url, status_code, error, next_retry_at)`` with outcome fetched, failed or skipped; a url is in one run only."""
    o = outcomes.select("url", "outcome", F.col("final_url").alias("__final"), F.col("status_code").alias("__code"), F.col("error").alias("__error"), F.col("next_retry_at").alias("__retry"))
    joined = urls.join(o, "url", "left")
    kind = F.col("outcome")
    changed = {
        "status": F.coalesce(kind, F.col("status")),
        "final_url": F.when(kind == "fetched", F.col("__final")).otherwise(F.col("final_url")),
        "status_code": F.when(kind == "fetched", F.col("__code")).otherwise(F.col("status_code")),
        "fetched_at": F.when(kind == "fetched", now).otherwise(F.col("fetched_at")),
        "last_error": F.when(kind.isin("failed", "skipped"), F.col("__error")).when(kind == "fetched", None).otherwise(F.col("last_error")),
        "next_retry_at": F.when(kind == "failed", F.col("__retry")).when(kind == "fetched", None).otherwise(F.col("next_retry_at")),
        "claimed_by": F.when(kind.isNull(), F.col("claimed_by")),
        "claim_expires_at": F.when(kind.isNull(), F.col("claim_expires_at")),
    }
    return joined.select(*(changed[c].alias(c) if c in changed else F.col(c) for c in urls.columns))


def apply_run_status(runs: DataFrame, run_id: str, status: str, error: str | None, now: Column) -> DataFrame:
    """Ends are dated for completed, failed and aborted runs only; an earlier end and error stay where no new one is given."""
    hit = F.col("id") == run_id
    ended = now if status in ("completed", "failed", "aborted") else F.lit(None).cast("timestamp")
    changed = {
        "status": F.when(hit, status).otherwise(F.col("status")),
        "completed_at": F.when(hit, F.coalesce(ended, F.col("completed_at"))).otherwise(F.col("completed_at")),
        "error": F.when(hit, F.coalesce(F.nullif(F.lit(error or ""), F.lit("")), F.col("error"))).otherwise(F.col("error")),
    }
    return runs.select(*(changed[c].alias(c) if c in changed else F.col(c) for c in runs.columns))


def fail_classifications(table: DataFrame, failures: DataFrame) -> DataFrame:
    """``failures(run_id, page_url, new_status, new_error)``: the label becomes Unclear, the action MANUAL_REVIEW."""
    joined = table.join(failures, ["run_id", "page_url"], "left")
    hit = F.col("new_status").isNotNull()
    values = {"judge_status": F.col("new_status"), "primary_label": F.lit("Unclear"), "confidence": F.lit(0.0), "suggested_action": F.lit("MANUAL_REVIEW"), "error": F.col("new_error")}
    return joined.select(*(F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in table.columns))


def complete_classifications(table: DataFrame, done: DataFrame) -> DataFrame:
    """Judgements of ``done`` go in and the status becomes judged; the number of attempts stays."""
    keep = ["run_id", "page_url", "attempt_count", "claimed_by", "claim_expires_at"]
    cols = [c for c in done.columns if c not in keep and c in table.columns and c != "judge_status"]
    d = done.select("run_id", "page_url", *(F.col(c).alias(f"__{c}") for c in cols), F.lit(True).alias("__hit"))
    joined = table.join(d, ["run_id", "page_url"], "left")
    hit = F.coalesce("__hit", F.lit(False))
    return joined.select(*(F.when(hit, F.lit("judged")).otherwise(F.col(c)).alias(c) if c == "judge_status" else F.when(hit, F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in cols else F.col(c) for c in table.columns))


#: Tables whose rows go with the page that the column names.
PAGE_CHILDREN = {"links": "from_url", "classifications": "page_url", "embeddings": "page_url"}


def delete_run(tables: dict[str, DataFrame], run_id: str) -> dict[str, DataFrame]:
    """The run, every row that belongs to it, its pages, and what hangs on those pages, whatever run wrote it."""
    out = {}
    pages = tables.get("pages")
    gone = None if pages is None else pages.filter(F.col("first_run_id") == run_id).select("url")
    for name, df in tables.items():
        mine = {"runs": "id", "pages": "first_run_id"}.get(name, "run_id")
        if mine in df.columns:
            df = df.filter(F.col(mine).isNull() | (F.col(mine) != run_id))
        if gone is not None and name in PAGE_CHILDREN:
            df = df.join(gone.withColumnRenamed("url", PAGE_CHILDREN[name]), PAGE_CHILDREN[name], "left_anti").select(*df.columns)
        out[name] = df
    return out


def delete_duplicates(duplicates: DataFrame, run_id: str) -> DataFrame:
    """The pairs of all other runs."""
    return duplicates.filter(F.col("run_id") != run_id)


def touch_heartbeats(runs: DataFrame, beats: DataFrame) -> DataFrame:
    """``beats(run_id, at)``: each run's last sign of life, which never goes back; beats of unknown runs are ignored."""
    last = beats.groupBy(F.col("run_id").alias("id")).agg(F.max("at").alias("__at"))
    joined = runs.join(last, "id", "left")
    return joined.select(*(F.greatest("last_heartbeat_at", "__at").alias(c) if c == "last_heartbeat_at" else F.col(c) for c in runs.columns))


def lookup(table: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    """``keys`` with the table's row of each, its columns null where there is none."""
    return keys.join(table.withColumn("found", F.lit(True)), key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def pages_by_run(pages: DataFrame, urls: DataFrame, run_id: str) -> DataFrame:
    """The pages that a run fetched, by url."""
    own = urls.filter((F.col("run_id") == run_id) & (F.col("status") == "fetched")).select("url").distinct()
    return pages.join(own, "url", "left_semi").orderBy("url")


def done_embeddings(embeddings: DataFrame, run_id: str, provider: str, model: str) -> DataFrame:
    return embeddings.filter((F.col("run_id") == run_id) & (F.col("embed_status") == "done") & (F.col("provider") == provider) & (F.col("model") == model)).orderBy("page_url")


def ordered_duplicates(duplicates: DataFrame, run_id: str) -> DataFrame:
    return duplicates.filter(F.col("run_id") == run_id).orderBy("cluster_id", "page_url_a", "page_url_b")


def store_report(reports: DataFrame, run_id: str, fmt: str, content: bytes, now: Column) -> DataFrame:
    """One rendering for each run and format; a later one replaces it."""
    one = reports.sparkSession.createDataFrame([(run_id, fmt, bytearray(content))], "run_id string, format string, content binary")
    new = one.select("run_id", "format", now.alias("rendered_at"), F.sha2("content", 256).alias("sha256"), "content")
    return upsert(reports, new.select(*reports.columns), ["run_id", "format"], order=["rendered_at"])


def store_reports(reports: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """Renderings ``new(run_id, format, content)`` of any number of runs at once; where one repeats, the larger digest stays."""
    rows = new.select("run_id", "format", now.alias("rendered_at"), F.sha2("content", 256).alias("sha256"), "content")
    return upsert(reports, rows.select(*reports.columns), ["run_id", "format"], order=["rendered_at", "sha256"])


def stored_report(reports: DataFrame, run_id: str, fmt: str) -> bytes | None:
    row = reports.filter((F.col("run_id") == run_id) & (F.col("format") == fmt)).select("content").first()
    return None if row is None else bytes(row.content)


def split_claims(claims: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Claimed ``claims(run_id, page_url)`` with their page, and those whose page is missing as failures."""
    p = pages.withColumnRenamed("url", "page_url")
    found = claims.join(p, "page_url")
    lost = claims.join(p.select("page_url"), "page_url", "left_anti").select("run_id", "page_url", F.lit("failed").alias("new_status"), F.lit("page not found").alias("new_error"))
    return found, lost


def resolve_run(runs: DataFrame, new: DataFrame, now: Column, resume: bool = False) -> tuple[str, DataFrame]:
    """The id to go on with, and the table of runs: with ``resume`` the active run of the site and configuration, alive or
    dead, else the one row of ``new``, which raises where an active run is there."""
    row = new.first()
    if resume:
        same = active_runs(runs, now, 90).filter((F.col("site_url") == row.site_url) & (F.col("prompts_sha256") == row.prompts_sha256)).first()
        if same is not None:
            return same.id, runs
    return row.id, insert_run(runs, new)


def append_events(events: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` carries its payload as a map; an empty one is no payload."""
    payload = F.when(F.size("payload") > 0, F.to_json("payload"))
    return events.unionByName(new.withColumn("payload_json", payload).drop("payload"), allowMissingColumns=True)


def append_api_calls(calls: DataFrame, new: DataFrame) -> DataFrame:
    """Empty texts and zero codes are stored as null."""
    clean = new
    for c in ("page_url", "error", "request_id"):
        clean = clean.withColumn(c, F.nullif(F.col(c), F.lit("")))
    return calls.unionByName(clean.withColumn("http_status", F.nullif(F.col("http_status"), F.lit(0))))


def latest_run(runs: DataFrame) -> DataFrame:
    """Each site's latest run."""
    rank = F.row_number().over(W.partitionBy("site_url").orderBy(F.desc("started_at"), F.desc("id")))
    return runs.withColumn("__n", rank).filter("__n = 1").drop("__n")


def active_runs(runs: DataFrame, now: Column, stale_seconds: int) -> DataFrame:
    """The latest active run of each site and configuration, and whether its heartbeat is too old."""
    rank = F.row_number().over(W.partitionBy("site_url", "prompts_sha256").orderBy(F.desc("started_at"), F.desc("id")))
    one = runs.filter(F.col("status").isin(ACTIVE_RUN_STATUSES)).withColumn("__n", rank).filter("__n = 1").drop("__n")
    return one.withColumn("stale", F.col("last_heartbeat_at") < now - F.make_dt_interval(secs=F.lit(float(stale_seconds))))
