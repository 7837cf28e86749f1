"""The whole audit of a corpus: crawl, judge, find duplicates, relabel, report; and the inspection of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scores import next_action
from ..functions.text import html_safe_json
from ..operators import crawl as C, judge as J, vectors as V
from ..schemas import CONFIG_KEYS
from ..session import materialize
from . import report as R


def audit(corpus: DataFrame, site: str, prompts: list[str] = (), judge=J.rule_judge, embed=V.fake_embedding, threshold: float = V.DEFAULT_THRESHOLD, thin_words: int = 50, dry_run: bool = False, find_duplicates: bool = True, **crawl_options) -> dict[str, DataFrame]:
    """Tables of one audit over ``corpus(url, html)``; each stage is written before the next reads it.

    ``dry_run`` ends after the crawl.  Thin pages are judged by rule alone, and shells are not embedded.
    """
    walked = C.walk(corpus, site, thin_words=thin_words, **crawl_options)
    urls, pages = materialize(walked["urls"], "urls"), materialize(walked["pages"], "pages")
    edges = C.link_edges(pages).filter("is_internal").withColumn("to_url", C.canonicalize(F.col("to_url"))).filter("to_url is not null")
    edges = materialize(edges.groupBy("from_url", "to_url").agg(F.min("anchor").alias("anchor"), F.max("is_internal").alias("is_internal")), "links")
    out = {"urls": urls, "pages": pages, "links": edges, "aliases": walked["aliases"]}
    if dry_run:
        return out
    thin = J.thin_judgements(pages, thin_words).withColumn("judge_status", F.lit("judged"))
    asked = J.judged(pages.join(thin.select(F.col("page_url").alias("url")), "url", "left_anti"), judge, prompts).withColumnRenamed("attempts", "attempt_count")
    classified = materialize(asked.unionByName(thin, allowMissingColumns=True), "classifications")
    pairs = V.similar_pairs(V.embedded(pages.filter("not is_empty_shell"), embed), threshold) if find_duplicates else corpus.sparkSession.createDataFrame([], "a string, b string, similarity double")
    pairs = materialize(pairs, "pairs")
    members = materialize(V.clusters(pairs), "members")
    of_pages = members.select(F.col("member").alias("url"), "cluster_id").join(pages.select("url", "word_count", "last_modified", "title"), "url")
    keep = materialize(V.canonical_members(of_pages), "keep")
    words = of_pages.select(F.col("url").alias("canonical"), F.col("word_count").alias("canonical_words"))
    redundant = of_pages.join(keep, "cluster_id").filter("url <> canonical").join(words, "canonical").select(F.col("url").alias("page_url"), "canonical", "cluster_id", "title", "canonical_words")
    classified = materialize(J.relabel_redundant(classified, redundant), "relabelled")
    inbound = C.inbound_counts(edges)
    rollup = V.cluster_rollup(pairs, members).join(V.report_canonical_members(of_pages).withColumnRenamed("canonical", "canonical_url"), "cluster_id").select("cluster_id", "canonical_url", "member_urls", "size", "avg_similarity")
    entries = R.page_entries(pages.select("url", "title", "word_count", "last_modified", "published_date"), classified, inbound, members)
    return out | {"classifications": classified, "duplicates": pairs.join(members.select(F.col("member").alias("a"), "cluster_id"), "a"), "clusters": rollup, "entries": entries}


def config_snapshot(**settings) -> Column:
    """A scan's settings, columns by name, as one JSON object with its keys in order; any but those of a scan raise."""
    if odd := set(settings) - set(CONFIG_KEYS):
        raise ValueError(f"no settings of a scan: {sorted(odd)}")
    text = html_safe_json(F.struct(*(settings.get(k, F.lit(None).cast("string")).alias(k) for k in sorted(CONFIG_KEYS))))
    # A whole rate is written without a point.
    return F.regexp_replace(text, r'("rate":-?\d+)\.0(?=[,}])', "$1")


def label_counts(classifications: DataFrame, run_id: str) -> DataFrame:
    """``(label, n)`` of a run's judgements that have come to an end; a missing label is the empty one."""
    own = classifications.filter((F.col("run_id") == run_id) & F.col("judge_status").isin("judged", "failed", "failed_schema"))
    return own.groupBy(F.coalesce("primary_label", F.lit("")).alias("label")).agg(F.count("*").alias("n"))


def inspect(runs: DataFrame, urls: DataFrame, classifications: DataFrame, events: DataFrame, calls: DataFrame, run_id: str, now) -> DataFrame:
    """One row about a run: status counts, label counts, event counts, token sums, retries and what to do next."""
    of = lambda df: df.filter(F.col("run_id") == run_id)
    counts = lambda df, c, n: of(df).groupBy(F.coalesce(c, F.lit("")).alias("k")).agg(F.count("*").alias("v")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias(n))
    tokens = of(calls).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("input_tokens", "cached_tokens", "output_tokens")), F.count("*").alias("api_calls"), F.count_if(F.col("attempt_number") > 1).alias("retries"))
    run = runs.filter(F.col("id") == run_id).select("id", "status", next_action(F.col("status"), F.col("error"), F.col("last_heartbeat_at"), now).alias("next_action"))
    # Each side is one row.
    for side in (counts(urls, "status", "urls"), counts(classifications.filter(F.col("judge_status").isin("judged", "failed", "failed_schema")), "primary_label", "labels"), counts(events, "event_type", "events"), tokens):
        run = run.join(F.broadcast(side))
    return run
