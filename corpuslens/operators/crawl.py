"""Crawling a corpus table: breadth-first levels, aliases, the link graph and in-degrees."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.batches import bounded
from ..functions.html import extracted, linked_urls
from ..functions.text import is_html, is_thin, word_count
from ..functions.urls import admitted_path, canonicalize, is_absolute, same_host
from ..session import materialize

#: Ways to a url, the one that counts first where several find it at one depth.
VIA = ["homepage", "seed", "sitemap_index", "canonical_alias", "canonical_tag", "bfs_link"]


def extract_pages(corpus: DataFrame, thin_words: int = 50, keep: list[str] = ()) -> DataFrame:
    """``corpus(url, html)`` with text, metadata, word count, shell flag, digest and links; the columns ``keep`` stay."""
    one = bounded(corpus).withColumn("x", extracted(F.col("html"), F.col("url")))
    words = word_count(F.col("x.body_text"))
    return one.select(
        *keep, "url", "x.*", words.alias("word_count"), is_thin(words, thin_words).alias("is_empty_shell"),
        F.sha2(F.coalesce("html", F.lit("")), 256).alias("raw_body_sha256"), F.octet_length(F.coalesce("html", F.lit(""))).cast("long").alias("body_size_bytes"),
    )


def link_edges(pages: DataFrame) -> DataFrame:
    """``(from_url, to_url, anchor, is_internal)``: of several links of a page to one target the first."""
    each = pages.select(F.col("url").alias("from_url"), F.posexplode("links").alias("at", "l")).select("from_url", "at", "l.*")
    rank = F.row_number().over(W.partitionBy("from_url", "to_url").orderBy("at"))
    return each.withColumn("n", rank).filter("n = 1").select("from_url", "to_url", "anchor", "is_internal")


def page_edges(pages: DataFrame) -> DataFrame:
    """``(from_url, to_url)`` of ``pages(url, html)``, distinct, with canonical ends."""
    links = bounded(pages).select("url", F.explode(linked_urls(F.col("html"), F.col("url"))).alias("to"))
    return links.select(canonicalize(F.col("url")).alias("from_url"), canonicalize(F.col("to")).alias("to_url")).filter("from_url is not null and to_url is not null").distinct()


def inbound_counts(edges: DataFrame, fetched: DataFrame | None = None) -> DataFrame:
    """``(to_url, inbound)`` over internal links, from fetched pages if they are given; self links count."""
    own = edges.filter("is_internal") if "is_internal" in edges.columns else edges
    if fetched is not None:
        own = own.join(fetched.select(F.col("url").alias("from_url")), "from_url", "left_semi")
    return own.groupBy("to_url").agg(F.count("*").alias("inbound"))


def canonical_aliases(pages: DataFrame) -> DataFrame:
    """``(alias_url, canonical_url, alias_type)``: redirects to another url, then canonical tags that point elsewhere on
    the same host; a relative tag is ignored."""
    redirects = pages.filter(F.col("final_url").isNotNull() & (canonicalize(F.col("final_url")) != F.col("url"))).select(F.col("url").alias("alias_url"), canonicalize(F.col("final_url")).alias("canonical_url"), F.lit("http_redirect").alias("alias_type"))
    to = canonicalize(F.col("canonical_url"))
    tags = pages.filter(is_absolute(F.col("canonical_url")) & (to != F.col("url")) & same_host(F.col("canonical_url"), F.col("url"))).select(F.col("url").alias("alias_url"), to.alias("canonical_url"), F.lit("canonical_tag").alias("alias_type"))
    both = redirects.withColumn("o", F.lit(0)).unionByName(tags.withColumn("o", F.lit(1)))
    return both.groupBy("alias_url").agg(F.min_by(F.struct("canonical_url", "alias_type"), "o").alias("v")).select("alias_url", "v.*")


def admit(found: DataFrame, site: str, includes=None, excludes=None, robots=None, max_depth: int = 0) -> DataFrame:
    """``found(url, depth, via, source)`` through canonical form, host, path, robots and depth; what fails is left out."""
    own = found.select(canonicalize(F.col("url")).alias("url"), "depth", "via", "source").filter("url is not null")
    own = own.filter(same_host(F.lit(site), F.col("url"))).filter(admitted_path(F.col("url"), includes, excludes))
    if robots is not None:
        own = own.filter(robots(F.col("url")))
    return own if max_depth <= 0 else own.filter(F.col("depth") <= max_depth)


def _table(spark, seeds, via: str) -> DataFrame:
    if isinstance(seeds, DataFrame):
        return seeds.select("url", F.lit(0).alias("depth"), F.lit(via).alias("via"), F.lit(None).cast("string").alias("source"))
    return spark.createDataFrame([(s, 0, via, None) for s in seeds], "url string, depth int, via string, source string")


def walk(corpus: DataFrame, site: str, seeds: list[str] | DataFrame = (), includes=None, excludes=None, robots=None, max_depth: int = 6, max_pages: int = 0, sitemap: DataFrame | None = None, aliases: DataFrame | None = None, respect_canonical: bool = True, thin_words: int = 50) -> dict[str, DataFrame]:
    """A breadth-first walk from the site, its seeds and its ``sitemap(url)``; ``corpus(url, html)`` stands for the web.

    The corpus may tell ``status_code``, ``content_type`` and ``final_url`` of its pages; ``aliases(alias_url, canonical_url)``
    are known from before.  Of a level's urls an alias is skipped and its target takes its place; one that the corpus lacks, or
    whose status isn't 200, failed; what isn't HTML is skipped, and so is a page whose canonical tag names another page of the
    host, which takes its place; the rest is fetched and its internal links are the next level.

    Gives ``urls(url, depth, discovered_via, discovered_from, status, reason)``, ``pages`` as ``extract_pages`` makes them for
    the fetched ones, and ``aliases``.  Of several corpus rows of one canonical url the smallest html counts.  A page limit
    takes the first urls by (depth, url), exactly.
    """
    spark = corpus.sparkSession
    facts = [c for c in ("status_code", "content_type", "final_url") if c in corpus.columns]
    known = corpus.select(canonicalize(F.col("url")).alias("url"), "html", *facts).filter("url is not null")
    known = known.groupBy("url").agg(F.min(F.struct("html", *facts)).alias("v")).select("url", "v.*")
    pages = materialize(extract_pages(known, thin_words, facts), "pages")
    kind = F.col("content_type") if "content_type" in facts else F.lit("")
    code = F.coalesce("status_code", F.lit(200)) if "status_code" in facts else F.lit(200)
    target = canonicalize(F.col("canonical_url"))
    moved = F.coalesce(is_absolute(F.col("canonical_url")) & (target != F.col("url")) & same_host(F.lit(site), target), F.lit(False)) & F.lit(respect_canonical)
    reason = F.when(code != 200, F.concat(F.lit("status="), code.cast("string"))).when(~is_html(kind), F.concat(F.lit("non-html: "), kind)).when(moved, F.concat(F.lit("canonical_tag -> "), target))
    status = F.when(code != 200, "failed").when(~is_html(kind) | moved, "skipped").otherwise("fetched")
    visits = materialize(pages.select("url", status.alias("status"), reason.alias("reason"), F.when(moved & (code == 200) & is_html(kind), target).alias("to"), F.when(status == "fetched", F.transform(F.filter("links", lambda x: x["is_internal"]), lambda x: x["to_url"])).alias("links")), "visits")
    rank = lambda c: F.array_position(F.array(*map(F.lit, VIA)), c)

    def fresh(found: DataFrame, seen: DataFrame | None) -> DataFrame:
        """What is admitted and not yet seen, each url once, by its first way."""
        own = admit(found, site, includes, excludes, robots, max_depth)
        own = own if seen is None else own.join(seen.select("url"), "url", "left_anti")
        first = F.min_by(F.struct("depth", "via", "source"), F.struct(F.col("depth"), rank(F.col("via")), F.col("source")))
        return own.groupBy("url").agg(first.alias("v")).select("url", "v.*")

    def visited(frontier: DataFrame) -> DataFrame:
        out = frontier.join(visits, "url", "left")
        if aliases is not None:
            out = out.join(aliases.select(F.col("alias_url").alias("url"), F.col("canonical_url").alias("alias")), "url", "left")
        else:
            out = out.withColumn("alias", F.lit(None).cast("string"))
        hit = F.col("alias").isNotNull()
        lost = F.col("status").isNull()
        return out.select("url", "depth", "via", "source", "alias", F.when(hit, "skipped").when(lost, "failed").otherwise(F.col("status")).alias("status"), F.when(hit, F.concat(F.lit("aliased to "), F.col("alias"))).when(lost, "not found").otherwise(F.col("reason")).alias("reason"), F.when(~hit, F.col("to")).alias("to"), F.when(~hit, F.col("links")).alias("links"))

    start = _table(spark, [site], "homepage").unionByName(_table(spark, seeds, "seed"))
    if sitemap is not None:
        start = start.unionByName(_table(spark, sitemap, "sitemap_index"))
    replaces = aliases is not None or not visits.filter("to is not null").isEmpty()
    frontier = materialize(fresh(start, None), "frontier")
    rounds, done, later = [frontier], [], []
    seen = lambda: functools.reduce(DataFrame.unionByName, (x.select("url") for x in rounds))
    while True:
        if frontier is None or frontier.isEmpty():
            # This depth is through; the next one is what its pages link to.
            if not later:
                break
            frontier = materialize(fresh(functools.reduce(DataFrame.unionByName, later), seen()), "frontier")
            rounds.append(frontier)
            later = []
            if frontier.isEmpty():
                break
        level = materialize(visited(frontier), "level")
        done.append(level)
        later.append(level.select(F.explode("links").alias("url"), (F.col("depth") + 1).alias("depth"), F.lit("bfs_link").alias("via"), F.col("url").alias("source")))
        frontier = None
        if replaces:
            same = level.filter("alias is not null").select(F.col("alias").alias("url"), "depth", F.lit("canonical_alias").alias("via"), F.col("url").alias("source"))
            same = same.unionByName(level.filter("to is not null").select(F.col("to").alias("url"), "depth", F.lit("canonical_tag").alias("via"), F.col("url").alias("source")))
            frontier = materialize(fresh(same, seen()), "frontier")
            rounds.append(frontier)
    all_ = functools.reduce(DataFrame.unionByName, done) if done else visited(rounds[0])
    urls = all_.select("url", "depth", F.col("via").alias("discovered_via"), F.col("source").alias("discovered_from"), "status", "reason")
    if max_pages > 0:
        urls = urls.orderBy("depth", "url").limit(max_pages)
    own = pages.join(urls.filter("status <> 'failed'").select("url"), "url", "left_semi")
    found = canonical_aliases(own if "final_url" in facts else own.withColumn("final_url", F.col("url")))
    return {"urls": urls, "pages": pages.join(urls.filter("status = 'fetched'").select("url"), "url", "left_semi"), "aliases": found.filter(same_host(F.lit(site), F.col("canonical_url")))}


def crawl(corpus: DataFrame, site: str, seeds: list[str] | DataFrame = (), **options) -> DataFrame:
    """``(url, depth, discovered_via, discovered_from, status)`` of all that ``walk`` finds."""
    return walk(corpus, site, seeds, **options)["urls"].drop("reason")
