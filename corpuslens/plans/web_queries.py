"""Queries over the web side: URLs, links, sitemaps, robots rules, bodies, crawls of corpora built from the driver's tables."""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions import text as X, urls as U
from ..functions.batches import bounded, mapped
from ..operators import crawl as C, vectors as V
from ..sources import web as B
from .registry import query, table

SITE = "https://s.example"


# -- urls ------------------------------------------------------------------------------------------------------------

#: Urls of every awkward form, made from an id, and what each becomes (fixed values).
FORMS = [
    ("HTTP://S.Example:80/a/../b//{k}/?utm_x=1&B=2&a={k}&a=0#top", "http://s.example/b/{k}?B=2&a={k}&a=0"),
    ("https://s.example:443/{k}?q=100%", "https://s.example/{k}"),
    ("https://s.example/{k}?x=%zz&y=a+b%20c&z", "https://s.example/{k}?y=a+b+c&z"),
    ("https://s.example/{k}?a;b=1&c=*~(&ref=9", "https://s.example/{k}?c=%2A~%28"),
    ("https://s.example/a b/é{k}/", "https://s.example/a%20b/%C3%A9{k}"),
    ("https://s.example/x%2Fy%20{k}", "https://s.example/x%2Fy%20{k}"),
    ("https://s.example/100%/{k}", None),
    ("/relative/{k}", None),
    ("https://s.example", "https://s.example/"),
    ("  https://s.example/(a)!{k}?  ", "https://s.example/(a)!{k}?"),
]


def _form(column: int) -> str:
    return "[" + ", ".join("null" if f[column] is None else "'" + f[column].replace("'", "''").replace("{k}", "' || event_id || '") + "'" for f in FORMS) + f"][1 + event_id % {len(FORMS)}]"


def _formed(spark, d) -> DataFrame:
    k = F.col("event_id").cast("string")
    made = F.array(*(F.replace(F.lit(f), F.lit("{k}"), k) for f, _ in FORMS))
    return table(spark, d, "events").select("event_id", F.element_at(made, (F.col("event_id") % len(FORMS) + 1).cast("int")).alias("url"))


@query(f"select event_id, {_form(1)} canonical from events")
def odd_urls(spark, d):
    return _formed(spark, d).select("event_id", U.canonicalize(F.col("url")).alias("canonical"))


@query(f"select event_id, event_id % {len(FORMS)} <> 7 absolute, (event_id % {len(FORMS)} not in (0, 1, 7)) same from events")
def url_tests(spark, d):
    u = F.col("url")
    return _formed(spark, d).select("event_id", U.is_absolute(u).alias("absolute"), U.same_host(F.lit("https://S.EXAMPLE/x"), u).alias("same"))


#: References against https://h.example/d/e?q=1 and where they lead (fixed values).
REFERENCES = [("f", "https://h.example/d/f"), ("../g?x", "https://h.example/g?x"), ("/r/./s", "https://h.example/r/s"), ("//o.example/p", "https://o.example/p"), ("?n=2", "https://h.example/d/e?n=2"), ("#frag", "https://h.example/d/e?q=1"), ("ftp://z/y", "ftp://z/y"), ("mailto:a@b", None), ("javascript:x()", None), ("tel:1", None)]


@query("select event_id, [" + ", ".join("null" if t is None else f"'{t}'" for _, t in REFERENCES) + f"][1 + event_id % {len(REFERENCES)}] target from events")
def resolved_references(spark, d):
    href = F.element_at(F.array(*(F.lit(r) for r, _ in REFERENCES)), (F.col("event_id") % len(REFERENCES) + 1).cast("int"))
    return table(spark, d, "events").select("event_id", F.when(U.followed_scheme(href), U.resolve(F.lit("https://h.example/d/e?q=1"), href)).alias("target"))


@query("select page_id, url || '/sitemap.xml' first, 5::bigint n from (select page_id, 'https://h' || page_id url from pages)")
def sitemap_places(spark, d):
    origin = F.concat(F.lit("https://h"), "page_id")
    places = U.sitemap_candidates(F.concat(origin, F.lit("/")), F.array(F.concat(origin, F.lit("/sitemap.xml")), F.concat(origin, F.lit("/own.xml"))))
    return table(spark, d, "pages").select("page_id", places[0].alias("first"), F.size(places).cast("long").alias("n"))


_PATH = "regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1)"


@query(f"select page_id, not regexp_matches({_PATH}, '/(?:{'|'.join(['wp-admin/', 'tag/', 'author/'])})|/feed/?$|/page/\\d+/?$') clean from pages")
def default_excludes(spark, d):
    return table(spark, d, "pages").select("page_id", U.admitted_path(F.col("url")).alias("clean"))


@query("select event_id, event_id % 6 < 4 html from events")
def html_types(spark, d):
    kinds = F.array(*map(F.lit, ["text/html; charset=utf-8", "TEXT/HTML", "application/xhtml+xml", "", "application/pdf", "text/plain"]))
    return table(spark, d, "events").select("event_id", X.is_html(F.element_at(kinds, (F.col("event_id") % 6 + 1).cast("int"))).alias("html"))


# -- bodies and embedded texts ---------------------------------------------------------------------------------------


@query("select event_id, sha256(substr(repeat(props, 1 + event_id::int % 40), 1, 200)) head, length(repeat(props, 1 + event_id::int % 40)) > 200 cut from events")
def capped_bodies(spark, d):
    body, cut = X.capped_body(F.encode(F.repeat("props", (F.col("event_id") % 40 + 1).cast("int")), "UTF-8"), 200)
    return table(spark, d, "events").select("event_id", F.sha2(body, 256).alias("head"), cut.alias("cut"))


@query("select page_id, sha256(html) digest from pages")
def gunzipped_bodies(spark, d):
    @F.arrow_udf("binary")
    def pack(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return mapped(lambda t: gzip.compress(t.encode()), texts, pa.binary())

    # A function in Python gets every row, whatever the condition around it; what needn't be packed is null to it.
    odd = F.col("page_id") % 2 == 1
    raw = F.when(odd, pack(F.when(odd, F.col("html")))).otherwise(F.encode("html", "UTF-8"))
    name = F.when(odd, "page.GZ").otherwise("page.html")
    return bounded(table(spark, d, "pages")).select("page_id", F.sha2(B.gunzipped(name, raw), 256).alias("digest"))


@query("select page_id, 'URL: ' || url || chr(10) || 'Title: t' || chr(10) || chr(10) || 'body ' || page_id prompt from pages")
def judge_prompts(spark, d):
    return table(spark, d, "pages").select("page_id", X.user_prompt(F.col("url"), F.lit("t"), F.concat(F.lit("body "), "page_id")).alias("prompt"))


@query("select event_id, case when event_id % 2 = 0 then 't' || event_id else 'u' || event_id end shown from events")
def titles_or_urls(spark, d):
    k = F.col("event_id").cast("string")
    return table(spark, d, "events").select("event_id", X.title_or_url(F.when(F.col("event_id") % 4 == 1, F.lit(None)).when(F.col("event_id") % 4 == 3, "").otherwise(F.concat(F.lit("t"), k)), F.concat(F.lit("u"), k)).alias("shown"))


_FNV = "list_reduce(list_prepend(14695981039346656037::uhugeint, list_prepend(i::uhugeint, list_transform(range(1, len(t) + 1), lambda j: ascii(substr(t, j, 1))::uhugeint))), lambda h, x: (xor(h, x) * 1099511628211::uhugeint) % 18446744073709551616::uhugeint)"


@query(f"select event_type, place, round(x / n, 4) value from (select t event_type, i place, x, sqrt(sum(x * x) over (partition by t)) n from (select t, i, sin(({_FNV} % 1000)::double) x from (select distinct event_type t from events), range(0, 8) r(i)))")
def fake_vectors(spark, d):
    e = table(spark, d, "events").select("event_type").distinct()
    got = V.embedded(e, key="event_type", text="event_type")
    return got.select(F.col("url").alias("event_type"), F.posexplode("vector").alias("place", "x")).select("event_type", F.col("place").cast("long").alias("place"), F.round(F.col("x").cast("double"), 4).alias("value"))


# -- sitemaps and robots ---------------------------------------------------------------------------------------------


def _sitemaps(spark, d) -> DataFrame:
    """An index of indexes of files of urls, ten pages a file; every file ends in the middle of an entry."""
    p = table(spark, d, "pages").select("page_id", F.floor(F.col("page_id") / 10).alias("file"))
    loc = F.concat(F.lit(f"<url><loc> {SITE}/p"), "page_id", F.lit("</loc><lastmod>2024-01-02</lastmod></url>"))
    files = p.groupBy("file").agg(F.array_join(F.sort_array(F.collect_list(loc)), "").alias("x"))
    files = files.select(F.concat(F.lit(f"{SITE}/f"), "file", F.lit(".xml")).alias("source"), F.concat(F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc></loc></url>'), "x", F.lit("<url><loc>cut")).alias("xml"))
    names = files.agg(F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("<sitemap><loc>"), "source", F.lit("</loc></sitemap>")))), "").alias("x"))
    index = names.select(F.lit(f"{SITE}/index.xml").alias("source"), F.concat(F.lit("<sitemapindex>"), "x", F.lit(f"<sitemap><loc>{SITE}/index.xml</loc></sitemap></sitemapindex>")).alias("xml"))
    return files.unionAll(index)


@query(f"select '{SITE}/f' || (page_id // 10) || '.xml' source, '{SITE}/p' || page_id loc, '2024-01-02' lastmod, false is_index from pages union all select distinct '{SITE}/index.xml', '{SITE}/f' || (page_id // 10) || '.xml', '', true from pages union all select '{SITE}/index.xml', '{SITE}/index.xml', '', true")
def sitemap_parse(spark, d):
    return B.sitemap_entries(_sitemaps(spark, d))


@query(f"select '{SITE}/p' || page_id loc, '{SITE}/f' || (page_id // 10) || '.xml' source from pages")
def sitemap_expansion(spark, d):
    return B.expand_sitemaps(_sitemaps(spark, d), [f"{SITE}/index.xml"]).select("loc", "source")


ROBOTS = "User-agent: other\nDisallow: /\n\nUser-agent: *\nDisallow: /*.pdf$\nDisallow: /private\nAllow: /private/open\nDisallow: /x*y/\nDisallow:\nSitemap: https://s.example/m.xml\n"
PATHS = [("/a.pdf", False), ("/a.pdf.html", True), ("/private", False), ("/private/open/1", True), ("/private/shut", False), ("/xay/z", False), ("/xay", True), ("/", True)]


@query("select event_id, [" + ", ".join(str(ok).lower() for _, ok in PATHS) + f"][1 + event_id % {len(PATHS)}] allowed from events")
def robots_rules(spark, d):
    path = F.element_at(F.array(*(F.lit(p) for p, _ in PATHS)), (F.col("event_id") % len(PATHS) + 1).cast("int"))
    return table(spark, d, "events").select("event_id", B.robots_filter(ROBOTS, "auditor")(F.concat(F.lit(SITE), path)).alias("allowed"))


# -- crawls ----------------------------------------------------------------------------------------------------------


def _numbered(spark, d) -> DataFrame:
    return table(spark, d, "pages").select("page_id").distinct()


def _tree(spark, d) -> DataFrame:
    """A binary tree of pages, its links in every kind of markup."""
    k = F.col("page_id")
    left, right = (k * 2 + 1).cast("string"), (k * 2 + 2).cast("string")
    html = F.concat(F.lit("<html><body><a href='/p"), left, F.lit("?a=1&amp;b=2'>One  way</a><A HREF=/p"), right, F.lit(">x</A> <a href=\"mailto:a@b\">m</a><a href=/p"), right, F.lit("#again>y</a><a href='//else.example/'>z</a></body></html>"))
    return _numbered(spark, d).select(F.concat(F.lit(f"{SITE}/p"), k, F.when((k % 2 == 1), "?b=2&a=1").otherwise("")).alias("url"), html.alias("html"))


_TREE = f"'{SITE}/p' || k || (case when k % 2 = 1 then '?a=1&b=2' else '' end)"


@query(f"""with recursive ids as (select distinct page_id k from pages), r(k, depth) as (select min(k), 0 from ids union all select 2 * r.k + t.i, depth + 1 from r join ids using (k), (values (1), (2)) t(i) where depth < 6)
 select {_TREE} url, depth, case when depth = 0 then 'homepage' else 'bfs_link' end discovered_via, case when exists (select 1 from ids where ids.k = r.k) then 'fetched' else 'failed' end status from r""")
def crawl_tree(spark, d):
    start = _numbered(spark, d).agg(F.min("page_id")).first()[0]
    return C.crawl(_tree(spark, d), f"{SITE}/p{start}{'?a=1&b=2' if start % 2 else ''}").drop("discovered_from")


@query(f"""with recursive ids as (select distinct page_id k from pages), r(k, depth) as (select min(k), 0 from ids union all select 2 * r.k + t.i, depth + 1 from r join ids using (k), (values (1), (2)) t(i) where depth < 3)
 select url, depth from (select {_TREE} url, depth from r) order by depth, url limit 9""")
def crawl_page_limit(spark, d):
    start = _numbered(spark, d).agg(F.min("page_id")).first()[0]
    return C.crawl(_tree(spark, d), f"{SITE}/p{start}{'?a=1&b=2' if start % 2 else ''}", max_depth=3, max_pages=9).select("url", "depth")


@query(f"select {_TREE} from_url, '{SITE}/p' || (2 * k + 1) || '?a=1&b=2' to_url, 'One way' anchor, true internal from (select distinct page_id k from pages) union all select {_TREE}, '{SITE}/p' || (2 * k + 2), 'x', true from (select distinct page_id k from pages) union all select {_TREE}, 'https://else.example/', 'z', false from (select distinct page_id k from pages)")
def first_links(spark, d):
    e = C.link_edges(C.extract_pages(_tree(spark, d)))
    return e.select(U.canonicalize(F.col("from_url")).alias("from_url"), U.canonicalize(F.col("to_url")).alias("to_url"), "anchor", F.col("is_internal").alias("internal"))


_STATE = "case when k % 13 = 5 then 'alias' when k % 11 = 3 then 'status' when k % 7 = 2 then 'type' when k % 5 = 0 then 'tag' else 'fetched' end"


def _mixed(spark, d) -> dict[str, DataFrame]:
    """Pages of every outcome, all of them in the sitemap: known aliases, errors, other types, canonical tags, redirects."""
    k = F.col("page_id")
    tag = F.when(k % 5 == 0, F.concat(F.lit(f'<link rel="canonical" href="{SITE}/t'), k, F.lit('">'))).otherwise(F.lit('<link rel="canonical" href="/relative">'))
    corpus = _numbered(spark, d).select(F.concat(F.lit(f"{SITE}/p"), k).alias("url"), F.concat(F.lit("<html><head>"), tag, F.lit("</head><body>x</body></html>")).alias("html"), F.when(k % 11 == 3, 404).otherwise(200).alias("status_code"), F.when(k % 7 == 2, "application/pdf").otherwise("text/html").alias("content_type"), F.when(k % 17 == 1, F.concat(F.lit(f"{SITE}/moved"), k)).otherwise(F.concat(F.lit(f"{SITE}/p"), k)).alias("final_url"))
    aliases = _numbered(spark, d).filter("page_id % 13 = 5").select(F.concat(F.lit(f"{SITE}/p"), k).alias("alias_url"), F.concat(F.lit(f"{SITE}/a"), k).alias("canonical_url"))
    return C.walk(corpus, f"{SITE}/", sitemap=corpus.select("url"), aliases=aliases)


@query(f"""with s as (select k, {_STATE} s from (select distinct page_id k from pages))
 select '{SITE}/' url, 'homepage' discovered_via, 'failed' status, 'not found' reason union all
 select '{SITE}/p' || k, 'sitemap_index', case s when 'status' then 'failed' when 'fetched' then 'fetched' else 'skipped' end, case s when 'alias' then 'aliased to {SITE}/a' || k when 'status' then 'status=404' when 'type' then 'non-html: application/pdf' when 'tag' then 'canonical_tag -> {SITE}/t' || k end from s union all
 select '{SITE}/a' || k, 'canonical_alias', 'failed', 'not found' from s where s = 'alias' union all select '{SITE}/t' || k, 'canonical_tag', 'failed', 'not found' from s where s = 'tag'""")
def crawl_outcomes(spark, d):
    return _mixed(spark, d)["urls"].select("url", "discovered_via", "status", "reason")


@query(f"""with s as (select k, {_STATE} s from (select distinct page_id k from pages)) select '{SITE}/p' || k alias_url, case when k % 17 = 1 then '{SITE}/moved' || k else '{SITE}/t' || k end canonical_url, case when k % 17 = 1 then 'http_redirect' else 'canonical_tag' end alias_type from s where s <> 'status' and (k % 17 = 1 or k % 5 = 0)""")
def crawl_aliases(spark, d):
    return _mixed(spark, d)["aliases"]


@query(f"""with s as (select k, {_STATE} s from (select distinct page_id k from pages)) select count(*) pages, count(distinct url) urls from (select '{SITE}/p' || k url from s where s = 'fetched')""")
def fetched_pages(spark, d):
    return _mixed(spark, d)["pages"].agg(F.count("*").alias("pages"), F.countDistinct("url").alias("urls"))


@query("select url || case when instr(url, '?') > 0 then '&' else '?' end || 'p=' || page_id loc, '2024-01-0' || (page_id % 9 + 1) lastmod, (select count(*) from pages) n from pages where page_id % 10 > 0")
def sitemap_files(spark, d):
    from ..session import scratch_path

    # Files of entries as Spark's text sink writes them; every tenth entry has no location.
    path = scratch_path(spark, "sitemaps")
    loc = F.concat("url", F.when(F.instr("url", "?") > 0, "&").otherwise("?"), F.lit("p="), F.col("page_id").cast("string"))
    safe = F.replace(F.replace(loc, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    entry = F.concat(F.lit("<url><image:image><image:loc>other</image:loc></image:image><loc>\n "), F.when(F.col("page_id") % 10 > 0, safe).otherwise(""), F.lit(" </loc><lastmod>2024-01-0"), (F.col("page_id") % 9 + 1).cast("string"), F.lit("</lastmod></url>"))
    pages = table(spark, d, "pages")
    pages.select(entry.alias("value")).write.text(path)
    got = B.sitemap_files(spark, path)
    return got.select("loc", "lastmod").withColumn("n", F.lit(pages.count()))
