"""Links by one scan are those of the tree; sitemap files are split between tasks; entries count themselves while they are written."""

import pytest
from pyspark.sql import functions as F

from corpuslens.functions.html import extract, page_targets
from corpuslens.plans import report as R
from corpuslens.sources import web

ODD = [
    "", "no tags", "<a href=x>", "<A HREF='/y#z'>t</A>", '<a class="c"href="q?a=1&amp;b=2">', "<a\nhref = \"sp ace\" >", "<a href=''>", '<a name=n>', "<abbr href=no>", '<a data-href="no">', "<a title='href=no' href=yes>",
    "<!-- <a href=no> --><a href=yes>", "<script>var x = '<a href=no>'</script><a href=yes>", "<style><a href=no></style>", "<a href=mailto:x@y><a href=javascript:void(0)><a href='tel:1'>", "<base href='/deep/'><a href=p>", "<base target=t><base href=//other.example/><a href=p><base href=/late/>",
    "<a href=one><a href=one#two><a href='one'>", '<a href="http://[bad">', "<a href=a>1<a href=b>2", "<a title='>' href=after>", "<a href=x/>", "<a/href=slash>", "<a href=caf&eacute;>", '<a href="a" href="b">',
]


@pytest.mark.parametrize("page", ODD)
def test_odd_pages(page):
    assert page_targets(page, "https://s.example/dir/page") == [x["to_url"] for x in extract(page, "https://s.example/dir/page")[6]]


def test_pages_of_the_table(spark, sf):
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        assert page_targets(r.html or "", r.url or "") == [x["to_url"] for x in extract(r.html or "", r.url or "")[6]]


def test_titles_and_text_areas_hold_no_tags():
    assert page_targets("<title><a href=no></title><textarea><a href=no></textarea><a href=yes>", "https://s.example/") == ["https://s.example/yes"]


def test_unclosed_tags_take_linear_time():
    for piece in ("<script>", "<a href=", "<!-- ", "<textarea>", "<a title='"):
        assert isinstance(page_targets(piece * 100_000, "https://s.example/"), list)


def test_sitemap_files_are_split(spark, tmp_path):
    entry = lambda i: f'<url><image:image><image:loc>no</image:loc></image:image><loc> https://s.example/{i}?a=1&amp;b=&#50; </loc><lastmod>2024-01-0{i % 9 + 1}</lastmod></url>\n'
    head = '<?xml version="1.0"?>\n<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9" xmlns:image="x">'
    text = head + "".join(map(entry, range(4000)))
    (tmp_path / "a.xml").write_text(text + "<url><loc>https://s.example/broken & </loc></url><url><lastmod>2</lastmod></url>" + entry(9000) + "<url><loc>https://s.example/cut")
    (tmp_path / "b.xml").write_text(head + "</urlset>")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        df = web.sitemap_files(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() > 10
        got = sorted((r.loc, r.lastmod, r.is_index) for r in df.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == sorted([(loc, mod, i) for loc, mod, i in web.parse_sitemap(text)] + [("https://s.example/9000?a=1&b=2", "2024-01-01", False)])
    (tmp_path / "i").mkdir()
    (tmp_path / "i" / "c.xml").write_text('<sitemapindex><sitemap><loc>https://s.example/a.xml</loc></sitemap><sitemap id="2"><loc><![CDATA[https://s.example/b.xml?x&y]]></loc></sitemap></sitemapindex>')
    assert sorted((r.loc, r.is_index) for r in web.sitemap_files(spark, str(tmp_path / "i"), index=True).collect()) == [("https://s.example/a.xml", True), ("https://s.example/b.xml?x&y", True)]


def test_observed_counts_are_the_summary(spark, tmp_path):
    pages = spark.range(200).select(F.concat(F.lit("u"), "id").alias("url"), F.lit("t").alias("title"), F.lit(9).cast("long").alias("word_count"), "id")
    pick = lambda *x: F.element_at(F.array(*map(F.lit, x)), (F.col("id") % len(x) + 1).cast("int"))
    c = pages.filter("id % 5 > 0").select(F.col("url").alias("page_url"), pick("Stale", "Unclear", "Aligned").alias("primary_label"), pick("UPDATE", "KEEP").alias("suggested_action"), pick("judged", "failed", "failed_schema", "pending").alias("judge_status"))
    members = pages.filter("id < 40").select(F.col("url").alias("member"), F.concat(F.lit("cl_"), F.floor(F.col("id") / 4)).alias("cluster_id"), F.concat(F.lit("u"), (F.floor(F.col("id") / 4) * 4)).alias("root"))
    e = R.page_entries(pages.drop("id"), c, spark.createDataFrame([], "to_url string, inbound long"), members)
    for entries in (e, e.limit(0)):
        rows, seen = R.observed(entries)
        rows.write.mode("overwrite").parquet(str(tmp_path / "out"))
        got = R.observed_summary(seen)
        assert {k: v for k, v in got.items() if not k.startswith("by_")} == R.summary(entries).first().asDict()
        for k, column in (("by_label", "primary_label"), ("by_action", "suggested_action")):
            assert got[k] == {r[0]: r[1] for r in R.counters(entries, column).collect()}
