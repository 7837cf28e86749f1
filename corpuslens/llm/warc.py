"""Operator 9: WARC archives, written and read back with boundary-chain verification.

Writing goes through Spark's own text sink: a row is one record without its
closing blank line, which is the line separator, so files appear by the commit
protocol on any file system.  Reading cuts files at the version line wherever
it stands, also inside payloads, so each piece is only a candidate.  Tasks
emit for every candidate its offset and the offset that its length leads to.
Runs of candidates that lead to one another become one segment, and pointer
jumping over segments from each file's start keeps what can be reached.

Defined results: a null or empty payload has length zero; payloads under
``MIN_REVISIT`` bytes are never revisits; rows that repeat a page_id keep a
record each, whether their payloads agree or not, and those of the smallest
page_id are all responses; rows of a null page_id are responses; columns
besides page_id, url and html are left out; an empty table gives an archive
without records and no rows.  A record's id is its page_id and payload digest,
so rows that repeat both share it.  Windows run by file: a file holds what one
task wrote, and only offsets pass through them, no payloads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .common import materialize, scratch_path

MAGIC = "WARC/1.1\r\n"
CLOSE = "\r\n\r\n"
MIN_REVISIT = 100
#: What a revisit says of itself (fixed value of the format).
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def revisits(bodies: DataFrame) -> DataFrame:
    """``(page_id, digest, first)`` of ``bodies(page_id, body, digest)``: payloads of at least ``MIN_REVISIT`` bytes that a smaller page_id has too."""
    small = bodies.filter(F.col("page_id").isNotNull() & (F.octet_length("body") >= MIN_REVISIT)).select("page_id", "digest")
    firsts = materialize(small.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).filter("first < last").drop("last"), "firsts")
    return materialize(small.join(firsts, "digest").filter("page_id <> first").select("page_id", "digest", "first").distinct(), "revisits")


def write_archive(pages: DataFrame, path: str, date: Column | None = None) -> None:
    """One record for each row of ``pages(page_id, url, html)``; ``date`` is the time of capture in UTC (now, if not given)."""
    body = F.coalesce("html", F.lit(""))
    bodies = pages.select("page_id", "url", body.alias("body")).withColumn("digest", F.sha2("body", 256))
    again = revisits(bodies)
    # Where no payload repeats, or few do, the planner sees the written table's size and broadcasts it.
    rows = bodies.join(again, ["page_id", "digest"], "left")
    revisit = F.col("first").isNotNull()
    line = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit("\r\n"))
    uri = F.regexp_replace(F.col("url"), r"[\x00-\x20\x7f]", "%20")
    named = lambda page: F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(":"), F.col("digest"), F.lit(">"))
    when = F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()) if date is None else date
    record = F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", named(F.col("page_id"))),
        line("WARC-Date", F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        F.coalesce(line("WARC-Target-URI", uri), F.lit("")),
        F.when(revisit, F.concat(line("WARC-Refers-To", named(F.col("first"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        line("WARC-Payload-Length", F.octet_length("body").cast("string")),
        line("Content-Type", F.lit("text/html")),
        line("Content-Length", F.when(revisit, 0).otherwise(F.octet_length("body")).cast("string")),
        F.lit("\r\n"),
        F.when(revisit, "").otherwise(F.col("body")),
    )
    rows.select(record.alias("value")).write.option("lineSep", CLOSE).text(path)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """Everything between two version lines, in file order by ``(file, block, at)``."""
    return (
        spark.read.option("lineSep", MAGIC)
        .text(path)
        .select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
        .withColumn("at", F.monotonically_increasing_id())
    )


def _field(head: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(F.concat(F.lit("\r\n"), head, F.lit("\r\n")), rf"\r\n{name}: ([^\r]*)\r\n", 1), F.lit(""))


def candidate_records(pieces: DataFrame) -> DataFrame:
    """A row for each piece after a version line: its start, where its length leads (``next``), and its fields."""
    head = F.substring_index("value", CLOSE, 1)
    cut = F.locate(CLOSE, F.col("value")) > 0
    rows = pieces.withColumn("head", F.when(cut, head)).withColumn("length", _field(F.col("head"), "Content-Length").try_cast("long"))
    skip = F.octet_length("head") + len(CLOSE)
    whole = F.coalesce(F.octet_length("value") == skip + F.col("length") + len(CLOSE), F.lit(False))
    payload = F.substr(F.col("value"), F.length("head") + F.lit(len(CLOSE) + 1), F.greatest(F.length("value") - F.length("head") - F.lit(2 * len(CLOSE)), F.lit(0)))
    small = rows.select(
        "file", "block", "at", F.octet_length("value").cast("long").alias("size"), skip.cast("long").alias("skip"), "length", whole.alias("whole"),
        _field(F.col("head"), "WARC-Type").alias("type"),
        F.regexp_extract(_field(F.col("head"), "WARC-Record-ID"), r"<urn:page:(-?\d+)[:>]", 1).try_cast("long").alias("page_id"),
        F.regexp_extract(_field(F.col("head"), "WARC-Refers-To"), r"<urn:page:(-?\d+)[:>]", 1).try_cast("long").alias("refers_to"),
        F.regexp_extract(_field(F.col("head"), "WARC-Payload-Digest"), r"^sha256:([0-9a-f]{64})$", 1).alias("said"),
        _field(F.col("head"), "WARC-Payload-Length").try_cast("long").alias("said_bytes"),
        _field(F.col("head"), "WARC-Target-URI").alias("uri"), F.md5(F.encode("value", "utf-8")).alias("piece"),
        F.when(whole, F.sha2(payload, 256)).alias("digest"),
    )
    order = W.partitionBy("file").orderBy("block", "at")
    end = F.sum(F.col("size") + len(MAGIC)).over(order.rowsBetween(W.unboundedPreceding, 0))
    placed = small.withColumn("start", end - F.col("size") - 2 * len(MAGIC)).filter("start >= 0")
    return placed.withColumn("next", F.col("start") + len(MAGIC) + F.col("skip") + F.col("length") + len(CLOSE))


def reachable(found: DataFrame) -> DataFrame:
    """Rows of ``found(file, start, next, ...)`` on the chain of lengths from each file's start."""
    order = W.partitionBy("file").orderBy("start")
    tight = materialize(found.select("file", "start", "next", F.lead("start").over(order).eqNullSafe(F.col("next")).alias("tight")), "chain")
    landing = tight.filter("not tight and next is not null").select("file", F.col("next").alias("start"), F.lit(True).alias("landed")).distinct()
    marked = tight.join(landing, ["file", "start"], "left")
    opens = F.coalesce("landed", F.lit(False)) | ~F.coalesce(F.lag("tight").over(order), F.lit(False))
    parts = materialize(marked.select("file", "start", "next", F.when(opens, F.col("start")).alias("opened")).withColumn("segment", F.last("opened", True).over(order.rowsBetween(W.unboundedPreceding, 0))).drop("opened"), "segments")
    jumps = materialize(parts.groupBy("file", "segment").agg(F.max_by("next", "start").alias("to")).join(parts.select("file", F.col("segment").alias("to")).distinct(), ["file", "to"], "left_semi"), "jumps")
    seen = materialize(parts.filter("segment = 0").select("file", "segment").distinct(), "seen")
    # Round k: what is reached within 2^k jumps; then the jumps double.
    while not jumps.isEmpty():
        step = seen.join(jumps, ["file", "segment"]).select("file", F.col("to").alias("segment"))
        more = materialize(seen.unionByName(step).distinct(), "seen")
        if more.count() == seen.count():
            break
        further = jumps.withColumnRenamed("to", "via").join(jumps.select("file", F.col("segment").alias("via"), "to"), ["file", "via"])
        seen, jumps = more, materialize(further.select("file", "segment", "to"), "jumps")
    kept = parts.join(seen, ["file", "segment"], "left_semi").select("file", "start")
    return found.join(kept, ["file", "start"], "left_semi")


def _assembled(spark: SparkSession, path: str, found: DataFrame, broken: DataFrame) -> DataFrame:
    """Digests of records whose payload holds version lines, from all pieces that such a record spans.

    Their text is read again.  A second read may be split otherwise, so pieces are told by their content, never by their
    place in a read; which content stands where was settled by the first.
    """
    order = W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, 0)
    owners = broken.select("file", "start", F.col("start").alias("owner"), F.col("next").alias("until"), "length", "skip")
    owned = found.select("file", "piece", "start").join(owners, ["file", "start"], "left")
    filled = owned.select("file", "piece", "start", *(F.last(c, True).over(order).alias(c) for c in ("owner", "until", "length", "skip"))).filter("start < until")
    filled = materialize(filled, "spanned")
    again = _pieces(spark, path).select("value", F.md5(F.encode("value", "utf-8")).alias("piece"))
    texts = again.join(filled.select("piece").distinct(), "piece", "left_semi").dropDuplicates(["piece"])
    joined = filled.join(texts, "piece").groupBy("file", F.col("owner").alias("start"), "length", "skip").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col("start").alias("s"), "value"))), lambda x: x["value"]), MAGIC).alias("value"))
    payload = F.expr("substring(encode(value, 'utf-8'), cast(skip + 1 as int), cast(length as int))")
    return joined.select("file", "start", F.sha2(payload, 256).alias("joined_digest"))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """``(page_id, uri, record_type, refers_to, payload_bytes, payload_digest)`` of every record on a file's chain.

    A response's length and digest are those of the bytes read; a revisit has no bytes and tells those of what it refers to.
    """
    found = materialize(candidate_records(_pieces(spark, path)), "records")
    kept = reachable(found)
    broken = materialize(kept.filter("not whole"), "broken")
    if broken.isEmpty():
        kept = kept.withColumn("joined_digest", F.lit(None).cast("string"))
    else:
        kept = kept.join(_assembled(spark, path, found, broken), ["file", "start"], "left")
    revisit = F.col("type") == "revisit"
    return kept.select(
        "page_id", "uri", F.col("type").alias("record_type"), F.when(revisit, F.col("refers_to")).alias("refers_to"),
        F.when(revisit, F.col("said_bytes")).otherwise(F.col("length")).alias("payload_bytes"),
        F.when(revisit, F.col("said")).otherwise(F.coalesce("digest", "joined_digest")).alias("payload_digest"),
    )


def archive_report(pages: DataFrame) -> DataFrame:
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archive(pages, path)
    return read_archive(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
