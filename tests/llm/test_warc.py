"""Operator 9: exact round trip, revisits, magic inside payloads."""

import hashlib

import pytest

from corpuslens.llm import warc
from corpuslens.llm.common import scratch_path

FAKE = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"


def expected(rows):
    first = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 100:
            first[b] = min(first.get(b, i), i)
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        again = first.get(b, i) != i
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[b] if again else None))
    return sorted(out)


ROWS = [
    (1, "http://a/1", "x" * 100), (2, "http://a/2", "x" * 100), (3, "http://a/3", "x" * 99), (4, "http://a/4", "x" * 99),
    (5, None, None), (6, "http://a b/\r\nWARC-Type: revisit", ""), (7, "u", FAKE), (8, "u", "before\r\n" + FAKE + FAKE + "after é\n"),
    (9, "u", "é" * 60), (10, "u", "é" * 60), (11, "u", "WARC/1.1\r\n"), (12, "u", "\r\n\r\n"), (13, "u", "WARC/1.1\r\nContent-Length: 3\r\n\r\n"),
    (14, "u", FAKE * 3), (15, "u", FAKE * 3), (16, "u", "y" * 5000 + "WARC/1.1\r\nContent-Length: 99999\r\n\r\n"), (17, "u", "z" * 50000),
    (-3, "u", "x" * 100),
]


@pytest.mark.parametrize("split", ["128m", "1k"])
@pytest.mark.parametrize("files", [1, 3])
def test_round_trip(spark, split, files):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").coalesce(files)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1" if split == "1k" else "4m")
    try:
        got = sorted(tuple(r) for r in warc.archive_report(pages).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == expected(ROWS)


def test_table(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    rows = [(r.page_id, r.url, r.html) for r in pages.collect()]
    assert sorted(tuple(r) for r in warc.archive_report(pages).collect()) == expected(rows)


def test_empty_and_extra_columns(spark):
    pages = spark.createDataFrame(ROWS[:3], "page_id long, url string, html string").selectExpr("*", "1 as body", "2 as first", "3 as digest")
    assert sorted(tuple(r) for r in warc.archive_report(pages).collect()) == expected(ROWS[:3])
    assert warc.archive_report(pages.limit(0)).count() == 0


def test_repeated_page_ids_keep_their_payloads(spark):
    a, b = "a" * 120, "b" * 120
    rows = [(1, "u", a), (2, "u", a), (2, "u", b), (2, "u", b), (3, "u", b), (None, "u", a), (None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    got = sorted((tuple(r) for r in warc.archive_report(pages).collect()), key=str)
    want = [(1, 120, digest(a), "response", None), (2, 120, digest(a), "revisit", 1), (2, 120, digest(b), "response", None), (2, 120, digest(b), "response", None), (3, 120, digest(b), "revisit", 2), (None, 120, digest(a), "response", None), (None, 0, digest(""), "response", None)]
    assert got == sorted(want, key=str)


def test_records_carry_the_mandatory_fields(spark):
    from pyspark.sql import functions as F

    path = scratch_path(spark, "fields")
    pages = spark.createDataFrame([(1, "u", "x" * 100), (2, "u", "x" * 100), (None, "u", "y")], "page_id long, url string, html string")
    warc.write_archive(pages, path, F.lit("2024-05-06 07:08:09").cast("timestamp"))
    data = "".join(bytes(r.content).decode() for r in spark.read.format("binaryFile").load(path).collect())
    records = [x for x in data.split("WARC/1.1\r\n") if x]
    assert len(records) == 3
    assert all("WARC-Date: 2024-05-06T07:08:09Z\r\n" in x and "WARC-Record-ID: <urn:page:" in x and "Content-Length: " in x for x in records)
    (again,) = [x for x in records if "WARC-Type: revisit" in x]
    assert "WARC-Profile: http" in again and "WARC-Refers-To: <urn:page:1:" in again


def test_files_are_plain_warc(spark):
    path = scratch_path(spark, "plain")
    warc.write_archive(spark.createDataFrame(ROWS[:1], "page_id long, url string, html string"), path)
    data = b"".join(bytes(r.content) for r in spark.read.format("binaryFile").load(path).collect())
    assert data.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and data.endswith(b"\r\n\r\n" + b"x" * 100 + b"\r\n\r\n")


def test_splits_may_change_between_the_reads(spark, monkeypatch):
    """The second read, of records whose payload holds version lines, is split otherwise than the first."""
    rows = [(i, "u", f"{i} before\r\n" + FAKE * (i % 4) + "x" * (7 * i) + "WARC/1.1\r\n") for i in range(60)]
    assembled = warc._assembled

    def otherwise(*args):
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        return assembled(*args)

    monkeypatch.setattr(warc, "_assembled", otherwise)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        got = sorted(tuple(r) for r in warc.archive_report(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2)).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == expected(rows)
