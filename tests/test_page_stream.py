"""The page source as a stream: a table of urls that grows, one task a host, stop and resume, repeats, odd rows."""

import tempfile
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq

from corpuslens.sources.pages import PageSource, _StreamReader, host


def add(table, name, urls):
    pq.write_table(pa.table({"n": list(range(len(urls))), "url": urls}), f"{table}/{name}.parquet")


def pages(folder, n):
    for i in range(n):
        (Path(folder) / f"{i}.html").write_text(f"<p>page {i} é</p>")
    return [f"file://{folder}/{i}.html" for i in range(n)]


def start(spark, table, out, at):
    spark.dataSource.register(PageSource)
    df = spark.readStream.format("audit_pages").option("table", table).option("buckets", 3).option("rate", "100000").load()
    return df.writeStream.format("parquet").option("path", out).option("checkpointLocation", at).start()


def rows(spark, out):
    return [(r.url, r.status_code, r.html) for r in spark.read.parquet(out).collect()]


def test_each_page_once_over_a_restart(spark, tmp_path):
    table, out, at = (str(tmp_path / x) for x in ("urls", "out", "at"))
    (tmp_path / "urls").mkdir()
    urls = pages(str(tmp_path), 30)
    add(table, "batch-000", urls[:10])
    q = start(spark, table, out, at)
    q.processAllAvailable()
    add(table, "batch-001", [*urls[10:20], None, ""])
    q.processAllAvailable()
    q.stop()
    add(table, "batch-002", [*urls[20:], f"file://{tmp_path}/missing.html"])
    q = start(spark, table, out, at)
    q.processAllAvailable()
    q.stop()
    got = rows(spark, out)
    assert sorted(u for u, _, h in got if h is not None) == sorted(urls) and len(got) == 31
    assert {h for u, _, h in got if u.endswith("/7.html")} == {"<p>page 7 é</p>"}
    # Nothing new, nothing fetched.
    q = start(spark, table, out, at)
    q.processAllAvailable()
    q.stop()
    assert len(rows(spark, out)) == 31


def test_a_killed_batch_is_fetched_anew(spark, tmp_path):
    """A batch whose offsets were logged and whose commit was not is what a killed driver leaves."""
    table, out, at = (str(tmp_path / x) for x in ("urls", "out", "at"))
    (tmp_path / "urls").mkdir()
    urls = pages(str(tmp_path), 8)
    add(table, "a", urls[:4])
    q = start(spark, table, out, at)
    q.processAllAvailable()
    add(table, "b", urls[4:])
    q.processAllAvailable()
    q.stop()
    for f in (tmp_path / "at" / "commits").glob("*1*"):
        f.unlink()
    q = start(spark, table, out, at)
    q.processAllAvailable()
    q.stop()
    assert sorted(u for u, _, _ in rows(spark, out)) == sorted(urls)


def test_a_host_has_one_task():
    table = tempfile.mkdtemp()
    urls = [f"http://{'Big' if i % 3 else f'h{i}'}.example/{i}" for i in range(90)]
    add(table, "x", urls[:50])
    add(table, "y", urls[50:])
    Path(table, "_SUCCESS").write_text("")
    r = _StreamReader({"table": f"file://{table}", "buckets": "4"})
    assert r.initialOffset() == {"files": 0} and r.latestOffset() == {"files": 2} and r.partitions({"files": 2}, {"files": 2}) == []
    dealt = [list(r.urls(p)) for p in r.partitions({"files": 0}, {"files": 2})]
    assert sorted(u for own in dealt for u in own) == sorted(urls)
    assert all(sum(any(host(u) == h for u in own) for own in dealt) == 1 for h in {host(u) for u in urls})
    assert [len(list(r.urls(p))) for p in r.partitions({"files": 1}, {"files": 2})] and sum(len(list(r.urls(p))) for p in r.partitions({"files": 1}, {"files": 2})) == 40
    assert _StreamReader({"table": table + "/none"}).latestOffset() == {"files": 0}
