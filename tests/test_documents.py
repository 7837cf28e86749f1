"""Report documents by a two-phase sink: against the driver's own writers, failures, order, sizes."""

import csv
import io
import json
import tempfile

import pytest
from pyspark.sql import functions as F

from corpuslens.plans import report as R
from corpuslens.schemas import EDIT_PLAN, FINDING, PAGE_SUMMARY
from corpuslens.sources import documents as D, sinks

ENTRY = f"url string, title string, word_count long, last_modified string, primary_label string, secondary_labels array<string>, confidence double, suggested_action string, priority double, affected_prompts array<string>, page_summary {PAGE_SUMMARY}, findings array<{FINDING}>, edit_plan {EDIT_PLAN}, rationale string, inbound long, cluster_id string, judge_status string, attempt_count int, input_tokens long, cache_hit_tokens long, output_tokens long, latency_ms long, judged_at timestamp"


def entries(spark, n=60):
    f = ("f1", "stale_fact", "low", 'say "<b>" & more\nthan one line', "top", "old", "new é")
    rows = []
    for i in range(n):
        plan = ("sum", ["keep, it"], [], [("h1", "old", "new")], None) if i % 3 == 0 else None
        rows.append((f"https://s.example/{i % 7}/{i}", None if i % 5 == 0 else f' Title, "{i}"', i, "" if i % 2 else "2024-01-02", "Stale", ["Thin"] if i % 4 else [], 0.5 if i % 2 else 1.0, "UPDATE", float(i * 37 % 11) / 2, None if i % 6 else ["p", "q"], ("now", None) if i % 2 else None, [f] * (i % 3) if i % 5 else None, plan, None if i % 4 == 0 else "because\r\nof it", i % 3, "cl_001" if i % 9 == 0 else None, "judged", 1, 2, 3, 4, 5, None))
    return spark.createDataFrame(rows, ENTRY)


def clusters(spark, n=1):
    return spark.createDataFrame([("cl_001", "u1", ["u1", "u<2>"], 2, 0.95)][:n], "cluster_id string, canonical_url string, member_urls array<string>, size long, avg_similarity double")


def failed(spark, n=2):
    return spark.createDataFrame([("crawl", "b", 2, None), ("judge", "a", 1, "no & answer")][:n], "phase string, url string, attempts int, last_error string")


def whole(folder):
    return b"".join(D.document_chunks(folder))


def test_json_is_one_document_in_order(spark):
    folder = tempfile.mkdtemp()
    head = {"report_version": "1", "run_id": "r1", "site": "a & b", "summary": {"pages_total": 60, "by_label": {"Stale": 60}}}
    found = D.json_document(entries(spark).repartition(7), clusters(spark), failed(spark), head, folder)
    text = whole(folder).decode()
    assert len(text.encode()) == found["bytes"] and found["rows"] == 63
    got = json.loads(text)
    assert list(got) == ["report_version", "run_id", "site", "summary", "pages", "duplicate_clusters", "failures"]
    assert [p["url"] for p in got["pages"]] == [r.url for r in R.ordered(entries(spark)).collect()]
    # Laid out as one dump of the whole: two-space steps, escapes, whole numbers.
    again = json.dumps(D._plain(got), indent=2, ensure_ascii=False) + "\n"
    for c in "<>&":
        again = again.replace(c, f"\\u{ord(c):04x}")
    assert text == again
    built = R.build(entries(spark), clusters(spark), failed(spark), {"id": "r1"})["pages"]
    for mine, theirs in zip(got["pages"], built):
        assert list(mine) == list(theirs)
        for k in ("url", "title", "primary_label", "secondary_labels", "confidence", "priority", "affected_prompts", "rationale", "findings"):
            assert mine[k] == theirs[k], k
        assert mine["metadata"] == {k: v for k, v in theirs["metadata"].items() if v not in (None, "")}
        assert list(mine["metadata"]) == [k for k in theirs["metadata"] if k in mine["metadata"]]
        assert mine["page_summary"].keys() == {"current_focus", "should_focus_on"}
        assert (mine["edit_plan"] is None) == (theirs["edit_plan"] is None) and "remove" not in (mine["edit_plan"] or {})


def test_empty_sections(spark):
    folder = tempfile.mkdtemp()
    D.json_document(entries(spark).limit(0), clusters(spark, 0), failed(spark, 0), {}, folder)
    assert whole(folder).decode() == '{\n  "pages": [],\n  "duplicate_clusters": [],\n  "failures": []\n}\n'
    D.csv_document(entries(spark).limit(0), folder + "/csv")
    assert whole(folder + "/csv").decode() == ",".join(sinks.CSV_COLUMNS) + "\r\n"


def test_csv_is_the_drivers_csv(spark):
    folder = tempfile.mkdtemp()
    e = entries(spark)
    D.csv_document(e.repartition(5), folder)
    text = whole(folder).decode()
    built = R.build(e, clusters(spark), failed(spark), {"id": "r1"})
    # White space in front is quoted, and line feeds inside are CR LF, as the format has it; cells are the same.
    mine, theirs = (list(csv.reader(io.StringIO(t, newline=""))) for t in (text, sinks.to_csv(built).decode()))
    assert mine == theirs and '," Title, ""' in text and text.endswith("\r\n")


def test_a_failed_write_leaves_the_document_as_it_was(spark):
    folder = tempfile.mkdtemp()
    D.write_document(folder, ["a:", ("s", spark.createDataFrame([("1",), ("2",)], "line string").coalesce(1), "lines"), ";"])
    assert whole(folder) == b"a:12;"
    bad = spark.range(8, numPartitions=4).select(F.when(F.col("id") == 7, F.raise_error(F.lit("lost")).cast("string")).otherwise(F.col("id").cast("string")).alias("line"))
    with pytest.raises(Exception, match="lost"):
        D.write_document(folder, ["b:", ("s", bad, "lines")])
    assert whole(folder) == b"a:12;"
    # The next write that succeeds clears what the failed one left.
    D.write_document(folder, ["c:", ("s", spark.createDataFrame([("3",), (None,), ("4",)], "line string").coalesce(1), "lines")])
    assert whole(folder) == b"c:34"
    system, base = D.place(folder + "/s")
    assert sum(i.base_name.startswith("part-") for i in system.get_file_info(D.afs.FileSelector(base))) == 1


def test_a_changed_part_is_noticed_and_a_document_assembled(spark):
    folder = tempfile.mkdtemp()
    rows = spark.range(50_000).select(F.format_string("%08d\n", "id").alias("line")).repartitionByRange(6, "line").sortWithinPartitions("line")
    found = D.write_document(folder, [("s", rows, "lines")])
    assert found["rows"] == 50_000 and len(found["chunks"]) == 6
    digest = D.assemble(folder, folder + "/whole.txt")
    text = open(folder + "/whole.txt").read()
    assert text == "".join(f"{i:08d}\n" for i in range(50_000)) and len(digest) == 64
    with open(f"{folder}/{found['chunks'][2]['file']}", "a") as f:
        f.write("x")
    with pytest.raises(ValueError):
        whole(folder)
    with pytest.raises(Exception, match="kind must be"):
        D.write_section(rows, folder + "/k", "xml")
