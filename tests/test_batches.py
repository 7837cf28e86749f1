"""What Python workers hold at once: trees go at once, batches come in pieces of bounded bytes."""

import gc
import gzip
import hashlib

import pyarrow as pa

from corpuslens.functions import batches as B, html as H
from corpuslens.plans.queries import QUERIES


def test_trees_go_without_the_collector():
    page = "<html><body><main><nav><ul><li><b>x</b></ul></nav><p>text <a href='/a'>one <i>link</i></a></main></body></html>"
    gc.collect()
    gc.disable()
    try:
        assert H.extract(page, "https://a.example/")[0] == "text one link"
        left = sum(isinstance(x, H.Node) for x in gc.get_objects())
    finally:
        gc.enable()
    assert left == 0


def test_pieces_hold_bounded_bytes():
    texts = ["a" * 40, None, "", "b" * 300, *["c" * 30] * 9]
    got = list(B.pieces(iter([(pa.array(texts), pa.array(range(13))), (pa.array([], pa.string()), pa.array([], pa.int64()))]), 100))
    assert [x for p, _ in got for x in p.to_pylist()] == texts and [x for _, n in got for x in n.to_pylist()] == list(range(13))
    assert all(len(p) <= 1 or sum(len(x or "") for x in p.to_pylist()) <= 100 for p, _ in got) and len(got) >= 5


def test_unpacked_bytes_are_held_in_pieces():
    bodies = [gzip.compress(bytes(5000)), None, *[gzip.compress(bytes(400))] * 6]
    got = [x.to_pylist() for x in B.mapped(gzip.decompress, iter([pa.array(bodies, pa.binary())]), pa.binary(), 1000)]
    assert [x for p in got for x in p] == [bytes(5000), None, *[bytes(400)] * 6]
    assert [sum(len(x or b"") for x in p) for p in got] == [5000, 1200, 1200]


def test_bodies_of_pages_without_html(spark, tmp_path):
    rows = [(1, "u1", None), (2, "u2", None), (3, "u3", "é<p>"), (4, "u4", ""), (5, "u5", "")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.digest for r in QUERIES["gunzipped_bodies"](spark, str(tmp_path)).collect()}
    assert got == {i: None if h is None else hashlib.sha256(h.encode()).hexdigest() for i, _, h in rows}
    assert {r.url: r.body_size_bytes for r in QUERIES["page_metadata"](spark, str(tmp_path)).collect()} == {u: len((h or "").encode()) for _, u, h in rows}
