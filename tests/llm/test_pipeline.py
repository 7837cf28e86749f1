"""The pipeline's stages: columns, effects, and each against brute force on its own input."""

import pytest

import corpus_pipeline as P
from corpuslens.llm import secrets
from corpuslens.llm.common import materialize

from . import brute
from .test_secrets import matches


@pytest.fixture(scope="module")
def stages(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [("documents", docs)]
    for name, f in P.STAGES:
        docs = materialize(f(spark, docs, sf_dir), name)
        out.append((name, docs))
    return out


def rows(stage):
    return {r.doc_id: r for r in stage.collect()}


def test_all_but_the_last_return_documents(stages):
    columns = stages[0][1].columns
    for name, df in stages[:-1]:
        assert df.columns == columns and df.dtypes == stages[0][1].dtypes, name


def test_quality_keeps_good_documents(spark, stages):
    before, after = rows(stages[0][1]), rows(stages[1][1])
    for i, r in before.items():
        n, _, _, _, repeats = brute.stats(r.text)
        if n < 10 or 100 * repeats > 20 * n:
            assert i not in after
    assert all(after[i] == before[i] for i in after)
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    good = [r.doc_id for r in labels if r.quality == 1 and brute.stats(before[r.doc_id].text)[4] * 5 <= brute.stats(before[r.doc_id].text)[0] >= 10]
    assert sum(i in after for i in good) >= 0.99 * len(good)
    bad = [r.doc_id for r in labels if r.quality == 0]
    assert sum(i in after for i in bad) <= 0.1 * len(bad)


def test_near_dedup_keeps_one_of_each_group(stages):
    before, after = rows(stages[1][1]), rows(stages[2][1])
    shingles = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, brute.words(r.text)) for i, r in before.items())}
    texts = {}
    for i in sorted(before):
        texts.setdefault(before[i].text, i)
    assert len({r.text for r in after.values()}) == len(after)
    by_shingle = {}
    for i, s in shingles.items():
        for x in s:
            by_shingle.setdefault(x, []).append(i)
    near = set()
    for own in by_shingle.values():
        if 1 < len(own) < 50:
            near |= {(a, b) for a in own for b in own if a < b}
    similar = [(a, b) for a, b in near if len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b])]
    assert similar and sum(a in after and b in after for a, b in similar) <= 0.05 * len(similar)
    related = {x for a, b in near if len(shingles[a] & shingles[b]) >= 0.3 * len(shingles[a] | shingles[b]) for x in (a, b)}
    assert all(i in after for i in before if i not in related)


def test_substring_dedup_removes_repeats(stages):
    before, after = rows(stages[2][1]), rows(stages[3][1])
    want = brute.substring_dedup([(i, r.text) for i, r in before.items()])
    for i, n, removed, digest in want:
        if removed == 0:
            assert after[i].text == before[i].text
        elif removed == n:
            assert i not in after
        else:
            assert brute.hashlib.sha256(after[i].text.encode()).hexdigest() == digest


def test_masked_texts(stages):
    before, after = rows(stages[3][1]), rows(stages[4][1])
    assert before.keys() == after.keys()
    some = 0
    for i, r in after.items():
        found = [m for rule in secrets.RULES for m in matches(rule, before[i].text)]
        some += bool(found)
        assert not any(matches(rule, r.text) for rule in secrets.RULES if rule.base)
        if not found:
            assert r == before[i]
    assert some


def test_packing_holds_all_documents(stages):
    ids = {r.doc_id for r in stages[5][1].select("doc_id").distinct().collect()}
    assert ids == set(rows(stages[4][1]))


def test_run_is_the_stages_in_order(spark):
    got = P.run(spark, "/root/testdata/sf0.001")
    assert {"doc_id", "sequence_id", "offset"} <= set(got.columns) and got.count() > 0
