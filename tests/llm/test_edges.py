"""Learned rules applied row by row; repeated rows, clashing names, ties and empty tables through the text operators."""

import public_tokenizers
from pyspark.sql import functions as F

from corpuslens.llm import quality as Q, shingles, simhash, substrings, tokens

from . import brute

SF = "/root/testdata/sf0.01"


def features(text):
    n, chars, symbols, dup, repeat = brute.stats(text)
    ratio = lambda a: a / n if n else 0.0
    return {"n_words": float(n), "mean_word_chars": ratio(chars), "symbols_per_word": ratio(symbols), "repeat_share": ratio(repeat), "dup_lines_per_word": ratio(dup)}


def test_verdicts_by_brute_force(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    rules = Q.fit_rules(docs, labels)
    assert rules
    got = {r.doc_id: r for r in Q.quality_report(docs, labels).collect()}
    fired = set()
    for r in docs.collect():
        x = features(r.text)
        n, _, _, _, repeat = brute.stats(r.text)
        first = next((i for i, rule in enumerate(rules, 1) if all((x[c.feature] > c.threshold) == c.above for c in rule.conditions)), 0)
        failed = n < 10 or 100 * repeat > 20 * n
        fired.add(first)
        assert (got[r.doc_id].rule, got[r.doc_id].base_failed, got[r.doc_id].kept) == (first, failed, not failed and first == 0)
    assert len(fired) > 1


def test_repeated_rows_and_clashing_names(spark):
    text = "the same words of one text that is long enough to count as such in all of them here"
    rows = [(1, text), (1, text), (2, text + " x"), (None, text), (3, None), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_words", "2 as n_tokens", "'k' as key", "3 as fps", "4 as node", "5 as pos", "6 as kind")
    path = public_tokenizers.path("byte_bpe_50k.json")
    counted = tokens.token_report(docs, path).collect()
    assert len(counted) == len(rows) and {r.n_tokens for r in counted if r.doc_id == 1} == {r.n_tokens for r in counted if r.doc_id is None}
    printed = simhash.simhash_report(docs).collect()
    assert len(printed) == len(rows) and len({(r.fingerprint, r.component_id) for r in printed if r.doc_id == 1}) == 1
    assert {r.fingerprint for r in printed if r.doc_id == 3} == {"0" * 16}
    labels = spark.createDataFrame([(1, 1), (1, 0), (99, 0)], "doc_id long, quality int")
    judged = Q.quality_report(docs, labels).collect()
    assert len(judged) == len(rows) and {r.n_words for r in judged if r.doc_id == 1} == {len(text.split())}
    for keep in (lambda d: Q.keep_good(d, labels), shingles.keep_first_copies, substrings.drop_repeats):
        out = keep(docs)
        assert out.columns == docs.columns
        left = out.filter(F.col("doc_id") == 1).count()
        assert left == 2  # rows of one id stay together
    for make in (lambda d: tokens.token_report(d, path), simhash.simhash_report, lambda d: Q.quality_report(d, labels), lambda d: Q.keep_good(d, labels), shingles.keep_first_copies, substrings.drop_repeats):
        assert make(docs.limit(0)).count() == 0


def test_fit_reads_one_row_an_id(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    ids = [r.doc_id for r in labels.select("doc_id").limit(40).collect()]
    again = docs.unionAll(docs.filter(F.col("doc_id").isin(ids)).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(30)))).drop("k"))
    assert Q.fit_rules(again, labels) == Q.fit_rules(docs, labels)
