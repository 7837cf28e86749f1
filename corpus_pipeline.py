"""The corpus pipeline: documents in, packed training sequences out.

``STAGES`` lists (name, function); each function takes ``(spark, docs, sf_dir)``
and returns a DataFrame, which is written as Parquet and read again as the
next one's ``docs``.  All but the last return the columns of ``documents``.

Every stage takes an empty table and gives one; columns besides doc_id and
text pass through untouched, whatever their names, but for the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpuslens.llm.common import drop, materialize, scratch_scope
from corpuslens.llm.packing import pack_documents
from corpuslens.llm.quality import keep_good
from corpuslens.llm.queries import SPECIAL, tokenizer_path
from corpuslens.llm.secrets import mask_secrets
from corpuslens.llm.simhash import keep_first_copies
from corpuslens.llm.substrings import drop_repeats


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the learned decision list reject.

    A null, empty or short text (under ten words) goes; rows that repeat a doc_id, or have none, are
    judged each by their own text; a very long text is judged whole.  Labels for no document count for nothing.
    """
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies.

    Null and empty texts are copies of one another; rows that repeat a doc_id are one document and stay
    or go together; rows of a null doc_id stay; a very long text is compared whole.
    """
    return keep_first_copies(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the windows of 20 words that start earlier elsewhere.

    A text that loses nothing stays as it is, one that loses every word goes; null, empty and short
    texts lose nothing, nor do rows of a null doc_id; rows that repeat a doc_id lose the same.
    """
    return drop_repeats(docs)


def secret_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every secret masked, all spans found on the text as it came; all rows stay.

    Null and empty texts stay as they are; rows that repeat a doc_id, or have none, are masked each.
    """
    return mask_secrets(docs)


def curve_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of up to 2048 tokens with their ids (32-bit, little-endian), neighbours along the curve together.

    A null or empty text is its closing id alone; rows that repeat a doc_id are packed each.
    """
    return pack_documents(docs, tokenizer_path("byte_bpe_50k.tiktoken"), SPECIAL)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("secret_masking", secret_masking),
    ("curve_packing", curve_packing),
]

#: Fingerprints, window hashes and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents; a stage's scratch tables and input go when its output is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, kept = docs, []
        with scratch_scope(kept):
            docs = materialize(stage(spark, before, sf_dir), f"stage-{name}")
            kept.append(docs)
        drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
