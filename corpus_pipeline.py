"""Training-corpus pipeline: toxicity, near-duplicates, repeated passages, mixing, encoding.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns what it keeps of ``docs`` with
the columns of documents, the last one tokens. ``run`` writes each stage's rows as Parquet to the shared folder and reads
them again for the next. The stages can't be expressed in SQL, so ``ORACLE_SQL`` is None; tests hold each stage against
its operator's scores, groups, spans and plans, which are held against brute force or SQL themselves.

Every stage takes nulls in any column, empty, blank and very long texts, ties, repeated rows, an empty table and other columns of any
name, and gives other columns back as they came: texts without words are no more toxic than examples without words, have no near-duplicates, no passages
and no tokens, so all but the mixing stage keep them; of equal rows the near-duplicate stage keeps one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfspark.llm import bpe, mixing, simhash, suffix_dedup
from shelfspark.llm import toxicity as tox
from shelfspark.llm.common import prepare, stored, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled examples call toxic go; all others stay as they are."""
    prepare(spark)
    return tox.remove_toxic(docs, tox.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates stays."""
    prepare(spark)
    return simhash.deduplicate(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of at least 50 words that stand earlier are cut; a document that holds nothing else goes."""
    prepare(spark)
    return suffix_dedup.deduplicate(docs)


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's share of the token budget reads them."""
    prepare(spark)
    return mixing.select(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and pre-token offsets of each document."""
    prepare(spark)
    return bpe.encode(docs)


STAGES = [
    ("toxicity", toxicity),
    ("simhash near-duplicates", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("mixing to target weights", mixing_weights),
    ("byte-level BPE", encoding),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table after all stages."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
