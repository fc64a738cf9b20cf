"""The queries of this subpackage over the shared tables, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embed_dedup, licenses, mixing, simhash, suffix_dedup, token_counts, topk, toxicity, url_filter
from .common import table

LOOSE = 0.35


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability of being bad of the URL of every page."""
    return url_filter.score(table(spark, sf_dir, "pages"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each leaf of the source tree reads."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest vectors of every vector whose id is divisible by 100, among all."""
    return topk.nearest(table(spark, sf_dir, "embeddings"), queries=F.col("vec_id") % topk.QUERY_EVERY == 0)


def op4_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages that stand earlier."""
    return suffix_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License templates in every document."""
    return licenses.find_licenses(table(spark, sf_dir, "documents"))


def op6_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of near-duplicates of every vector."""
    return embed_dedup.links(table(spark, sf_dir, "embeddings"))


def embed_dedup_loose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same at a threshold that the small tables have pairs for."""
    return embed_dedup.links(table(spark, sf_dir, "embeddings"), LOOSE)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document before and after redaction."""
    return token_counts.count_with_edits(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability of being toxic, with evidence, of every document."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate group and number of links of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).drop("th", "f1", "f2")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids and pre-token offsets of every document, and whether they decode to its text."""
    return bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), check=True)


def queries() -> dict:
    return {f.__name__: f for f in (op1_url_filter, op2_mixing, op3_topk, op4_suffix, op5_licenses, op6_embed_dedup, embed_dedup_loose, op7_token_counts, op8_toxicity, op9_simhash, op10_bpe)}


def oracle_sql() -> dict[str, str]:
    return {"op2_mixing": mixing.ORACLE, "op3_topk": topk.ORACLE, "op4_suffix": suffix_dedup.ORACLE, "op6_embed_dedup": embed_dedup.ORACLE, "embed_dedup_loose": embed_dedup.oracle(LOOSE)}
