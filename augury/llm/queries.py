"""Queries p7 to p9 over the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from augury.llm import bpe, canon, leakage
from augury.sources.tables import table


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document by byte_bpe_50k."""
    return bpe.encode(table(spark, d, "documents"))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    """Documents, tokens and characters per source."""
    docs = table(spark, d, "documents").withColumn("chars", F.length(F.coalesce("text", F.lit(""))))
    return bpe.encode(docs, keep=["source", "chars"]).groupBy("source").agg(
        F.count("*").alias("n_docs"), F.sum(F.size("ids")).alias("n_tokens"), F.sum("chars").alias("n_chars")
    )


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold at least ten consecutive words of a test item."""
    return p8_leaks(spark, d).where(F.col("n_words") >= leakage.WORDS).select("doc_id", "item_id")


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Leaked and similar items per document, with the longest run of equal words."""
    return leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of documents that look the same though their characters differ."""
    return canon.look_alike_pairs(table(spark, d, "documents"))


def p9_forms(spark: SparkSession, d: str) -> DataFrame:
    """The consistent form of every document."""
    return canon.forms(table(spark, d, "documents"))


def p9_scripts(spark: SparkSession, d: str) -> DataFrame:
    """Tokens by the kind of their script confusion."""
    return canon.script_report(table(spark, d, "documents"))


def p9_classes(spark: SparkSession, d: str) -> DataFrame:
    """The class of documents of one look, per document."""
    return canon.look_alike_classes(table(spark, d, "documents"))
