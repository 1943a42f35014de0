"""The corpus pipeline: low quality out, near copies out, benchmark leaks out, secrets masked, packed into training sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.llm import decontaminate, packing, quality, secret_scan, simhash_dedup
from folioscan.llm.common import stage, table


def good_only(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised scorer rejects go."""
    return quality.keep_good(docs, quality.train(docs))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are near copies, the one with the least doc_id stays."""
    return simhash_dedup.keep_one(docs)


def no_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def no_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked, and n_chars follows; the documents stay."""
    masked = secret_scan.mask(docs, secret_scan.default_model(docs))
    return masked.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else masked


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences, a row per piece."""
    return packing.pack(docs, digest=True)


STAGES = [("quality", good_only), ("simhash_dedup", one_of_each), ("decontaminate", no_leaks), ("secret_scan", no_secrets), ("packing", packed)]

#: Fingerprints, tokenizers and trained models are beyond SQL; a brute-force version in the tests takes its place.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``; each stage is written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
