"""Document-quality analytics on Spark."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession

HOME = str(Path(__file__).resolve().parent.parent)


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package where it was not shipped with --py-files."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if HOME not in paths:
        env["PYTHONPATH"] = ":".join([HOME, *paths])
    return spark
