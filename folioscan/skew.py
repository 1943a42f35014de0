"""Joins and numbering in which no task gets very many rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscan.staging import stage

MOST_HOT = 1000


def join_unique(rows: DataFrame, others: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``rows`` with the row of ``others`` that has their key, of which there is one at most.

    Keys that more than a thousandth of ``rows`` have, so at most ``MOST_HOT`` of them, are broadcast with their one row; the rest is shuffled. ``rows`` is read three
    times, so it should be a stored table. Null keys meet nothing.
    """
    counts = rows.groupBy(key).agg(F.count("*").alias("_n"))
    total = rows.count()
    hot = counts.where((F.col("_n") > max(total / MOST_HOT, 1000)) & F.col(key).isNotNull()).select(key)
    often = F.broadcast(others.join(F.broadcast(hot), key, "left_semi"))
    cold = rows.join(F.broadcast(hot), key, "left_anti").join(others, key, how)
    return rows.join(F.broadcast(hot), key, "left_semi").join(often, key, how).unionByName(cold)


def numbered(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """``rows`` with their place from 1 on in ``order``, counted over many tasks: sorted by ranges, numbered in each, and moved by the sizes of the ranges before."""
    at = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = stage(at, "numbered").withColumn("_range", F.shiftright("_at", 33))
    sizes = placed.groupBy("_range").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = sizes.select("_range", "_first", F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row a task
    return placed.join(F.broadcast(before), "_range").withColumn(name, F.col("_at") - F.col("_first") + F.col("_before") + 1).drop("_at", "_range", "_first", "_before")
