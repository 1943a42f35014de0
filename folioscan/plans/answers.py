"""A reviewer's answers, kept: a prompt that was answered not long ago is not asked again.

Answers are rows of a stored table, keyed by a hash of mode, model and prompt. Of the requests of a run, each distinct prompt without a live answer is asked once, at a
limited pace; what was answered is kept for the next run. Calls that fail are not kept. A task that is run again asks its prompts again.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.plans import review
from folioscan.skew import join_unique
from folioscan.staging import stage
from folioscan.store import Store


def store(spark: SparkSession, path: str) -> Store:
    return Store(spark, path, {"answers": ("key string, content string, at timestamp", ["key"])})


def keyed(requests: DataFrame, mode: str, model: str) -> DataFrame:
    """The requests with the key of their answers; null prompts are empty."""
    return requests.withColumn("key", F.sha2(F.concat_ws("|", F.lit(mode), F.lit(model), F.coalesce("prompt", F.lit(""))), 256))


def ask(requests: DataFrame, reviewer: Callable[[str], str], kept: Store, mode: str = "local", model: str = "", ttl: timedelta = timedelta(hours=1), most: int | None = None, rpm: float = 0, tasks: int = 1, now: datetime | None = None) -> DataFrame:
    """``requests`` (prompt and any other columns) with content, error and known: whether the answer was there before.

    ``tasks`` calls run at a time, all together at most ``rpm`` a minute (0: no limit). Answers older than ``ttl`` are dropped; beyond ``most`` the oldest are. The answers of
    this run are given even where ``most`` has no room for them.
    """
    spark, now = requests.sparkSession, now or datetime.now(timezone.utc)
    asked_for = stage(keyed(requests, mode, model), "requests")
    live = kept.read("answers").where(F.col("at") >= F.lit(now - ttl))
    open_ = asked_for.groupBy("key").agg(F.min(F.coalesce("prompt", F.lit(""))).alias("prompt")).join(live, "key", "left_anti")
    fresh = stage(review.ask(open_.repartition(tasks), reviewer, 60 * tasks / rpm if rpm else 0), "answers")
    old = live.select("key", "content", F.lit(None).cast("string").alias("error"), F.lit(True).alias("known"), "at")
    new = fresh.select("key", "content", "error", F.lit(False).alias("known"), F.lit(now).alias("at"))
    every = stage(old.unionByName(new), "known")
    held = every.where("content is not null").select("key", "content", "at")
    if not fresh.where("content is not null").isEmpty():
        kept.put(answers=held.orderBy(F.desc("at"), "key").limit(most) if most is not None else held)
    return join_unique(asked_for, every.drop("at"), "key").drop("key")
