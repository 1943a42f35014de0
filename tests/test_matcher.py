"""Words in texts against a search of every word in every text."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from folioscan.operators import custom, matcher


def plain(texts, words):
    return sorted((n, k) for n, t in texts for k, w in words if t and w and w in t)


@pytest.mark.parametrize("most", [120, 2000, 4 << 20])
def test_words_of_any_number(spark, most):
    rng = random.Random(most)
    letters = "ab的é\U0001f600 \n"
    texts = [(n, "".join(rng.choices(letters, k=rng.randint(0, 60)))) for n in range(150)] + [(200, None), (201, ""), (201, "")]
    words = [(k, "".join(rng.choices(letters, k=rng.randint(0, 4)))) for k in range(200)] + [(300, None), (301, "ab"), (302, "ab")]
    found = matcher.matches(spark.createDataFrame(texts, "n int, text string"), "text", spark.createDataFrame(words, "k int, word string"), "word", most)
    assert sorted((r.n, r.k) for r in found.collect()) == plain(texts, words)


def test_no_part_is_over_its_size(spark):
    words = spark.createDataFrame([(k, "same" if k % 3 == 0 else f"w{k}") for k in range(3000)] + [(9999, "x" * 5000)], "k int, word string")
    cut = matcher.parts(words, "word", 4000)
    sizes = [p.select(F.sum(16 + F.length(F.col("k").cast("string")) + F.length("word")), F.count("*")).first() for p in cut]
    assert sum(n for _, n in sizes) == 3001 and all(size <= 4000 or n == 1 for size, n in sizes)


def test_no_words(spark):
    texts = spark.createDataFrame([(1, "a")], "n int, text string")
    assert matcher.matches(texts, "text", spark.createDataFrame([(1, ""), (2, None)], "k int, word string"), "word") is None
    units = spark.createDataFrame([(1, "word", "paragraph", 1, "x", "a")], "doc_id long, doc_type string, unit_kind string, unit_idx int, location string, text string")
    assert custom.check_wordbank(units, spark.createDataFrame([], custom.ENTRIES)).collect() == []


def test_many_entries_build_one_automaton_and_move_no_texts(spark):
    entries = spark.range(30_000).select(F.lit("g").alias("gid"), F.lit("n").alias("gname"), F.when(F.col("id") % 2 == 0, "all").otherwise("excel").alias("scope"), F.lit(True).alias("g_enabled"), F.col("id").cast("string").alias("eid"), F.concat(F.lit("w"), F.col("id").cast("string"), F.lit(";")).alias("keyword"), F.lit("").alias("tag"), F.lit("").alias("suggestion"), F.lit(True).alias("enabled"), F.lit(0).alias("ord"))
    units = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("word").alias("doc_type"), F.lit("paragraph").alias("unit_kind"), F.lit(1).alias("unit_idx"), F.lit("x").alias("location"), F.concat(F.lit("a w"), F.col("id").cast("string"), F.lit("; w"), (F.col("id") + 1).cast("string"), F.lit("; w999999;")).alias("text"))
    found = custom.check_wordbank(units, entries)
    assert found.count() == 2000  # one of two neighbours is in scope
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "hashpartitioning" not in plan.split("MapInArrow")[0]


def test_a_bank_of_many_rows_is_one_pass_over_the_texts(spark):
    """Passes follow the distinct words, not what rows say besides."""
    words = spark.range(60_000).select(F.concat(F.lit("w"), (F.col("id") % 20_000).cast("string"), F.lit(";")).alias("word"), F.repeat(F.lit("x"), 100).alias("more"), "id")
    texts = spark.range(500).select(F.col("id").alias("n"), F.concat(F.lit("a w"), F.col("id").cast("string"), F.lit("; w999999;")).alias("text"))
    found = matcher.matches(texts, "text", words, "word")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert sorted((r.n, r.id) for r in found.select("n", "id").collect()) == [(n, n + k) for n in range(500) for k in (0, 20_000, 40_000)]
