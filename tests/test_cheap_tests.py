"""What is looked at before patterns and phrases: it never says no to a text that holds one, and mostly no to others."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from folioscan import lexicon
from folioscan.functions.text import folded, holds_any, may_match, regex


def test_patterns(spark):
    rng = random.Random(4)
    patterns = [p for bank in ("units", "grammar", "vocab", "asset_terms") for p, _ in lexicon.patterns(bank)]
    words = ["a", "an", "apple", "book", "hour", "university", "3", "KM", "l", "T", "%", "They", "İS", "is", "ſhe", "am", "you", "was", "Was", "we", "has", "went", "more", "better", "fact", "that", "the", "因为", "因此", "的原因", "通过", "使", "的的", "never", "have", "no", "of", "could", "unique", "very", "_", "é"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", " ", " ", "\u00a0", "\u3000", "\n", "", "."]) for _ in range(rng.randint(2, 12))) for _ in range(3000)]
    texts += ["(is\u2003you)", "3you\u0085was", "Éa\u3000apple", "5\u00a0KM"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("low", folded(F.col("text")))
    lost, found = F.lit(0), F.lit(0)
    for p in patterns:
        match = F.regexp_extract("text", regex(p, True), 0) != ""
        lost, found = lost + (match & ~may_match(F.col("low"), p)).cast("int"), found + match.cast("int")
    odd = ~F.col("text").contains("İ")  # two letters in lower case
    assert rows.where(odd).agg(F.sum(found) > 500, F.sum(lost)).first() == (True, 0)


def test_texts_with_words_apart_are_not_searched(spark):
    texts = spark.createDataFrame([("you know that this is fine, he said they are here",)], "text string")
    assert not texts.where(may_match(F.col("text"), r"\bis\s+you\b") | may_match(F.col("text"), r"\bare\s+he\b") | may_match(F.col("text"), r"(\d)\s*L\b")).count()


def test_phrases(spark):
    phrases = ["因为", "因为所以", "的", "gonna", "a.b", "一(二"]
    texts = ["", "x因为", "因", "所以的", "gonn", "xgonnax", "a.b", "aXb", "一(二", "一二", "\U0001f600因\n为"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", holds_any(F.col("text"), phrases).alias("held")).collect()
    assert {r["text"]: r["held"] for r in rows} == {t: any(p in t for p in phrases) for t in texts}
