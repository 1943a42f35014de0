"""Banks of very many words: one pass over the texts, no shuffle of what is found, and the same finds as a plain search."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioscan.operators import custom, matcher


@pytest.mark.parametrize("least", [1, 3, 7])
def test_words_and_texts_of_any_length(least):
    """Among them words that begin alike far beyond the walk, texts that end inside a word, and texts longer than what is walked at once."""
    rng = random.Random(least)
    said = lambda n: "".join(rng.choices("ab的\U0001f600 ", k=n))
    long = "ab" * matcher.LONG
    words = sorted({said(rng.randint(least, least + 6)) for _ in range(300)} | {long, long + "a", long + "b", long + "的", "a" * matcher.LONG, "b" * (matcher.LONG + 1)})
    texts = [said(rng.randint(0, 80)) for _ in range(200)] + [None, "", long[:-1], long + "a", "x" + long + "ab", "a" * 200, said(matcher.PLACES // 2) + long + "b"]
    rng.shuffle(words)
    found = matcher.Words(pa.array(words, pa.large_string()))
    row, word = found.find([None if t is None else t.encode() for t in texts])
    bank = found.words.to_pylist()
    assert [(r, bank[w]) for r, w in zip(row, word)] == [(n, w) for n, t in enumerate(texts) for w in bank if t and w in t]


def test_words_that_begin_alike_are_not_gone_through():
    start = "https://example.org/" + "x" * matcher.LONG
    words = [f"{start}/{k}" for k in range(20_000)]
    found = matcher.Words(pa.array(words, pa.large_string()))
    row, word = found.find([f" {start}/{k} {start}".encode() for k in range(20_000)])  # 400 million pairs begin alike
    assert {(int(r), found.words[int(w)].as_py()) for r, w in zip(row, word)} == {(k, f"{start}/{str(k)[:n]}") for k in range(20_000) for n in range(1, len(str(k)) + 1)}


def test_prefixes_that_hash_alike_are_compared(monkeypatch):
    """With hashes of one value every place of a word's length is looked up, and what is not the word is left out."""
    monkeypatch.setattr(matcher, "_longer", lambda h, byte: (h ^ byte) & matcher.np.uint64(0))
    words, texts = ["abc", "bcd", "abcdef"], ["zabcz", "bcdbcd", "abcde", "xyz"]
    bank = matcher.Words(pa.array(words, pa.large_string()))
    row, word = bank.find([t.encode() for t in texts])
    assert [(r, bank.words[int(w)].as_py()) for r, w in zip(row, word)] == [(0, "abc"), (1, "bcd"), (2, "abc"), (2, "bcd")]


def test_millions_of_words_are_one_pass(spark):
    """By the sizes that parts are cut by, 2.5 million words of 13 letters are one part; texts and finds meet no shuffle and no join."""
    words = spark.range(2_500_000).select(F.concat(F.lit("w"), F.lpad(F.col("id").cast("string"), 11, "0"), F.lit(";")).alias("keyword"))
    assert len(matcher.parts(words, "keyword")) == 1
    few = words.where("substr(keyword, 8, 5) < '30000'").limit(30_000).unionByName(words.limit(10))
    units = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("word").alias("doc_type"), F.lit("paragraph").alias("unit_kind"), F.lit(1).alias("unit_idx"), F.lit("x").alias("location"), F.format_string("a w%011d; w%011d; w%011d;", F.col("id"), F.col("id") + 1, F.col("id")).alias("text"))
    found = custom.held_keywords(units, few)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan
    had = {r.keyword for r in few.distinct().collect()}
    assert sorted((r.doc_id, r.keyword) for r in found.select("doc_id", "keyword").collect()) == sorted((n, w) for n in range(500) for w in (f"w{n:011d};", f"w{n + 1:011d};") if w in had)
    assert custom.held_keywords(units, words.where("false")).collect() == []
