"""Samples of operators that learn, on tables in which one document stands very often."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from folioscan.llm import language_id, quality


def often(spark, docs, times):
    """The documents with their first one ``times`` more, under its id and under others."""
    first = docs.where("lang = 'en'").orderBy("doc_id").limit(1)
    same = spark.range(times).join(F.broadcast(first.select("doc_id", "text", "lang")), how="cross")
    return docs.select("doc_id", "text", "lang").unionByName(same.select("doc_id", "text", "lang"))


def test_languages_are_learned_from_different_texts(spark, documents):
    docs = documents.where("lang is not null")
    plain, crowded = language_id.train(docs, per_lang=60), language_id.train(often(spark, docs, 60_000), per_lang=60)
    assert plain.langs == crowded.langs and np.allclose(plain.weights, crowded.weights)
    few = docs.limit(50)
    told = lambda model: sorted((r.doc_id, r.lang_pred, round(r.score, 6)) for r in language_id.predict(few, model).collect())
    assert told(plain) == told(crowded)


def test_copies_under_other_ids_do_not_crowd_the_sample(spark, documents):
    docs = documents.where("lang is not null").select("doc_id", "text", "lang")
    first = docs.where("lang = 'en'").limit(1).drop("doc_id")
    copies = spark.range(20_000).join(F.broadcast(first), how="cross").select((F.col("id") + 10_000_000).alias("doc_id"), "text", "lang")
    plain, crowded = language_id.train(docs, per_lang=60), language_id.train(docs.unionByName(copies), per_lang=60)
    assert plain.langs == crowded.langs and np.allclose(plain.weights, crowded.weights, atol=1e-5)


def test_quality_is_learned_from_different_texts(spark, documents):
    plain, crowded = quality.train(documents, per_class=100), quality.train(often(spark, documents, 20_000), per_class=100)
    assert np.allclose(plain.weights, crowded.weights) and np.isclose(plain.bias, crowded.bias)
