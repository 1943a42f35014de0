"""Masking of texts of any length, and tokens that are no secrets."""

from __future__ import annotations

import random
import string
import time

import pytest
from pyspark.sql import functions as F

from folioscan.llm import secret_scan
from test_text_operators import base_spans, markov_spans

#: None of these is among the words that sample identifiers are built of.
OTHER_WORDS = "quantum harvest lantern velvet orchard mirror copper glacier pepper thunder blanket canyon ribbon walnut hammer saddle meadow biscuit cradle juniper bramble cobalt dolphin ember fossil gravel hollow island jacket kettle".split()


def plain_mask(text, odds):
    out, end = "", 0
    for s, _, e in sorted([*base_spans(text), *markov_spans(text, odds)]):
        if s >= end:
            out += text[end:s] + "[secret]"
        end = max(end, e)
    return out + text[end:]


@pytest.mark.parametrize("block", [1, 7, 1024])
def test_masked_texts(spark, documents, block):
    rng = random.Random(3)
    odds = secret_scan.train(secret_scan.rule_samples(spark))
    token = lambda: "".join(rng.choices(string.ascii_letters + string.digits, k=rng.randint(10, 40)))
    texts = ["".join(rng.choice([f"password={token()}", "é\U0001f600 ", f"AKIA{token().upper()}", f"{rng.getrandbits(96):024x}", " ", token(), "plain words\n"]) for _ in range(rng.randint(1, 30))) for _ in range(150)]
    texts += [r.text for r in documents.limit(50).collect()]
    got = dict(secret_scan.mask(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), odds, block=block).collect())
    assert got == {i: plain_mask(t, odds) for i, t in enumerate(texts)}


def test_masking_takes_as_long_as_the_text(spark):
    rng = random.Random(4)
    odds = secret_scan.train(secret_scan.rule_samples(spark, 200))
    took = {}
    for n in (2000, 20_000):  # 68 and 680 KB
        text = " ".join(f"password = {rng.getrandbits(80):020x}" for _ in range(n))
        docs = spark.createDataFrame([(1, text)], "i int, text string")
        began = time.monotonic()
        assert secret_scan.mask(docs, odds).first().text == " ".join(["[secret]"] * n)
        took[n] = time.monotonic() - began
    assert took[20_000] < 15 and took[20_000] < 20 * max(took[2000], 0.5)


def share(spark, tokens, odds):
    docs = spark.createDataFrame([(t,) for t in tokens], "text string")
    return docs.where(F.size(F.filter(secret_scan.all_spans(F.col("text"), odds), lambda x: x["kind"] == 3)) > 0).count() / len(tokens)


def test_tokens_of_words_outside_the_samples(spark, documents):
    rng = random.Random(9)
    words = lambda k: rng.choices(OTHER_WORDS, k=k)
    kinds = {
        "snake": lambda: "_".join(words(5)),
        "camel": lambda: "".join(w.capitalize() for w in words(5)),
        "path": lambda: "/usr/lib/" + "/".join(words(3)),
        "version": lambda: f"{'-'.join(words(3))}-{rng.randint(0, 9)}-{rng.randint(0, 99)}-{rng.randint(0, 9999)}",
        "address": lambda: f"https/{rng.choice(OTHER_WORDS)}/com/{rng.randint(0, 9999)}/{rng.randint(0, 99)}/{rng.randint(0, 9)}/{rng.randint(0, 9999999)}",
        "date": lambda: f"{rng.choice(OTHER_WORDS)}_{rng.randint(1970, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}_{rng.randint(0, 10**6)}",
        "number": lambda: "".join(rng.choices(string.digits, k=rng.randint(20, 30))),
    }
    odds = secret_scan.default_model(documents)
    alarms = {name: share(spark, [make() for _ in range(400)], odds) for name, make in kinds.items()}
    assert max(v for k, v in alarms.items() if k != "number") <= 0.02, alarms
    secrets = ["".join(rng.choices(string.ascii_letters + string.digits + extra, k=rng.randint(24, 40))) for extra in ("", "+/", "_-") for _ in range(200)]
    assert share(spark, secrets, odds) >= 0.97, share(spark, secrets, odds)


def test_the_sample_of_the_corpus_is_bounded(spark, documents):
    many = documents.unionByName(documents).select("doc_id", "text")
    few = secret_scan.corpus_samples(many, most=5)
    ids = [r.doc_id for r in documents.select("doc_id", F.xxhash64("doc_id").alias("h")).orderBy("h").limit(5).collect()]
    want = documents.where(F.col("doc_id").isin(ids)).select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9+/_-]{4,}"), F.lit(0))).alias("t")).where("length(t) < 20")
    assert few.count() == want.count() and few.where("is_secret").count() == 0
