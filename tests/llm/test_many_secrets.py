"""One long text full of secrets of all kinds, and how well the Markov part tells random strings from identifiers."""

from __future__ import annotations

import random
import string

from pyspark.sql import functions as F

from folioscan.llm import secret_scan
from test_text_operators import base_spans, joined, markov_spans


def random_token(rng):
    return "".join(rng.choices(string.ascii_letters + string.digits, k=rng.randint(24, 40)))


def test_a_text_full_of_secrets(spark):
    rng, parts = random.Random(7), []
    for _ in range(3000):
        t = random_token(rng)
        parts.append(rng.choice([f"password={t}", f"x {t} y", f"AKIA{t.upper()}", f"{t}{rng.getrandbits(96):024x}", f"token: {t}=={t}", "plain words here", f"{rng.getrandbits(90):023x}{t}"]))
    texts = [" ".join(parts), " ".join(parts[:300]), "".join(parts[:40])]
    odds = secret_scan.train(secret_scan.rule_samples(spark))
    docs = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = dict(docs.select("i", secret_scan.spans_text(secret_scan.all_spans(F.col("text"), odds))).collect())
    for i, t in enumerate(texts):
        assert got[i] == joined(sorted([*base_spans(t), *markov_spans(t, odds)]))


def test_recall_and_false_alarms_of_the_ratio(spark, documents):
    rng = random.Random(8)
    secrets = [random_token(rng) for _ in range(400)]
    words = ["".join(w.capitalize() for w in rng.choices(secret_scan.IDENTIFIER_WORDS, k=5)) for _ in range(200)] + ["_".join(rng.choices(secret_scan.IDENTIFIER_WORDS, k=5)) for _ in range(200)]
    odds = secret_scan.default_model(documents)
    docs = spark.createDataFrame([(t, t in set(secrets)) for t in secrets + words], "text string, secret boolean")
    got = docs.select("secret", (F.size(F.filter(secret_scan.all_spans(F.col("text"), odds), lambda x: x["kind"] == 3)) > 0).alias("found")).collect()
    assert sum(r["found"] for r in got if r["secret"]) >= 0.9 * len(secrets)
    assert sum(r["found"] for r in got if not r["secret"]) <= 0.02 * len(words)
