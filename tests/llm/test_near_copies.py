"""One document of each group of near copies: five-word shingles, similarity 0.8, and which row stays."""

from __future__ import annotations

import random
from itertools import combinations

import numpy as np

from folioscan.llm import language_id, quality, simhash_dedup
from folioscan.llm.simhash_dedup import fingerprint, similarity


def prose(rng, n):
    return ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(n)]


def edited(rng, words, changes):
    out = list(words)
    for k in rng.sample(range(len(out)), changes):
        out[k] = "changed" + str(rng.randint(0, 99))
    return out


def groups(texts):
    """Components of all pairs whose similarity is 0.8 or more, by brute force."""
    root = list(range(len(texts)))

    def find(i):
        return i if root[i] == i else find(root[i])

    shingles = [simhash_dedup.shingle_set(t or "", 5) for t in texts]
    for i, j in combinations(range(len(texts)), 2):
        x, y = shingles[i], shingles[j]
        if min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and len(x & y) >= 0.8 * len(x | y):
            root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(texts))]


def corpus():
    rng, texts = random.Random(9), []
    for _ in range(60):
        base = prose(rng, rng.randint(60, 400))
        texts += [" ".join(base), *(" ".join(edited(rng, base, rng.choice([1, 1, 2, len(base) // 60]))) for _ in range(3))]
    big = prose(rng, 300)
    texts += [" ".join(edited(rng, big, 1)) for _ in range(150)]  # a large group of unlike near copies
    texts += [" ".join(prose(rng, 50)) for _ in range(60)]
    return [*texts, texts[0], texts[0], None, "", " \n", "one two", "one  two", "one two three"]


def test_groups_against_brute_force(spark):
    texts = corpus()
    want = groups(texts)
    docs = spark.createDataFrame([(k, t, k, "f", 1, 2) for k, t in enumerate(texts)], "doc_id long, text string, row int, file string, at int, best int")
    for node_rows in (4096, 50):
        kept = simhash_dedup.keep_one(docs, node_rows=node_rows)
        assert kept.columns == docs.columns
        assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want))


def test_share_of_planted_near_copies_that_go(spark):
    """Pairs of which most are close to a similarity of 0.8; no radius has a say in what is expected."""
    rng, texts, alike = random.Random(2), [], []
    for size, changes in ((60, 1), (60, 2), (100, 2), (200, 2), (200, 4), (400, 8), (1000, 20)):
        for _ in range(60):
            base = prose(rng, size)
            texts += [" ".join(base), " ".join(edited(rng, base, changes))]
            alike.append(similarity(*texts[-2:]) >= 0.8)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash_dedup.keep_one(docs).collect()}
    assert set(range(0, len(texts), 2)) <= kept
    gone = [2 * k + 1 not in kept for k in range(len(alike))]
    assert not any(g and not a for g, a in zip(gone, alike))  # what is less alike stays
    assert sum(gone) >= 0.97 * sum(alike) and sum(alike) > 200


def test_a_bucket_in_parts(spark):
    """One large group of which most pairs are a little too far apart: copies at 0.85 of their base and at 0.74 of each other."""
    rng = random.Random(12)
    base = prose(rng, 120)
    texts = [" ".join(base), *(" ".join(edited(rng, base, 2)) for _ in range(1200)), *(" ".join(prose(rng, 120)) for _ in range(50))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = set(groups(texts))
    for node_rows in (512, 8192):
        kept = {r["doc_id"] for r in simhash_dedup.keep_one(docs, node_rows=node_rows).collect()}
        assert want <= kept and len(kept - want) <= 0.05 * (len(texts) - len(want))


def test_estimates_of_sketches():
    rng = random.Random(13)
    errors = []
    for size, changes in ((30, 1), (100, 2), (300, 10), (2000, 60)):
        for _ in range(30):
            a = prose(rng, size)
            b = edited(rng, a, changes)
            one, two = (np.frombuffer(simhash_dedup.sketch(simhash_dedup.shingle_hashes(" ".join(x), 5))[1], np.uint8) for x in (a, b))
            errors.append(1 - 2 * int(np.bitwise_count(one ^ two).sum()) / simhash_dedup.HASHES - similarity(" ".join(a), " ".join(b)))
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.04


def test_a_column_named_as_the_metadata(spark, tmp_path):
    spark.createDataFrame([(1, "a b c d e f", "x"), (2, "a b c d e f", "y"), (3, "other", "z")], "doc_id long, text string, _metadata string").write.parquet(str(tmp_path / "t"))
    kept = simhash_dedup.keep_one(spark.read.parquet(str(tmp_path / "t")))
    assert sorted(map(tuple, kept.collect())) == [(1, "a b c d e f", "x"), (3, "other", "z")]


def test_which_row_stays(spark, tmp_path):
    rows = [(5, "a b c d e f g", "x"), (3, "a b c d e f g", "y"), (3, "A b c d e f g", "z"), (None, "a b c d e f g", "n"), (None, "p q r s t u", "m"), (None, "p q r s t u", "m")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = sorted((r["doc_id"], r["source"]) for r in simhash_dedup.keep_one(docs).collect() if r["doc_id"] is not None)
    assert len(kept) == 1 and kept[0][0] == 3
    least = min((t for d, t, _ in rows if d == 3), key=lambda t: docs.where(docs.text == t).selectExpr("xxhash64(text)").first()[0])
    assert simhash_dedup.keep_one(docs).where("doc_id = 3").first()["text"] == least
    assert simhash_dedup.keep_one(docs).where("doc_id is null").count() == 1
    docs.write.parquet(str(tmp_path / "docs"))
    read = spark.read.parquet(str(tmp_path / "docs"))
    assert sorted(map(str, simhash_dedup.keep_one(read).collect())) == sorted(map(str, simhash_dedup.keep_one(docs).collect()))
    assert simhash_dedup.keep_one(read.where("false")).count() == 0


def test_repeated_ids_with_unlike_texts_are_learned_alike(spark):
    rng = random.Random(3)
    rows = [(k % 7, " ".join(prose(rng, 40)) + (" !!! ### |||" * 20 if k % 3 == 0 else ""), ("en", "de")[k % 2]) for k in range(80)]
    one, two = (spark.createDataFrame(r, "doc_id long, text string, lang string").repartition(n) for r, n in ((rows, 1), (rows[::-1], 5)))
    a, b = language_id.train(one, per_lang=20), language_id.train(two, per_lang=20)
    assert a.langs == b.langs and np.array_equal(a.weights, b.weights)
    a, b = quality.train(one, per_class=15), quality.train(two, per_class=15)
    assert a.bias == b.bias and np.array_equal(a.weights, b.weights)
