"""Near copies are joined exactly: no pair at 0.8 or above is left out, whatever proposers find."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from test_near_copies import edited, groups, prose

from folioscan.llm import simhash_dedup


def check(spark, texts, **how):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = sorted(r["doc_id"] for r in simhash_dedup.keep_one(docs, **how).collect())
    assert kept == sorted(set(groups(texts)))


def test_pairs_that_sketches_miss(spark):
    """Pairs at 0.804 that share no band of least hashes, or whose bits tell of less than 0.7."""
    rng, texts = random.Random(12), []
    while len(texts) < 8:
        base = prose(rng, 50)
        pair = [" ".join(base), " ".join([*base[:25], "changed", *base[26:]])]
        (bands, bits), (others, more) = (simhash_dedup.sketch(simhash_dedup.shingle_hashes(t, 5)) for t in pair)
        apart = int(np.bitwise_count(np.frombuffer(bits, np.uint8) ^ np.frombuffer(more, np.uint8)).sum())
        same = (np.frombuffer(bands, np.uint32) == np.frombuffer(others, np.uint32)).reshape(simhash_dedup.BANDS, -1).all(axis=1).any()
        if not same or apart > simhash_dedup.HASHES * (1 - simhash_dedup.AGREE) / 2:
            texts += pair
    check(spark, [*texts, *(" ".join(prose(rng, 50)) for _ in range(40)), None, "", " \n", "one two", "one two three"])


def test_texts_that_nothing_proposes(spark, monkeypatch):
    """Without sketches, and with sub-tries and buckets in parts."""
    monkeypatch.setattr(simhash_dedup, "alike_by_sketch", lambda nodes, *_: nodes.select(nodes.node.alias("a"), nodes.node.alias("b")).where("false"))
    monkeypatch.setattr(simhash_dedup, "COMMON", 5)
    rng, texts = random.Random(5), []
    for size in (5, 12, 30, 90, 300, 700):
        base = prose(rng, size)
        texts += [" ".join(base), *(" ".join(edited(rng, base, k)) for k in (1, 1, max(1, size // 60), size // 40))]
    big = prose(rng, 200)
    texts += [" ".join(edited(rng, big, 4)) for _ in range(80)]
    check(spark, texts, node_rows=20)


@pytest.mark.parametrize("few", [1, 6, 128])
def test_odd_bits_go_with_few_rows(spark, monkeypatch, few):
    """Long texts that share passages and are not alike send no row with odd bits for every shingle shared; copies at some 0.8 are found, whether their shingles are counted or not."""
    seen, told = spark.sparkContext.accumulator(0), simhash_dedup._possible

    def watched(batches, least):
        def each():
            for rows in batches:
                seen.add(len(rows))
                yield rows

        return told(each(), least)

    monkeypatch.setattr(simhash_dedup, "_possible", watched)
    monkeypatch.setattr(simhash_dedup, "alike_by_sketch", lambda nodes, *_: nodes.select(nodes.node.alias("a"), nodes.node.alias("b")).where("false"))
    monkeypatch.setattr(simhash_dedup, "FEW", few, raising=False)
    rng = random.Random(8)
    passages = [" ".join(f"p{k}w{i}" for i in range(40)) for k in range(60)]
    texts = [" ".join(x for p in rng.sample(passages, 12) for x in (p, " ".join(f"t{t}x{rng.random()}" for _ in range(40)))) for t in range(24)]
    for size in (20, 100, 900):
        base = prose(rng, size)
        texts += [" ".join(base), *(" ".join(edited(rng, base, k)) for k in range(max(1, size // 55), size // 40 + 2))]
    check(spark, texts)
    if few == 128:
        assert seen.value < 500


def test_odd_bits_never_tell_too_much():
    rng = np.random.default_rng(3)
    rows, sets = [], []
    for k in range(60):
        own = rng.integers(0, 1 << 63, rng.integers(1, 900), np.uint64)
        for m in (own, own[: len(own) * 9 // 10 + 1], np.r_[own, own[:1] + np.uint64(1)]):
            n, _, odd = simhash_dedup.prefix(m, 0.8, np.empty(0, np.uint64))
            sets.append(set(m.tolist()))
            rows.append((k % 4, 0, 0, 0, len(rows), len(rows), n, odd))
    rows = pd.DataFrame(sorted(rows), columns=["token", "i", "j", "side", "node", "root", "n", "odd"])
    cut = iter([rows.iloc[:50], rows.iloc[50:51], rows.iloc[51:]])
    got = {(a, b) for part in simhash_dedup._possible(cut, 0.8) for a, b in part.itertuples(index=False)}
    near = lambda x, y: len(x & y) >= 0.8 * len(x | y)
    want = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if a // 3 % 4 == b // 3 % 4 and near(sets[a], sets[b])}
    assert len(want) > 100 and want <= got and len(got) < 2 * len(want)
