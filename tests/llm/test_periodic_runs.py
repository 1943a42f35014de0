"""Runs against a comparison of every pair of words."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

from folioscan.llm import periodic_runs as R


def plain(words):
    """(start, stop, period) of all runs, by comparing the words with themselves at each distance."""
    out, n = {}, len(words)
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(24, 3 * q):
                out.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((s, e, q) for (s, e), q in out.items()), key=lambda r: (r[0], r[2]))


def pieces(rng, n, letters):
    """Random words with repeats of many kinds, also within repeats."""
    out = []
    while len(out) < n:
        kind = rng.random()
        if kind < 0.3:
            out += rng.choices(range(letters), k=rng.randint(1, 40))
        elif kind < 0.7:
            unit = rng.choices(range(letters), k=rng.choice([1, 2, 3, 5, 8, 13, 40]))
            if rng.random() < 0.3:
                unit += [rng.randrange(letters)] * rng.randint(20, 40)
            out += (unit * rng.randint(2, 12))[: rng.randint(5, 300)]
        elif out:
            a = rng.randrange(len(out))
            out += out[a : a + rng.randint(1, 400)]
    return out[:n]


@pytest.mark.parametrize("letters", [1, 2, 3, 50, 100_000])
def test_runs_of_numbers(letters):
    rng = random.Random(letters)
    for n in [*range(20, 60), *[rng.randint(60, 900) for _ in range(60)]]:
        words = pieces(rng, n, letters)
        assert R.runs_of(np.array(words), np.zeros(n, np.int64)) == plain(words)


def test_runs_stay_within_their_texts():
    rng = random.Random(1)
    texts = [pieces(rng, rng.choice([0, 1, 24, 30, 200, 500]), 3) for _ in range(80)] + [[1] * 30] * 3
    words = [w for t in texts for w in t]
    group = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    heads = np.cumsum([0, *(len(t) for t in texts)])
    assert R.runs_of(np.array(words), group) == sorted(((s + h, e + h, q) for t, h in zip(texts, heads) for s, e, q in plain(t)), key=lambda r: (r[0], r[2]))


def test_all_parts_of_the_method_are_needed():
    """Most runs touch a block's start; some are copies inside blocks."""
    rng = random.Random(2)
    inner = 0
    for _ in range(40):
        seq = np.array([*pieces(rng, 600, 4), 99])
        agree = R.Agreement(seq)
        starts, sources = R.blocks(*R.previous_factors(agree))
        found = R.main_extensions(agree, starts)
        inner += len(R.copied(found, starts, sources)) - len(found)
    assert inner > 10


def test_previous_factors():
    rng = random.Random(7)
    seq = [*pieces(rng, 200, 3), 99]
    length, source = R.previous_factors(R.Agreement(np.array(seq)))
    same = lambda i, j: next((k for k in range(len(seq) - max(i, j)) if seq[i + k] != seq[j + k]), len(seq) - max(i, j))
    assert length == [max((same(i, j) for j in range(i)), default=0) for i in range(len(seq))]
    assert all(same(i, source[i]) == length[i] for i in range(len(seq)) if length[i])


def expected(doc_id, text, tails=True):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if tails and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs, sha = plain(words), lambda b: hashlib.sha256(b).hexdigest()
    gone = {i for s, e, q in runs for i in range(s + q, e)}
    best = max(runs, key=lambda r: ((r[1] - r[0]) / r[2], -r[0], -r[2]), default=None)
    best = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *best, sha("".join(f"{s},{e - s},{q}\n" for s, e, q in runs).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_documents(documents):
    docs = documents.orderBy("doc_id")
    got = R.digest(R.find(R.with_tails(docs))).select(*COLUMNS).collect()
    want = [expected(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, got)) == sorted(want)
    assert sum(w[1] > 0 for w in want) > 10


def test_odd_documents(spark, odd_docs, no_docs):
    odd = odd_docs.union(spark.createDataFrame([(77, "  a b c\x1cd " * 40, None, None, None, None, None, None, None), (78, "é\t" * 30_000, None, None, None, None, None, None, None)], odd_docs.schema))
    rows = [r for r in odd.collect() if len(r.text or "") < 100_000]
    small = odd.where("text is null or length(text) < 100000")
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, R.digest(R.find(R.with_tails(small))).select(*COLUMNS).collect()), key=key) == sorted((expected(r.doc_id, r.text) for r in rows), key=key)
    assert R.find(odd).count() == odd.count()
    assert R.digest(R.find(R.with_tails(no_docs))).collect() == []


def test_a_very_long_repeat():
    n = 300_000
    words = np.arange(n) % 70_001
    assert R.runs_of(words, np.zeros(n, np.int64)) == [(0, n, 70_001)]
