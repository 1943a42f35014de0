"""The quality query against a plain version: measures character by character, expectation-maximisation in loops, shapes as strings."""

from __future__ import annotations

import math
import unicodedata
from collections import Counter

import numpy as np

from folioscan.llm import quality
from folioscan.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
NAMES = ("space", "lower", "upper", "digit", "line", "mark", "shout", "bar", "symbol")


def kind(c):
    if c == "\n":
        return "line"
    if c.isspace():
        return "space"
    if c.isalpha():
        return "upper" if c.isupper() else "lower"
    if c.isdigit():
        return "digit"
    if c in "!|":
        return "shout" if c == "!" else "bar"
    return "mark" if c in ".,;:?'\"()-" or ord(c) > 127 and unicodedata.category(c).startswith("P") else "symbol"


def measured(text):
    kinds, words = [kind(c) for c in text], text.split()
    if not words:
        return None, kinds
    n, size, count = Counter(kinds), len(text), len(words)
    letters, triples = n["lower"] + n["upper"], [tuple(words[i : i + 3]) for i in range(count - 2)]
    ends = sum(k in ("symbol", "shout") and (i + 1 == size or kinds[i + 1] in ("space", "line")) for i, k in enumerate(kinds))
    return {
        "symbols": (n["symbol"] + n["shout"] + n["bar"]) / size, "decorated": ends / count, "bars": n["bar"] / size, "capitals": n["upper"] / letters if letters > 20 else 0.0,
        "repeats": 1 - len(set(triples)) / len(triples) if triples else 0.0, "stutter": sum(a == b for a, b in zip(words, words[1:])) / count, "odd_length": abs((size - n["space"] - n["line"]) / count - 5), "digits": n["digit"] / size,
    }, kinds


def votes(found):
    return tuple("-" if found is None else "j" if found[k] > junk else "g" if found[k] < good else "-" for k, (junk, good) in quality.LABELLERS.items())


def believed(counts):
    """Expectation-maximisation over vote patterns."""
    good = {}
    for v in counts:
        p = (1 + v.count("g")) / (2 + len(v) - v.count("-"))
        good[v] = min(p, 0.4) if "j" in v else max(p, 0.6)
    total = sum(counts.values())
    for _ in range(200):
        table = [[{x: 0.5 + sum(n * (good[v] if side else 1 - good[v]) for v, n in counts.items() if v[j] == x) for x in "jg-"} for j in range(8)] for side in (0, 1)]
        prior = [(sum(n * (good[v] if side else 1 - good[v]) for v, n in counts.items()) + 1) / (total + 2) for side in (0, 1)]
        logs = {v: [math.log(prior[s]) + sum(math.log(table[s][j][v[j]] / sum(table[s][j].values())) for j in range(8)) for s in (0, 1)] for v in counts}
        now = {v: 1 / (1 + math.exp(max(-60, min(60, a - b)))) for v, (a, b) in logs.items()}
        done = max(abs(now[v] - good[v]) for v in counts) < 1e-9
        good = good if done else now
        if done:
            break
    return good


def described(text, found, kinds):
    number = [NAMES.index(k) if k != "symbol" else 8 + ord(c) % 8 for c, k in zip(text, kinds)]
    sums = Counter()
    for size in range(2, 6):
        for i in range(len(number) - size + 1):
            code = 0
            for x in number[i : i + size]:
                code = code << 4 | x
            sums[((code + ((size - 1) << 24)) * 0x9E3779B1 & 0xFFFFFFFF) >> 21] += 1
    total = max(1, sum(sums.values()))
    x = np.zeros(quality.BUCKETS)
    for b, n in sums.items():
        x[b] = math.sqrt(n / total)
    for i, (k, (junk, _)) in enumerate(quality.LABELLERS.items()):
        step = 9 if found is None else int(min(8, 4 * found[k] / junk))
        x[((16 * i + step + 7) * 0x9E3779B1 & 0xFFFFFFFF) >> 21] += 1
    return x


def test_whole_query_against_a_plain_version(spark):
    docs = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    seen = [measured(t) for _, t in docs]
    voted = [votes(f) for f, _ in seen]
    good = believed(Counter(voted))
    x = np.array([described(t, f, k) for (_, t), (f, k) in zip(docs, seen)])
    first = {d: i for i, (d, _) in enumerate(docs)}
    assert len(first) == len(docs)
    # fewer documents than the scorer may learn from, so all teach, a side counting as much as it has documents
    y = np.array([good[v] for v in voted])
    order = np.argsort([d for d, _ in docs])
    taught, labels = x[order].astype(np.float16).astype(float), y[order]
    w, look = np.zeros(quality.BUCKETS + 1), np.zeros(quality.BUCKETS + 1)
    taught = np.c_[taught, np.ones(len(taught))]
    rate = 4 / np.mean((taught**2).sum(1))
    for t in range(400):
        p = 1 / (1 + np.exp(-np.clip(taught @ look, -30, 30)))
        step = look - rate * (taught.T @ (p - labels) / len(labels) + 1e-4 * look)
        look, w = step + t / (t + 3) * (step - w), step
    want = {d: 0.0 if f is None else 1 / (1 + math.exp(-float(v @ w[:-1] + w[-1]))) for (d, _), (f, _), v in zip(docs, seen, x)}
    for r in QUERIES["op3_quality"](spark, SF).collect():
        assert abs(r["score"] - want[r["doc_id"]]) < 2e-3, r
        assert r["keep"] == (r["score"] >= 0.2)
