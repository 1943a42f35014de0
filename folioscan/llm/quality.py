"""Quality from weak labels.

Eight heuristic labellers look at each text and vote junk, good, or nothing. How often each pattern of votes occurs is counted over all documents;
expectation-maximisation on these counts (at most 3 ** 8 of them) estimates how reliable each labeller is and gives every pattern a posterior. A
linear scorer over hashed character-shape n-grams learns the posteriors from a sample of at most ``per_class`` documents of either side, and its
score decides for every document.

A document is kept from a score of 0.2 on: short clean texts give little evidence and score near one half, junk scores near 0.
A score of exactly 0.2 is kept. A text without words, null included, scores 0 and is rejected; very long texts are measured whole. Repeated rows are
scored one by one. Columns other than doc_id and text are not looked at. An empty table gives no rows.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscan.llm.common import map_texts, stage

BUCKETS = 1 << 11
SPACE, LOWER, UPPER, DIGIT, LINE, MARK, SHOUT, BAR, SYMBOL = range(9)
JUNK, GOOD, ABSTAIN = range(3)
#: Labellers: a measure of the text, over which value it votes junk, under which it votes good; in between it abstains.
LABELLERS = {"symbols": (0.06, 0.045), "decorated": (0.2, 0.05), "bars": (0.01, 0.002), "capitals": (0.3, 0.15), "repeats": (0.25, 0.08), "stutter": (0.1, 0.03), "odd_length": (1.6, 1.0), "digits": (0.5, 0.1)}
_TABLE: list[np.ndarray] = []


def _classes() -> np.ndarray:
    """Code point -> its class."""
    if not _TABLE:

        def of(c: int) -> int:
            ch = chr(c)
            if ch == "\n":
                return LINE
            if ch.isspace():
                return SPACE
            if ch.isalpha():
                return UPPER if ch.isupper() else LOWER
            if ch.isdigit():
                return DIGIT
            if ch == "!":
                return SHOUT
            if ch == "|":
                return BAR
            return MARK if ch in ".,;:?'\"()-" or c > 127 and unicodedata.category(ch)[0] == "P" else SYMBOL

        _TABLE.append(np.array([of(c) for c in range(0x110000)], np.uint8))
    return _TABLE[0]


def measures(text: str) -> tuple[dict[str, float] | None, np.ndarray]:
    """The labellers' measures of a text, None if it has no words; and its characters' shapes, 4 bits each."""
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
    kinds = _classes()[codes]
    n, words = np.bincount(kinds, minlength=9).tolist(), text.split()
    shapes = np.where(kinds < SYMBOL, kinds, 8 + (codes & 7)).astype(np.uint32)
    if not words:
        return None, shapes
    size, letters, count = len(codes), n[LOWER] + n[UPPER], len(words)
    loud = (kinds == SYMBOL) | (kinds == SHOUT)
    ends = np.count_nonzero(loud[:-1] & (kinds[1:] <= LINE) & ((kinds[1:] == SPACE) | (kinds[1:] == LINE))) + bool(loud[-1])
    triples = max(1, count - 2)
    return {
        "symbols": (n[SYMBOL] + n[SHOUT] + n[BAR]) / size,
        "decorated": ends / count,
        "bars": n[BAR] / size,
        "capitals": n[UPPER] / letters if letters > 20 else 0.0,
        "repeats": 1 - len(set(zip(words, words[1:], words[2:], strict=False))) / triples if count > 2 else 0.0,
        "stutter": sum(map(str.__eq__, words, words[1:])) / count,
        "odd_length": abs((size - n[SPACE] - n[LINE]) / count - 5.0),
        "digits": n[DIGIT] / size,
    }, shapes


def pattern(found: dict[str, float] | None) -> int:
    """The votes as one number in base 3."""
    code = 0
    for name, (junk, good) in LABELLERS.items():
        code = 3 * code + (ABSTAIN if found is None else JUNK if found[name] > junk else GOOD if found[name] < good else ABSTAIN)
    return code


def _votes(code: int) -> list[int]:
    return [code // 3**i % 3 for i in range(len(LABELLERS) - 1, -1, -1)]


def posteriors(counts: dict[int, int], rounds: int = 200) -> dict[int, float]:
    """Probability of good for each vote pattern, by expectation-maximisation; labellers are taken as independent given the class."""
    if not counts:
        return {}
    codes = list(counts)
    votes, n = np.array([_votes(c) for c in codes]), np.array([counts[c] for c in codes], float)
    good = (1 + (votes == GOOD).sum(1)) / (2 + (votes != ABSTAIN).sum(1))
    good = np.where((votes == JUNK).any(1), np.minimum(good, 0.4), np.maximum(good, 0.6))
    for _ in range(rounds):
        share = np.stack([1 - good, good]) * n
        prior = (share.sum(1) + 1) / (n.sum() + 2)
        logs = np.log(prior)[:, None] + np.zeros((2, len(codes)))
        for j in range(votes.shape[1]):
            table = np.stack([share[:, votes[:, j] == v].sum(1) for v in range(3)], 1) + 0.5
            logs += np.log(table / table.sum(1, keepdims=True))[:, votes[:, j]]
        now = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -60, 60)))
        if np.abs(now - good).max() < 1e-9:
            break
        good = now
    return dict(zip(codes, good.tolist(), strict=True))


def features(found: dict[str, float] | None, shapes: np.ndarray) -> np.ndarray:
    """Hashed shape n-grams of two to five characters, as square roots of their shares, and the measures in steps."""
    out = np.zeros(BUCKETS, np.float32)
    code = shapes
    for k in range(1, 5):
        if len(shapes) <= k:
            break
        code = (code[:-1] << np.uint32(4)) | shapes[k:]
        hashed = ((code + np.uint32(k << 24)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - 11)
        out += np.bincount(hashed, minlength=BUCKETS).astype(np.float32)
    out = np.sqrt(out / max(1.0, float(out.sum())))
    for i, (name, (junk, good)) in enumerate(LABELLERS.items()):
        step = 9 if found is None else int(min(8, 4 * found[name] / junk))
        out[((i * 16 + step + 7) * 0x9E3779B1 & 0xFFFFFFFF) >> 21] += 1.0
    return out


@dataclass
class Model:
    weights: np.ndarray
    bias: float


def fit(x: np.ndarray, good: np.ndarray, weight: np.ndarray, rounds: int = 400, ridge: float = 1e-4) -> Model:
    """Logistic regression on soft labels, by accelerated gradient descent."""
    x = np.c_[x, np.ones(len(x), np.float32)].astype(np.float64)  # as the weights: mixed kinds would be cast anew in every round
    w = look = np.zeros(x.shape[1])
    rate = 4 / (np.mean((x**2).sum(1)) + 1e-9)
    for t in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ look, -30, 30)))
        step = look - rate * (x.T @ ((p - good) * weight) / max(weight.sum(), 1e-9) + ridge * look)
        look, w = step + t / (t + 3) * (step - w), step
    return Model(w[:-1].astype(np.float32), float(w[-1]))


def train(docs: DataFrame, per_class: int = 2000) -> Model:
    """Votes are counted over all of ``docs``; the scorer is fitted on at most ``per_class`` documents of either side, those with the least hash of their id.

    Rows that repeat an id and its text are one document and vote once; unlike texts with one id are different documents. Of copies under many ids each votes, but
    a text is learned once, under its least id.
    """

    def vote(texts: list[str]) -> list:
        return [[pattern(measures(t)[0]) for t in texts]]

    def described(texts: list[str]) -> list:
        return [[features(*measures(t)).astype(np.float16).tobytes() for t in texts]]

    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("print"))
    voted = stage(map_texts(docs, lambda: vote, "votes int", ("doc_id", "print")).distinct(), "votes")
    counts = {r["votes"]: r["n"] for r in voted.groupBy("votes").agg(F.count("*").alias("n")).collect()}  # at most 3 ** 8 rows
    good = posteriors(counts)
    if not good:
        return Model(np.zeros(BUCKETS, np.float32), 0.0)
    sides = voted.sparkSession.createDataFrame(list(good.items()), "votes int, good double")
    judged = voted.where("doc_id is not null").groupBy("print").agg(F.min("doc_id").alias("doc_id"), F.min("votes").alias("votes")).join(F.broadcast(sides), "votes")  # a row per vote pattern
    some = [judged.where(side).orderBy(F.xxhash64("doc_id"), "doc_id", "print").limit(per_class) for side in ("good >= 0.5", "good < 0.5")]
    chosen = stage(some[0].union(some[1]).select("doc_id", "print", "good"), "chosen")
    texts = docs.join(F.broadcast(chosen), ["doc_id", "print"]).groupBy("doc_id", "print", "good").agg(F.min("text").alias("text"))  # per_class rows a side
    rows = map_texts(texts, lambda: described, "x binary", ("doc_id", "print", "good")).orderBy("doc_id", "print").collect()
    if not rows:
        return Model(np.zeros(BUCKETS, np.float32), 0.0)
    x = np.stack([np.frombuffer(r["x"], np.float16) for r in rows]).astype(np.float32)
    y = np.array([r["good"] for r in rows])
    # a side's weight is its share of all documents, whatever its share of the sample
    total = {side: sum(n for c, n in counts.items() if (good[c] >= 0.5) == side) for side in (False, True)}
    weight = np.where(y >= 0.5, total[True] / max(1, (y >= 0.5).sum()), total[False] / max(1, (y < 0.5).sum()))
    return fit(x, y, weight / weight.max())


def _scorer(model: Model):
    def run(texts: list[str]) -> list:
        found = [measures(t) for t in texts]
        x = np.stack([features(*f) for f in found])
        p = 1 / (1 + np.exp(-np.clip(x @ model.weights + model.bias, -60, 60).astype(np.float64)))
        return [np.where([f[0] is None for f in found], 0.0, p)]

    return run


def score(docs: DataFrame, model: Model, threshold: float = 0.2) -> DataFrame:
    """doc_id, score (probability of good) and keep of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return map_texts(docs, lambda: _scorer(shared.value), "score double").withColumn("keep", F.col("score") >= threshold)


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.2) -> DataFrame:
    """The rows of ``docs`` whose text scores ``threshold`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.DoubleType())
    def value(texts: pd.Series) -> pd.Series:
        run, given = _scorer(shared.value), [t or "" for t in texts]
        return pd.Series(np.concatenate([np.empty(0), *(run(given[i : i + 256])[0] for i in range(0, len(given), 256))]))

    return docs.where(value("text") >= threshold)
