"""Language identification with string kernels.

The kernel of two texts is the number of character n-grams (all lengths from one to ``ORDERS``, a blended spectrum) that occur in both, presence
only, over the geometric mean of their own numbers. N-grams are kept as hashed bits, so a text is one row of 0 and 1. Landmark texts give Nyström
features, a ridge regression of each language against the rest is fitted on them, and both fold into one matrix: whole batches of texts are scored
by one matrix product.

Letters are lower-cased, every run of other characters counts as one space. A text that is null or has no letters is ``und`` with score 0, and so
is every text if there is nothing to learn from, as with an empty table. Repeated rows are scored one by one; on a tie the language first in alphabetical
order wins. Very long texts are read whole, piece by piece. Columns other than doc_id, text and lang are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscan.llm.common import map_texts, stage

ORDERS, BUCKET_BITS = 4, 16
_FOLD: list[np.ndarray] = []


def _fold() -> np.ndarray:
    """Code point -> code point of its lower-case letter, or of a space."""
    if not _FOLD:
        _FOLD.append(np.array([ord(chr(c).lower()[0]) if chr(c).isalpha() else 32 for c in range(0x110000)], np.uint32))
    return _FOLD[0]


def presence(text: str, row: np.ndarray, piece: int = 1 << 18) -> bool:
    """Set the bits of a text's n-grams in ``row``; False if it has no letters. Long texts are taken piece by piece."""
    letters, fold, space = False, _fold(), np.array([32], np.uint32)
    carry = space
    for i in range(0, max(1, len(text)), piece):
        codes = fold[np.frombuffer(text[i : i + piece].encode("utf-32-le"), "<u4")]
        gap = codes == 32
        letters |= not gap.all()
        codes = codes[~(gap & np.r_[carry[-1] == 32, gap[:-1]][: len(gap)])]
        codes = np.concatenate((carry, codes, space if i + piece >= len(text) else space[:0]))
        carry = codes[1 - ORDERS :]
        h = np.zeros(len(codes), np.uint32)
        for n in range(1, min(ORDERS, len(codes)) + 1):
            h = h[: len(codes) - n + 1] * np.uint32(0x01000193) + codes[n - 1 :] + np.uint32(n << 24)
            m = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            row[m >> np.uint32(32 - BUCKET_BITS)] = 1
    return letters


@dataclass
class Model:
    """Languages, and for each bucket and language the weight of its presence."""

    langs: list[str]
    weights: np.ndarray


def held_out(doc_id: Column) -> Column:
    """True for the fifth of documents that is never learned from, rows without an id included."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def _blocks(packed: list[bytes], rows: int = 128) -> Iterator[np.ndarray]:
    """Presence rows of unit length, some at a time."""
    for i in range(0, len(packed), rows):
        x = np.unpackbits(np.frombuffer(b"".join(packed[i : i + rows]), np.uint8)).reshape(-1, 1 << BUCKET_BITS).astype(np.float32)
        yield x / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))


def fit(packed: list[bytes], langs: list[str], landmarks: int = 256, ridge: float = 1e-2) -> Model:
    """Kernel ridge regression on Nyström features; ``packed`` are presence rows as bits, and of each language the same share are landmarks."""
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros((1 << BUCKET_BITS, 0), np.float32))
    order = np.random.default_rng(7).permutation(len(packed))
    by_lang = [[i for i in order if langs[i] == n] for n in names]
    z = np.concatenate(list(_blocks([packed[i] for group in by_lang for i in group[: max(1, landmarks // len(names))]])))
    value, vector = np.linalg.eigh((z @ z.T).astype(np.float64))
    good = value > 1e-6 * value.max()
    to_feature = vector[:, good] / np.sqrt(value[good])
    phi = np.concatenate([(x @ z.T).astype(np.float64) @ to_feature for x in _blocks(packed)])
    y = np.where(np.array(langs)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    # each class counts the same, whatever its share of the sample
    share = sum(np.where(np.array(langs) == n, len(langs) / (len(names) * langs.count(n)), 0.0) for n in names)[:, None]
    w = np.linalg.solve(phi.T @ (phi * share) + ridge * len(packed) / 100 * np.eye(phi.shape[1]), phi.T @ (y * share))
    return Model(names, (z.T @ (to_feature @ w)).astype(np.float32))


def _bits(texts: list[str]) -> list[list]:
    out = []
    for text in texts:
        row = np.zeros(1 << BUCKET_BITS, np.uint8)
        presence(text, row)
        out.append(np.packbits(row).tobytes())
    return [out]


def train(docs: DataFrame, per_lang: int = 400, landmarks: int = 256, ridge: float = 1e-2, most_langs: int = 64) -> Model:
    """A model of at most ``per_lang`` documents of each language, those with the least hash of their id, of the part that may be learned from.

    A text of one language is learned once, under its least id, however often it is repeated: shares and samples are those of different texts. With more than
    ``most_langs`` languages the share of each falls, so that the driver is sent ``per_lang * most_langs`` rows of 8 KB at most.
    """
    may = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).withColumn("print", F.xxhash64("text")).select("doc_id", "lang", "text", "print")
    once = stage(may.groupBy("lang", "print").agg(F.min("doc_id").alias("doc_id")), "once")
    # a share of each language that holds about three times as many, so that what meets in a language's window is as small for any input
    sizes = stage(once.groupBy("lang").agg(F.count("*").alias("size")), "sizes")
    per_lang = max(1, min(per_lang, per_lang * most_langs // max(1, sizes.count())))
    share = F.shiftrightunsigned(F.xxhash64("doc_id"), 32) < F.lit(3.0 * per_lang * 2**32) / F.col("size")
    some = once.join(F.broadcast(sizes), "lang").where(share)  # a row per language, as the model has a column per language
    first = W.partitionBy("lang").orderBy(F.shiftrightunsigned(F.xxhash64("doc_id"), 32), "doc_id", "print")
    chosen = stage(some.withColumn("n", F.row_number().over(first)).where(F.col("n") <= per_lang).select("doc_id", "lang", "print"), "chosen")
    texts = may.join(F.broadcast(chosen), ["doc_id", "lang", "print"], "left_semi")  # per_lang rows a language
    # a chosen text that is repeated under its id very often meets once a task here, and once at all after that
    texts = texts.groupBy("doc_id", "lang", "print").agg(F.min("text").alias("text"))
    rows = map_texts(texts, lambda: _bits, "bits binary", ("doc_id", "lang", "print")).orderBy("lang", "doc_id", "print").collect()
    return fit([r["bits"] for r in rows], [r["lang"] for r in rows], landmarks, ridge)


def score(texts: list[str], model: Model) -> tuple[list[str], np.ndarray]:
    """Languages and scores of a batch of texts."""
    rows = np.zeros((len(texts), 1 << BUCKET_BITS), np.uint8)
    real = np.array([presence(t, r) for t, r in zip(texts, rows, strict=True)], bool)
    if not model.langs:
        return ["und"] * len(texts), np.zeros(len(texts))
    size = np.sqrt(np.maximum(rows.sum(1, dtype=np.int64), 1))
    margins = (rows.astype(np.float32) @ model.weights) / size[:, None]
    odds = np.exp(4 * (margins - margins.max(1, keepdims=True)))
    best = margins.argmax(1)
    sure = odds[np.arange(len(texts)), best] / odds.sum(1)
    return [model.langs[b] if ok else "und" for b, ok in zip(best, real, strict=True)], np.where(real, sure, 0.0).astype(np.float64)


def predict(docs: DataFrame, model: Model, batch: int = 64) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row; only the text is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one weight per bucket and language

    found = map_texts(docs, lambda: lambda texts: score(texts, shared.value), "lang_pred string, score double", rows=batch)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
