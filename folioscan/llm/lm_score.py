"""Masked pseudo-likelihood of documents.

A word is predicted from the ``REACH`` words on either side of it by a small network: embeddings of the neighbours, one hidden layer, a softmax over
the vocabulary. The vocabulary is the most frequent words of all documents; other words fall into classes, which are learned: words are put in ``ENDINGS``
buckets by the hash of their last three letters, all documents are counted for which of ``NEAR`` buckets of words follow each within ``REACH`` places, and buckets that
are followed alike become a class, by splitting the heaviest class in two until there are ``CLASSES``. So a class says which words go together, a language for one.
All other words of all documents are counted as well, so that a word's probability is that of its class times that of the word given its class: its
count and ``UNSEEN`` among those of the class, in which all words that occur in no document are one word more, of count 0. That table is as large as
the corpus makes it: the ``HEAD`` most frequent of its words go to every task, occurrences of the others are joined to it on Spark.
Training is spread over Spark: every document is trained on once over the rounds, each round taking a part of all documents by the hash of id and text,
so that copies of a text are spread over the rounds. In a document the words at a ``MASKED`` share of its places, drawn anew for each, are hidden and
predicted, all others are context. In a round each task improves the shared weights on its own documents, and the weights are averaged by words
predicted; the weights therefore depend a little on how the table is cut into tasks, but a task that runs again learns the same. A document's score
is the sum of the log-probabilities of all its words, each given both sides; without the table of other words, those of their classes alone.

Words are what ``str.lower().split()`` gives, here and in every count. A text without words, null included, has 0 tokens, a log-probability of 0 and no
mean; very long texts are scored whole. Repeated rows are scored one by one; null or repeated ids make no difference, and columns other than doc_id and
text are not looked at. Of words equally frequent the alphabetically first come first. An empty table gives no rows; with no words at all, there is
nothing to learn and the first weights stay.
"""

from __future__ import annotations

import math
import zlib
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscan.llm.common import map_texts, stage

REACH, VOCAB, CLASSES, WIDTH, HIDDEN, ROUNDS = 2, 256, 64, 16, 32, 3
HEAD, UNSEEN, MASKED = 1 << 18, 0.5, 0.2
ENDINGS, NEAR, PRIOR = 4096, 64, 20.0
PAD = 0  # stands outside a document and is never predicted
SHAPES = ((VOCAB, WIDTH), (2 * REACH * WIDTH, HIDDEN), (HIDDEN,), (HIDDEN, VOCAB), (VOCAB,))


def unpack(flat: np.ndarray) -> list[np.ndarray]:
    out, at = [], 0
    for shape in SHAPES:
        n = int(np.prod(shape))
        out.append(flat[at : at + n].reshape(shape))
        at += n
    return out


def first_weights(seed: int = 11) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return np.concatenate([(rng.normal(0, 1 / np.sqrt(s[0]), s) if len(s) > 1 else np.zeros(s)).ravel() for s in SHAPES]).astype(np.float32)


def ending(word: str) -> int:
    return zlib.crc32(word[-3:].encode()) % ENDINGS


@dataclass
class Model:
    """The frequent words, the network, and the class of each bucket of endings; before they are learned, classes are by the hash alone."""

    words: list[str]
    weights: np.ndarray
    classes: np.ndarray = field(default_factory=lambda: np.arange(ENDINGS) % CLASSES)

    def coder(self) -> Callable[[str], np.ndarray]:
        """text -> token ids: 1.. for the frequent words, then the classes."""
        codes = Codes(self)
        return lambda text: codes.of([text.lower().split()])[0]


class Codes(dict):
    """Numbers for words as they come, with the token id of each and, with ``head``, its log-probability given its class: 0 for frequent words, NaN for words not in it.

    More than ``most`` words are forgotten before the next texts.
    """

    def __init__(self, model: Model, head: dict[str, float] | None = None, most: int = 1 << 19) -> None:
        super().__init__()
        self.model, self.head, self.most, self.classes = model, head, most, model.classes.tolist()
        self._start()

    def _start(self) -> None:
        self.clear()
        self.update({w: k for k, w in enumerate(self.model.words)})
        self.ids, self.given = array("i", range(1, len(self) + 1)), array("d", bytes(8 * len(self)))

    def __missing__(self, word: str) -> int:
        k = self[word] = len(self.ids)
        self.ids.append(VOCAB - CLASSES + self.classes[ending(word)])
        self.given.append(0.0 if self.head is None else self.head.get(word, math.nan))
        return k

    def of(self, said: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of the words of some texts, one text after the other, and the log-probabilities given their classes."""
        if len(self) > self.most:
            self._start()
        k = np.fromiter(map(self.__getitem__, chain.from_iterable(said)), np.int64, sum(map(len, said)))
        return np.array(self.ids, np.int32)[k], np.array(self.given)[k]


def lined_up(coded: list[np.ndarray]) -> np.ndarray:
    """Documents in one line with pads between them."""
    pad = np.full(REACH, PAD, np.int32)
    return np.concatenate([pad, *(x for c in coded for x in (c, pad))])


def spread(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """What ``lined_up`` gives, of the ids of all documents and their sizes."""
    out = np.full(len(ids) + REACH * (len(sizes) + 1), PAD, np.int32)
    out[np.arange(len(ids)) + REACH * np.repeat(np.arange(1, len(sizes) + 1), sizes)] = ids
    return out


def _forward(ids: np.ndarray, at: np.ndarray, weights: list[np.ndarray], small: bool = False) -> tuple[np.ndarray, ...]:
    emb, w1, b1, w2, b2 = weights
    sides = np.stack([ids[at + d] for d in range(-REACH, REACH + 1) if d], 1)
    x = emb[sides].reshape(len(at), -1)
    h = np.tanh(x @ w1 + b1)
    z = h @ w2
    z += b2
    if not small:
        z -= z.max(1, keepdims=True)
    return sides, x, h, z


def log_probs(ids: np.ndarray, at: np.ndarray, weights: list[np.ndarray], batch: int = 1024) -> np.ndarray:
    """Log-probability of the word at each place given its neighbours."""
    out = np.empty(len(at))
    small = float(np.abs(weights[3]).sum(0).max() + np.abs(weights[4]).max()) < 60  # no sum can leave the range of exp
    for i in range(0, len(at), batch):
        own = at[i : i + batch]
        *_, z = _forward(ids, own, weights, small)
        out[i : i + batch] = z[np.arange(len(own)), ids[own]]
        np.exp(z, out=z)
        out[i : i + batch] -= np.log(z.sum(1))
    return out


def improve(flat: np.ndarray, ids: np.ndarray, rng: np.random.Generator, rate: float, batch: int = 128, masked: float = 1.0) -> int:
    """Stochastic gradient descent over a line of documents, in place, a share ``masked`` of the places in random order; how many."""
    emb, w1, b1, w2, b2 = weights = unpack(flat)
    at = np.flatnonzero(ids != PAD)
    at = rng.permutation(at[rng.random(len(at)) < masked])
    for i in range(0, len(at), batch):
        own = at[i : i + batch]
        sides, x, h, z = _forward(ids, own, weights)
        p = np.exp(z)
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(own)), ids[own]] -= 1
        p *= rate / len(own)
        back = (p @ w2.T) * (1 - h * h)
        down = (back @ w1.T).reshape(len(own), 2 * REACH, WIDTH)
        w2 -= h.T @ p
        b2 -= p.sum(0)
        w1 -= x.T @ back
        b1 -= back.sum(0)
        np.subtract.at(emb, sides, down)
    return len(at)


@dataclass
class Others:
    """Log-probabilities of the words outside the vocabulary given their classes: ``head`` and ``tail`` (w, given) of seen ones, ``unseen`` by class."""

    head: dict[str, float]
    tail: DataFrame
    unseen: list[float]


class _Numbers(dict):
    """Numbers from 1 on for words, as they come; of each its ending's bucket and its own among neighbours, from 1 on."""

    def __init__(self) -> None:
        super().__init__()
        self.endings, self.near = array("i", [0]), array("i", [0])

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self) + 1
        self.endings.append(1 + ending(word))
        self.near.append(1 + zlib.crc32(word.encode()) % NEAR)
        return n


def _counted(batches: Iterator[pa.RecordBatch], most: int = 1 << 19, at_once: int = 1024) -> Iterator[pa.RecordBatch]:
    """Counts of words, handed on whenever more than ``most`` different ones are held, and at the end counts of endings by words behind them."""
    known, seen, side = _Numbers(), np.zeros(1, np.int64), NEAR + 1
    cells = np.zeros((ENDINGS + 1) * side, np.int64)

    def told() -> pa.RecordBatch:
        n = np.zeros(len(known), np.int64)
        n[: len(seen) - 1] = seen[1:]
        return pa.RecordBatch.from_arrays([pa.array(known.keys(), pa.string()), pa.nulls(len(known), pa.int32()), pa.array(n)], names=["w", "cell", "n"])

    for batch in batches:
        for i in range(0, batch.num_rows, at_once):
            said = [(t or "").lower().split() for t in batch.column(0).slice(i, at_once).to_pylist()]
            sizes = np.array([len(w) for w in said])
            ids = spread(np.fromiter(map(known.__getitem__, chain.from_iterable(said)), np.int64, sizes.sum()), sizes)
            now = np.bincount(ids, minlength=len(known) + 1)
            now[: len(seen)] += seen
            seen = now
            rows, columns = (np.array(known.endings) * side)[ids], np.array(known.near)[ids]
            for d in range(1, REACH + 1):
                cells += np.bincount(rows[:-d] + columns[d:], minlength=len(cells))
            if len(known) > most:
                yield told()
                known, seen = _Numbers(), np.zeros(1, np.int64)
    if known:
        seen[0] = 0
        yield told()
    table = cells.reshape(-1, side)[1:, 1:].ravel()
    some = np.flatnonzero(table)
    if len(some):
        yield pa.RecordBatch.from_arrays([pa.nulls(len(some), pa.string()), pa.array(some, pa.int32()), pa.array(table[some])], names=["w", "cell", "n"])


def gather(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(w, n): how often each word of all documents occurs; (cell, n): how often a bucket of words follows an ending's bucket. Staged together."""
    counted = docs.select("text").mapInArrow(_counted, "w string, cell int, n long")
    whole = stage(counted.groupBy("w", "cell").agg(F.sum("n").alias("n")), "words")
    return whole.where("w is not null").select("w", "n"), whole.where("cell is not null").select("cell", "n")


def count_words(docs: DataFrame) -> DataFrame:
    return gather(docs)[0]


def learned_classes(cells: DataFrame) -> np.ndarray:
    """The class of each bucket of endings: buckets that are followed alike together."""
    table = np.zeros(ENDINGS * NEAR)
    for r in cells.collect():  # at most ENDINGS * NEAR numbers
        table[r["cell"]] = r["n"]
    table = table.reshape(ENDINGS, NEAR)
    if not table.any():
        return np.arange(ENDINGS) % CLASSES
    weight, share = table.sum(1) + 1e-9, table.sum(0) / table.sum()
    # square roots of shares, so that plain distances tell how unlike two buckets are; few occurrences count as the average
    x = np.sqrt((table + PRIOR * share) / (table.sum(1, keepdims=True) + PRIOR)) - np.sqrt(share)
    groups = [np.arange(ENDINGS)]
    while len(groups) < CLASSES:
        own = groups.pop(max(range(len(groups)), key=lambda i: weight[groups[i]].sum() if len(groups[i]) > 1 else -1.0))
        w = weight[own]
        z = x[own] - np.average(x[own], axis=0, weights=w)
        way = np.linalg.eigh((z * w[:, None]).T @ z)[1][:, -1]
        along = z @ (way * np.sign(way[np.argmax(np.abs(way))]))
        order = np.argsort(along, kind="stable")
        # where two parts are furthest from each other for their weight
        sums, ws = np.cumsum((along * w)[order]), np.cumsum(w[order])
        gain = sums[:-1] ** 2 / ws[:-1] + (sums[-1] - sums[:-1]) ** 2 / (ws[-1] - ws[:-1])
        cut = int(np.argmax(gain)) + 1
        groups += [own[order[:cut]], own[order[cut:]]]
    out = np.zeros(ENDINGS, np.int64)
    for k, own in enumerate(groups):
        out[own] = k
    return out


def vocabulary(counts: DataFrame, size: int = VOCAB - CLASSES - 1) -> list[str]:
    """The ``size`` most frequent words."""
    return [r["w"] for r in _frequent(counts, size).orderBy(F.desc("n"), "w").limit(size).collect()]


def _frequent(table: DataFrame, most: int) -> DataFrame:
    """The rows among which the ``most`` frequent words are, and few others: every task would send as many to the driver.

    Counts are put in eighths of a power of two, so the driver sees some hundred sums.
    """
    step = F.floor(8 * F.log2("n")).cast("int")
    sums, seen = sorted(((r["k"], r["m"]) for r in table.groupBy(step.alias("k")).agg(F.count("*").alias("m")).collect()), reverse=True), 0
    for k, m in sums:
        seen += m
        if seen >= most:
            return table.where(step >= k)
    return table


def _class(word: Column, model: Model) -> Column:
    bucket = F.pmod(F.crc32(F.encode(F.right(word, F.lit(3)), "utf-8")), F.lit(ENDINGS)).cast("int")
    return F.get(F.expr(f"array({', '.join(map(str, model.classes.tolist()))})"), bucket)


def other_words(counts: DataFrame, model: Model, head: int = HEAD) -> Others:
    """The table of all counted words that ``model`` knows by their class only."""
    rest = counts.where(~F.col("w").isin(model.words)).withColumn("c", _class(F.col("w"), model))
    totals = {r["c"]: r["n"] + UNSEEN * (r["v"] + 1) for r in rest.groupBy("c").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}  # CLASSES rows
    totals = [math.log(totals.get(c, UNSEEN)) for c in range(CLASSES)]
    table = rest.select("w", "n", (F.log(F.col("n") + UNSEEN) - F.get(F.array(*map(F.lit, totals)), F.col("c"))).alias("given"))
    first = _frequent(table, head).orderBy(F.desc("n"), "w").limit(head).select("w", "n", "given").collect()  # ``head`` rows
    tail = table.where("false")
    if len(first) == head:
        n, w = (first[-1]["n"], first[-1]["w"]) if first else (None, None)
        tail = table if n is None else table.where((F.col("n") < n) | ((F.col("n") == n) & (F.col("w") > w)))
    return Others({r["w"]: r["given"] for r in first}, tail.select("w", "given"), [math.log(UNSEEN) - t for t in totals])


def start(counts: DataFrame, cells: DataFrame) -> Model:
    """Vocabulary and classes of what ``gather`` has found, with the first weights."""
    return Model(vocabulary(counts), first_weights(), learned_classes(cells))


def encode(docs: DataFrame, model: Model, others: Others | None = None) -> DataFrame:
    """Every row as doc_id, row (its number), print (a hash of id and text), n_tokens, ids (a byte a word), given and rest, staged: words are cut and looked up once, for training and scoring.

    ``given`` sums the log-probabilities given their classes of the words that go to every task, ``rest`` are words that are to be joined.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model, None if others is None else others.head))  # as large for any input

    def make() -> Callable[[list[str]], list]:
        codes, head = Codes(*shared.value), shared.value[1]

        def run(texts: list[str]) -> list:
            said = [t.lower().split() for t in texts]
            ids, given = codes.of(said)
            sizes = np.array([len(w) for w in said], np.int64)
            ends, raw, far = np.cumsum(sizes), ids.astype(np.uint8).tobytes(), np.isnan(given) & (head is not None)
            sums = np.r_[0.0, np.cumsum(np.nan_to_num(given))]
            words, at = list(chain.from_iterable(said)), np.flatnonzero(far)
            cuts = np.searchsorted(at, np.r_[0, ends])
            rest = [[words[i] for i in at[s:e].tolist()] for s, e in zip(cuts, cuts[1:], strict=False)]
            return [sizes, [raw[e - n : e] for n, e in zip(sizes.tolist(), ends.tolist(), strict=True)], sums[ends] - sums[ends - sizes], rest]

        return run

    named = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.xxhash64("doc_id", "text").alias("print"), "text")
    return stage(map_texts(named, make, "n_tokens long, ids binary, given double, rest array<string>", ("doc_id", "row", "print"), rows=64), "encoded")


def _line(ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A line of coded documents with pads between them, and their sizes."""
    ids = ids.cast(pa.binary())
    _, offsets, data = ids.buffers()
    cuts = np.frombuffer(offsets, np.int32)[ids.offset : ids.offset + len(ids) + 1]
    flat = np.frombuffer(data, np.uint8)[cuts[0] : cuts[-1]] if data is not None and len(ids) else np.empty(0, np.uint8)
    return spread(flat, np.diff(cuts).astype(np.int64)), np.diff(cuts).astype(np.int64)


def _round(batches: Iterator[pa.RecordBatch], model: Model, rate: float, seed: int) -> Iterator[pa.RecordBatch]:
    flat, seen, rng = model.weights.copy(), 0, np.random.default_rng(seed)
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            seen += improve(flat, _line(batch.column(0).slice(i, 256))[0], rng, rate, masked=MASKED)
    if seen:
        yield pa.RecordBatch.from_arrays([pa.array([seen], pa.int64()), pa.array([flat], pa.list_(pa.float32()))], names=["seen", "w"])


def training_part(docs: DataFrame, k: int, one_in: int) -> DataFrame:
    """The documents of round ``k``: one in ``one_in``, other ones in each of as many rounds."""
    name = F.col("print") if "print" in docs.columns else F.xxhash64("doc_id", "text")
    return docs.where(F.pmod(name, F.lit(one_in)) == k % one_in)


def learn(coded: DataFrame, model: Model, rounds: int = ROUNDS, one_in: int = ROUNDS, rate: float = 0.5) -> Model:
    """The model with weights learned from encoded documents, by averaging what every task learns, round after round."""
    sc = coded.sparkSession.sparkContext
    for k in range(rounds):
        shared = sc.broadcast(model)
        learned = training_part(coded, k, one_in).select("ids").mapInArrow(lambda b, k=k, shared=shared: _round(b, shared.value, rate / (1 + k), k), "seen long, w array<float>")
        each = learned.select("seen", F.posexplode("w").alias("i", "v"))
        mean = each.groupBy("i").agg((F.sum(F.col("v").cast("double") * F.col("seen")) / F.sum("seen")).cast("float").alias("v")).orderBy("i").collect()  # one row per weight
        if mean:
            model = Model(model.words, np.array([r["v"] for r in mean], np.float32), model.classes)
    return model


def train(docs: DataFrame, rounds: int = ROUNDS, one_in: int = ROUNDS, rate: float = 0.5, counts: DataFrame | None = None, cells: DataFrame | None = None) -> Model:
    """A model of all documents: their words and classes, or what ``gather`` has found, and then the weights."""
    if counts is None or cells is None:
        counts, cells = gather(docs)
    model = start(counts, cells)
    return learn(encode(docs, model), model, rounds, one_in, rate)


def score_encoded(coded: DataFrame, model: Model, others: Others | None = None) -> DataFrame:
    """``score`` of documents that were encoded with the same words, classes and table of other words."""
    from pyspark.sql.pandas.types import to_arrow_schema

    shared = coded.sparkSession.sparkContext.broadcast(model.weights)  # as large for any input
    shape = T.StructType([coded.schema["doc_id"], *T.StructType.fromDDL("row long, n_tokens long, log_prob double")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, schema = unpack(shared.value), to_arrow_schema(shape)
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                ids, sizes = _line(part.column(4))
                ends = np.cumsum(sizes)
                sums = np.r_[0.0, np.cumsum(log_probs(ids, np.flatnonzero(ids != PAD), weights))]
                total = sums[ends] - sums[ends - sizes] + part.column(3).to_numpy()
                yield pa.RecordBatch.from_arrays([part.column(0).cast(schema.field(0).type), part.column(1), part.column(2), pa.array(total)], schema=schema)

    found = coded.select("doc_id", "row", "n_tokens", "given", "ids").mapInArrow(run, shape)
    if others is not None:
        unseen = F.get(F.array(*map(F.lit, others.unseen)), _class(F.col("w"), model))
        each = coded.select("row", F.explode("rest").alias("w")).join(others.tail, "w", "left").select("row", F.coalesce("given", unseen).alias("given"))
        more = each.groupBy("row").agg(F.sum("given").alias("more"))
        found = found.join(more, "row", "left").withColumn("log_prob", F.col("log_prob") + F.coalesce("more", F.lit(0.0)))
    mean = F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens"))
    return found.select("doc_id", "n_tokens", "log_prob").withColumn("per_token", mean).withColumn("perplexity", F.exp(-mean))


def score(docs: DataFrame, model: Model, others: Others | None = None) -> DataFrame:
    """doc_id, n_tokens, log_prob (sum over its words), per_token and perplexity of every row."""
    return score_encoded(encode(docs, model, others), model, others)
