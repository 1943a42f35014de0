"""Benchmark passages in documents.

Texts are lower-cased words; their shingles of five words are hashed, repeats included. Of each benchmark item the SimHash of its shingles is kept,
cut into ``BLOCKS`` blocks: two fingerprints within ``RADIUS`` bits differ in at most RADIUS // BLOCKS bits of one block at least, so looking up a
fingerprint's blocks with every choice of so many bits flipped proposes every item within the radius. Documents are looked at in windows as long as each
item. A window that shares too few shingles with all items of its size to reach the threshold cannot match any of them and gets no fingerprint; the others
are looked up, and what is within the radius is compared exactly: the weighted Jaccard similarity of window and item, a shingle weighing as often as it
occurs. A document of fewer shingles than an item is its one window, compared exactly with every longer item that it shares a shingle with and that is
short enough to reach the threshold. Windows of similarity 0.8 and more lie about 10 bits from their item; ``tests/llm`` measure how few lie beyond the radius.

The benchmark is indexed in parts, dealt by hash; a part whose index would be over ``INDEX_BYTES`` is halved until it is not, so what is sent to every
task is bounded. With more than one part, one pass over all documents finds those that share enough shingles with the whole benchmark for any item,
by a bit map of at most ``MAP_BYTES`` (hashes that meet there only keep a document too many), and writes their shingles' hashes. The parts follow one
after the other, each a job over those hashes alone: a task holds one part at a time, and texts are read and cut into words once.

Items of fewer than five words match nothing. A null text is empty; very long texts are looked through whole. Repeated documents are each reported.
Items of equal text are all reported, a row of the benchmark that is repeated once; of equal windows, the first. An empty benchmark or table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscan.llm.common import fresh, map_texts, stage

WORDS, SIMILARITY, RADIUS, BLOCKS, PART_BYTES, INDEX_BYTES, MAP_BYTES = 5, 0.8, 20, 7, 8 << 20, 64 << 20, 32 << 20
_WORD = re.compile(r"\w+")


def shingle_hashes(text: str) -> np.ndarray:
    """Hashes of a text's shingles, in order."""
    words = _WORD.findall(text.lower())
    n = len(words) - WORDS + 1
    if n < 1:
        return np.empty(0, np.uint64)
    own = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    mixed = np.zeros(n, np.uint64)
    for i in range(WORDS):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + own[i : i + n]
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ (mixed >> np.uint64(32))


def window_prints(hashes: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """SimHash of ``size`` shingles from each start."""
    out, first = np.empty(len(starts), np.uint64), 0
    while first < len(starts):  # stretches of starts, so that the running sums stay small
        last = int(np.searchsorted(starts, starts[first] + 4096))
        lo, hi = int(starts[first]), int(starts[last - 1]) + size
        bits = np.unpackbits(hashes[lo:hi].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums = np.zeros((hi - lo + 1, 64), np.int32)
        np.cumsum(bits, axis=0, out=sums[1:])
        at = starts[first:last] - lo
        out[first:last] = np.packbits(2 * (sums[at + size] - sums[at]) > size, axis=1, bitorder="little").view("<u8")[:, 0]
        first = last
    return out


def least_shared(size: int) -> int:
    """Shingles that a window must share with an item of its size: n shared of size each, and n / (2 size - n) must reach the threshold."""
    return math.ceil(2 * size * SIMILARITY / (1 + SIMILARITY) - 1e-9)


def _places(hashes: np.ndarray, at: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Those of the places ``at`` whose hash is among ``known``, which is sorted."""
    return at[known[np.minimum(np.searchsorted(known, hashes[at]), len(known) - 1)] == hashes[at]]


class Index:
    """Fingerprints and shingles of one part of the benchmark."""

    def __init__(self, items: list[tuple[int | None, str | None]]) -> None:
        found = [(i, h) for i, t in items if len(h := shingle_hashes(t or ""))]
        none = np.empty(0, np.uint64)
        self.ids = [i for i, _ in found]
        self.sizes = np.array([len(h) for _, h in found], np.int64)
        self.prints = np.array([window_prints(h, np.array([0]), len(h))[0] for _, h in found], np.uint64)
        bags = [np.unique(h, return_counts=True) for _, h in found]
        # the items' bags of shingles in one line: item i has those from bounds[i] to bounds[i + 1]
        self.bounds = np.cumsum([0, *(len(h) for h, _ in bags)])
        self.bag, self.times = np.concatenate([none, *(h for h, _ in bags)]), np.concatenate([np.empty(0, np.int32), *(n.astype(np.int32) for _, n in bags)])
        self.holder = np.repeat(np.arange(len(bags), dtype=np.int32), np.diff(self.bounds))[np.argsort(self.bag, kind="stable")]
        self.held = np.sort(self.bag, kind="stable")
        self.known = np.unique(self.held)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.known & np.uint64((1 << 20) - 1)] = True
        length = np.repeat(self.sizes, np.diff(self.bounds))
        # for each size, in order: the least number of shared shingles, and the shingles of its items
        self.by_size = {size: (least_shared(size), np.unique(self.bag[length == size])) for size in np.unique(self.sizes).tolist()}
        edges = [round(64 * b / BLOCKS) for b in range(BLOCKS + 1)]
        self.widths = [hi - lo for lo, hi in zip(edges, edges[1:], strict=False)]
        self.lows = np.array(edges[:-1], np.uint64)
        self.masks = np.array([(1 << w) - 1 for w in self.widths], np.uint64)
        self.flips = [np.array([sum(1 << i for i in on) for n in range(RADIUS // BLOCKS + 1) for on in combinations(range(w), n)], np.uint32) for w in self.widths]
        self.near = {size: self._tables(np.flatnonzero(self.sizes == size)) for size in self.by_size}

    def bytes(self) -> int:
        """What goes to every task."""
        arrays = [self.sizes, self.prints, self.bounds, self.bag, self.times, self.holder, self.held, self.known, self.maybe, *(own for _, own in self.by_size.values())]
        return 64 * len(self.ids) + sum(a.nbytes for a in arrays) + sum(a.nbytes for tables in self.near.values() for t in tables for a in t)

    def _blocks(self, prints: np.ndarray) -> np.ndarray:
        """The blocks of each fingerprint, a row each."""
        return ((prints[:, None] >> self.lows) & self.masks).astype(np.uint32)

    def _tables(self, items: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each block the items in the order of its value, and where each value's items begin."""
        out = []
        for block, width in zip(self._blocks(self.prints[items]).T, self.widths, strict=True):
            order = np.argsort(block, kind="stable")
            out.append((items[order].astype(np.int32), np.searchsorted(block[order], np.arange((1 << width) + 1)).astype(np.int32)))
        return out

    def matches(self, text: str) -> list[tuple[int, float, int]]:
        """(item, similarity, first word) of every item of which some window of the text is similar enough, at its best window."""
        return self.found(shingle_hashes(text))

    def found(self, hashes: np.ndarray) -> list[tuple[int, float, int]]:
        """``matches`` of a text whose shingles have these hashes."""
        if not len(hashes) or not len(self.known):
            return []
        hit = self.maybe[hashes & np.uint64((1 << 20) - 1)]
        if not hit.any():
            return []
        where = _places(hashes, np.flatnonzero(hit), self.known)
        best: dict[int, tuple[float, int]] = {}
        for size, (least, known) in self.by_size.items():
            if size > len(hashes) or least > len(where):
                break  # sizes come in order
            own = _places(hashes, where, known)
            if least > len(own):
                continue
            shared = np.zeros(len(hashes) + 1, np.int64)
            shared[own + 1] = 1
            np.cumsum(shared, out=shared)
            starts = np.flatnonzero(shared[size:] - shared[:-size] >= least)
            if not len(starts):
                continue
            at, items = self._proposed(window_prints(hashes, starts, size), size)
            for start, i in zip(starts[at].tolist(), items.tolist(), strict=True):
                if (like := self._similarity(hashes[start : start + size], i)) >= SIMILARITY and like > best.get(i, (0.0, 0))[0]:
                    best[i] = (like, start)
        if int(self.sizes.max()) > len(hashes) and len(where) > SIMILARITY * len(hashes) - 1e-9:
            for i in self._longer(hashes):
                if (like := self._similarity(hashes, i)) >= SIMILARITY:
                    best[i] = (like, 0)
        return [(i, like, start) for i, (like, start) in sorted(best.items())]

    def _longer(self, hashes: np.ndarray) -> list[int]:
        """Items of more shingles than a whole text, but not of too many to be like it, that hold one of its shingles."""
        asked = np.unique(hashes)
        spans = zip(np.searchsorted(self.held, asked).tolist(), np.searchsorted(self.held, asked, "right").tolist(), strict=True)
        items = np.unique(np.concatenate([self.holder[a:b] for a, b in spans]))
        return items[(self.sizes[items] > len(hashes)) & (SIMILARITY * self.sizes[items] <= len(hashes) + 1e-9)].tolist()

    def _proposed(self, prints: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the fingerprints of windows, those within the radius of an item of their size, by number, and that item; in order."""
        at, items = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for (owner, first), block, flips in zip(self.near[size], self._blocks(prints).T, self.flips, strict=True):
            asked = block[:, None] ^ flips
            begin = first[asked]
            count = first[asked + 1] - begin
            row, col = np.nonzero(count)
            count, begin = count[row, col], begin[row, col]
            nth = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            own, item = np.repeat(row, count), owner[np.repeat(begin, count) + nth]
            near = np.bitwise_count(prints[own] ^ self.prints[item]) <= RADIUS
            at.append(own[near])
            items.append(item[near].astype(np.int64))
        pairs = np.unique(np.concatenate(at) * len(self.ids) + np.concatenate(items))  # blocks may propose a pair twice
        return np.divmod(pairs, len(self.ids))

    def _within(self, own: np.uint64, size: int) -> list[int]:
        return self._proposed(np.array([own], np.uint64), size)[1].tolist()

    def _similarity(self, window: np.ndarray, item: int) -> float:
        lo, hi = self.bounds[item], self.bounds[item + 1]
        bag, times = self.bag[lo:hi], self.times[lo:hi]
        own, n = np.unique(window, return_counts=True)
        at = np.minimum(np.searchsorted(bag, own), len(bag) - 1)
        both = int(np.minimum(n, times[at])[bag[at] == own].sum())
        return both / (len(window) + int(self.sizes[item]) - both)


def indexes(benchmark: DataFrame, part_bytes: int = PART_BYTES, index_bytes: int = INDEX_BYTES) -> Iterator[Index]:
    """One index after the other, each of a part of the benchmark that is dealt by hash, holds about ``part_bytes`` of text and has at most ``index_bytes``."""
    items = benchmark.select("item_id", "text").distinct()  # rows that are repeated would all be in one part
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, math.ceil(size / part_bytes))
    number = lambda of: F.pmod(F.xxhash64("item_id", "text"), F.lit(of))
    items = items.withColumn("part", number(parts))
    if parts > 1:  # each part is then read from a folder of its own
        items = stage(items.repartition("part"), "benchmark", ("part",))
    left = [(p, parts) for p in range(parts)]
    while left:
        p, of = left.pop(0)
        own = items.where((F.col("part") == p % parts) & (number(of) == p)).select("item_id", "text").orderBy("item_id", "text")
        index = Index([tuple(r) for r in own.collect()])  # about part_bytes
        if index.bytes() > index_bytes and len(set(index.ids)) > 1 and of < 1 << 40:
            left = [(p, 2 * of), (p + of, 2 * of), *left]
        else:
            yield index


class Sieve:
    """A bit map of all shingles of the benchmark, and the sizes of its items."""

    def __init__(self, bits: np.ndarray, sizes: list[int]) -> None:
        self.bits, self.sizes = bits, sizes
        self.mask = np.uint64(8 * len(bits) - 1)

    def may_match(self, hashes: np.ndarray) -> bool:
        if not len(hashes) or not self.sizes:
            return False
        at = hashes & self.mask
        hit = (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1)
        shared = np.r_[0, np.cumsum(hit, dtype=np.int64)]
        for size in self.sizes:
            least = least_shared(size)
            if least > shared[-1]:
                break  # sizes come in order
            if size <= len(hashes) and int((shared[size:] - shared[:-size]).max()) >= least:
                return True
        return self.sizes[-1] > len(hashes) and shared[-1] > SIMILARITY * len(hashes) - 1e-9


def sieve(benchmark: DataFrame, map_bytes: int = MAP_BYTES) -> Sieve:
    """The bit map is made on Spark, by tasks that each cover a stretch of it; sizes are as many as items have different lengths."""

    def described(texts: list[str]) -> list:
        return [[shingle_hashes(t).tobytes() for t in texts]]

    hashed = stage(map_texts(benchmark, lambda: described, "hashes binary", ("item_id",)).select("hashes").where("length(hashes) > 0"), "items")
    total = (hashed.agg(F.sum(F.length("hashes"))).first()[0] or 0) // 8
    size = min(map_bytes, 1 << max(13, (32 * total // 8).bit_length()))

    def marks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own: dict[int, np.ndarray] = {}
        for rows in batches:
            for raw in rows["hashes"]:
                at = np.frombuffer(raw, np.uint64) & np.uint64(8 * size - 1)
                for page in np.unique(at >> np.uint64(16)).tolist():
                    inside = at[at >> np.uint64(16) == page] & np.uint64(65535)
                    np.bitwise_or.at(own.setdefault(page, np.zeros(8192, np.uint8)), (inside >> np.uint64(3)).astype(np.int64), np.uint8(1) << (inside & np.uint64(7)).astype(np.uint8))
        for page, bits in own.items():
            yield pd.DataFrame({"page": [page], "bits": [bits.tobytes()]})

    def merged(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"page": rows["page"].iloc[:1], "bits": [np.bitwise_or.reduce(np.stack([np.frombuffer(b, np.uint8) for b in rows["bits"]])).tobytes()]})

    bits = np.zeros(size, np.uint8)
    for r in hashed.mapInPandas(marks, "page long, bits binary").groupBy("page").applyInPandas(merged, "page long, bits binary").collect():  # map_bytes in all
        bits[8192 * r["page"] : 8192 * (r["page"] + 1)] = np.frombuffer(r["bits"], np.uint8)
    return Sieve(bits, sorted(r[0] for r in hashed.select((F.length("hashes") / 8).cast("int")).distinct().collect()))


def _finder(shared: Broadcast):
    def run(texts: list[str | bytes]) -> list:
        index = shared.value
        found = (index.matches(t) if isinstance(t, str) else index.found(np.frombuffer(t, np.uint64)) for t in texts)
        return [[[{"item_id": index.ids[i], "similarity": s, "first_word": w} for i, s, w in own] for own in found]]

    return lambda: run


def _hits(docs: DataFrame, shared: Broadcast, key: str, column: str = "text") -> DataFrame:
    own = map_texts(docs, _finder(shared), "hits array<struct<item_id:bigint,similarity:double,first_word:bigint>>", (key,), column=column)
    return own.select(key, F.inline("hits"))


def _sieved(docs: DataFrame, benchmark: DataFrame, column: str) -> DataFrame:
    """``docs`` with the hashes of the shingles of those that may hold an item, null for the others; written, so that no text is asked twice."""
    shared = docs.sparkSession.sparkContext.broadcast(sieve(benchmark))

    @F.pandas_udf(T.BinaryType())
    def asked(texts: pd.Series) -> pd.Series:
        hashes = (shingle_hashes(t or "") for t in texts)
        return pd.Series([h.tobytes() if shared.value.may_match(h) else None for h in hashes], dtype=object)

    own = stage(docs.withColumn(column, asked("text")), "sieved")
    shared.destroy()
    return own


def _by_parts(suspects: DataFrame, found: Iterator[Index], key: str, column: str) -> DataFrame:
    """The hits of each part, written before the next one is built and sent: tasks and driver hold one part at a time."""
    out = None
    for index in found:
        shared = suspects.sparkSession.sparkContext.broadcast(index)
        own = stage(_hits(suspects, shared, key, column), "hits")
        shared.destroy()
        out = own if out is None else out.union(own)
    return out


def matches(docs: DataFrame, benchmark: DataFrame, part_bytes: int = PART_BYTES, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """(doc_id, item_id, similarity, first_word): every document that holds a benchmark item, once for each item."""
    found = indexes(benchmark, part_bytes, index_bytes)
    index, more = next(found), next(found, None)
    if more is None:
        return _hits(docs, docs.sparkSession.sparkContext.broadcast(index), "doc_id")
    suspects = _sieved(docs.select("doc_id", "text"), benchmark, "hashes").where("hashes is not null")
    return _by_parts(suspects, chain([index, more], found), "doc_id", "hashes")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, part_bytes: int = PART_BYTES, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item."""
    found = indexes(benchmark, part_bytes, index_bytes)
    index, more = next(found), next(found, None)
    if more is None:
        return docs.where(_is_clean(docs.sparkSession.sparkContext.broadcast(index))("text"))
    row, hashes = fresh(docs, "_row"), fresh(docs, "_hashes")
    rows = _sieved(docs.withColumn(row, F.monotonically_increasing_id()), benchmark, hashes)  # the numbers are those in the files
    suspects = rows.where(F.col(hashes).isNotNull())
    leaks = _by_parts(suspects, chain([index, more], found), row, hashes).select(row).distinct()
    return rows.where(F.col(hashes).isNull()).union(suspects.join(leaks, row, "left_anti").select(rows.columns)).drop(row, hashes)


def _is_clean(shared: Broadcast):
    @F.pandas_udf(T.BooleanType())
    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([not shared.value.matches(t or "") for t in texts], dtype=bool)

    return clean
