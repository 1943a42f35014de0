"""SimHash near-duplicates by a binary trie self-join.

Fingerprints are cut into ``radius + 1`` blocks. Two fingerprints within ``radius`` bits agree on one block at least, so each block in turn
becomes the top of a trie, where no bit may differ, and the pairs of nodes below it are walked together: differing bits add up, and a pair of
nodes is dropped once they exceed the budget. Spark deals the sub-tries (block number, block value) over tasks. With more fingerprints than
``node_rows`` for each sub-trie, the first levels of the walk are taken on Spark: sub-tries are dealt as pairs of nodes a few bits further down that
are still within the budget, so copies grow with a power of those bits, not with the fingerprints. A node that is over ``node_rows`` nonetheless is
dealt as pairs of hashed parts, so no task holds an unbounded group. Each task reports a forest of its links, not all pairs, and components are found
by star contraction on Spark.

Nulls and texts without words have fingerprint zero and are linked like any other. Repeated rows each keep their row. A component whose
doc_ids are all null has a null component_id. Very long texts are read whole; ties (equal fingerprints, equal distances) are links like any other. Columns
other than doc_id and text are only passed on. An empty table gives no rows.

``keep_one`` leaves one document of each group of near copies: those with an exact Jaccard similarity of 0.8 or more between their sets of five-word shingles.
Two proposers find what is to be compared: the trie join over fingerprints of these shingles, and, because most pairs at 0.8 are further apart than a
trie can be walked, sketches of least hashes. Similar texts share a band of four least hashes (all but one in 500 pairs at 0.8), and within a band's bucket one
bit of each of ``HASHES`` tells how alike two texts are, with a standard error of 0.03. A task compares all sketches of a bucket, or of two parts of a large one, and
proposes forests, the most alike first: one, and ``MORE`` others that join anew what no pair beyond doubt has joined. So a group of thousands of copies is
verified along a few pairs a text and not along all. Every proposal is verified.

What the proposers leave apart is then joined exactly: two texts at ``least`` or above share one of the first shingles of theirs (a fifth of them at 0.8) in any order; here
those known to be in many texts come last, and others in the order of their hashes. So texts meet on these. Pairs of one component need no second look; of the others, all are verified but those that sizes, the number of first shingles shared, or the parities of hashed shingles, show to be less alike.
So a pair is left out only where two shingles of a text have the same 64 bits. Pairs that share a shingle but no component are counted first; where many texts share one they are compared pair by pair, in parts of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscan.llm.common import stage

BITS, WIDE, SIMILARITY = 64, 3, 0.8
#: Least hashes of a sketch; how many bands there are, of how many; the estimated similarity that is proposed, that is beyond doubt, and how many further forests there are.
HASHES, BANDS, BAND = 512, 12, 4
AGREE, SURE, MORE = 0.7, 0.89, 2
#: The least and the most bits that tell how far two sets of shingles are apart at least.
PARITY = 512, 1 << 16
#: Texts that shingles of many texts are looked for in, at least, and how many such shingles are known to every task.
LOOKED_AT, COMMON = 8_000, 1 << 18
#: Texts that share a shingle are told apart by their odd bits where there are more of them.
FEW = 128


def shingle_hashes(text: str, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each shingle, repeats included; none for a text without words."""
    w = text.encode().lower().split()  # bytes: only A-Z change, only ASCII white space separates
    if not w:
        return np.empty(0, np.uint64)
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)) if len(w) >= words else iter([b" ".join(w)])
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s, seed) for s in shingles), np.uint64, max(1, len(w) - words + 1))


def _majority(hashes: np.ndarray) -> int:
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 16384):
        ones += np.unpackbits(hashes[i : i + 16384].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint(text: str, words: int = 3, seed: int = 42) -> int:
    """Signed 64-bit SimHash of a text's shingles: a bit is 1 if set in over half of the shingles' XXH64."""
    return _majority(shingle_hashes(text, words, seed))


_TURNS = np.random.default_rng(11).integers(0, 1 << 32, (2, HASHES, 1), np.uint32)


def sketch(hashes: np.ndarray) -> tuple[bytes, bytes]:
    """The least of the hashes under each of ``HASHES`` orders, on which texts agree with the probability of their similarity: those of the bands, and one bit of each."""
    short, least = np.unique((hashes >> np.uint64(32)).astype(np.uint32)), np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(short), 512):
        least = np.minimum(least, (short[None, i : i + 512] * (_TURNS[0] | np.uint32(1)) + _TURNS[1]).min(axis=1))
    mixed = (least ^ (least >> np.uint32(15))) * np.uint32(0x9E3779B1)
    return least[: BANDS * BAND].tobytes(), np.packbits(mixed >> np.uint32(31) == 1).tobytes()


def fingerprints_udf(words: int = 3):
    @F.pandas_udf(T.LongType())
    def prints(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t or "", words) for t in texts], dtype="int64")

    return prints


def common(texts: DataFrame, words: int) -> np.ndarray:
    """Hashes of shingles that many of the texts (h, text) have, sorted; at most ``COMMON`` of them. They are looked for in a 16th of the texts, ``LOOKED_AT`` at least: only the order of shingles comes of it."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def hashed(texts: pd.Series) -> pd.Series:
        return pd.Series([np.unique(shingle_hashes(t, words)).view(np.int64) for t in texts])

    share = max(1, min(16, texts.count() // LOOKED_AT))
    some = texts.where(F.pmod("h", F.lit(share)) == 0).dropDuplicates(["h"])
    often = some.select(F.explode(hashed("text")).alias("token")).groupBy("token").count().where("count > 3").orderBy(F.desc("count"), "token").limit(COMMON)
    return np.sort(np.array([r[0] for r in often.select("token").collect()], np.int64).view(np.uint64))


def prefix(hashes: np.ndarray, least: float, often: np.ndarray) -> tuple[int, np.ndarray, bytes]:
    """How many different shingles there are, the first of them, those that are in ``often`` being last, and which bits an odd number of them fall on.

    Of two texts at ``least`` or above, the first shingles in any order that all texts share have one in common: those two sets that differ in all of them have too few others.
    Bits that are odd in one text alone number at most the shingles that one text alone has.
    """
    own = np.unique(hashes) if len(hashes) else np.zeros(1, np.uint64)  # texts without words are alike
    n = len(own)
    last = often[np.searchsorted(often, own) % len(often)] == own if len(often) else np.zeros(n, bool)
    width = min(max(PARITY[0], 1 << (2 * n - 1).bit_length()), PARITY[1])
    odd = np.bincount((own & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return n, np.concatenate([own[~last], own[last]])[: n - math.ceil(least * n - 1e-6) + 1].view(np.int64), np.packbits(odd.astype(bool)).tobytes()


def marks_udf(words: int, least: float, often: Broadcast):
    """fp, the two parts of the sketch, and what ``prefix`` gives."""

    @F.pandas_udf("fp long, bands binary, bits binary, n long, first array<long>, odd binary")
    def marks(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            hashes = shingle_hashes(t or "", words)
            out.append((_majority(hashes), *sketch(hashes), *prefix(hashes, least, often.value)))
        return pd.DataFrame(out, columns=["fp", "bands", "bits", "n", "first", "odd"])

    return marks


def shingle_set(text: str, words: int) -> set[tuple[bytes, ...]]:
    """The words' shingles, as ``fingerprint`` takes them."""
    w = text.encode().lower().split()
    return set(zip(*(w[i:] for i in range(words)), strict=False)) if len(w) >= words else {tuple(w)}


def similarity(a: str, b: str, words: int = 5) -> float:
    """Jaccard similarity of two texts' shingles; texts without words are alike."""
    x, y = shingle_set(a, words), shingle_set(b, words)
    return len(x & y) / len(x | y)


def walk_pairs(keys: np.ndarray, roots: list[np.ndarray], bits: int, radius: int, leaf: int = 1 << 14, wide: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of the sorted ``keys`` that differ in at most ``radius`` of their low ``bits``, below each pair of root ranges.

    ``roots``: arrays a_lo, a_hi, b_lo, b_hi; equal ranges mean a self-join. A frontier wider than ``wide`` is walked part by part.
    """
    n = len(roots[0])
    stack = [(*roots, np.full(n, bits - 1, np.int64), np.zeros(n, np.int64))]
    one = np.uint64(1)
    while stack:
        front = stack.pop()
        if len(front[0]) > wide:
            half = len(front[0]) // 2
            stack += [tuple(x[:half] for x in front), tuple(x[half:] for x in front)]
            continue
        a0, a1, b0, b1, bit, err = front
        small = ((a1 - a0) * (b1 - b0) <= leaf) | (bit < 0)
        if small.any():
            yield from _leaves(keys, *(x[small] for x in (a0, a1, b0, b1)), radius, bits)
        a0, a1, b0, b1, bit, err = (x[~small] for x in front)
        if not len(a0):
            continue
        step = one << bit.astype(np.uint64)

        def middle(lo: np.ndarray, step: np.ndarray = step) -> np.ndarray:
            return np.searchsorted(keys, (keys[lo] & ~((step << one) - one)) | step)

        am, bm, same = middle(a0), middle(b0), a0 == b0
        below = []
        for x0, x1, y0, y1, more, use in ((a0, am, b0, bm, 0, None), (am, a1, bm, b1, 0, None), (a0, am, bm, b1, 1, None), (am, a1, b0, bm, 1, ~same)):
            ok = (x0 < x1) & (y0 < y1) & (err + more <= radius)
            ok = ok if use is None else ok & use
            below.append(tuple(x[ok] for x in (x0, x1, y0, y1, bit - 1, err + more)))
        stack.append(tuple(np.concatenate(x) for x in zip(*below, strict=True)))


def _leaves(keys: np.ndarray, a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray, radius: int, bits: int, most: int = 1 << 20, block: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    mask = np.uint64((1 << bits) - 1)
    counts = (a1 - a0) * (b1 - b0)
    large = counts > block
    for lo, hi, lo2, hi2 in zip(*(x[large].tolist() for x in (a0, a1, b0, b1)), strict=True):  # large pairs of nodes one by one, as a table
        i, j = np.nonzero(np.bitwise_count((keys[lo:hi, None] ^ keys[None, lo2:hi2]) & mask) <= radius)
        if lo == lo2:
            i, j = i[i < j], j[i < j]
        if len(i):
            yield i + lo, j + lo2
    a0, a1, b0, b1, counts = (x[~large] for x in (a0, a1, b0, b1, counts))
    cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(counts) // most)) + 1), len(counts)]
    for s, e in zip(cuts, cuts[1:], strict=False):
        c = counts[s:e]
        which = np.repeat(np.arange(s, e), c)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(c) - c, c)
        wide = (b1 - b0)[which]
        i, j = a0[which] + nth // wide, b0[which] + nth % wide
        near = ((a0 != b0)[which] | (i < j)) & (np.bitwise_count((keys[i] ^ keys[j]) & mask) <= radius)
        yield i[near], j[near]


def _forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The least index that each of n items is linked to."""
    least = np.arange(n)
    for i, j in pairs:
        while True:
            x, y = least[i], least[j]
            if not (apart := x != y).any():
                break
            np.minimum.at(least, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
            while not np.array_equal(least, jumped := least[least]):
                least = jumped
    return least


def _spanning(n: int, walks: Iterator[Iterator[tuple[np.ndarray, np.ndarray]]]) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of n items out of the pairs themselves; pairs of an earlier walk come first."""
    least, left, right = np.arange(n), [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for pairs in walks:
        for i, j in pairs:
            while True:
                x, y = least[i], least[j]
                if not (apart := x != y).any():
                    break
                i, j, high, low = i[apart], j[apart], np.maximum(x, y)[apart], np.minimum(x, y)[apart]
                # each root hangs below one other, by one pair
                heads, first = np.unique(high, return_index=True)
                least[heads] = low[first]
                left.append(i[first])
                right.append(j[first])
                while not np.array_equal(least, jumped := least[least]):
                    least = jumped
    return np.concatenate(left), np.concatenate(right)


def _links(batches: Iterator[pd.DataFrame], radius: int, nearest: bool) -> Iterator[pd.DataFrame]:
    """Rows come sorted by group (turn, top, i, j); a group cut off by the end of a batch is carried on."""
    head, kept = ["turn", "top", "i", "j"], None
    width = BITS // (radius + 1)

    def done(rows: pd.DataFrame) -> pd.DataFrame:
        group = np.cumsum(np.r_[True, (rows[head].to_numpy()[1:] != rows[head].to_numpy()[:-1]).any(axis=1)]) - 1
        out = []
        for first in range(0, int(group[-1]) + 1, 1 << (width - 1)):
            part = rows[(group >= first) & (group < first + (1 << (width - 1)))]
            g = group[(group >= first) & (group < first + (1 << (width - 1)))] - first
            low = np.uint64(BITS - width)
            rest = part["rest"].to_numpy().astype(np.uint64)
            # side 1 of a cross pair sorts behind side 0 by its own number
            number = (2 * g + part["side"].to_numpy()).astype(np.uint64)
            keys = (number << low) | rest
            order = np.argsort(keys, kind="stable")
            keys, number, fps = keys[order], number[order], part["fp"].to_numpy()[order]
            starts = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
            ends, ids = np.r_[starts[1:], len(keys)], number[starts]
            cross = part["i"].to_numpy()[order][starts] != part["j"].to_numpy()[order][starts]
            own = ~cross
            pair = np.flatnonzero(cross[:-1] & (ids[:-1] % 2 == 0) & (ids[1:] == ids[:-1] + 1))
            roots = [np.r_[starts[own], starts[pair]], np.r_[ends[own], ends[pair]], np.r_[starts[own], starts[pair + 1]], np.r_[ends[own], ends[pair + 1]]]
            if nearest:
                one, two = _spanning(len(keys), (walk_pairs(keys, roots, BITS - width, r) for r in sorted({min(radius, r) for r in (1, 3, radius)})))
            else:
                least = _forest(len(keys), walk_pairs(keys, roots, BITS - width, radius))
                one = np.flatnonzero(least != np.arange(len(keys)))
                two = least[one]
            out.append(pd.DataFrame({"a": fps[one], "b": fps[two]}))
        return pd.concat(out)

    for rows in batches:
        rows = rows if kept is None else pd.concat([kept, rows], ignore_index=True)
        if not len(rows):
            continue
        last = (rows[head] == rows[head].iloc[-1]).all(axis=1).to_numpy()
        begin = len(rows) - int(np.argmin(last[::-1])) if not last.all() else 0
        kept = rows.iloc[begin:]
        if begin:
            yield done(rows.iloc[:begin])
    if kept is not None and len(kept):
        yield done(kept)


def links(prints: DataFrame, radius: int = 3, node_rows: int = 4096, depth: int | None = None, nearest: bool = False) -> DataFrame:
    """A forest (a, b) that links all distinct fingerprints ``fp`` within ``radius`` bits of each other; with ``nearest``, by pairs within the radius, near ones first.

    ``depth``: the bits below a block that deal its sub-tries as pairs of nodes; unless given, as many as bring evenly spread fingerprints to ``node_rows``.
    """
    width = BITS // (radius + 1)
    if width * (radius + 1) != BITS:
        raise ValueError("radius + 1 must divide 64")
    if depth is None:
        depth = min(BITS - width, max(0, math.ceil(math.log2(max(1, prints.count()) / (node_rows << width)))))
    turned = []
    for turn in range(radius + 1):
        up = width * (turn + 1)
        top = F.shiftrightunsigned("fp", BITS - up).bitwiseAND((1 << width) - 1)
        around = F.shiftleft("fp", up).bitwiseOR(F.shiftrightunsigned("fp", BITS - up)) if up < BITS else F.col("fp")
        rest = F.shiftrightunsigned(around, width)
        turned.append(F.struct(F.lit(turn).alias("turn"), top.alias("top"), rest.alias("rest"), F.shiftrightunsigned(rest, BITS - width - depth).alias("node")))
    rows, key = prints.select("fp", F.inline(F.array(*turned))), ["turn", "top", "node"]
    large = rows.groupBy(*key).count().where(F.col("count") > node_rows).select(*key, F.ceil(F.col("count") * 2 / node_rows).cast("int").alias("parts"))
    rows = rows.join(large, key, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    if depth:  # each node meets itself and those that differ in a few bits
        apart = [sum(1 << b for b in bits) for n in range(radius + 1) for bits in combinations(range(depth), n)]
        rows = rows.withColumn("other", F.explode(F.transform(F.array(*(F.lit(m).cast("long") for m in apart)), lambda m: F.col("node").bitwiseXOR(m))))
        rows = rows.join(large.select("turn", "top", F.col("node").alias("other"), F.col("parts").alias("others")), ["turn", "top", "other"], "left").withColumn("others", F.coalesce("others", F.lit(1)))
    else:
        rows = rows.withColumns({"other": F.col("node"), "others": F.col("parts")})
    numbered = lambda node, part: F.shiftleft(node, 32).bitwiseOR(part.cast("long"))
    own = numbered(F.col("node"), F.pmod(F.xxhash64("fp"), F.col("parts")))
    meets = F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda k: numbered(F.col("other"), k))
    meets = F.transform(meets, lambda it: F.struct(F.least(it, own).alias("i"), F.greatest(it, own).alias("j"), F.when(own > it, 1).otherwise(0).alias("side")))
    rows = rows.select("turn", "top", "rest", "fp", F.inline(meets))
    dealt = rows.repartition("turn", "top", "i", "j").sortWithinPartitions("turn", "top", "i", "j")
    return dealt.mapInPandas(lambda batches: _links(batches, radius, nearest), "a long, b long").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node of the edges (a, b), root being the least node of its component: alternating large and small stars."""
    edges = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    for _ in range(rounds):
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == mark or not now[0]:
            break
        mark = now
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least).where("a <> b").distinct()
        edges = stage(small, "edges")
    else:
        raise RuntimeError(f"components not settled after {rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row, staged."""
    return stage(docs.select("doc_id", fingerprints_udf()("text").alias("fp")), "fingerprints")


def classes(prints: DataFrame, radius: int = 3, node_rows: int = 4096) -> DataFrame:
    """(fp, component_id) per distinct fingerprint."""
    firsts = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "firsts")
    roots = components(links(firsts, radius, node_rows))
    known = firsts.join(roots, firsts.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = known.groupBy("root").agg(F.min("first").alias("component_id"))
    return known.join(least, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, radius: int = 3, node_rows: int = 4096) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row."""
    prints = fingerprints(docs)
    found = classes(prints, radius, node_rows)
    return prints.join(found, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _placed(docs: DataFrame) -> DataFrame:
    """(row, file, at): rows with a name that lasts, the file and the row's number in it; what is not a table of Parquet files as it was read is staged first."""
    if docs._jdf.queryExecution().analyzed().nodeName() != "LogicalRelation" or not docs.inputFiles()[:1] or not docs.inputFiles()[0].endswith(".parquet"):
        docs = stage(docs, "rows")
    place = docs.metadataColumn("_metadata")  # also where a column has that name
    return docs.select(F.struct("*").alias("row"), F.xxhash64(place["file_path"]).alias("file"), place["row_index"].alias("at"))


def verified(pairs: DataFrame, words: int, least: float) -> DataFrame:
    """The pairs (a, b, text_a, text_b) whose texts are similar enough."""

    @F.pandas_udf(T.BooleanType())
    def alike(one: pd.Series, two: pd.Series) -> pd.Series:
        return pd.Series([similarity(x, y, words) >= least for x, y in zip(one, two, strict=True)], dtype=bool)

    return pairs.where(alike("text_a", "text_b")).select("a", "b")


def _agreeing(one: np.ndarray, two: np.ndarray | None, most: int, block: int = 128) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index pairs of sketches that differ in ``most`` bits at most, the most alike first, and those bits; within ``one``, or between it and ``two``, which are numbered behind it."""
    found = [np.empty((3, 0), np.int32)]
    for i in range(0, len(one), block):
        others = one[i:] if two is None else two
        for j in range(0, len(others), 4096):
            apart = np.bitwise_count(one[i : i + block, None, :] ^ others[None, j : j + 4096, :]).sum(axis=2, dtype=np.int16)
            x, y = np.nonzero(apart <= most)
            n = apart[x, y]
            x, y = x + i, y + j + (i if two is None else len(one))
            found.append(np.stack([x, y, n])[:, x < y].astype(np.int32))
    x, y, n = np.concatenate(found, axis=1)
    order = np.argsort(n, kind="stable")
    return x[order], y[order], n[order]


def _levels(x: np.ndarray, y: np.ndarray, apart: np.ndarray) -> Iterator[list[tuple[np.ndarray, np.ndarray]]]:
    """Pairs that differ in as many bits, together."""
    cuts = [0, *(np.flatnonzero(np.diff(apart)) + 1).tolist(), len(apart)]
    return ([(x[s:e], y[s:e])] for s, e in zip(cuts, cuts[1:], strict=False))


def _forests(n: int, x: np.ndarray, y: np.ndarray, apart: np.ndarray, sure: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs, and others of pairs not used before, between what pairs of up to ``sure`` bits leave apart."""
    left, right = _spanning(n, _levels(x, y, apart))
    used = [left * n + right]
    for _ in range(MORE):
        fresh = ~np.isin(x.astype(np.int64) * n + y, np.concatenate(used))
        known = apart <= sure
        if not (fresh & ~known).any():
            break
        a, b = _spanning(n, ([(x[known], y[known])], *_levels(*(v[fresh & ~known] for v in (x, y, apart)))))
        new = ~np.isin(a * n + b, x[known].astype(np.int64) * n + y[known])
        used.append((a * n + b)[new])
    every = np.concatenate(used)
    return every // max(n, 1), every % max(n, 1)


def _proposals(batches: Iterator[pd.DataFrame], most: int, sure: int) -> Iterator[pd.DataFrame]:
    """Forests of the groups (band, key, i, j), which rows are sorted by; a group cut off by the end of a batch is carried on."""
    head, kept = ["band", "key", "i", "j"], None

    def done(rows: pd.DataFrame) -> pd.DataFrame:
        marks = rows[head].to_numpy()
        edges = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1).tolist(), len(rows)]
        nodes, bits, side = rows["node"].to_numpy(), np.frombuffer(b"".join(rows["bits"]), np.uint64).reshape(-1, HASHES // 64), rows["side"].to_numpy()
        left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for s, e in zip(edges, edges[1:], strict=False):
            if marks[s, 2] != marks[s, 3]:
                order = np.argsort(side[s:e], kind="stable") + s
                cut = int((side[s:e] == 0).sum())
                pairs = _agreeing(bits[order[:cut]], bits[order[cut:]], most)
            else:
                order, pairs = np.arange(s, e), _agreeing(bits[s:e], None, most)
            a, b = _forests(e - s, *pairs, sure)
            left.append(nodes[order[a]])
            right.append(nodes[order[b]])
        one, two = np.concatenate(left), np.concatenate(right)
        return pd.DataFrame({"a": np.minimum(one, two), "b": np.maximum(one, two)})

    for rows in batches:
        rows = rows if kept is None else pd.concat([kept, rows], ignore_index=True)
        if not len(rows):
            continue
        last = (rows[head] == rows[head].iloc[-1]).all(axis=1).to_numpy()
        begin = len(rows) - int(np.argmin(last[::-1])) if not last.all() else 0
        kept = rows.iloc[begin:]
        if begin:
            yield done(rows.iloc[:begin])
    if kept is not None and len(kept):
        yield done(kept)


def alike_by_sketch(nodes: DataFrame, node_rows: int = 2048, agree: float = AGREE, sure: float = SURE) -> DataFrame:
    """(a, b): forests over the nodes (node, bands, bits) that share a band and agree in enough hashes; a bucket over ``node_rows`` is dealt as pairs of hashed parts."""
    key = F.array(*(F.xxhash64(F.substring("bands", 1 + 4 * BAND * k, 4 * BAND)) for k in range(BANDS)))
    rows = nodes.select("node", "bits", F.posexplode(key).alias("band", "key"))
    sizes = rows.groupBy("band", "key").count().where("count > 1").select("band", "key", F.when(F.col("count") > node_rows, F.ceil(F.col("count") * 2 / node_rows)).otherwise(1).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    meets = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(F.least(k, part).alias("i"), F.greatest(k, part).alias("j"), F.when(part > k, 1).otherwise(0).alias("side")))
    dealt = rows.join(sizes, ["band", "key"]).select("band", "key", "node", "bits", F.inline(meets)).repartition("band", "key", "i", "j").sortWithinPartitions("band", "key", "i", "j")
    return dealt.mapInPandas(lambda batches: _proposals(batches, *(int(HASHES * (1 - s) / 2) for s in (agree, sure))), "a long, b long").distinct()


def _whole(batches: Iterator[pd.DataFrame], head: list[str]) -> Iterator[pd.DataFrame]:
    """Rows sorted by ``head`` in parts that cut no group; a group cut off by the end of a batch is carried on."""
    kept: list[pd.DataFrame] = []
    for rows in batches:
        if not len(rows):
            continue
        last = (rows[head] == rows[head].iloc[-1]).all(axis=1).to_numpy()
        begin = len(rows) - int(np.argmin(last[::-1])) if not last.all() else 0
        if begin or kept and (kept[-1][head].iloc[-1] != rows[head].iloc[-1]).any():
            yield pd.concat([*kept, rows.iloc[:begin]], ignore_index=True)
            kept = []
        kept.append(rows.iloc[begin:])
    if kept:
        yield pd.concat(kept, ignore_index=True)


def _meetings(rows: pd.DataFrame, head: list[str], most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of rows that meet in the groups ``head``, of which the last two are the numbers of the parts: all of one part, or those of either side."""
    marks, side, n = rows[head].to_numpy(), rows["side"].to_numpy(), np.arange(len(rows))
    starts = np.flatnonzero(np.r_[True, (marks[1:] != marks[:-1]).any(axis=1)])
    sizes = np.diff(np.r_[starts, len(rows)])
    ends, cuts = np.repeat(starts + sizes, sizes), np.repeat(starts + np.add.reduceat(side == 0, starts, dtype=np.int64), sizes)
    begins = np.where(marks[:, -2] == marks[:, -1], n + 1, np.where(side == 0, cuts, ends))
    counts = ends - begins
    edges = [0, *(np.flatnonzero(np.diff(np.cumsum(counts) // most)) + 1).tolist(), len(rows)]
    for s, e in zip(edges, edges[1:], strict=False):
        c = counts[s:e]
        which = np.repeat(n[s:e], c)
        yield which, begins[which] + np.arange(len(which)) - np.repeat(np.cumsum(c) - c, c)


def _apart(x: np.ndarray, y: np.ndarray, odd: dict[int, np.ndarray], width: np.ndarray, at: np.ndarray, most: int = 1 << 21) -> np.ndarray:
    """In how many odd bits the rows x and y differ; the bits of the longer one are folded."""

    def halved(bits: np.ndarray, words: int) -> np.ndarray:
        while bits.shape[1] > words:
            half = bits.shape[1] // 2
            bits = bits[:, :half] ^ bits[:, half:]
        return bits

    out = np.zeros(len(x), np.int64)
    for u, v in np.unique(np.stack([width[x], width[y]]), axis=1).T.tolist():
        all_of = np.flatnonzero((width[x] == u) & (width[y] == v))
        step = max(1, most // max(u, v))
        for k in range(0, len(all_of), step):
            pick = all_of[k : k + step]
            a, b = (halved(odd[w][at[z[pick]]], min(u, v)) for w, z in ((u, x), (v, y)))
            out[pick] = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)
    return out


def _possible(batches: Iterator[pd.DataFrame], least: float) -> Iterator[pd.DataFrame]:
    """Of the pairs that meet, those of different components that sizes and odd bits allow."""
    for rows in _whole(batches, ["token", "i", "j"]):
        node, root, n = (rows[c].to_numpy() for c in ("node", "root", "n"))
        width, at, odd = rows["odd"].map(len).to_numpy() // 8, np.zeros(len(rows), np.int64), {}
        for w in np.unique(width).tolist():
            own = np.flatnonzero(width == w)
            at[own], odd[w] = np.arange(len(own)), np.frombuffer(b"".join(rows["odd"].iloc[own]), np.uint64).reshape(-1, w)
        for x, y in _meetings(rows, ["token", "i", "j"]):
            near = (root[x] != root[y]) & (np.minimum(n[x], n[y]) >= least * np.maximum(n[x], n[y]) - 1e-6)
            x, y = x[near], y[near]
            near = _apart(x, y, odd, width, at) <= (1 - least) / (1 + least) * (n[x] + n[y]) + 1e-6
            x, y = node[x[near]], node[y[near]]
            if len(x):
                yield pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y)}).drop_duplicates()


def _dealt(rows: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """(a, b): of the rows (token, node, root, parts), the pairs that meet and that sizes and odd bits allow."""
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    meets = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(F.least(k, part).alias("i"), F.greatest(k, part).alias("j"), F.when(part > k, 1).otherwise(0).alias("side")))
    dealt = rows.join(nodes.select("node", "n", "odd"), "node").select("token", "node", "root", "n", "odd", F.inline(meets)).repartition("token", "i", "j").sortWithinPartitions("token", "i", "j", "side")
    return dealt.mapInPandas(lambda batches: _possible(batches, least), "a long, b long").distinct()


def _counted(rows: DataFrame, least: float) -> DataFrame:
    """(token, node, root, parts): of the rows (token, node, root, n), the pairs that meet so often that what they do not share among their first shingles leaves them room; each with a token of its own.

    Of two sets, that whose first shingles end earlier in the order shares with the other one only what both have among the first, and at most all that follow.
    """
    one, two = (rows.select("token", *(F.col(c).alias(f"{c}_{x}") for c in ("node", "root", "n"))) for x in "ab")
    larger, smaller = F.greatest("n_a", "n_b"), F.least("n_a", "n_b")
    met = one.join(two, "token").where((F.col("node_a") < F.col("node_b")) & (F.col("root_a") != F.col("root_b")) & (smaller >= least * larger - 1e-6))
    often = met.groupBy("node_a", "node_b").agg(F.count("*").alias("shared"), *(F.first(c).alias(c) for c in ("root_a", "root_b", "n_a", "n_b")))
    often = often.where(F.col("shared") + F.ceil(least * larger - 1e-6) - 1 >= least / (1 + least) * (larger + smaller) - 1e-6)
    ends = F.array(*(F.struct(F.col(f"node_{x}").alias("node"), F.col(f"root_{x}").alias("root"), F.lit(1).alias("parts")) for x in "ab"))
    return often.select(F.xxhash64("node_a", "node_b").alias("token"), F.inline(ends))


def left_apart(nodes: DataFrame, roots: DataFrame, least: float = SIMILARITY, node_rows: int = 2048) -> DataFrame:
    """(a, b): all pairs of the nodes (node, n, first, odd) that may reach ``least`` and are of different components (node, root); a node without root is its own.

    Only shingles that texts of different components and of sizes near enough have among their first go on from the first shuffle. What ``FEW`` texts at most share is
    counted for each pair, so that odd bits go only with those that meet often; a pair that meets among more texts too is told by its odd bits there.
    """
    rows = nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), F.col("n").cast("int").alias("n"), F.explode("first").alias("token"))
    own = W.partitionBy("token")
    near = lambda other: F.coalesce(F.least("n", other) >= least * F.greatest("n", other) - 1e-6, F.lit(False))
    whole, by_size = own.orderBy("n").rowsBetween(W.unboundedPreceding, W.unboundedFollowing), own.orderBy("n")
    rows = rows.withColumns({"low": F.min("root").over(whole), "high": F.max("root").over(whole), "count": F.count("*").over(whole), "below": F.lag("n").over(by_size), "above": F.lead("n").over(by_size)})
    rows = rows.where((F.col("low") < F.col("high")) & (near(F.col("below")) | near(F.col("above"))))
    parts = F.when(F.col("count") > node_rows, F.ceil(F.col("count") * 2 / node_rows)).otherwise(1).cast("int")
    rows = stage(rows.select("token", "node", "root", "n", parts.alias("parts"), (F.col("count") > FEW).alias("many")), "met")
    return _dealt(rows.where("many").select("token", "node", "root", "parts").union(_counted(rows.where("not many"), least)), nodes, least)


@contextmanager
def _short_batches(spark: SparkSession, rows: int = 1024) -> Iterator[None]:
    """Python workers get at most so many rows at a time: texts, pairs of texts and odd bits are large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def keep_one(docs: DataFrame, radius: int = WIDE, node_rows: int = 4096, words: int = 5, least: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` with one row left of each group of near copies: that with the least doc_id, null last, then the least hash of its text.

    Texts with proposals are fetched and go once to each pair that they are in. Rows are found by their places: while the list of places is small it is broadcast and other
    texts stay where they are; beyond that Spark shuffles the table, once to fetch texts and once to leave out rows.
    """
    with _short_batches(docs.sparkSession):
        rows, gone = _gone(_placed(docs), radius, node_rows, words, least)
    return rows.join(gone, ["file", "at"], "left_anti").select("row.*")


def _gone(rows: DataFrame, radius: int, node_rows: int, words: int, least: float) -> tuple[DataFrame, DataFrame]:
    """The rows (row, file, at), and the stored places (file, at) of those that do not stay."""
    text = F.coalesce("row.text", F.lit(""))
    often = rows.sparkSession.sparkContext.broadcast(common(rows.select(F.xxhash64(text).alias("h"), text.alias("text")), words))
    marked = rows.select(F.col("row.doc_id").alias("doc_id"), marks_udf(words, least, often)("row.text").alias("m"), F.xxhash64(text).alias("h"), "file", "at")
    prints = stage(marked.select("doc_id", "m.*", "h", "file", "at"), "prints")
    # a node is a text; its best row is the one that would stay
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h", "file", "at")).alias("best")
    marks = F.first(F.struct("bands", "bits", "n", "first", "odd")).alias("m")
    nodes = stage(prints.groupBy("fp", "h").agg(best, marks).select("fp", "h", "best", "m.*").withColumn("node", F.monotonically_increasing_id()), "nodes")
    heads = nodes.groupBy("fp").agg(F.min(F.struct("h", "node")).alias("head"), F.count("*").alias("texts"))
    heads = stage(heads.select("fp", F.col("head.node").alias("head"), "texts"), "heads")
    far = links(heads.select("fp"), radius, node_rows, nearest=True)
    ends = heads.select(F.col("fp").alias("a"), F.col("head").alias("x")), heads.select(F.col("fp").alias("b"), F.col("head").alias("y"))
    far = far.join(ends[0], "a").join(ends[1], "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    same = nodes.join(heads.where("texts > 1"), "fp").where("node <> head").select(F.least("head", "node").alias("a"), F.greatest("head", "node").alias("b"))
    pairs = stage(far.union(same).union(alike_by_sketch(nodes.select("node", "bands", "bits"), node_rows // 2)).distinct(), "pairs")

    def similar(pairs: DataFrame) -> DataFrame:
        asked = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        asked = nodes.join(asked, "node", "left_semi").select("node", F.col("best.file").alias("file"), F.col("best.at").alias("at"))
        texts = stage(rows.select("file", "at", text.alias("text")).join(stage(asked, "asked"), ["file", "at"]).select("node", "text"), "texts")
        both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
        return verified(both, words, least)

    roots = stage(components(similar(pairs)), "roots")
    rest = stage(left_apart(nodes, roots, least, node_rows // 2), "rest")
    if not rest.isEmpty():
        roots = components(similar(rest).union(roots.select("node", "root")))
    grouped = nodes.join(roots, "node", "left").select(F.coalesce("root", "node").alias("root"), "best")
    stays = grouped.groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.file").alias("file"), F.col("best.at").alias("at"))
    return rows, stage(prints.select("file", "at").join(stays, ["file", "at"], "left_anti"), "gone")
