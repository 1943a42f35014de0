"""Stretches of a text that repeat themselves: all maximal runs of words, by the longest-previous-factor array.

A run is a stretch of words with smallest period q (words q apart are equal), at least ``LEAST`` words and ``TIMES`` periods long, that no neighbouring word extends.
A few texts at a time go through numpy:

1. words become numbers; 16 words in a row are hashed, and only stretches whose every word lies in a 16-word string that occurs again in the same stretch are
   kept. Every word of a run lies in such a string, because a run agrees with itself, moved by its period, in at least 16 words, so nothing is lost;
2. suffix array by prefix doubling; the ranks of all doubling steps also answer how far two places agree, forwards and backwards; LCP array of neighbours;
3. longest previous factor of each place from suffix array and LCP; from it the LZ blocks and an earlier occurrence of each;
4. Main's extensions at each block's start: for each period that the two blocks around it allow, how far the words agree to both sides;
5. runs that lie strictly inside a block are copies of runs in its earlier occurrence; runs, kept by their starts, are copied block by block.

A null text has no words, like an empty one; both have no runs. Very long texts are taken whole: their memory is some 4 bytes a word and doubling step, of kept
stretches only. Rows are kept one for one, repeated rows and null ids included. Several runs may overlap; each is listed once, with its smallest period. Columns
other than those to keep and text are not looked at. An empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import let, map_texts

LEAST, TIMES, GRAM = 24, 3, 16
MADE = "n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
SPACE = r"[\x20\x09-\x0D]+"


def word_numbers(words: list[bytes]) -> np.ndarray:
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def stretches(words: np.ndarray, group: np.ndarray) -> list[tuple[int, int]]:
    """(start, stop) of what may hold runs: maximal stretches within one group, each word in a string of ``GRAM`` words that its stretch holds twice."""
    n = len(words)
    if n < LEAST:
        return []
    x = (words.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    base = 0xBF58476D1CE4E5B9
    for step in (1, 2, 4, 8):  # x[i] becomes the hash of the next 2 * step words
        x = x[:-step] * np.uint64(base) + x[step:]
        base = base * base % (1 << 64)
    at = np.flatnonzero(group[: n - GRAM + 1] == group[GRAM - 1 :])
    while len(at):
        key = x[at] ^ (group[at].astype(np.uint64) * np.uint64(0x94D049BB133111EB))
        order = np.sort(key)
        twice = order[1:][order[1:] == order[:-1]]
        if not len(twice):
            return []
        kept = at[twice[np.minimum(np.searchsorted(twice, key), len(twice) - 1)] == key]
        edge = np.zeros(n + 1, np.int64)
        np.add.at(edge, kept, 1)
        np.add.at(edge, kept + GRAM, -1)
        inside = np.cumsum(edge[:-1]) > 0
        begins = inside & np.append(True, ~inside[:-1] | (group[1:] != group[:-1]))
        ends = inside & np.append(~inside[1:] | (group[1:] != group[:-1]), True)
        starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        finer = np.full(n, -1)
        finer[inside] = (np.cumsum(begins) - 1)[inside]
        long = (stops - starts) >= LEAST
        kept = kept[long[finer[kept]]]
        if len(kept) == len(at):
            return list(zip(starts[long].tolist(), stops[long].tolist(), strict=True))
        at, group = kept, finer
    return []


class Agreement:
    """How far two places of a sequence agree, from the ranks of prefix doubling; its last element must occur once."""

    def __init__(self, seq: np.ndarray) -> None:
        n = len(seq)
        order = np.argsort(seq, kind="stable")
        new = np.append(True, seq[order][1:] != seq[order][:-1])
        rank = np.empty(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        self.ranks, step = [rank.astype(np.int32)], 1
        open_ = order[~(new & np.append(new[1:], True))]
        while len(open_):
            key = rank[open_] * (n + 1) + np.where(open_ + step < n, rank[np.minimum(open_ + step, n - 1)] + 1, 0)
            by = np.argsort(key, kind="stable")
            open_, key = open_[by], key[by]
            new = np.append(True, key[1:] != key[:-1])
            at, old = np.arange(len(open_)), rank[open_]
            head = np.maximum.accumulate(np.where(np.append(True, old[1:] != old[:-1]), at, 0))
            rank = rank.copy()
            rank[open_] = old + np.maximum.accumulate(np.where(new, at, 0)) - head
            self.ranks.append(rank.astype(np.int32))
            open_ = open_[~(new & np.append(new[1:], True))]
            step *= 2
        self.order = np.empty(n, np.int64)
        self.order[rank] = np.arange(n)

    def forwards(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Of how many elements from i and j on are equal, for i != j."""
        far, last = np.zeros(len(i), np.int64), len(self.order) - 1
        for k in range(len(self.ranks) - 1, -1, -1):
            a, b = i + far, j + far
            far += np.where((a <= last) & (b <= last) & (self.ranks[k][np.minimum(a, last)] == self.ranks[k][np.minimum(b, last)]), 1 << k, 0)
        return far

    def backwards(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many elements just before i and j are equal, for i != j."""
        far = np.zeros(len(i), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            a, b = i - far - (1 << k), j - far - (1 << k)
            far += np.where((a >= 0) & (b >= 0) & (self.ranks[k][np.maximum(a, 0)] == self.ranks[k][np.maximum(b, 0)]), 1 << k, 0)
        return far


def previous_factors(agree: Agreement) -> tuple[list[int], list[int]]:
    """The length of the longest string that begins at a place and also earlier, and where it does (0, -1: nowhere)."""
    order, n = agree.order, len(agree.order)
    lcp = [0, *agree.forwards(order[:-1], order[1:]).tolist(), 0]
    rank, order = agree.ranks[-1].tolist(), [-1, *order.tolist(), -1]
    before, after, length, source = list(range(-1, n)), list(range(1, n + 2)), [0] * n, [-1] * n
    for i in range(n - 1, -1, -1):  # all later places are out of the list, so neighbours are earlier ones
        r = rank[i]
        a, b, up, down = before[r], after[r], lcp[r], lcp[after[r]]
        if up or down:
            length[i], source[i] = (up, order[a + 1]) if up >= down else (down, order[b + 1])
        lcp[b] = min(up, down)
        after[a], before[b] = b, a
    return length, source


def blocks(length: list[int], source: list[int]) -> tuple[list[int], list[int]]:
    """Starts of the LZ blocks, the end after them, and their earlier occurrences."""
    starts, sources, i = [], [], 0
    while i < len(length):
        starts.append(i)
        sources.append(source[i])
        i += max(1, length[i])
    return [*starts, i], sources


def main_extensions(agree: Agreement, starts: Sequence[int]) -> dict[tuple[int, int], int]:
    """(start, stop) -> period of the runs that touch a block's start and end before the block does, or at its end."""
    edge = np.array(starts)
    span = edge[2:] - edge[:-2]  # two blocks around each inner start
    # a run that ends in the second block begins less than a period before the first, so three periods leave 2 * period < span
    most = (span - 1) // 2
    most = np.where(most + span - 1 >= LEAST, most, 0)
    b = np.repeat(edge[1:-1], most)
    p = np.arange(len(b)) - np.repeat(np.cumsum(most) - most, most) + 1
    found: dict[tuple[int, int], int] = {}
    if len(agree.ranks) < 4 or not len(b):
        return found
    last, eight = len(agree.order) - 1, agree.ranks[3]
    for left in (b, b - p):  # the whole period lies after the start, or before it
        ok = (left >= 0) & (left + p <= last)
        i, j, q = left[ok], (left + p)[ok], p[ok]
        # 16 equal pairs are needed, so 8 to one side
        near = (eight[i] == eight[j]) | ((i >= 8) & (eight[np.maximum(i - 8, 0)] == eight[np.maximum(j - 8, 0)]))
        i, j, q = i[near], j[near], q[near]
        start, stop = i - agree.backwards(i, j), j + agree.forwards(i, j)
        good = stop - start >= np.maximum(LEAST, TIMES * q)
        for s, e, period in zip(start[good].tolist(), stop[good].tolist(), q[good].tolist(), strict=True):
            found[s, e] = min(period, found.get((s, e), period))
    return found


def copied(found: dict[tuple[int, int], int], starts: Sequence[int], sources: Sequence[int]) -> dict[tuple[int, int], int]:
    """Add the runs strictly inside a block, from the block's earlier occurrence."""
    known = dict(found)
    buckets = sorted(known)  # by start, then by stop
    for b, stop, source in zip(starts[:-1], starts[1:], sources, strict=True):
        if stop - b < LEAST + 2:
            continue
        moved, end = b - source, source + stop - b
        i = bisect_right(buckets, (source + 1, 0))
        while i < len(buckets) and buckets[i][0] < end:  # a block may overlap its source: what is added comes up later
            s, e = buckets[i]
            if e < end and (s + moved, e + moved) not in known:
                known[s + moved, e + moved] = known[s, e]
                insort(buckets, (s + moved, e + moved))
            i += 1
    return known


def runs_of(words: np.ndarray, group: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, stop, period) of all runs of a sequence, none across groups, by start and period."""
    parts = stretches(words, group)
    if not parts:
        return []
    n = int(words.max()) + 1
    pieces = [np.append(words[a:b], n + k) for k, (a, b) in enumerate(parts)]  # each followed by an element of its own
    agree = Agreement(np.concatenate(pieces))
    starts, sources = blocks(*previous_factors(agree))
    found = copied(main_extensions(agree, starts), starts, sources)
    heads = np.cumsum([0, *(len(x) for x in pieces)])
    out = []
    for (s, e), period in found.items():
        k = int(np.searchsorted(heads, s, side="right")) - 1
        shift = parts[k][0] - int(heads[k])
        out.append((s + shift, e + shift, period))
    return sorted(out, key=lambda r: (r[0], r[2]))


def _scan(texts: list[str]) -> tuple[list, list, list]:
    said = [t.encode().split() for t in texts]  # bytes.split() cuts at the six ASCII spaces
    sizes = np.array([len(w) for w in said])
    heads = np.cumsum(sizes) - sizes
    runs: list[list] = [[] for _ in texts]
    drop = [None] * len(texts)
    for s, e, period in runs_of(word_numbers([w for words in said for w in words]), np.repeat(np.arange(len(texts)), sizes)):
        d = int(np.searchsorted(heads, s, side="right")) - 1
        s, e = s - int(heads[d]), e - int(heads[d])
        runs[d].append({"start": s, "length": e - s, "period": period})
        if drop[d] is None:
            drop[d] = np.zeros(len(said[d]), bool)
        drop[d][s + period : e] = True
    kept = [w if x is None else [word for word, gone in zip(w, x.tolist(), strict=True) if not gone] for w, x in zip(said, drop, strict=True)]
    return sizes.tolist(), runs, [b" ".join(w).decode() for w in kept]


def find(docs: DataFrame, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of each row with n_words, its runs by start and period, and its words joined by a space without what runs repeat."""
    return map_texts(docs, lambda: _scan, MADE, keep)


def with_tails(docs: DataFrame) -> DataFrame:
    """doc_id and text; a tenth of the documents, chosen by hash, repeat one stretch of their words from some word to their end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (3 + g % 8))
        tail = F.slice(F.flatten(F.array_repeat(F.slice(words, (a + 1).cast("int"), p.cast("int")), F.ceil((n - a) / p).cast("int"))), F.lit(1), (n - a).cast("int"))
        return F.when(n > 0, F.array_join(F.concat(F.slice(words, F.lit(1), a.cast("int")), tail), " "))

    words = F.filter(F.split("text", SPACE), lambda w: w != "")
    return docs.select("doc_id", F.when(h % 10 == 0, F.coalesce(let(words, repeated), "text")).otherwise(F.col("text")).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """Number, best run (most periods, then the first) and hashes of the runs and of what is left of the text."""
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    better = lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.aggregate("runs", none, better).alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return rows.select("doc_id", "n_runs", "best.*", F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
