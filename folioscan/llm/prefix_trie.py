"""The trie of all conversations' prefixes.

A numpy scan gives each turn a polynomial rolling fingerprint of its conversation up to there: the sum of hash(turn i) * base ** i, modulo two primes. The scan
runs over segments of ``SEGMENT`` turns, so no conversation has to fit in one task; segment totals are added afterwards. Prefixes of one depth and one
fingerprint are a candidate group. Its representative is its smallest conversation, and every member is held against it turn by turn: whole role and text of
the last turn, and the group of the prefix before it. By induction over the depth members then agree in all turns. Members that differ are split off under
a new mark, which their longer prefixes inherit, and what was split off is verified again until no group holds two kinds.

A node is owned by its smallest member, and the nodes a conversation owns are the last ones of its path. So a sum over a subtree is the sum, over the
members of its top, of what each of them owns from that depth on: suffix sums along conversations and one aggregation, however deep the trie is.

Turns are ordered by turn, null first, then by role and text; repeated rows are turns of their own. Null roles and texts are empty. Rows without conv_id belong to
no conversation and are left out. Conversations without turns end at the root. Very long texts are compared whole. Columns other than these four are not
looked at. An empty table has no nodes, not even a root.

Hot keys: places come from a range sort that splits a conversation over tasks, groups are summed before they are shuffled, joins are by (conversation, depth)
or (conversation, segment), and nodes with very many children go to their children by a broadcast of at most ``HOT`` rows. The ids that end at one node are
joined in pieces of ``PIECE`` ids; only hashing the pieces, which SHA-256 must do in order, is one stream in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscan.llm.common import stage

SEGMENT, PIECE_BITS, HOT = 1024, 10, 10_000
PIECE = 1 << PIECE_BITS
PRIMES, BASES = (2147483647, 2147483629), (911382323, 972663749)
KEY = ["depth", "fp", "mark"]


def _rank(new: np.ndarray) -> np.ndarray:
    """Place of each row within its group, where ``new`` is set for rows that begin one; row 0 counts as such."""
    at = np.arange(len(new))
    return at - np.maximum.accumulate(np.where(new, at, 0))


def number(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, role, text): turns numbered from 0, staged. A long conversation is numbered over as many tasks as its rows are dealt to."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for b in batches:
            if not b.num_rows:
                continue
            conv = b.column(0).to_numpy()
            rank = _rank(np.append(True, conv[1:] != conv[:-1]))
            if conv[0] == last:
                ends = np.flatnonzero(conv != last)
                rank[: ends[0] if len(ends) else None] += seen
            last, seen = conv[-1], rank[-1] + 1
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rank, pa.int64()), b.column(1), b.column(2), pa.array(np.full(len(rank), part), pa.int32())], names=["conv_id", "place", "role", "text", "part"])

    said = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    order = ["conv_id", "turn", "role", "text", "row"]  # the row spreads what is repeated very often
    ordered = said.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "role", "text")
    rows = stage(ordered.mapInArrow(count, "conv_id long, place long, role string, text string, part int"), "numbered")
    counts = rows.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    # at most one row a task: the conversation that its first rows continue
    before = counts.select("conv_id", "part", F.sum("n").over(W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)).alias("before")).where("before > 0")
    return rows.join(F.broadcast(before), ["conv_id", "part"], "left").select("conv_id", (F.col("place") + F.coalesce("before", F.lit(0))).alias("place"), "role", "text")


def lengths(turns: DataFrame) -> DataFrame:
    """(conv_id, n) of every conversation with turns."""
    return turns.groupBy("conv_id").agg(F.count("*").alias("n"))


def rebuilt(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """(conv_id, place, role, text): the first h turns of conversation c - c % 5, then c's own turns after its first h; h = crc32(c) % 9."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    bases = ids.where("conv_id % 5 = 0").select(F.col("conv_id").alias("base"), F.least("n", F.lit(8)).alias("lent"))
    each = ids.select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % 5).alias("base")).join(bases, "base", "left").withColumn("lent", F.coalesce(F.least("lent", "h"), F.lit(0)))
    first = turns.where("place < 8 and conv_id % 5 = 0").select(F.col("conv_id").alias("base"), "place", "role", "text")
    lent = each.where("lent > 0").select("conv_id", "base", "lent").join(first, "base").where("place < lent").select("conv_id", "place", "role", "text")
    segments = each.where("n > h").select("conv_id", (F.col("h") - F.col("lent")).alias("back"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / SEGMENT))).alias("segment"))
    own = turns.where(F.col("place") >= h).withColumn("segment", F.floor(F.col("place") / SEGMENT)).join(segments, ["conv_id", "segment"])
    return lent.union(own.select("conv_id", (F.col("place") - F.col("back")).alias("place"), "role", "text"))


def fingerprints(turns: DataFrame, primes: Sequence[int] = PRIMES) -> DataFrame:
    """The turns with depth, fp of the prefix that they end and prev, that of the prefix before; staged."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = []
        for p, base in zip(primes, BASES, strict=True):
            x = np.ones(SEGMENT, np.int64)
            for i in range(1, SEGMENT):
                x[i] = x[i - 1] * (base % p) % p
            powers.append(x)
        last, carry = None, [0, 0]
        for b in batches:
            if not b.num_rows:
                continue
            conv, place, h = (b.column(i).to_numpy() for i in range(3))
            segment, within = place // SEGMENT, place % SEGMENT
            new = np.append(True, (conv[1:] != conv[:-1]) | (segment[1:] != segment[:-1]))
            began = np.flatnonzero(new)
            of = np.cumsum(new) - 1
            out = []
            for k, (p, base) in enumerate(zip(primes, BASES, strict=True)):
                kinds, which = np.unique(segment, return_inverse=True)
                shift = np.array([pow(base, int(s) * SEGMENT, p) for s in kinds], np.int64)[which]
                term = ((h >> k) % p) * powers[k][within] % p * shift % p
                total = np.cumsum(term)
                sums = total - (total - term)[began][of]
                if last == (conv[0], segment[0]):
                    sums[of == 0] += carry[k]
                sums %= p
                carry[k] = int(sums[-1])
                out += [sums, term]
            last = (conv[-1], segment[-1])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), b.column(4), *(pa.array(x) for x in out)], names=["conv_id", "place", "role", "text", "r1", "t1", "r2", "t2"])

    segment = F.floor(F.col("place") / SEGMENT)
    dealt = turns.select("conv_id", "place", F.xxhash64("role", "text").alias("h"), "role", "text").repartition("conv_id", segment).sortWithinPartitions("conv_id", "place")
    rows = stage(dealt.mapInArrow(scan, "conv_id long, place long, role string, text string, r1 long, t1 long, r2 long, t2 long"), "scanned").withColumn("segment", segment)
    # only a full segment has another after it
    full = rows.where(F.col("place") % SEGMENT == SEGMENT - 1).select("conv_id", (F.col("segment") + 1).alias("segment"), "r1", "r2")
    far = W.partitionBy("conv_id").orderBy("segment")
    carry = full.select("conv_id", "segment", F.sum("r1").over(far).alias("c1"), F.sum("r2").over(far).alias("c2"))
    late = rows.where("segment > 0").join(carry, ["conv_id", "segment"])
    both = rows.where("segment = 0").withColumns({"c1": F.lit(0).cast("long"), "c2": F.lit(0).cast("long")}).unionByName(late)

    def joined(a: str, b: str) -> F.Column:
        x, y = (F.pmod(F.expr(e), F.lit(p)) for e, p in zip((a, b), primes, strict=True))
        return F.shiftleft(x, 31).bitwiseOR(y)

    depth = (F.col("place") + 1).alias("depth")
    return both.select("conv_id", depth, joined("r1 + c1", "r2 + c2").alias("fp"), joined("r1 + c1 - t1", "r2 + c2 - t2").alias("prev"), "role", "text")


def grouped(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, kinds): ``rows`` with mark and prev_mark, such that (depth, fp, mark) names exactly one prefix, and the one kind of each such group.

    The kinds of a group are the distinct (group of the prefix before, role, text) of its members; the representative's is the one with the smallest conversation.
    """
    zero = F.lit(0).cast("long")
    rows, turn = rows.withColumns({"mark": zero, "prev_mark": zero}), 0
    while True:
        kind = [*KEY, "prev", "prev_mark", "role", "text"]
        whole = rows.groupBy(*kind).agg(F.min("conv_id").alias("rep"), F.count("*").alias("n_convs"))
        kinds = stage(whole.withColumn("bytes", F.octet_length("text").cast("long")).drop("role", "text"), "kinds")
        several = kinds.groupBy(*KEY).agg(F.min("rep").alias("first"), F.count("*").alias("kinds")).where("kinds > 1")
        if several.isEmpty():
            return rows, kinds
        turn += 1
        odd = whole.join(several, KEY).where("rep != first").select(*kind)
        mark = F.shiftrightunsigned(F.xxhash64(F.lit(turn), *KEY), 24) + 1
        odd = stage(rows.join(odd, kind, "left_semi").select("conv_id", "depth", mark.alias("own")), "odd")
        path = W.partitionBy("conv_id").orderBy("depth")
        moved = rows.join(odd.select("conv_id").distinct(), "conv_id", "left_semi").join(odd, ["conv_id", "depth"], "left")
        moved = moved.withColumn("mark", F.col("mark") + F.sum(F.coalesce("own", zero)).over(path)).withColumn("prev_mark", F.coalesce(F.lag("mark").over(path), zero)).drop("own")
        rows = stage(rows.join(odd.select("conv_id").distinct(), "conv_id", "left_anti").unionByName(moved), "prefixes")


def _from_parents(nodes: DataFrame, total: int) -> DataFrame:
    """(depth, fp, mark, parent_conv_id) of nodes below the root. Parents of over a ten-thousandth of the nodes, so at most ``HOT``, are broadcast."""
    at = ["up_depth", "prev", "prev_mark"]
    parents = nodes.where("n_children > 0").select(F.col("depth").alias("up_depth"), F.col("fp").alias("prev"), F.col("mark").alias("prev_mark"), F.col("rep").alias("parent_conv_id"), "n_children")
    below = nodes.where("depth > 0").withColumn("up_depth", F.col("depth") - 1).select(*KEY, *at)
    many = F.col("n_children") > max(total / HOT, 1000)
    hot = F.broadcast(parents.where(many).drop("n_children"))
    rest = below.join(F.broadcast(parents.where(many).select(*at)), at, "left_anti").join(parents.where(~many).drop("n_children"), at)
    return below.join(hot, at).unionByName(rest).select(*KEY, "parent_conv_id")


def _suffix_sums(rows: DataFrame, owned: DataFrame) -> DataFrame:
    """``rows`` (conv_id and a key) with what their conversation owns from that depth on: kept and leaves."""
    segment = F.floor(F.col("depth") / SEGMENT).alias("segment")
    each = stage(rows.join(owned, ["conv_id", "depth"], "left").select("conv_id", *KEY, segment, F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("leaf", F.lit(0)).alias("leaf")), "owned")
    down = W.partitionBy("conv_id", "segment").orderBy(F.desc("depth"))
    later = W.partitionBy("conv_id").orderBy(F.desc("segment")).rowsBetween(W.unboundedPreceding, -1)
    sums = each.groupBy("conv_id", "segment").agg(F.sum("kept").alias("kept"), F.sum("leaf").alias("leaf"))
    carry = sums.select("conv_id", "segment", F.sum("kept").over(later).alias("more_kept"), F.sum("leaf").over(later).alias("more_leaf")).where("more_kept > 0 or more_leaf > 0")
    local = each.select("conv_id", "segment", *KEY, F.sum("kept").over(down).alias("kept"), F.sum("leaf").over(down).alias("leaf"))
    return local.join(carry, ["conv_id", "segment"], "left").select(*KEY, (F.col("kept") + F.coalesce("more_kept", F.lit(0))).alias("kept"), (F.col("leaf") + F.coalesce("more_leaf", F.lit(0))).alias("leaf"))


def _end_hashes(rows: DataFrame) -> DataFrame:
    """(depth, fp, mark, ends_sha256): of the ids, ascending and comma-joined, of the conversations that end at a node."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        made = lambda key, state: pa.RecordBatch.from_arrays([*(pa.array([k], pa.int64()) for k in key), pa.array([state.hexdigest()])], names=[*KEY, "ends_sha256"])
        for b in batches:
            for *own, ids in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if own != key:
                    if state:
                        yield made(key, state)
                    key, state = own, hashlib.sha256(ids.encode())
                else:
                    state.update(f",{ids}".encode())
        if state:
            yield made(key, state)

    last = rows.groupBy("conv_id").agg(F.max(F.struct(*KEY)).alias("at")).select("at.*", "conv_id")
    order = [*KEY, "conv_id"]
    placed = stage(last.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("piece", F.shiftright(F.monotonically_increasing_id(), PIECE_BITS)), "ends")
    pieces = placed.groupBy(*KEY, "piece").agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    return pieces.repartition(*KEY).sortWithinPartitions(*KEY, "piece").select(*KEY, "ids").mapInArrow(hashed, "depth long, fp long, mark long, ends_sha256 string")


def trie(turns: DataFrame, ids: DataFrame, primes: Sequence[int] = PRIMES) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns``: conv_id, place from 0 without gaps, role, text, none null; ``ids``: conv_id of every conversation, those without turns too.
    A node is the first ``depth`` turns of conversation ``conv_id``, its smallest member.
    """
    zero, none = F.lit(0).cast("long"), F.lit("")
    top = ids.select("conv_id", zero.alias("depth"), zero.alias("fp"), zero.alias("prev"), none.alias("role"), none.alias("text"))
    rows, kinds = grouped(fingerprints(turns, primes).union(top))
    children = kinds.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("prev").alias("fp"), F.col("prev_mark").alias("mark")).agg(F.count("*").alias("n_children"))
    nodes = stage(kinds.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", zero)), "nodes")
    owned = nodes.select(F.col("rep").alias("conv_id"), "depth", ((F.col("n_convs") - 1) * F.col("bytes")).alias("kept"), (F.col("n_children") == 0).cast("long").alias("leaf"))
    below = _suffix_sums(rows.select("conv_id", *KEY), owned).groupBy(*KEY).agg(F.sum("leaf").alias("n_leaves"), F.sum("kept").alias("saved_tokens"))
    whole = nodes.join(below, KEY).join(_from_parents(nodes, nodes.count()), KEY, "left").join(_end_hashes(rows.select("conv_id", *KEY)), KEY, "left")
    ends = F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")
    return whole.select(F.col("rep").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", ends)


def with_turns(nodes: DataFrame, turns: DataFrame) -> DataFrame:
    """The nodes with role and text of their last turn, null at the root."""
    said = turns.select("conv_id", (F.col("place") + 1).alias("depth"), "role", "text")
    return nodes.join(said, ["conv_id", "depth"], "left")


def of_conversations(conversations: DataFrame) -> DataFrame:
    """The trie of a table of turns as it is."""
    turns = number(conversations)
    return trie(turns, lengths(turns))


def of_rebuilt(conversations: DataFrame) -> DataFrame:
    """The trie of conversations that begin with turns of another (``rebuilt``)."""
    turns = number(conversations)
    ids = stage(lengths(turns), "ids")
    return trie(rebuilt(turns, ids), ids)
