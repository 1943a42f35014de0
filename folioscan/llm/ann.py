"""Approximate nearest neighbours by a robust-pruned directed graph.

Rows are dealt by hash into shards, also those of one id, and each shard gets a graph: points enter in random order, a greedy search from the middle
proposes neighbours, and pruning keeps a proposal only if no kept neighbour is nearer to it by the factor ``ALPHA``, so that edges point in many
directions. A query runs a beam search in each shard and the shards' best are merged. Graphs are built and searched on vectors moved to the middle of
their shard and scaled to it, in double precision and by differences, so that far away, very large or very small vectors lose nothing; distances that
count are computed from the original vectors.

How wide a beam has to be depends on how many vectors a shard holds, their width and how they lie. So each shard measures it when its graph is built: of ``PROBES`` of its own
points the nearest ``k`` are computed exactly, and the beam doubles until the search finds ``REACH`` of them; the index keeps it. A shard where that takes a beam of an
eighth of its points is searched without the graph.

Shards hold ``SHARD_ROWS`` vectors and, from 64 shards on, more with the table, up to ``MOST_ROWS``, so that a query visits few of them. Queries are sent to
all tasks in blocks of at most ``QUERY_BYTES``, one block after the other; each block reads the graphs once, and only what is found is written and shuffled.

Equal vectors in a shard are one point of the graph, with all their ids. Vectors that are null, all zero, or hold null or non-finite components, and
rows without an id, take no part; vectors are compared with vectors of their own length only. Rows with one id are one candidate each; as queries,
the least of their vectors counts, and of the rows with its id only one that holds that vector is not a candidate. Ties go to the smaller id. Columns other
than vec_id and embedding are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscan.llm.common import stage

SHARD_ROWS, MOST_ROWS, QUERY_BYTES, DEGREE, BUILD_BEAM, BEAM, ALPHA = 8192, 65536, 32 << 20, 28, 48, 48, 1.2
PROBES, REACH = 200, 0.95
INDEX = "dim int, shard long, ids binary, owner binary, vectors binary, edges binary, middle int, beam int"


def scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Vectors around their middle, within -1 and 1; that middle and the scale."""
    middle = x.mean(0) if len(x) else 0.0
    x = x - middle
    return x / (size := float(np.abs(x).max(initial=0.0)) or 1.0), middle, size


def _distances(x: np.ndarray, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Squared distances of each query to its row of ids."""
    apart = x[ids] - q[:, None, :]
    return np.einsum("nkd,nkd->nk", apart, apart)


def beam_search(x: np.ndarray, edges: np.ndarray, middle: int, q: np.ndarray, beam: int, at_once: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """For a batch of queries, all moved on in step: the ``beam`` nearest points found, nearest first, and their distances; -1 where there are none."""
    n, rows = len(q), np.arange(len(q))[:, None]
    seen = np.zeros((n, len(x) + 1), bool)  # the last column takes the place of no edge
    seen[:, [middle, -1]] = True
    ids = np.full((n, beam), -1)
    far = np.full((n, beam), np.inf)
    ids[:, 0], far[:, :1] = middle, _distances(x, q, np.full((n, 1), middle))
    opened = np.ones((n, beam), bool)
    opened[:, 0] = False
    while not opened.all():
        # the nearest few that are not opened yet; ids come sorted by distance
        turn = np.cumsum(~opened, 1)
        pick = ~opened & (turn <= at_once)
        where = np.argsort(~pick, 1, kind="stable")[:, :at_once]
        chosen = np.where(np.take_along_axis(pick, where, 1), np.take_along_axis(ids, where, 1), -1)
        opened |= pick
        next_ids = np.where(chosen[:, :, None] >= 0, edges[chosen], -1).reshape(n, -1)
        next_ids[seen[rows, next_ids]] = -1
        # a point proposed twice counts once
        order = np.sort(next_ids, 1)
        order[:, 1:][order[:, 1:] == order[:, :-1]] = -1
        seen[rows, order] = True
        keep = int((order >= 0).sum(1).max())
        if not keep:
            continue
        order = np.sort(order, 1)[:, -keep:]
        d = _distances(x, q, order)
        d[order < 0] = np.inf
        all_ids, all_far = np.concatenate((ids, order), 1), np.concatenate((far, d), 1)
        all_opened = np.concatenate((opened, order < 0), 1)
        best = np.argsort(all_far, 1, kind="stable")[:, :beam]
        ids, far, opened = (np.take_along_axis(a, best, 1) for a in (all_ids, all_far, all_opened))
    return np.where(np.isfinite(far), ids, -1), far


def prune(x: np.ndarray, points: np.ndarray, proposals: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each point at most ``degree`` of its proposals (-1: none), nearest first, none of them much nearer to a kept one than to the point."""
    proposals = np.where((proposals == points[:, None]), -1, proposals)
    ordered = np.sort(proposals, 1)
    ordered[:, 1:][ordered[:, 1:] == ordered[:, :-1]] = -1
    c = x[ordered] - x[points][:, None, :]
    squares = np.einsum("nkd,nkd->nk", c, c)
    own = np.where(ordered < 0, np.inf, squares)
    between = squares[:, :, None] + squares[:, None, :] - 2 * np.matmul(c, c.transpose(0, 2, 1))
    alive = np.isfinite(own)
    out, rows = np.full((len(points), degree), -1), np.arange(len(points))
    for k in range(degree):
        first = np.where(alive, own, np.inf).argmin(1)
        some = alive[rows, first]
        if not some.any():
            break
        out[some, k] = ordered[rows, first][some]
        alive &= ~(alpha**2 * between[rows, first] <= own) & some[:, None]
        alive[rows, first] = False
    return out


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, batch: int = 256, seed: int = 3) -> tuple[np.ndarray, int]:
    """(edges, middle): edges[i] are the points that point i leads to, -1 where it has fewer."""
    n = len(x)
    edges = np.full((n + 1, degree), -1, np.int32)
    middle = int(np.argmin(((x - x.mean(0)) ** 2).sum(1)))
    rng = np.random.default_rng(seed)
    order = rng.permutation(n)
    order = np.r_[middle, order[order != middle]]
    done, size = 1, 8
    while done < n:
        own = order[done : done + size]
        found, _ = beam_search(x, edges, middle, x[own], beam)
        # points that enter together see each other too
        mates = own[rng.integers(0, len(own), (len(own), 8))]
        edges[own] = prune(x, own, np.concatenate((found, mates), 1), degree, alpha)
        source, target = np.repeat(own, degree), edges[own].ravel()
        source, target = source[target >= 0], target[target >= 0]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        heads, first, count = np.unique(target, return_index=True, return_counts=True)
        fresh = np.full((len(heads), int(count.max(initial=1))), -1)
        fresh[np.repeat(np.arange(len(heads)), count), np.arange(len(target)) - np.repeat(first, count)] = source
        have = (edges[heads] >= 0).sum(1)
        roomy = have + count <= degree
        for h, f, k, c in zip(heads[roomy], fresh[roomy], have[roomy], count[roomy], strict=True):
            edges[h, k : k + c] = f[:c]
        full = np.flatnonzero(~roomy)
        for i in range(0, len(full), batch):
            part = full[i : i + batch]
            edges[heads[part]] = prune(x, heads[part], np.concatenate((edges[heads[part]], fresh[part]), 1), degree, alpha)
        done += len(own)
        size = min(batch, 2 * size)
    return edges, middle


def _nearest(x: np.ndarray, q: np.ndarray, k: int, block: int = 1 << 22) -> np.ndarray:
    """The ``k`` nearest points of each query, by comparing all; -1 where there are fewer."""
    out, rows = np.full((len(q), k), -1), max(1, block // max(1, x.size))
    for i in range(0, len(q), rows):
        apart = x[None] - q[i : i + rows, None]
        far = np.einsum("nkd,nkd->nk", apart, apart)
        some = np.argpartition(far, min(k, len(x)) - 1, 1)[:, :k]
        out[i : i + rows, : some.shape[1]] = np.take_along_axis(some, np.argsort(np.take_along_axis(far, some, 1), 1, kind="stable"), 1)
    return out


def measured_beam(x: np.ndarray, edges: np.ndarray, middle: int, k: int = 10, probes: int = PROBES, reach: float = REACH) -> int:
    """The least of BEAM, twice that and so on with which the search finds ``reach`` of the ``k`` nearest others of some points; 0 if that is an eighth of all points."""
    own = np.unique(np.linspace(0, len(x) - 1, min(probes, len(x))).astype(int))
    want = [set(w) - {i, -1} for w, i in zip(_nearest(x, x[own], k + 1).tolist(), own.tolist(), strict=True)]
    beam = BEAM
    while beam < len(x) / 8:
        found, _ = beam_search(x, edges, middle, x[own], max(beam, k + 1))
        if sum(len(w & set(f)) for w, f in zip(want, found.tolist(), strict=True)) >= reach * sum(map(len, want)):
            return beam
        beam *= 2
    return 0


def _valid(embedding: Column) -> Column:
    bad = F.exists(embedding, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return embedding.isNotNull() & ~bad & F.exists(embedding, lambda v: v != 0)


def _rows(vectors: DataFrame) -> DataFrame:
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    return rows.where(F.col("vec_id").isNotNull() & F.coalesce(_valid(F.col("v")), F.lit(False))).withColumn("dim", F.size("v"))


def _shards(rows: int, shard_rows: int) -> int:
    return max(1, math.ceil(rows / min(max(shard_rows, rows // 64), max(shard_rows, MOST_ROWS))))


def build_index(vectors: DataFrame, shard_rows: int = SHARD_ROWS, k: int = 10) -> DataFrame:
    """One row per shard, staged: ids, vectors and graph as bytes, and the beam that finds ``k`` neighbours."""
    rows = _rows(vectors)
    sizes = {r["dim"]: r["n"] for r in rows.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # one row per length of vector
    parts = F.element_at(F.create_map(*(F.lit(v) for d, n in sizes.items() for v in (d, _shards(n, shard_rows)))), F.col("dim")) if sizes else F.lit(1)

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("vec_id", kind="stable")
        points, owner = np.unique(np.stack(rows["v"].to_list()), axis=0, return_inverse=True)
        small = scaled(points)[0]
        edges, middle = build_graph(small)
        return pd.DataFrame([(rows["dim"].iloc[0], rows["shard"].iloc[0], rows["vec_id"].to_numpy(np.int64).tobytes(), owner.astype(np.int64).tobytes(), points.astype(np.float64).tobytes(), edges.tobytes(), middle, measured_beam(small, edges, middle, k))], columns=["dim", "shard", "ids", "owner", "vectors", "edges", "middle", "beam"])

    # by row: also an id that very many rows have is in all shards
    return stage(rows.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), parts)).groupBy("dim", "shard").applyInPandas(build, INDEX), "graphs")


def _apart(points: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """Euclidean distances; differences are scaled, so that their squares are within range."""
    apart = points - vector
    size = np.abs(apart).max(1, initial=0.0)[:, None]
    size = np.where((size > 1e150) | (size < 1e-150) & (size > 0), size, 1.0)
    return np.sqrt(((apart / size) ** 2).sum(1)) * size[:, 0]


def _search_shard(g: pd.Series, asked: np.ndarray, at: np.ndarray, k: int, beam: int | None) -> pd.DataFrame:
    """(query_id, vec_id, score): the ``k`` nearest that the search of one shard finds of each query, and one more, as the query itself may be among them."""
    out = []
    ids, owner = np.frombuffer(g["ids"], np.int64), np.frombuffer(g["owner"], np.int64)
    points = np.frombuffer(g["vectors"]).reshape(-1, int(g["dim"]))
    small, middle, size = scaled(points)
    edges = np.frombuffer(g["edges"], np.int32).reshape(-1, DEGREE)
    by = np.argsort(owner, kind="stable")
    first = np.searchsorted(owner[by], np.arange(len(points) + 1))
    beam = int(g["beam"]) if beam is None else beam
    for i in range(0, len(asked), 256):
        q = at[i : i + 256]
        moved = (q - middle) / size
        found = beam_search(small, edges, int(g["middle"]), moved, max(beam, k + 1))[0] if beam else _nearest(small, moved, k + 1)
        for own, vector, near in zip(asked[i : i + 256].tolist(), q, found, strict=True):
            near = near[near >= 0]
            exact, hits = _apart(points[near], vector), []
            for d, p in sorted(zip(exact.tolist(), near.tolist(), strict=True)):
                held = ids[by[first[p] : first[p + 1]]]  # in order, as ids are sorted
                hits += [(d, v) for v in held[: k + 1].tolist()]
                if len(hits) > k + 1 and hits[k + 1][0] < d:
                    break
            out += [(own, v, d) for d, v in sorted(hits)[: k + 1]]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])


def search(index: DataFrame, queries: DataFrame, k: int = 10, beam: int | None = None, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each query among all rows but its own; ties go to the smaller id.

    ``beam``: unless given, what each shard has measured.
    """
    asked = stage(_rows(queries).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v")), "queries")
    blocks = max(1, math.ceil((asked.agg(F.sum(8.0 * (F.col("dim") + 1))).first()[0] or 0) / query_bytes))
    sc, found = index.sparkSession.sparkContext, None

    def finder(shared: Broadcast) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for graphs in batches:
                for _, g in graphs.iterrows():
                    if int(g["dim"]) in shared.value:
                        yield _search_shard(g, *shared.value[int(g["dim"])], k, beam)

        return run

    for b in range(blocks):
        block: dict[int, list] = {}
        for r in asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).orderBy("vec_id").collect():  # about query_bytes of vectors
            block.setdefault(r["dim"], []).append((r["vec_id"], r["v"]))
        shared = sc.broadcast({dim: (np.array([i for i, _ in own], np.int64), np.array([v for _, v in own])) for dim, own in block.items()})
        more = index.mapInPandas(finder(shared), "query_id long, vec_id long, score double")
        if blocks > 1:  # done before the next block is sent
            more = stage(more, "found")
            shared.unpersist()
        found = more if found is None else found.union(more)
    order = W.partitionBy("query_id").orderBy("score", "vec_id")
    first = found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    # of what a query's own row and rows just like it have found, one goes
    own = (F.col("vec_id") == F.col("query_id")) & (F.col("score") == 0)
    others = first.withColumn("own", F.row_number().over(W.partitionBy("query_id", own).orderBy("n"))).where(~own | (F.col("own") > 1))
    return others.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
