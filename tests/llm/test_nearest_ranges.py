"""Nearest neighbours of far away, very large and very small vectors, of repeated ids, and recall on many vectors, against exact answers."""

from __future__ import annotations

import numpy as np
import pytest

from folioscan.llm import ann


def exact(x, queries, k=10):
    return {i: set(np.lexsort((np.arange(len(x)), np.where(np.arange(len(x)) == i, np.inf, ((x - x[i]) ** 2).sum(1))))[:k].tolist()) for i in queries}


def found(spark, x, queries, **index):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").repartition(8)
    got = {}
    for r in ann.search(ann.build_index(df, **index), df.where(df.vec_id.isin(queries))).collect():
        got.setdefault(r["query_id"], {})[r["vec_id"]] = r["score"]
    return got


G = np.random.default_rng(4).normal(size=(1500, 16))


@pytest.mark.parametrize("kind, x", [("plain", G), ("shifted", G + 5000), ("huge", G * 1e19), ("tiny", G * 1e-19), ("two far groups", np.r_[G[:700] + 1e6, G[700:] - 1e6])])
def test_recall_does_not_depend_on_place_or_scale(spark, kind, x):
    x = x.astype(np.float32).astype(np.float64)
    asked = list(range(0, len(x), 50))
    want, got = exact(x, asked), found(spark, x, asked, shard_rows=800)
    assert set(got) == set(want) and all(len(v) == 10 for v in got.values())
    assert sum(len(want[q] & set(got[q])) for q in want) >= 0.97 * 10 * len(want)
    assert all(abs(s - np.sqrt(((x[q] - x[v]) ** 2).sum())) <= 1e-12 * s for q, near in got.items() for v, s in near.items())


def test_rows_that_repeat_an_id(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 0.5]), (2, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.search(ann.build_index(df), df.where("vec_id = 1")).collect())
    assert got == [(1, 1, 1, 0.0), (1, 2, 2, 0.5), (1, 3, 1, 1.0)]


def test_shards_grow_with_the_table():
    assert [ann._shards(n, 8192) for n in (0, 1, 8192, 8193, 64 * 8192, 128 * 8192, 1 << 30)] == [1, 1, 1, 2, 64, 64, (1 << 30) // 65536]


@pytest.mark.parametrize("n, width", [(8192, 128), (24_000, 64)])
def test_the_beam_follows_rows_and_width(n, width):
    """Gaussian vectors, the hardest kind; 24,000 rows are what a shard of a table of 1.5 million has."""
    x = ann.scaled(np.random.default_rng(n).normal(size=(n, width)))[0]
    edges, middle = ann.build_graph(x)
    beam = ann.measured_beam(x, edges, middle)
    assert beam > ann.BEAM
    asked = np.arange(3, n, n // 150)
    want, (got, _) = ann._nearest(x, x[asked], 11), ann.beam_search(x, edges, middle, x[asked], beam)
    hits = sum(len((set(w) - {i}) & set(g)) for w, g, i in zip(want.tolist(), got.tolist(), asked.tolist()))
    assert hits >= 0.92 * 10 * len(asked)


def test_points_that_a_graph_does_not_reach():
    """Where no beam is wide enough, all points are compared."""
    x = ann.scaled(np.random.default_rng(1).normal(size=(400, 8)))[0]
    edges = np.full((401, ann.DEGREE), -1, np.int32)
    assert ann.measured_beam(x, edges, 0) == 0


def test_an_id_that_a_third_of_the_rows_have(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 8))
    ids = [7 if i % 3 == 0 else i for i in range(3000)]
    df = spark.createDataFrame(list(zip(ids, x.tolist())), "vec_id long, embedding array<double>").repartition(5)
    index = ann.build_index(df, shard_rows=300)
    sizes = [len(r.ids) // 8 for r in index.select("ids").collect()]
    assert sum(sizes) == 3000 and max(sizes) < 420
    asked = [i for i in ids if i % 100 == 50]
    want = {i: sorted((float(np.sqrt(((x[j] - x[i]) ** 2).sum())), ids[j]) for j in range(3000) if j != i)[:10] for i in asked}
    got = {}
    for r in ann.search(index, df.where(df.vec_id.isin(asked)), query_bytes=1000).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.score, r.vec_id))
    hits = sum(len({round(d, 9) for d, _ in want[i]} & {round(d, 9) for _, d, _ in got[i]}) for i in asked)
    assert hits >= 0.97 * 10 * len(asked) and all(len(v) == 10 for v in got.values())


def test_vectors_whose_squares_are_out_of_range(spark):
    x = [[1e200, 0.0], [1.5e200, 0.0], [4e200, 1e200], [1e-200, 0.0]]
    df = spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<double>")
    got = [(r.vec_id, r.score) for r in ann.search(ann.build_index(df), df.where("vec_id = 0")).orderBy("rank").collect()]
    assert [v for v, _ in got] == [1, 3, 2] and np.allclose([s for _, s in got], [5e199, 1e200, np.hypot(3e200, 1e200)])
