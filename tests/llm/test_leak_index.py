"""The index of benchmark items: its size, how few items it proposes, what lies beyond its radius, and benchmarks in many parts."""

from __future__ import annotations

import numpy as np

from folioscan.llm import decontaminate
from folioscan.llm.decontaminate import Index, shingle_hashes, window_prints

RNG = np.random.default_rng(12)


def words(n):
    return [f"w{v}" for v in RNG.integers(0, 50_000, n)]


def test_an_item_costs_few_bytes_and_a_part_is_halved(spark):
    texts = [" ".join(words(12)) for _ in range(3000)]
    size = Index(list(enumerate(texts))).bytes() - Index([]).bytes()
    assert size < 12 * sum(map(len, texts))
    bench = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    parts = list(decontaminate.indexes(bench, index_bytes=Index([]).bytes() + size // 3))
    assert len(parts) > 3 and all(p.bytes() <= Index([]).bytes() + size // 3 for p in parts)
    assert sorted(i for p in parts for i in p.ids) == list(range(3000))


def test_few_windows_of_the_threshold_lie_beyond_the_radius():
    lost = seen = 0
    for _ in range(3000):
        n = int(RNG.integers(12, 150))
        item = words(n)
        copy = list(item)
        for k in RNG.choice(n, max(1, n // 45), replace=False):
            copy[k] = "changed"
        a, b = shingle_hashes(" ".join(item)), shingle_hashes(" ".join(copy))
        both = len(set(a.tolist()) & set(b.tolist()))
        if 0.8 <= both / (2 * len(a) - both) < 0.9:
            seen += 1
            pa, pb = (window_prints(h, np.array([0]), len(h))[0] for h in (a, b))
            lost += int(np.bitwise_count(pa ^ pb)) > decontaminate.RADIUS
    assert seen > 500 and lost <= 0.001 * seen


def test_windows_that_share_nothing_with_items_of_their_size_get_no_fingerprint(monkeypatch):
    items = [words(n) for n in range(20, 140)]
    index, made = Index([(k, " ".join(w)) for k, w in enumerate(items)]), []
    monkeypatch.setattr(decontaminate, "window_prints", lambda h, starts, size: made.append(len(starts)) or window_prints(h, starts, size))
    text = [*words(300), *items[110], *words(300)]  # windows of all lesser sizes lie within the passage
    found = index.matches(" ".join(text))
    assert [(i, first) for i, _, first in found] == [(110, 300)] and sum(made) < 60
    assert index.matches(" ".join([*words(20), *items[5], *words(20), *items[90][:-2]])) and [i for i, *_ in index.matches(" ".join(items[5] + items[90][:-2]))] == [5, 90]


def test_many_parts_see_only_documents_that_may_match(spark):
    items = [(k, " ".join(words(40))) for k in range(60)]
    texts = [" ".join(words(200)) for _ in range(40)] + [" ".join([*words(30), *t.split()[:38], *words(20)]) for _, t in items[:20]] + [items[3][1], None, "", items[5][1][:-30]]
    docs = spark.createDataFrame([(k, t, 1, "r", 7) for k, t in enumerate([*texts, texts[45]])], "doc_id long, text string, hits int, _row string, hashes int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    one, many = (sorted(tuple(r) for r in decontaminate.matches(docs, bench, part).collect()) for part in (1 << 20, 1000))
    assert one == many and {d for d, *_ in one} == {*range(40, 61), 63, 64}
    sieve = decontaminate.sieve(bench)
    assert [sieve.may_match(shingle_hashes(t or "")) for t in texts] == [False] * 40 + [True] * 21 + [False, False, True]
    kept = decontaminate.drop_leaks(docs, bench, 1000)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [*range(40), 61, 62]
    assert decontaminate.drop_leaks(docs, bench).exceptAll(kept).count() == 0
    assert decontaminate.drop_leaks(docs.where("doc_id < 40"), bench, 1000).count() == 40


def test_rows_without_an_id_and_repeated_rows_in_many_parts(spark):
    items = [(k, " ".join(words(30))) for k in range(40)]
    docs = spark.createDataFrame([(None, items[0][1]), (None, items[0][1]), (1, items[1][1]), (1, items[1][1]), (1, "clean"), (None, None), (1 << 60, items[2][1])], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((str(d), i) for d, i, *_ in decontaminate.matches(docs, bench, 800).collect())
    assert got == [("1", 1), ("1", 1), (str(1 << 60), 2), ("None", 0), ("None", 0)]
    assert sorted(map(tuple, decontaminate.drop_leaks(docs, bench, 800).collect()), key=str) == [(1, "clean"), (None, None)]


def test_a_repeated_row_of_the_benchmark_is_one_item(spark):
    rest = [(k, " ".join(words(30))) for k in range(20)]
    bench = spark.createDataFrame([(7, " ".join(map(str, range(40))))] * 4000 + rest, "item_id long, text string")
    parts = list(decontaminate.indexes(bench, part_bytes=1000))
    assert sum(len(p.ids) for p in parts) == 21 and max(len(p.ids) for p in parts) < 12
    docs = spark.createDataFrame([(3, " ".join(map(str, range(45))))], "doc_id long, text string")
    assert [(r["doc_id"], r["item_id"]) for r in decontaminate.matches(docs, bench, 1000).collect()] == [(3, 7)]


def test_each_text_is_asked_once_and_parts_are_sent_one_at_a_time(spark, monkeypatch):
    live, most, sc = set(), [], spark.sparkContext
    send = type(sc).broadcast

    def counted(self, value):
        shared = send(self, value)
        live.add(id(shared))
        most.append(len(live))
        drop = shared.destroy
        monkeypatch.setattr(shared, "destroy", lambda: (live.discard(id(shared)), drop()))
        return shared

    monkeypatch.setattr(type(sc), "broadcast", counted)
    items = [(k, " ".join(words(30))) for k in range(40)]
    docs = spark.createDataFrame([(k, t) for k, t in items], "doc_id long, text string")
    kept = decontaminate.drop_leaks(docs, spark.createDataFrame(items, "item_id long, text string"), 800)
    assert len(most) > 5 and max(most) == 1 and not live and kept.count() == 0
    assert "asked" not in kept._jdf.queryExecution().toString() and "ArrowEvalPython" not in kept._jdf.queryExecution().toString()
