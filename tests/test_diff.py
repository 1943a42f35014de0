"""Changes between texts against a plain patience diff and, where lines do not repeat, against the standard library's."""

from __future__ import annotations

import difflib
import random
import time
from bisect import bisect_left
from collections import Counter

from pyspark.sql import functions as F

from folioscan.plans import diff

SHAPE = "pair_id long, old_text string, new_text string"


def chain(matches):
    """The longest rising chain, by trying every predecessor; of several, that of the patience rule."""
    ends, at, before = [], [], []
    for k, (_, j) in enumerate(matches):
        n = bisect_left(ends, j)
        before.append(at[n - 1] if n else -1)
        ends[n : n + 1], at[n : n + 1] = [j], [k]
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(matches[k])
        k = before[k]
    return out[::-1]


def matched(a, b, gap):
    """Matches inside one gap by the first step that finds some."""
    (a1, a2), (b1, b2) = gap
    x, y = range(a1, a2), range(b1, b2)
    ca, cb = Counter(a[i] for i in x), Counter(b[j] for j in y)
    where = {b[j]: j for j in y}
    if once := [(i, where[a[i]]) for i in x if ca[a[i]] == 1 and cb[a[i]] == 1]:
        return 0, chain(once)
    k = 0
    while k < min(len(x), len(y)) and a[a1 + k] == b[b1 + k]:
        k += 1
    if k:
        return 1, [(a1 + m, b1 + m) for m in range(k)]
    while k < min(len(x), len(y)) and a[a2 - 1 - k] == b[b2 - 1 - k]:
        k += 1
    if k:
        return 2, [(a2 - k + m, b2 - k + m) for m in range(k)]
    seen, places = Counter(), {}
    for j in y:
        seen[b[j]] += 1
        places[b[j], seen[b[j]]] = j
    seen, found = Counter(), []
    for i in x:
        seen[a[i]] += 1
        if (a[i], seen[a[i]]) in places:
            found.append((i, places[a[i], seen[a[i]]]))
    return 3, chain(found)


def plain(old, new):
    a, b = (old or "").splitlines(), (new or "").splitlines()
    todo, out = [((0, len(a)), (0, len(b)))], []
    while todo:
        gap = todo.pop()
        (a1, a2), (b1, b2) = gap
        if a1 == a2 or b1 == b2:
            continue
        _, found = matched(a, b, gap)
        if not found:
            x, y = "\n".join(a[a1:a2]), "\n".join(b[b1:b2])
            if x.strip() and y.strip() and x.strip() != y.strip():
                out.append((a1, x, y))
            continue
        edges = [(a1 - 1, b1 - 1), *found, (a2, b2)]
        todo += [((i + 1, k), (j + 1, m)) for (i, j), (k, m) in zip(edges, edges[1:])]
    return [(x, y) for _, x, y in sorted(out)][:30]


def got(spark, pairs):
    df = diff.changes(spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], SHAPE))
    out = [[] for _ in pairs]
    for r in df.orderBy("pair_id", "n").collect():
        assert r.n == len(out[r.pair_id])
        out[r.pair_id].append((r.old, r.new))
    return out


def test_texts_with_repeated_lines(spark):
    rng = random.Random(6)
    pairs = [("a", None), (None, None), ("", "x"), ("a\n\nb", "a\nnew\nb"), ("q\nr", "q\n r "), ("a\r\nb\x0bc d", "a\nB\nc\nD\n"), ("x\n" * 50, "x\n" * 40)]
    for letters in (2, 4, 30):
        for _ in range(60):
            a = [rng.choice("abcdefghijklmnopqrstuvwxyz    "[:letters]) for _ in range(rng.randint(0, 30))]
            b = list(a)
            for _ in range(rng.randint(0, 6)):
                k = rng.randint(0, len(b))
                b[k : k + rng.randint(0, 3)] = [rng.choice("abcdefghijklmnopqrstuvwxyz    "[:letters]) + rng.choice(["", "+"]) for _ in range(rng.randint(0, 3))]
            pairs.append(("\n".join(a), "\n".join(b)))
    assert got(spark, pairs) == [plain(*p) for p in pairs]


def test_lines_that_do_not_repeat(spark):
    rng = random.Random(7)
    pairs, want = [], []
    for _ in range(40):
        a = [f"line {k}" for k in range(rng.randint(1, 200))]
        b = [x for x in a if rng.random() > 0.1]
        for _ in range(rng.randint(0, 60)):
            k = rng.randint(0, len(b))
            b[k : k + rng.randint(0, 2)] = [f"new {rng.random()}"]
        pairs.append(("\n".join(a), "\n".join(b)))
        ops = difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes()
        want.append([("\n".join(a[i:j]), "\n".join(b[k:m])) for kind, i, j, k, m in ops if kind == "replace"][:30])
    assert got(spark, pairs) == want


def test_moved_blocks(spark):
    a = [f"l{k}" for k in range(40)]
    moved = a[20:30] + ["between"] + a[:20] + a[30:]
    assert got(spark, [("\n".join(a), "\n".join(moved))]) == [plain("\n".join(a), "\n".join(moved))]


def test_ids_need_not_be_unique(spark):
    pairs = spark.createDataFrame([(1, "a\nb", "a\nc"), (1, "a\nb", "a\nc"), (None, "x", "y")], SHAPE)
    assert sorted((str(r.pair_id), r.n, r.old, r.new) for r in diff.changes(pairs).collect()) == [("1", 0, "b", "c"), ("1", 0, "b", "c"), ("None", 0, "x", "y")]
    assert diff.changes(spark.createDataFrame([], SHAPE)).collect() == []


def test_a_million_lines(spark):
    """Every line stands a few times, a third of them are blank, and blocks are moved, dropped and edited."""
    k = F.col("id")
    old = spark.range(1_000_000).select(F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("line "), (k % 700_000).cast("string"))).alias("line"), k)
    whole = old.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "line"))), lambda x: x["line"]), "\n").alias("old_text"))
    edited = F.array_join(F.transform(F.split("old_text", "\n"), lambda x, n: F.when(n % 50_000 == 7_000, F.concat(x, F.lit(" edited"))).otherwise(x)), "\n")
    began = time.time()
    found = diff.changes(whole.select(F.lit(1).alias("pair_id"), "old_text", edited.alias("new_text"))).collect()
    assert len(found) == 13 and all(r.new == f"{r.old} edited" for r in found)  # blank lines of old are no change
    assert time.time() - began < 120


def test_clipped(spark):
    text = "  a\n\t b　c\x1c " + "d" * 400
    assert spark.createDataFrame([(text,)], "t string").select(diff.clipped(F.col("t"))).first()[0] == ("a b c " + "d" * 294) + "…"


def test_a_step_shuffles_lines_once(spark, tmp_path):
    """All windows and aggregations of a step take the lines as they were dealt by pairs."""
    spark.createDataFrame([(r, 0, s, n, bytes([n + s])) for r in range(3) for s in (0, 1) for n in range(5)], "row long, gap long, side int, n long, key binary").write.parquet(str(tmp_path / "lines"))
    lines = spark.read.parquet(str(tmp_path / "lines"))
    matches = diff._once(lines.repartition("row"))
    assert sorted((r["i"], r["j"]) for r in matches.collect()) == sorted([(1, 0), (2, 1), (3, 2), (4, 3)] * 3)
    shuffles = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert shuffles(diff._meet(lines.repartition("row"), "key")) == 1
    cut = diff._cut(lines, matches)
    assert shuffles(cut) == 1 and cut.count() == 0  # line 0 of the old side is before any, line 4 of the new one behind all
