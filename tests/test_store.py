"""Stored tables, kept answers and learned records against plain dictionaries."""

from __future__ import annotations

import random
import time
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from folioscan.plans import answers, learned
from folioscan.skew import join_unique
from folioscan.store import Conflict, Store

SHAPES = {"t": ("k string, n int, v string", ["k", "n"]), "u": ("k string", ["k"])}


def table(kept, name="t"):
    return sorted((tuple(r) for r in kept.read(name).collect()), key=str)


def test_upserts_and_deletes(spark, tmp_path):
    kept, want, rng = Store(spark, str(tmp_path), SHAPES), {}, random.Random(1)
    assert table(kept) == []
    for step in range(6):
        rows = [(rng.choice("abcd") if rng.random() > 0.1 else None, rng.randint(0, 3), f"{step}.{i}") for i in range(8)]
        df = spark.createDataFrame(rows, SHAPES["t"][0])
        if step % 3 == 2:
            kept.delete("t", df)
            want = {k: v for k, v in want.items() if k not in {r[:2] for r in rows}}
        else:
            kept.upsert("t", df, "v")
            want |= {r[:2]: r[2] for r in rows}
        assert table(kept) == sorted(((*k, v) for k, v in want.items()), key=str)


def test_a_crash_before_the_switch_changes_nothing(spark, tmp_path, monkeypatch):
    kept = Store(spark, str(tmp_path), SHAPES)
    rows = lambda *ks: spark.createDataFrame([(k, 1, "v") for k in ks], SHAPES["t"][0])
    kept.put(t=rows("a"), u=spark.createDataFrame([("x",)], "k string"))
    before = kept.read("t")
    with monkeypatch.context() as m:
        m.setattr(Store, "_switch", lambda *_: (_ for _ in ()).throw(OSError("killed")))
        with pytest.raises(OSError, match="killed"):
            kept.put(t=rows("b"), u=spark.createDataFrame([], "k string"))
    assert table(kept) == [("a", 1, "v")] and table(kept, "u") == [("x",)]
    kept.upsert("t", rows("b"))
    assert [r[0] for r in table(kept)] == ["a", "b"] and table(kept, "u") == [("x",)]
    assert [r.k for r in before.collect()] == ["a"]  # what was read stays as it was


def test_two_writers_of_one_version(spark, tmp_path):
    kept = Store(spark, str(tmp_path), SHAPES)
    kept.put(u=spark.createDataFrame([("x",)], "k string"))
    kept._switch(2, "a", {"u": kept._last()[1]["u"]})
    with pytest.raises(Conflict):
        kept._switch(2, "b", {})
    assert table(kept, "u") == [("x",)]


def requests(spark, prompts):
    return spark.createDataFrame([(i, p) for i, p in enumerate(prompts)], "id int, prompt string")


def test_answers_are_asked_once_and_kept(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def reviewer(prompt):
        import uuid

        (calls / uuid.uuid4().hex).write_text(prompt)
        if prompt == "bad":
            raise TimeoutError("t")
        return prompt.upper()

    def asked():
        found = sorted(p.read_text() for p in calls.iterdir())
        for p in calls.iterdir():
            p.unlink()
        return found

    kept, now = answers.store(spark, str(tmp_path / "store")), datetime(2024, 1, 1, tzinfo=timezone.utc)
    run = lambda prompts, **more: sorted((r.id, r.content, r.error, r.known) for r in answers.ask(requests(spark, prompts), reviewer, kept, **{"now": now, "tasks": 3} | more).collect())
    assert run(["a", "b", "a", "bad", None]) == [(0, "A", None, False), (1, "B", None, False), (2, "A", None, False), (3, None, "TimeoutError: t", False), (4, "", None, False)]
    assert asked() == ["", "a", "b", "bad"]
    # a second run asks nothing but what failed and what is new
    assert run(["c", "b", "a", "bad"]) == [(0, "C", None, False), (1, "B", None, True), (2, "A", None, True), (3, None, "TimeoutError: t", False)]
    assert asked() == ["bad", "c"]
    assert run(["a", "b", "c"], now=now + timedelta(minutes=30)) == [(0, "A", None, True), (1, "B", None, True), (2, "C", None, True)]
    assert asked() == []
    # another model has answers of its own
    assert run(["a"], model="m")[0][3] is False and asked() == ["a"]
    # after the time to live all is asked again, and beyond the most the oldest go
    later = now + timedelta(hours=2)
    assert [r[3] for r in run(["a", "b"], now=later)] == [False, False] and asked() == ["a", "b"]
    assert [r[3] for r in run(["a", "d"], now=later + timedelta(minutes=1), most=1)] == [True, False] and asked() == ["d"]
    assert kept.read("answers").count() == 1 and run(["d"], now=later + timedelta(minutes=2))[0][3] is True
    assert run([]) == []


def test_calls_keep_their_pace(spark, tmp_path):
    began = time.monotonic()
    out = answers.ask(requests(spark, list("abcdef")), lambda p: p, answers.store(spark, str(tmp_path)), rpm=300, tasks=2)
    assert out.count() == 6 and time.monotonic() - began >= 2 * 0.4  # three calls a task, 0.4 s apart


def test_hot_keys(spark):
    rows = spark.range(20_000).select("id", F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 7 != 0, F.concat(F.lit("k"), (F.col("id") % 500).cast("string"))).alias("key"))
    others = spark.createDataFrame([("hot", 1), ("k1", 2), ("k3", 3), ("none", 4)], "key string, v int")
    for how in ("inner", "left"):
        want = sorted(map(str, rows.join(others, "key", how).select("id", "key", "v").collect()))
        assert sorted(map(str, join_unique(rows, others, "key", how).select("id", "key", "v").collect())) == want


def model(items, groups, records):
    return (sorted((k, *v) for k, v in items.items()), sorted(groups), sorted((k, *v) for k, v in records.items()))


def state(kept):
    get = lambda name, *cols: sorted(tuple(r) for r in kept.read(name).select(*cols).collect())
    items = [((k, g, i), s, e) for k, g, i, s, e in get("items", "kind", "gid", "iid", "source", "enabled")]
    return items, get("groups", "kind", "gid"), [(a, (k, g, i), e) for a, k, g, i, e in get("records", "id", "kind", "gid", "iid", "enabled")]


def test_learned_records(spark, tmp_path):
    rng, kept = random.Random(8), learned.store(spark, str(tmp_path))
    items, groups, records = {}, {}, {}
    for i in range(60):
        kind, gid = rng.choice(["wordbank", "rule"]), f"g{rng.randint(0, 12)}"
        mine = rng.random() < 0.6
        items[kind, gid, f"i{i}"] = ("learned" if mine else "user", True)
        groups[kind, gid] = "learned" if gid in ("g1", "g2") else "user"
        if mine:
            records[f"r{i}"] = ((kind, gid, f"i{i}"), True)
    records["lost item"], records["lost group"] = (("rule", "g1", "none"), True), (("rule", "none", "i1"), True)
    groups["rule", "g1"] = "learned"
    groups["rule", "bare"] = "user"
    learned.add(
        kept,
        spark.createDataFrame([(a, "s", *k, e) for a, (k, e) in records.items()], learned.SHAPES["records"][0]),
        spark.createDataFrame([(*k, "n", "keyword", "p", "s", "low", src, e) for k, (src, e) in items.items()], learned.SHAPES["items"][0]),
        spark.createDataFrame([(*k, "n", src, True) for k, src in groups.items()], learned.SHAPES["groups"][0]),
    )
    ids = lambda some: spark.createDataFrame([(x,) for x in some], "id string")
    assert state(kept) == model(items, groups, records)

    some = rng.sample(sorted(records), 15) + ["lost item", "unknown"]
    hit = [a for a in set(some) & set(records) if records[a][0] in items]
    for a in hit:
        items[records[a][0]] = (items[records[a][0]][0], False)
        records[a] = (records[a][0], False)
    assert learned.toggle(kept, ids(some), False) == len(hit)
    assert state(kept) == model(items, groups, records)

    some = rng.sample(sorted(records), 20) + ["lost item", "lost group"]
    hit = [a for a in set(some) & set(records) if records[a][0][:2] in groups]
    touched = {records[a][0][:2] for a in hit}
    for a in hit:
        items.pop(records.pop(a)[0], None)
    for g in touched - {k[:2] for k in items}:
        groups.pop(g)
    assert "lost group" in records
    assert learned.delete(kept, ids(some)) == len(hit)
    assert state(kept) == model(items, groups, records)

    removed = sum(src == "learned" for src, _ in items.values())
    items = {k: v for k, v in items.items() if v[0] != "learned"}
    groups = {k: src for k, src in groups.items() if src != "learned" and k in {x[:2] for x in items}}
    assert learned.clear(kept, "learned") == removed
    assert state(kept) == model(items, groups, {})
    learned.delete_samples(kept, ids(["x"]))
    assert learned.toggle(kept, ids(["x"]), True) == learned.delete(kept, ids([])) == 0
