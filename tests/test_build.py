"""Builds of banks and rules with a recorded reviewer."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from folioscan.plans import answers, build

PROMPTS = {"points": "POINTS", "doc": "DOC", "dialogue": "TALK"}
BANK = {"wordbanks": [{"name": "n", "entries": [{"keyword": "k", "tag": "t", "suggestion": "s"}]}], "rules": []}
RULE = {"wordbanks": [], "rules": [{"name": "r", "match_mode": "regex", "pattern": "r'a+'", "severity": "high", "suggestion": "s"}]}


def recorder(folder):
    """Answers by what the prompt holds; each call is written down."""
    folder.mkdir()

    def reviewer(prompt):
        import uuid

        (folder / uuid.uuid4().hex).write_text(prompt)
        first = prompt.startswith("POINTS")
        if "down" in prompt:
            raise ConnectionError("no")
        if first:
            return {"few": "1234567", "none": " ab "}.get(next((w for w in ("few", "none") if w in prompt), ""), "points: " + prompt[8:60] + "\nend")
        if "hollow" in prompt:
            return json.dumps({"wordbanks": [], "rules": []})
        if "prose" in prompt:
            return "no object here"
        if "broken" in prompt:
            return "{a b}" * 20
        if "badrule" in prompt:
            return json.dumps({"wordbanks": [], "rules": [{"name": "x", "match_mode": "regex", "pattern": "(", "severity": "low"}]})
        return "so: " + json.dumps(RULE if "rule" in prompt else BANK)

    def calls():
        said = sorted(p.read_text() for p in folder.iterdir())
        for p in folder.iterdir():
            p.unlink()
        return said

    return reviewer, calls


REQUESTS = [
    ("t1", "text", "  some rule text "), ("t2", "text", "x" * 7000), ("t3", "text", " \n"), ("t4", "text", None), ("d1", "dialogue", "wish"), ("d2", "dialogue", "w" * 2001), ("d3", "dialogue", "hollow wish"), ("d4", "dialogue", "prose"),
    ("d5", "dialogue", "broken"), ("d6", "dialogue", "badrule"), ("d7", "dialogue", "down"), ("f1", "doc", "a document about a rule, long enough"), ("f2", "doc", "y" * 3000), ("f3", "doc", "too short"), ("f4", "doc", "few points in this document here"),
    ("f5", "doc", "none at all in this document here"), ("f6", "doc", "down down down down down down down"), ("o", "other", "text"),
]
WANT = {
    "t1": (True, build.DONE), "t2": (True, build.DONE), "t3": (False, build.EMPTY["text"]), "t4": (False, build.EMPTY["text"]), "d1": (True, build.DONE), "d2": (True, build.DONE), "d3": (True, build.DONE), "d4": (False, build.NO_JSON),
    "d5": (False, build.BAD_JSON + "{a b}" * 16 + "…"), "d6": (False, "规则「x」的正则无法编译"), "d7": (False, "ConnectionError: no"), "f1": (True, build.DONE), "f2": (True, build.DONE), "f3": (False, build.EMPTY["doc"]), "f4": (True, build.DIRECT),
    "f5": (False, build.NO_POINTS), "f6": (False, "ConnectionError: no"), "o": (False, build.UNKNOWN),
}


def requests(spark, rows=REQUESTS):
    return spark.createDataFrame(rows, "id string, kind string, text string")


def test_builds(spark, tmp_path):
    reviewer, calls = recorder(tmp_path / "calls")
    kept = answers.store(spark, str(tmp_path / "kept"))
    made = build.build(requests(spark), reviewer, kept, PROMPTS, tasks=4)
    assert {r.id: (r.ok, r.message) for r in made.outcome.collect()} == WANT
    assert sorted((r.id, r.pattern, r.severity) for r in made.rules.collect()) == [("f1", "a+", "high"), ("t1", "a+", "high")]
    assert sorted((r.id, r.name, r.keyword) for r in made.banks.collect()) == [(i, "n", "k") for i in ("d1", "d2", "f2", "f4", "t2")]
    said = calls()
    points = [p for p in said if p.startswith("POINTS")]
    assert len(points) == 5 and "POINTS\n\n" + "y" * 2500 + "…" in points
    assert "DOC\n\n" + build.LEADS["text"] + "x" * 6000 + "…" in said and "TALK\n\n" + build.LEADS["dialogue"] + "w" * 2000 + "…" in said
    assert "DOC\n\n" + build.FROM_POINTS + "points: a document about a rule, long enough⏎end" in said and "DOC\n\n" + build.LEADS["doc"] + "few points in this document here" in said
    assert sum("hollow" in p for p in said) == 2 and len(said) == len(points) + 9 + 3 + 1  # what is empty is asked for once more
    # again: only what failed to be asked is asked
    made = build.build(requests(spark), reviewer, kept, PROMPTS)
    assert {r.id: (r.ok, r.message) for r in made.outcome.collect()} == WANT
    assert all("down" in p for p in calls())


def test_a_run_that_breaks_off(spark, tmp_path, monkeypatch):
    reviewer, calls = recorder(tmp_path / "calls")
    kept = answers.store(spark, str(tmp_path / "kept"))
    some = requests(spark, [r for r in REQUESTS if r[0] in ("f1", "f2", "f4")])
    with monkeypatch.context() as m:
        m.setattr(build, "_read", lambda _: (_ for _ in ()).throw(OSError("killed")))
        with pytest.raises(OSError, match="killed"):
            build.build(some, reviewer, kept, PROMPTS)
    assert len(calls()) == 6
    made = build.build(some, reviewer, kept, PROMPTS)
    assert made.outcome.where("ok").count() == 3 and calls() == []


def test_no_requests(spark, tmp_path):
    made = build.build(requests(spark, []), lambda p: p, answers.store(spark, str(tmp_path)), PROMPTS)
    assert made.outcome.collect() == made.banks.collect() == made.rules.collect() == []


def test_every_id_has_one_outcome(spark, tmp_path):
    many = spark.range(300).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") % 3 == 0, "doc").otherwise("text").alias("kind"), F.concat(F.lit("about the rule of things "), (F.col("id") % 7).cast("string")).alias("text"))
    reviewer, calls = recorder(tmp_path / "calls")
    made = build.build(many, reviewer, answers.store(spark, str(tmp_path / "kept")), PROMPTS, tasks=4)
    assert made.outcome.where("ok").select("id").distinct().count() == made.outcome.count() == 300 and made.rules.count() == 300
    assert len(calls()) == 7 * 3  # equal texts are asked about once
