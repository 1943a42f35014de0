"""The prefix trie against a plain dictionary of prefixes."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from folioscan.llm import prefix_trie as P

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SHAPE = "conv_id long, turn long, role string, text string, depth string, fp int, mark string, place string, part int"


def told(rows):
    """conv_id -> its turns, ordered."""
    said = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            said[conv].append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    return {c: [x[2:] for x in sorted(v)] for c, v in said.items()}


def rebuilt(said):
    out = {}
    for c, own in said.items():
        h, base = zlib.crc32(str(c).encode()) % 9, c - (abs(c) % 5) * (1 if c >= 0 else -1)
        out[c] = said.get(base, [])[:h] + own[h:]
    return out


def plain(said):
    members = defaultdict(list)
    for c, turns in said.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    rows = []
    for node, m in members.items():
        under = [x for x in members if x[: len(node)] == node]
        children = lambda x: sum(len(y) == len(x) + 1 and y[: len(x)] == x for y in under)  # noqa: B023, E731
        ends = ",".join(str(c) for c in sorted(c for c in m if len(said[c]) == len(node)))
        rows.append((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), children(node), sum(not children(x) for x in under), sum((len(members[x]) - 1) * len(x[-1][1]) for x in under if x), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=str)


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", "z", 2) for r in rows], SHAPE)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = []
    for c in [*range(-12, 40), 1005, 1006]:
        for t in range(rng.randint(1, 12)):
            out.append((c, None if rng.random() < 0.05 else t, rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "ü\U0001f600", "", None])))
    out += [out[5], out[5], (None, 1, "user", "a"), (7, 3, "user", "x" * 300_000), (8, 3, "user", "x" * 300_000)]
    rng.shuffle(out)
    return out


def got(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def test_rebuilt_conversations(spark, rows):
    df = P.of_rebuilt(table(spark, rows))
    assert got(df) == plain(rebuilt(told(rows)))


def test_nodes_with_their_last_turns(spark, rows):
    turns, said = P.number(table(spark, rows)), told(rows)
    last = {(r.conv_id, r.depth): (r.role, r.text) for r in P.with_turns(P.trie(turns, P.lengths(turns)), turns).collect()}
    assert all(turn == (tuple(x.decode() for x in said[c][d - 1]) if d else (None, None)) for (c, d), turn in last.items())


@pytest.mark.parametrize("primes", [(2, 3), (1, 1), (7, 5)])
def test_collisions_are_split(spark, rows, primes):
    few = [r for r in rows if r[0] is not None and r[0] < 16]
    turns = P.number(table(spark, few))
    assert got(P.trie(turns, P.lengths(turns), primes)) == plain(told(few))


def test_long_conversations_over_many_tasks(spark, monkeypatch):
    rng = random.Random(4)
    first = [("user", rng.choice("ab")) for _ in range(3000)]
    rows = [(c, t, *turn) for c, n in ((1, 3000), (2, 2500), (3, 1024), (4, 1025), (5, 1)) for t, turn in enumerate(first[:n])]
    rows += [(2, 9999, "user", "other"), (6, 0, "user", "other")]
    out = {(r.conv_id, r.depth): r for r in P.of_conversations(table(spark, rows)).collect()}
    assert len(out) == 3000 + 1 + 1 + 1
    assert out[2, 2501].parent_conv_id == 1 and out[2, 2501].n_convs == 1
    assert (out[1, 0].n_leaves, out[1, 0].n_children, out[1, 0].n_convs) == (3, 2, 6)
    assert (out[1, 2500].n_convs, out[1, 2500].n_leaves, out[1, 2500].n_children) == (2, 2, 2)
    # each of the first turns is kept once for 5, 4, 3, ... conversations
    assert out[1, 0].saved_tokens == sum(n for n in (2500, 1024, 1025, 1))
    assert out[1, 2000].saved_tokens == 501
    assert out[1, 1024].ends_sha256 == hashlib.sha256(b"3").hexdigest()


def test_very_many_copies(spark, monkeypatch):
    monkeypatch.setattr(P, "HOT", 1)
    rows = [(c, t, "user", "same") for c in range(5000) for t in range(2)] + [(c, 0, "user", f"own {c}") for c in range(5000, 7000)]
    out = {(r.conv_id, r.depth): r for r in P.of_conversations(table(spark, rows)).collect()}
    assert len(out) == 2003 and out[0, 0].n_children == 2001 and out[0, 0].n_leaves == 2001
    assert out[6000, 1].parent_conv_id == 0
    assert out[0, 2].ends_sha256 == hashlib.sha256(",".join(map(str, range(5000))).encode()).hexdigest()
    assert out[0, 0].saved_tokens == 2 * 4 * 4999


def test_no_conversations(spark):
    assert P.of_rebuilt(table(spark, [])).collect() == []
    assert P.of_conversations(table(spark, [(None, 1, "user", "a")])).collect() == []


def test_conversations_without_turns(spark):
    # the base is absent and there are fewer turns than h
    c = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 9 > 2 and c % 5)
    rows = [(c, 0, "user", "a"), (c, 1, "user", "b")]
    assert got(P.of_rebuilt(table(spark, rows))) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]
