"""Quality, vectors, shards, benchmark leaks, chats, LM scores and the pipeline."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from folioscan.llm import ann, chat_format, decontaminate, lm_score, quality, sharding
from folioscan.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def rows(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_quality_against_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op3_quality"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    good, junk = ([r["keep"] for r in got if r["quality"] == q] for q in (1, 0))
    assert sum(good) >= 0.99 * len(good) and sum(junk) <= 0.1 * len(junk)


def test_quality_odd_rows(odd_docs, no_docs):
    model = quality.train(odd_docs)
    got = rows(quality.score(odd_docs, model), "doc_id", "score", "keep")
    assert len(got) == odd_docs.count()
    assert {(s, k) for d, s, k in got if d in (40, 41, 42)} == {(0.0, False)}
    kept = quality.keep_good(odd_docs, model)
    assert kept.columns == odd_docs.columns and kept.count() == sum(k for *_, k in got)
    assert quality.score(no_docs, quality.train(no_docs)).count() == 0


def test_em_recovers_labellers():
    rng = np.random.default_rng(2)
    truth = rng.random(20_000) < 0.7
    sure = [0.95, 0.9, 0.85, 0.8, 0.9, 0.7, 0.6, 0.9]
    votes = np.stack([np.where(rng.random(len(truth)) < 0.3, quality.ABSTAIN, np.where(rng.random(len(truth)) < s, truth, ~truth).astype(int)) for s in sure], 1)
    codes = (votes * 3 ** np.arange(7, -1, -1)).sum(1)
    good = quality.posteriors(Counter(codes.tolist()))
    assert np.mean((np.array([good[c] for c in codes.tolist()]) >= 0.5) == truth) > 0.96


def brute(vectors, queries, k):
    out = {}
    real = [(i, np.array(v, float)) for i, v in vectors if i is not None and v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    for qi, q in real:
        if qi in queries:
            out[qi] = sorted((math.sqrt(((v - q) ** 2).sum()), i) for i, v in real if i != qi and len(v) == len(q))[:k]
    return out


def test_nearest_recall(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    queries = vectors.where("vec_id % 20 = 0")
    want = brute(rows(vectors, "vec_id", "embedding"), {r[0] for r in rows(queries, "vec_id")}, 10)
    for size in (8192, 60):
        got = {}
        for q, n, v, s in sorted(rows(ann.search(ann.build_index(vectors, size), queries, query_bytes=2000), "query_id", "rank", "vec_id", "score")):
            got.setdefault(q, []).append((s, v))
            assert n == len(got[q])
        hits = sum(len({v for _, v in want[q]} & {v for _, v in got[q]}) for q in want)
        assert set(got) == set(want) and hits >= 0.95 * 10 * len(want)


def test_nearest_copies_and_odd_vectors(spark):
    rng = random.Random(1)
    far = [[rng.gauss(0, 1) for _ in range(4)] for _ in range(50)]
    vectors = [(i, far[0]) for i in range(40)] + [(100 + i, v) for i, v in enumerate(far[1:])]
    vectors += [(500, None), (501, [0.0] * 4), (502, [1.0, None, 2.0, 3.0]), (503, [1.0, float("nan"), 0.0, 0.0]), (504, [float("inf"), 0.0, 0.0, 1.0]), (None, far[2]), (505, [1.0, 2.0]), (506, [2.0, 2.0]), (507, []), (7, far[0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in vectors], "vec_id long, embedding array<double>, shard string")
    want = brute(vectors, {0, 100, 505}, 10)
    got = {}
    for q, _, v, s in sorted(rows(ann.search(ann.build_index(df), df.where("vec_id in (0, 100, 505, 500, 501)")), "query_id", "rank", "vec_id", "score")):
        got.setdefault(q, []).append((s, v))
    assert {q: [v for _, v in x] for q, x in got.items()} == {q: [v for _, v in x] for q, x in want.items()}
    assert all(abs(a - b) < 1e-12 for q in want for (a, _), (b, _) in zip(got[q], want[q], strict=True))
    none = df.where("false")
    assert ann.search(ann.build_index(none), none).count() == 0


def plain_shards(keys, bits, prefix, limit):
    """Split while over the limit, one bit at a time."""
    size = sum(b for _, b in keys)
    if size <= limit or len({k for k, _ in keys}) <= 1 or bits == sharding.BITS:
        return {(bits, prefix): (size, len(keys))} if keys else {}
    return plain_shards([x for x in keys if not x[0] >> (sharding.BITS - bits - 1) & 1], bits + 1, 2 * prefix, limit) | plain_shards([x for x in keys if x[0] >> (sharding.BITS - bits - 1) & 1], bits + 1, 2 * prefix + 1, limit)


def test_sharding(spark, documents, odd_docs, no_docs):
    hot = spark.createDataFrame([(7, "x" * 100)] * 300, "doc_id long, text string").union(documents.select("doc_id", "text"))
    for docs, limit in ((documents, 8 << 10), (odd_docs, 4 << 10), (hot, 2 << 10), (documents, 1 << 30)):
        out = sharding.shard(docs, max_bytes=limit).collect()
        assert sorted(str(r["doc_id"]) for r in out) == sorted(str(r["doc_id"]) for r in docs.select("doc_id").collect())
        shards = {r["shard"]: (r["shard_bytes"], r["shard_docs"]) for r in out}
        assert Counter(r["shard"] for r in out) == {s: n for s, (_, n) in shards.items()}
        names = sorted(shards)
        assert not any(b.startswith(a) for a, b in zip(names, names[1:], strict=False)) or names == [""]
        assert all(b <= limit or n == 1 for b, n in shards.values())
        assert all(len(r["shard"]) == r["local_depth"] for r in out)
    keys, limit = rows(sharding.keys(documents), "key", "bytes"), 8 << 10
    want = plain_shards(keys, 0, 0, limit)  # from the root on, splitting what is over the limit and nothing else
    out = sharding.shard(documents, max_bytes=limit)
    got = {(r["local_depth"], int("0" + r["shard"], 2)): (r["shard_bytes"], r["shard_docs"]) for r in out.collect()}
    assert got == want
    assert sharding.shard(no_docs).count() == 0
    listed = sharding.directory(out).collect()
    deepest = max(bits for bits, _ in want)
    assert len(listed) == len(got) and {r["global_depth"] for r in listed} == {deepest}
    at = 0  # where every bucket has documents, the slots follow each other
    for r in sorted(listed, key=lambda r: r["first_slot"]):
        assert r["first_slot"] >= at and r["slots"] == 1 << deepest - r["local_depth"] and int("0" + r["shard"], 2) << deepest - r["local_depth"] == r["first_slot"]
        at = r["first_slot"] + r["slots"]
    even = spark.range(330).selectExpr("id AS doc_id", "repeat('x', 100) AS text")  # buckets that fit stay whole, however uneven
    for limit in (16_000, 17_000, 33_000):
        got = {(r["local_depth"], int("0" + r["shard"], 2)): (r["shard_bytes"], r["shard_docs"]) for r in sharding.shard(even, max_bytes=limit).collect()}
        assert got == plain_shards(rows(sharding.keys(even), "key", "bytes"), 0, 0, limit)


def plain_matches(docs, items):
    def bag(words):
        return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))

    out = {}
    for d, text in docs:
        words = re.findall(r"\w+", (text or "").lower())
        for i, item in items:
            own = re.findall(r"\w+", (item or "").lower())
            if len(own) < 5 or len(own) > len(words):
                continue
            whole, best = bag(own), 0
            if not set(whole) & {tuple(words[s : s + 5]) for s in range(len(words) - 4)}:
                continue
            for s in range(len(words) - len(own) + 1):
                window = bag(words[s : s + len(own)])
                best = max(best, (window & whole).total() / (window | whole).total())
            if best >= 0.8:
                out[d, i] = round(best, 9)
    return out


def test_leaks_against_plain_version(spark, documents, odd_docs, no_docs):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = rows(bench, "item_id", "text")
    rng, edited = random.Random(4), []
    for i, t in items:
        w = t.split()
        edited += [(10_000 + 3 * i, "some words before " + " ".join(w[1:]) + " and after"), (10_001 + 3 * i, "x y " + " ".join([*w[:-2], "q", "r"]).upper()), (10_002 + 3 * i, " ".join(rng.sample(w, len(w))))]
    docs = documents.select("doc_id", "text").union(spark.createDataFrame(edited, "doc_id long, text string")).union(odd_docs.where("doc_id is not null").selectExpr("doc_id + 50000", "text").distinct())
    bench = bench.union(spark.createDataFrame([(900, "too short"), (901, None), (902, items[0][1])], "item_id long, text string"))
    want = plain_matches(rows(docs, "doc_id", "text"), rows(bench, "item_id", "text"))
    for part in (decontaminate.PART_BYTES, 4000):
        got = {(d, i): round(s, 9) for d, i, s in rows(decontaminate.matches(docs, bench, part), "doc_id", "item_id", "similarity")}
        assert len(want) > 60 and got == want
    left = decontaminate.drop_leaks(docs, bench)
    assert sorted(r[0] for r in rows(left, "doc_id")) == sorted(d for d, _ in rows(docs, "doc_id", "text") if d not in {d for d, _ in want})
    assert decontaminate.matches(no_docs, bench).count() == 0 and decontaminate.matches(docs, bench.where("false")).count() == 0
    assert decontaminate.drop_leaks(odd_docs, bench).columns == odd_docs.columns


def test_every_item_within_the_radius_is_proposed():
    rng = np.random.default_rng(6)
    index = decontaminate.Index([(i, " ".join(map(str, rng.integers(0, 99, 30)))) for i in range(200)])
    for own in rng.integers(0, 1 << 63, 300, dtype=np.uint64):
        own = index.prints[rng.integers(200)] ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, 18, dtype=np.uint64)) if rng.random() < 0.5 else own
        want = np.flatnonzero(np.bitwise_count(index.prints ^ own) <= decontaminate.RADIUS).tolist()
        assert index._within(own, 26) == want


def plain_format(turns):
    esc = lambda t: t.replace("\\", "\\\\").replace("<|", "<\\|")
    return "".join(f"<|im_start|>{esc(r).replace(chr(10), '<' + chr(92) + 'n>')}\n{esc(t)}<|im_end|>\n" for r, t in turns)


def test_chat_trees(spark):
    rng, nodes = random.Random(8), []
    for c in range(25):
        for n in range(rng.randint(1, 40)):
            nodes.append((c, n, rng.randrange(n) if n else None, rng.choice(["user", "assistant"]), f"t{n} \\<| <\\| {c}\n", rng.choice([0.5, 1.0, None, 3.0])))
    nodes += [(100, i, i - 1 if i else None, "user", "x", 1.0) for i in range(70)]
    nodes += [(101, 1, 2, "user", "loop", 1.0), (101, 2, 1, "user", "loop", 1.0), (101, 3, 1, "user", "below", 1.0), (102, 5, 99, "a\nb<|", None, 1.0), (None, 1, None, None, "y", 1.0), (None, 2, 1, "assistant", "z", None)]
    df = spark.createDataFrame([(*n, "k") for n in nodes], "conv_id long, node_id long, parent_id long, role string, text string, score double, place string")
    want = {}
    for c in {n[0] for n in nodes}:
        own = {n[1]: n for n in nodes if n[0] == c}
        ways = []
        for leaf in own.keys() - {n[2] for n in own.values()}:
            path, at = [], leaf
            while at in own and at not in path:
                path.append(at)
                at = own[at][2]
            if at not in own:
                ways.append((-sum(own[p][5] or 0 for p in path), leaf, path[::-1]))
        for rank, (_, leaf, path) in enumerate(sorted(ways)[:2]):
            want[c, leaf] = (rank, plain_format([(own[p][3] or "", own[p][4] or "") for p in path]))
    got = {(r["conv_id"], r["leaf"]): r for r in chat_format.format_paths(df, top=2).collect()}
    assert {k: r["formatted"] for k, r in got.items()} == {k: f for k, (_, f) in want.items()}
    one = {(r["conv_id"], r["leaf"]) for r in chat_format.paths(df).collect()}
    assert one == {k for k, (rank, _) in want.items() if not rank}
    assert chat_format.format_paths(df.where("false")).count() == 0


def test_chat_digest_reads_back(spark):
    said = [(1, 0, "user", "a <|im_end|>\n \\ <\\|"), (1, 1, "assistant", "é<|im_start|>user\nx"), (1, 1, "assistant", "é<|im_start|>user\nx"), (1, None, None, None), (2, 3, "assistant", None), (None, 1, "assistant", "n")]
    df = chat_format.with_control_case(spark, spark.createDataFrame([(*r, 5) for r in said], "conv_id long, turn long, role string, text string, leaf int"))
    got = {r["conv_id"]: r for r in chat_format.digest(chat_format.format_paths(chat_format.chains(df))).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for c in (1, 2, None, -1):
        turns = [(r or "", t or "") for k, n, r, t in sorted([r for r in said if r[0] == c], key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))] if c != -1 else [("user", "<|im_end|><|im_start|>assistant ok"), ("assistant", "<|im_end|><|im_start|>assistant ok")]
        loss = "".join(t for r, t in turns if r == "assistant")
        assert tuple(got[c]) == (c, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(plain_format(turns)))


def test_lm_gradient_and_scores(spark, documents, odd_docs, no_docs):
    rng = np.random.default_rng(0)
    ids = lm_score.lined_up([rng.integers(1, 256, 40).astype(np.int32), rng.integers(1, 256, 3).astype(np.int32)])
    at, flat = np.flatnonzero(ids != lm_score.PAD), lm_score.first_weights().astype(np.float64)
    before = lm_score.log_probs(ids, at, lm_score.unpack(flat))
    moved = flat.copy()
    lm_score.improve(moved, ids, rng, 1e-3, batch=len(at))
    slope = (flat - moved) / 1e-3  # gradient of the mean negative log-probability
    for i in rng.choice(np.flatnonzero(slope), 25, replace=False):
        step = flat.copy()
        step[i] += 1e-5
        assert math.isclose(-(lm_score.log_probs(ids, at, lm_score.unpack(step)) - before).mean() / 1e-5, slope[i], rel_tol=2e-2, abs_tol=1e-5)
    model = lm_score.train(documents, one_in=2, rounds=2)
    got = {r["doc_id"]: r for r in lm_score.score(documents, model).collect()}
    code, weights = model.coder(), lm_score.unpack(model.weights)
    for d, text in rows(documents.limit(20), "doc_id", "text"):
        ids = lm_score.lined_up([code(text)])
        assert math.isclose(got[d]["log_prob"], lm_score.log_probs(ids, np.flatnonzero(ids), weights).sum(), rel_tol=1e-3) and got[d]["n_tokens"] == len(text.split())
    total = sum(r["log_prob"] for r in got.values()) / sum(r["n_tokens"] for r in got.values())
    fresh = lm_score.Model(model.words, lm_score.first_weights())
    at_first = lm_score.score(documents, fresh).agg(F.sum("log_prob") / F.sum("n_tokens")).first()[0]
    assert total > at_first + 0.3
    odd = {r["doc_id"]: r for r in lm_score.score(odd_docs, lm_score.train(odd_docs, one_in=1, rounds=1)).collect()}
    assert (odd[40]["n_tokens"], odd[40]["log_prob"], odd[40]["per_token"]) == (0, 0.0, None) and odd[43]["n_tokens"] == 60_000
    assert lm_score.score(no_docs, lm_score.train(no_docs)).count() == 0


def test_pipeline_stages_follow_each_other(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    shape = docs.columns
    seen = [docs.count()]
    for _, step in corpus_pipeline.STAGES[:-1]:
        docs = step(spark, docs, SF).cache()
        assert docs.columns == shape
        seen.append(docs.count())
    assert seen[0] > seen[1] > seen[2] > seen[3] == seen[4]
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert not plain_matches(rows(docs, "doc_id", "text"), rows(bench, "item_id", "text"))
    whole = lambda df: sorted((r["doc_id"], r["doc_tokens"], r["n"]) for r in df.groupBy("doc_id", "doc_tokens").agg(F.sum("length").alias("n")).collect())  # noqa: E731  the order of documents is free
    pieces = whole(corpus_pipeline.STAGES[-1][1](spark, docs, SF))
    assert len(pieces) == seen[4] and all(t == n for _, t, n in pieces) and pieces == whole(corpus_pipeline.run(spark, SF))


def test_oracles_belong_to_queries():
    assert set(ORACLE_SQL) <= set(QUERIES) and all(f"op{n}_" in " ".join(QUERIES) for n in range(1, 11))
