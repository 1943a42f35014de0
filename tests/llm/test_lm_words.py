"""Words outside the vocabulary of the LM, and what its training reads."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import pytest

from folioscan.llm import lm_score


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    common = [f"common{k}" for k in range(191)]
    rare = [f"{stem}{k}ing" for stem in ("walk", "talk") for k in range(40)]
    texts = [" ".join(rng.choices(common, k=30) + rng.choices(rare, k=2)) for _ in range(300)]
    texts += [" ".join(common)] * 40 + ["walk1ing talk1ing", "talk2ing walk3ing", "walk1ing talk1ing", "zzqqing xxqqing", "", None]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_words_of_a_class_are_told_apart(spark, corpus):
    counts = lm_score.count_words(corpus)
    model = lm_score.Model(lm_score.vocabulary(counts), lm_score.first_weights())
    plain = Counter(w for r in corpus.collect() for w in (r["text"] or "").lower().split() if w not in model.words)
    assert {r["w"]: r["n"] for r in counts.collect() if r["w"] not in model.words} == plain and len(plain) > 60
    code, of_class = model.coder(), {}
    for w, n in plain.items():
        of_class.setdefault(int(code(w)[0]), []).append(n)

    def given(w):
        ns = of_class.get(int(code(w)[0]), [])
        return math.log((plain.get(w, 0) + lm_score.UNSEEN) / (sum(ns) + lm_score.UNSEEN * (len(ns) + 1)))

    more = spark.createDataFrame([(900, "walk1ing neverseening"), (901, "neverseening qqwwee\u2003ooppkk\x1cwalk1ing")], "doc_id long, text string")
    texts = corpus.union(more)
    alone = {r["doc_id"]: r["log_prob"] for r in lm_score.score(texts, model).collect()}
    for head in (lm_score.HEAD, 20, len(plain), 0):  # all words go to every task, a part does, all but none are joined
        got = {r["doc_id"]: r for r in lm_score.score(texts, model, lm_score.other_words(counts, model, head)).collect()}
        assert len(got) == texts.count()
        for r in texts.collect():
            want = alone[r["doc_id"]] + sum(given(w) for w in (r["text"] or "").lower().split() if w not in model.words)
            assert math.isclose(got[r["doc_id"]]["log_prob"], want, rel_tol=1e-6, abs_tol=1e-6)
        assert abs(got[340]["log_prob"] - got[341]["log_prob"]) > 1e-3 > abs(got[340]["log_prob"] - got[342]["log_prob"])


def test_the_table_of_words_grows(spark, corpus):
    model = lm_score.Model(lm_score.vocabulary(lm_score.count_words(corpus)), lm_score.first_weights())
    new = spark.createDataFrame([(k, f"newword{k}") for k in range(500)], "doc_id long, text string")
    small, large = (lm_score.other_words(lm_score.count_words(d), model, 50) for d in (corpus, corpus.union(new)))
    assert large.tail.count() == small.tail.count() + 500 and len(large.head) == len(small.head) == 50


def test_every_document_is_trained_on_once(spark):
    docs = spark.createDataFrame([(k % 50, f"text {k % 7}") for k in range(200)] + [(None, "no id"), (None, None)], "doc_id long, text string")
    parts = [[r["text"] for r in lm_score.training_part(docs, k, lm_score.ROUNDS).collect()] for k in range(lm_score.ROUNDS)]
    assert Counter(t for p in parts for t in p) == Counter(r["text"] for r in docs.collect()) and min(map(len, parts)) > 20
    for text in ("one two three", "a b c d", "only this"):  # one text alone, whatever its hash
        same = spark.createDataFrame([(k, text) for k in range(20)], "doc_id long, text string")
        assert (lm_score.train(same).weights != lm_score.first_weights()).any()


def plain_score(text, model, plain):
    """Word by word, in Python floats, with nothing of the module but the sizes."""
    words, emb = text.lower().split(), None
    sizes, flat, parts = lm_score.SHAPES, [float(v) for v in model.weights], []
    for shape in sizes:
        n = math.prod(shape)
        own, flat = flat[:n], flat[n:]
        parts.append([own[i : i + shape[1]] for i in range(0, n, shape[1])] if len(shape) == 2 else own)
    emb, w1, b1, w2, b2 = parts
    first_class = lm_score.VOCAB - lm_score.CLASSES
    number = lambda w: model.words.index(w) + 1 if w in model.words else first_class + int(model.classes[zlib.crc32(w[-3:].encode()) % 4096])
    ids, total = [number(w) for w in words], 0.0
    for k, w in enumerate(words):
        x = [v for d in range(-lm_score.REACH, lm_score.REACH + 1) if d for v in emb[ids[k + d] if 0 <= k + d < len(ids) else lm_score.PAD]]
        h = [math.tanh(sum(a * r[j] for a, r in zip(x, w1, strict=True)) + b1[j]) for j in range(lm_score.HIDDEN)]
        z = [sum(a * r[j] for a, r in zip(h, w2, strict=True)) + b2[j] for j in range(lm_score.VOCAB)]
        total += z[ids[k]] - math.log(math.fsum(map(math.exp, z)))
        if w not in model.words:
            ns = [n for v, n in plain.items() if v not in model.words and number(v) == ids[k]]
            total += math.log((plain.get(w, 0) + lm_score.UNSEEN) / (sum(ns) + lm_score.UNSEEN * (len(ns) + 1)))
    return len(words), total


def test_scores_against_a_plain_version(spark, corpus):
    counts = lm_score.count_words(corpus)
    model = lm_score.train(corpus, counts=counts)
    assert (model.weights != lm_score.first_weights()).any()
    plain = Counter(w for r in corpus.collect() for w in (r["text"] or "").lower().split())
    odd = spark.createDataFrame([(500, "İSTANBUL ΟΔΟΣ walk1ing Straße \x1c common3"), (501, "new words only"), (502, None)], "doc_id long, text string")
    few = corpus.where("doc_id in (0, 1, 340, 341, 343, 344)").union(odd)
    for head in (lm_score.HEAD, 5):
        got = {r["doc_id"]: (r["n_tokens"], r["log_prob"]) for r in lm_score.score(few, model, lm_score.other_words(counts, model, head)).collect()}
        for r in few.collect():
            n, want = plain_score(r["text"] or "", model, plain)
            assert got[r["doc_id"]][0] == n and math.isclose(got[r["doc_id"]][1], want, rel_tol=1e-4, abs_tol=1e-6)


def test_counts_of_neighbours_against_a_plain_version(spark, corpus):
    words, cells = Counter(), Counter()
    for r in corpus.collect():
        said = (r["text"] or "").lower().split()
        words.update(said)
        for i, w in enumerate(said):
            for v in said[i + 1 : i + 3]:
                cells[lm_score.ending(w) * lm_score.NEAR + zlib.crc32(v.encode()) % lm_score.NEAR] += 1
    got = lm_score.gather(corpus)
    assert {r["w"]: r["n"] for r in got[0].collect()} == words and {r["cell"]: r["n"] for r in got[1].collect()} == cells
    told = [r for most in (5, 1 << 18) for r in [list(lm_score._counted(iter(corpus.select("text").toArrow().to_batches()), most, 7))]]
    for batches in told:  # also where few words are held at a time
        total, near = Counter(), Counter()
        for b in batches:
            for w, c, n in zip(*(b.column(k).to_pylist() for k in range(3))):
                if w is None:
                    near[c] += n
                else:
                    total[w] += n
        assert total == words and near == cells


def test_words_that_go_together_share_classes(spark):
    """Two vocabularies that never stand in one text: no class has endings of both that occur often."""
    rng = random.Random(5)
    kinds = [["".join(rng.choices(letters, k=6)) for _ in range(300)] for letters in ("abcdef", "uvwxyz")]
    texts = [" ".join(rng.choices(kinds[k % 2], k=60)) for k in range(400)]
    classes = lm_score.learned_classes(lm_score.gather(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))[1])
    one, two = ({int(classes[lm_score.ending(w)]) for w in kind} for kind in kinds)
    shared = {lm_score.ending(w) for w in kinds[0]} & {lm_score.ending(w) for w in kinds[1]}
    assert len(one & two) <= len(shared) and len(one | two) > 40


def test_better_than_word_counts_on_held_out_documents(spark):
    """Of documents of several languages a fifth is held out: the network is 0.5 nats a word better than the words' frequencies."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text is not null")
    seen, held = docs.where("doc_id % 5 <> 0"), docs.where("doc_id % 5 = 0")
    counts, cells = lm_score.gather(seen)
    model = lm_score.train(seen, counts=counts, cells=cells)
    got = lm_score.score(held, model, lm_score.other_words(counts, model)).agg(F.sum("log_prob"), F.sum("n_tokens")).first()
    plain = {r["w"]: r["n"] for r in counts.collect()}
    total = math.log(sum(plain.values()) + lm_score.UNSEEN * (len(plain) + 1))
    words = [w for r in held.collect() for w in r["text"].lower().split()]
    unigram = sum(math.log(plain.get(w, 0) + lm_score.UNSEEN) - total for w in words) / len(words)
    assert got[1] == len(words) and got[0] / got[1] > unigram + 0.5, (got[0] / got[1], unigram)
    print("nats a word", got[0] / got[1], unigram)
