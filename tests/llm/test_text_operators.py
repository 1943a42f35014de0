"""Language id, secrets, near copies and packing against plain versions."""

from __future__ import annotations

import hashlib
import re
import sys
import zlib
from itertools import combinations

import numpy as np
import public_tokenizers
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from folioscan.llm import language_id, packing, secret_scan, simhash_dedup


def rows(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_language_held_out(spark, documents):
    found = language_id.predict(documents, language_id.train(documents, per_lang=40))
    got = found.join(documents.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 20
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.9 * len(got)
    assert all(0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in found.collect())


def test_language_kernel_is_the_ridge_regression():
    texts = ["the cat and the dog", "der hund und die katze", "the bird of the sea", "das haus und der baum", "an old man and the sea", "die alte frau und das meer"]
    langs = ["en", "de"] * 3
    bits = np.zeros((6, 1 << language_id.BUCKET_BITS), np.uint8)
    for t, r in zip(texts, bits, strict=True):
        language_id.presence(t, r)
    model = language_id.fit([np.packbits(r).tobytes() for r in bits], langs, landmarks=6, ridge=1e-3)
    x = bits / np.sqrt(bits.sum(1, keepdims=True))  # all texts are landmarks: plain kernel ridge regression, classes weighing the same
    k, y = x @ x.T, np.where(np.array(langs)[:, None] == [["de", "en"]], 1.0, -1.0)
    assert np.allclose(x @ model.weights, k @ np.linalg.solve(k + 6e-5 * np.eye(6), y), atol=1e-3)
    assert language_id.score(["the man and the bird", "die katze und das haus", "1234 !!", ""], model)[0] == ["en", "de", "und", "und"]
    one, two = np.zeros((2, 1 << language_id.BUCKET_BITS), np.uint8)
    text = "ab cd éf " * 70_000
    language_id.presence(text, one)
    language_id.presence(text, two, piece=1000)
    assert (one == two).all()


def test_language_odd_rows(odd_docs, no_docs):
    model = language_id.train(odd_docs, per_lang=10)
    got = rows(language_id.predict(odd_docs, model), "doc_id", "lang_pred", "score")
    assert len(got) == odd_docs.count()
    assert {(d, p) for d, p, _ in got if d in (40, 41, 42)} == {(40, "und"), (41, "und"), (42, "und")}
    empty = language_id.train(no_docs)
    assert language_id.predict(no_docs, empty).count() == 0
    assert {r[0] for r in rows(language_id.predict(odd_docs, empty), "lang_pred")} == {"und"}


def base_spans(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.IGNORECASE) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


def markov_spans(text, odds):
    out, base, a = [], base_spans(text), secret_scan.ALPHABET
    for m in re.finditer(secret_scan.TOKEN, text or ""):
        total = sum(odds[a.index(x) * len(a) + a.index(y)] for x, y in zip("^" + m[0], m[0], strict=False))
        if total > 0.5 * len(m[0]) and not any(s < m.end() and m.start() < e for s, _, e in base):
            out.append((m.start(), 3, m.end()))
    return out


def joined(spans):
    return ",".join(f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in spans)


def test_secrets_against_plain_version(spark, documents, odd_docs):
    extra = spark.createDataFrame([(1000, "é token: token: password=abc, secret='abcdefghijklmn' 0123456789abcdef0 AKIA AKIA0123456789ABCD x" + " deadbeefdeadbeef" * 700), (1001, "key Zk3vT9qLw8XbN2mPs7RyUc4D and getUserNameFromTable"), (1002, "TOKEN=abcdef.ghij_kl==")], "doc_id long, text string")
    docs = documents.select("doc_id", "text").union(odd_docs.select("doc_id", "text")).union(extra)
    odds = secret_scan.train(secret_scan.rule_samples(spark))
    got = docs.select("doc_id", "text", secret_scan.spans_text(secret_scan.all_spans(F.coalesce("text", F.lit("")), odds)).alias("s")).collect()
    assert len(got) == docs.count()
    for r in got:
        assert r["s"] == joined(sorted([*base_spans(r["text"]), *markov_spans(r["text"], odds)])), r["doc_id"]
    by = {r["doc_id"]: r["s"] for r in got}
    assert by[1001] == "markov:4:28"
    assert by[1002].startswith("assign:0:22")


def test_secret_digest_and_mask(spark, odd_docs, no_docs):
    got = {r["doc_id"]: r for r in secret_scan.digest(odd_docs).collect()}
    assert got[45]["n_assign"] == 0 and got[45]["base_sha256"] == hashlib.sha256(joined(base_spans(odd_docs.where("doc_id = 45").first()["text"])).encode()).hexdigest()
    assert got[40]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert secret_scan.digest(no_docs).count() == 0
    odds = secret_scan.train(secret_scan.rule_samples(spark))
    docs = spark.createDataFrame([(1, "a password=abcdefabcdef0123456789 b", 7), (2, "plain", 8), (3, None, 9)], "doc_id long, text string, _spans int")
    masked = secret_scan.mask(docs, odds)
    assert masked.columns == docs.columns
    assert sorted(rows(masked, "doc_id", "text", "_spans")) == [(1, "a [secret] b", 7), (2, "plain", 8), (3, None, 9)]
    assert sum(secret_scan.train(no_docs.selectExpr("text", "true AS is_secret"))) == 0


def plain_print(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not w:
        return 0
    hashes = [xxhash.xxh64(" ".join(s).encode(), seed=42).intdigest() for s in (list(zip(w, w[1:], w[2:], strict=False)) or [w])]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(docs):
    prints = np.array([plain_print(t) for _, t in docs], np.uint64)
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in np.flatnonzero(np.bitwise_count(prints[i] ^ prints[i + 1 :]) <= 3) + i + 1:
            root[find(int(j))] = find(i)
    least = {}
    for i, (d, _) in enumerate(docs):
        r = find(i)
        least[r] = d if least.get(r) is None else min(least[r], d if d is not None else least[r])
    return [(d, f"{int(p):016x}", least[find(i)]) for i, (d, p) in enumerate(zip((d for d, _ in docs), prints, strict=True))]


def order(xs):
    return sorted(xs, key=str)


def test_near_duplicates_against_plain_version(spark, documents, odd_docs, no_docs):
    docs = documents.select("doc_id", "text").union(odd_docs.selectExpr("doc_id + 5000", "text"))
    want = plain_classes(rows(docs, "doc_id", "text"))
    for node_rows in (4096, 3):  # the second one deals most sub-tries as pairs of parts
        assert order(rows(simhash_dedup.near_duplicates(docs, node_rows=node_rows), "doc_id", "fingerprint", "component_id")) == order(want)
    kept = simhash_dedup.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    own = plain_classes(rows(odd_docs, "doc_id", "text"))
    assert kept.count() == len({c if c is not None else ("null", p) for _, p, c in own})
    assert simhash_dedup.near_duplicates(no_docs).count() == 0 and simhash_dedup.keep_one(no_docs).count() == 0


def test_sub_tries_dealt_as_pairs_of_nodes(spark):
    rng = np.random.default_rng(5)
    flips = np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (900, 3), dtype=np.uint64), axis=1)
    prints = np.unique(rng.integers(0, 1 << 63, 60, dtype=np.uint64)[rng.integers(0, 60, 900)] ^ flips).view(np.int64).tolist()
    frame = spark.createDataFrame([(p,) for p in prints], "fp long").repartition(4)

    def roots(pairs):
        least = {p: p for p in prints}

        def find(p):
            return p if least[p] == p else find(least[p])

        for a, b in pairs:
            a, b = find(a), find(b)
            least[max(a, b)] = min(a, b)
        return {p: find(p) for p in prints}

    want = roots((a, b) for a, b in combinations(prints, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3)
    for depth, node_rows in ((5, 4096), (4, 3)):  # the second one deals most nodes as pairs of parts
        assert roots(tuple(r) for r in simhash_dedup.links(frame, node_rows=node_rows, depth=depth).collect()) == want


def test_trie_walk_finds_all_pairs():
    rng = np.random.default_rng(3)
    for seeds, n, bits in ((3, 300, 16), (40, 2000, 48), (1, 900, 48)):
        base = rng.integers(0, 1 << bits, seeds, dtype=np.uint64)
        keys = np.unique(base[rng.integers(0, seeds, n)] ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, bits, (n, 3), dtype=np.uint64), axis=1))
        whole = [np.array([x]) for x in (0, len(keys), 0, len(keys))]
        got = {(int(a), int(b)) for i, j in simhash_dedup.walk_pairs(keys, whole, bits, 3, leaf=8, wide=64) for a, b in zip(i, j, strict=True)}
        i, j = np.nonzero(np.triu(np.bitwise_count(keys[:, None] ^ keys[None, :]) <= 3, 1))
        assert got == set(zip(i.tolist(), j.tolist(), strict=True))


def test_components_of_a_long_chain(spark):
    n = 200
    edges = spark.createDataFrame([(i, i + 1) for i in range(n) if i != 100] + [(7, 7)], "a long, b long")
    assert dict(rows(simhash_dedup.components(edges), "node", "root")) == {i: 0 if i <= 100 else 101 for i in range(n + 1)}


def test_encoder_gives_the_ids_of_tokenizers(documents):
    path = public_tokenizers.path("byte_bpe_50k.json")
    whole, encode = Tokenizer.from_file(path), packing.encoder(path)
    marks = [c for c in range(1, sys.maxunicode, 7) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"{chr(c)}a {chr(c)} 1{chr(c)}" for c in marks[i : i + 500]) for i in range(0, len(marks), 500)]
    texts += ["", " ", "  a\n\n b\t'S 'll I'm <|endoftext|> x", "<|endoftext|>", *(r["text"] for r in documents.limit(60).collect())]
    for t in texts:
        assert encode(t).tolist() == whole.encode(t, add_special_tokens=False).ids


def test_packing_round_trip(documents, odd_docs, no_docs):
    whole = Tokenizer.from_file(packing.default_vocabulary())
    for docs in (documents, odd_docs):
        pieces = docs.sparkSession.createDataFrame(packing.pack(docs.repartition(7), length=256).collect(), "doc_id long, start long, length long, sequence_id long, offset long, doc_tokens long, ids binary").collect()
        ids = {}
        for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
            ids.setdefault(p["sequence_id"], []).append(p)
        total = sum(p["length"] for p in pieces)
        assert sorted(ids) == list(range(-(-total // 256)))
        for k, ps in ids.items():
            at = 0
            for p in ps:
                assert p["offset"] == at and len(p["ids"]) == 4 * p["length"]
                at += p["length"]
            assert at == (256 if k < total // 256 else total % 256)
        whole_line = np.concatenate([np.frombuffer(p["ids"], "<u4") for ps in ids.values() for p in ps]).tolist()
        docs_in_order, got = [], []
        for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
            docs_in_order += [p["doc_id"]] if p["start"] == 0 else []
            got.append(p["doc_tokens"] if p["start"] == 0 else 0)
        assert sum(got) == total
        want = sorted((str(r["doc_id"]), [*whole.encode(r["text"] or "", add_special_tokens=False).ids, 1]) for r in docs.select("doc_id", "text").collect())
        cut, at = [], 0
        for d, n in zip(docs_in_order, [g for g in got if g], strict=True):
            cut.append((str(d), whole_line[at : at + n]))
            at += n
        assert sorted(cut) == want
    assert packing.pack(no_docs).count() == 0
    digests = packing.pack(odd_docs, digest=True).collect()
    assert {(r["length"], r["ids_crc32"]) for r in digests if r["doc_id"] == 40} == {(1, zlib.crc32(b"\x01\0\0\0"))}
    assert [packing.padding(n) for n in (2048, 4, 5, 3072, 2047)] == [0, 0, 2043, 0, 1]
