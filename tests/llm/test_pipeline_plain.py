"""The whole pipeline against plain versions of its stages, one after the other."""

from __future__ import annotations

import math
from collections import Counter

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F
from test_learned_operators import plain_matches
from test_near_copies import groups
from test_quality_plain import believed, described, measured, votes
from test_text_operators import base_spans, markov_spans
from tokenizers import Tokenizer

from folioscan.llm import packing, quality, secret_scan

SF = "/root/testdata/sf0.001"


def accepted(docs):
    """Of (doc_id, text) those that a scorer learned from all of them keeps."""
    seen = [measured(t) for _, t in docs]
    voted = [votes(f) for f, _ in seen]
    good = believed(Counter(voted))
    x = np.array([described(t, f, k) for (_, t), (f, k) in zip(docs, seen)])
    order = np.argsort([d for d, _ in docs])
    model = quality.fit(x[order].astype(np.float16).astype(np.float32), np.array([good[v] for v in voted])[order], np.ones(len(docs)))
    return [(d, t) for (d, t), (f, _), v in zip(docs, seen, x) if f is not None and 1 / (1 + math.exp(-float(v @ model.weights + model.bias))) >= 0.2]


def masked(text, odds):
    spans, out, end = sorted([*base_spans(text), *markov_spans(text, odds)]), "", 0
    for start, _, stop in spans:
        if start >= end:
            out += text[end:start] + "[secret]"
        end = max(end, stop)
    return out + text[end:]


def test_run_against_plain_stages(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    docs = [(r["doc_id"], r["text"] or "") for r in table.collect()]
    kept = sorted(accepted(docs))
    first = groups([t for _, t in kept])
    kept = [kept[i] for i in sorted(set(first))]  # ids come sorted, so the first of a group has the least
    leaks = {d for d, _ in plain_matches(kept, [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()])}
    kept = [(d, t) for d, t in kept if d not in leaks]
    odds = secret_scan.default_model(table.where(F.col("doc_id").isin([d for d, _ in kept])))
    coder = Tokenizer.from_file(packing.default_vocabulary())
    want = {d: len(coder.encode(masked(t, odds), add_special_tokens=False).ids) + 1 for d, t in kept}
    pieces = corpus_pipeline.run(spark, SF).collect()
    got = Counter()
    for p in pieces:
        got[p["doc_id"]] += p["length"]
        assert p["doc_tokens"] == want[p["doc_id"]]
    assert got == want and 50 < len(want) < len(docs) and leaks
    at = Counter()
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["offset"] == at[p["sequence_id"]]
        at[p["sequence_id"]] += p["length"]
    assert all(n == 2048 for k, n in at.items() if k < len(at) - 1)
