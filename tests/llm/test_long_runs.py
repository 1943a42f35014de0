"""Very long runs of one kind of character through packing and the other operators that read whole texts."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from folioscan.llm import packing

RUNS = {"blanks": " ", "line ends": "\n", "letters": "a", "digits": "7", "mixed": " \n", "marks": "!"}


@pytest.mark.parametrize("kind", RUNS)
def test_packing_of_a_million_and_more(spark, kind):
    whole = Tokenizer.from_file(packing.default_vocabulary())
    texts = [RUNS[kind] * (n // len(RUNS[kind])) for n in (1_000_000, 3_000_000)] + ["x" + RUNS[kind] * 700_000 + "y"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in sorted(packing.pack(docs).collect(), key=lambda r: (r["doc_id"], r["start"])):
        got.setdefault(r["doc_id"], []).append(r["ids"])
    for i, t in enumerate(texts):
        want = np.array([*whole.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes()
        assert zlib.crc32(b"".join(got[i])) == zlib.crc32(want)
