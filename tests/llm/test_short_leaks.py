"""Documents that are shorter than the benchmark item they hold."""

from __future__ import annotations

import re
from collections import Counter

from folioscan.llm import decontaminate


def plain(docs, items):
    def bag(text):
        words = re.findall(r"\w+", text.lower())
        return [tuple(words[i : i + 5]) for i in range(len(words) - 4)]

    out = {}
    for d, text in docs:
        for i, item in items:
            own, all_ = bag(item), bag(text)
            if not own or not all_:
                continue
            windows = (Counter(all_[s : s + len(own)]) for s in range(max(1, len(all_) - len(own) + 1)))
            best = max((w & Counter(own)).total() / (w | Counter(own)).total() for w in windows)
            if best >= 0.8:
                out[d, i] = round(best, 9)
    return out


def test_documents_shorter_than_the_item(spark):
    item = [f"word{k}" for k in range(40)]
    items = [(1, " ".join(item)), (2, "a b c d e f g h i"), (3, "r r r r r r r r r r r r"), (4, " ".join(item[:9] + item[20:]))]
    cut = {f"{a}:{b}": item[a:b] for a in range(6) for b in range(30, 41)} | {f"no {k}": item[:k] + item[k + 1 :] for k in range(40)}
    texts = [" ".join(w) for w in cut.values()] + ["a b c d e f g h", "b c d e f g h i", "a b c d e f g", "r r r r r r r r r r r", "r " * 9, "", "a b c d"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = plain(list(enumerate(texts)), items)
    got = {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in decontaminate.matches(docs, bench).collect()}
    assert got == want and any(d == texts.index(" ".join(item[:38])) for d, _ in want) and {2, 3} <= {i for _, i in want}
    assert {r["doc_id"] for r in decontaminate.drop_leaks(docs, bench).collect()} == set(range(len(texts))) - {d for d, _ in want}
