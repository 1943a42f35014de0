"""Licence rules on short texts, their order, and the base phrases against plain regular expressions."""

from __future__ import annotations

import random
import re

import pytest

from folioscan.llm import license_scan as L

PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
COLUMNS = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"]


def plain(doc_id, text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    at = [(i, label) for phrase, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    places = [i for i, _ in at]
    return (doc_id, len(words), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({label for _, label in at})))


def test_base_phrases(spark, odd_docs, no_docs, documents):
    rng = random.Random(9)
    parts = ["gnu", "General", "public", "license", "LICENSE.", "apache", "mit", "cc", "by", "cc-by", "\n# ", "é", "KİT", "K", "MIT-License", "cc by ", "x"]
    texts = [" ".join(rng.choices(parts, k=rng.randint(0, 60))) for _ in range(300)]
    made = spark.createDataFrame([(i, t, "en", "s", 1, "", "", "", 1) for i, t in enumerate(texts)], odd_docs.schema)
    for docs in (made, odd_docs, no_docs, documents.select("doc_id", "text")):
        got = [tuple(r) for r in L.digest(L.scan(docs)).select(*COLUMNS).collect()]
        key = lambda r: tuple(str(x) for x in r)
        assert sorted(got, key=key) == sorted((plain(r.doc_id, r.text) for r in docs.collect()), key=key)


def labels(text):
    _, (found,) = L.scanner(L.default_rules())([text])
    return sorted({d["label"] for d in found if d["kept"]})


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("This work is licensed under the GNU General Public License, version 3.", ["gpl-3.0"]),
        ("Licensed under the Apache License, Version 2.0.", ["apache-2.0"]),
        ("Licensed under CC BY-NC 4.0.", ["cc-by-nc-4.0"]),
        ("Released under the MIT License.", ["mit"]),
        ("// SPDX-License-Identifier: GPL-2.0-or-later", ["gpl-2.0"]),
        ("# SPDX-License-Identifier: MIT-0", ["mit-0"]),
        ("GNU Lesser General Public License as published by the Free Software Foundation; version 2.1", ["lgpl-2.1"]),
        ("the GNU Affero General Public License v3.0 only", ["agpl-3.0"]),
        ("See https://creativecommons.org/licenses/by-sa/4.0/legalcode", ["cc-by-sa-4.0"]),
        ("Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International Public License", ["cc-by-nc-sa-4.0"]),
        ("Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions\n * are met", ["bsd-2-clause"]),
        ("Neither the name of the Foo project nor the names of its contributors may be used to endorse or promote products derived from this software", ["bsd-3-clause"]),
        ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ["mpl-2.0"]),
        ("Distributed under the Boost Software License, Version 1.0. (See https://www.boost.org/LICENSE_1_0.txt)", ["boost"]),
        ("This is free and unencumbered software released into the public domain.", ["unlicense"]),
        ("Copyright (c) 2020 Jane Doe. All rights reserved.", ["all-rights-reserved"]),
        ("released under the expat licence", ["mit"]),
        ("Der Text kommt mit Lizenz und ohne Garantie; mit uns, gpl, by the way.", []),
        ("The apache helicopter may permit a licence of taste.", []),
    ],
)
def test_short_texts(text, want):
    assert labels(text) == want


def test_every_rule_is_sound():
    rules = L.default_rules()
    assert len(rules) > 300 and len({(r.kind, r.pattern) for r in rules}) == len(rules)
    for r in rules:
        r.regex()
        assert all(k == k.strip() and re.fullmatch(r"[^\x00-\x1F\x21-\x2F\x3A-\x60\x7B-\x7F]+", k) for k in r.keywords), r


def test_gating_by_keywords_loses_nothing(documents):
    """On the documents and on texts made of the rules' own words, every rule tried on every text finds the same."""
    rules = L.default_rules()
    rng = random.Random(2)
    words = sorted({w for r in rules for w in re.findall(r"[a-z0-9]+", r.pattern)})
    texts = [r.text for r in documents.collect()] + [" ".join(rng.choices(words, k=300)) for _ in range(50)]
    said = [b" ".join(t.encode().translate(L._WORDS).split()).decode() for t in texts]
    for r in rules:
        regex = r.regex()
        assert all(any(k in m.group() for k in r.keywords) for t in said for m in regex.finditer(t)), r


def test_suppression_against_all_pairs():
    rng = random.Random(4)
    for _ in range(300):
        found = sorted({(a := rng.randrange(30), a + rng.randint(1, 12), rng.randrange(3), rng.randrange(9)) for _ in range(rng.randint(0, 25))})
        order = sorted(found, key=lambda f: (f[2], f[0], -f[1], f[3]))
        want = []
        for f in order:
            if not any(g[0] <= f[0] and g[1] >= f[1] for g in want):
                want.append(f)
        assert [f for f, k in zip(found, L.kept(found)) if k] == sorted(want)


def test_places_of_detections(spark):
    docs = spark.createDataFrame([(1, "Hello, the MIT License; and (MIT License) again")], "doc_id long, text string")
    (row,) = L.scan(docs).collect()
    assert row.n_words == 8
    assert [(d.label, d.kind, d.start, d.stop, d.kept) for d in row.detections] == [("mit", "name", 1, 4, True), ("mit", "base", 2, 4, False), ("mit", "base", 5, 7, True)]


def test_long_text_in_linear_time(spark):
    text = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software. Licensed under the Apache License and the MIT license. " * 20_000
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert L.digest(L.scan(docs)).first().n_base == 40_000


def test_rules_of_ones_own(spark):
    rules = L.read_rules(["# own", "", "acme | notice | acme | the acme ~2 licen[sc]e"])
    docs = spark.createDataFrame([(1, "the ACME license"), (2, None), (3, "by the Acme (very) open License"), (4, "the acme a b c license")], "doc_id long, text string")
    assert [(r.doc_id, [(d.label, d.start, d.stop) for d in r.detections]) for r in L.scan(docs, rules).orderBy("doc_id").collect()] == [(1, [("acme", 0, 3)]), (2, []), (3, [("acme", 1, 6)]), (4, [])]
    assert L.scan(docs, []).where("size(detections) > 0").count() == 0
    with pytest.raises(ValueError, match="unknown kind"):
        L.read_rules(["a | b | c | d"])
