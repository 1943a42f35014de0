"""Licences named or quoted in texts, by ordered signature rules.

A text is reduced to its words, lower-cased and joined by single spaces, so that line breaks, comment signs and punctuation make no difference. One pass of an
Aho-Corasick automaton finds which keywords the text holds, and only rules with one of these are tried. ``license_rules.txt`` has the rules, each a regex over words with
a label and a kind. Kinds have an order: a whole licence text speaks louder than a notice, that louder than a tag, an address or a name. A detection whose words all lie within
those of one of a higher kind, or of a longer one of the same kind, is suppressed; of equal ones the earlier rule stays. ``base`` rules are phrases whose
places are all counted, overlapped or not.

A null text has no words and no detections, like an empty one. Very long texts are scanned whole; rules have bounded gaps, so the time follows the text. Rows are kept one
for one, repeated rows and null ids included. Columns other than those to keep and text are not looked at. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from pathlib import Path

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import map_texts

RULES = Path(__file__).with_name("license_rules.txt")
#: Kinds in their order, each with the confidence of its detections.
KINDS = {"text": 0.99, "notice": 0.95, "tag": 0.98, "url": 0.9, "name": 0.7, "base": 0.7}
MADE = "n_words long, detections array<struct<label:string,kind:string,start:bigint,stop:bigint,kept:boolean>>"

#: To lower case what is A to Z, and to a space what is no part of a word: ASCII without digits and letters.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


@dataclass(frozen=True)
class Rule:
    label: str
    kind: str
    keywords: tuple[str, ...]
    pattern: str

    def regex(self) -> re.Pattern:
        gaps = re.sub(r" ~(\d+) ", r"(?: [^ ]+){0,\1}? ", self.pattern)
        return re.compile(f"(?<![^ ])(?:{gaps})(?![^ ])")


def read_rules(lines: Sequence[str]) -> list[Rule]:
    """Rules of lines ``label | kind | keywords | pattern``; blank lines and those that begin with # are left out."""
    out = []
    for line in lines:
        if line.strip() and not line.startswith("#"):
            label, kind, keywords, pattern = line.strip().split(" | ", 3)
            if kind not in KINDS:
                raise ValueError(f"unknown kind {kind!r}")
            out.append(Rule(label, kind, tuple(keywords.split(", ")), pattern))
    return out


def default_rules() -> list[Rule]:
    return read_rules(RULES.read_text().splitlines())


def kept(found: list[tuple[int, int, int, int]]) -> list[bool]:
    """Which of (start, stop, rank of the kind, rule) stay; none lies within one of a lower rank, or of its own rank and before it."""
    stays = [False] * len(found)
    starts, reach = np.empty(0, np.int64), np.empty(0, np.int64)  # of what is kept: starts, and the furthest stop of those up to each
    for rank in sorted({f[2] for f in found}):
        own = sorted((f[0], -f[1], f[3], k) for k, f in enumerate(found) if f[2] == rank)
        furthest, new = -1, []
        for start, stop, _, k in own:
            stop = -stop
            before = int(np.searchsorted(starts, start, side="right"))
            if stop > furthest and not (before and reach[before - 1] >= stop):
                stays[k] = True
                furthest = stop
                new.append((start, stop))
        both = sorted([*zip(starts.tolist(), reach.tolist(), strict=True), *new])
        starts = np.array([s for s, _ in both], np.int64)
        reach = np.maximum.accumulate(np.array([e for _, e in both], np.int64)) if both else starts
    return stays


def scanner(rules: Sequence[Rule]) -> Callable[[list[str]], tuple[list, list]]:
    ranks = {kind: k for k, kind in enumerate(KINDS)}
    regexes, automaton, of = [r.regex() for r in rules], ahocorasick.Automaton(), {}
    for k, rule in enumerate(rules):
        for word in rule.keywords:
            of.setdefault(word, []).append(k)
    for word, which in of.items():
        automaton.add_word(word, which)
    if of:
        automaton.make_automaton()

    def one(text: str) -> tuple[int, list[dict]]:
        words = text.encode().translate(_WORDS).split()  # what is left of ASCII white space is spaces
        said = b" ".join(words).decode()
        asked = sorted({k for _, which in automaton.iter(said) for k in which}) if of else []
        found = sorted((m.start(), m.end(), ranks[rules[k].kind], k) for k in asked for m in regexes[k].finditer(said))
        out, place, at = [], 0, 0
        for (start, stop, _, k), stays in zip(found, kept(found), strict=True):
            place, at = place + said.count(" ", at, start), start
            out.append({"label": rules[k].label, "kind": rules[k].kind, "start": place, "stop": place + said.count(" ", start, stop) + 1, "kept": stays})
        return len(words), out

    def scan(texts: list[str]) -> tuple[list, list]:
        done = [one(t) for t in texts]
        return [n for n, _ in done], [found for _, found in done]

    return scan


def scan(docs: DataFrame, rules: Sequence[Rule] | None = None, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of each row with n_words and its detections by place: label, kind, words from start to before stop, and whether it is kept."""
    rules = default_rules() if rules is None else list(rules)
    return map_texts(docs, lambda: scanner(rules), MADE, keep)


def digest(scanned: DataFrame) -> DataFrame:
    """Counts and places of the base phrases, their labels, all labels, and the confidence of the surest detection."""
    base = F.filter("detections", lambda d: d["kind"] == "base")
    told = F.filter("detections", lambda d: d["kept"] | (d["kind"] == "base"))
    labels = lambda found: F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda d: d["label"]))), ",")
    sure = F.lit(0.0)
    for kind, confidence in KINDS.items():
        sure = F.greatest(sure, F.when(F.exists(told, lambda d: d["kind"] == kind), F.lit(confidence)).otherwise(F.lit(0.0)))  # noqa: B023
    starts = F.transform(base, lambda d: d["start"])
    return scanned.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), labels(base).alias("base_labels"), labels(told).alias("labels"), sure.alias("score")
    )
