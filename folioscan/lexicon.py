"""The built-in banks, read when a plan is built; patterns that do not compile are dropped there."""

from __future__ import annotations

import re
from functools import cache

from folioscan.config import HERE

BANKS = ("colloquial", "redundant", "confusable", "ambiguous", "typo", "en_typo", "abbrev", "units", "grammar", "vocab", "asset_terms")
WHITELIST_MARK = "-----WHITELIST-----"


@cache
def lines(bank: str) -> tuple[str, ...]:
    """Live lines of a bank: trimmed, no blanks, no comments."""
    found = (x.strip() for x in (HERE / f"{bank}.txt").read_text(encoding="utf-8").splitlines())
    return tuple(x for x in found if x and not x.startswith("#"))


def compiles(pattern: str) -> bool:
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True


@cache
def pairs(bank: str) -> tuple[tuple[str, str], ...]:
    """(phrase, note) by the first bar; the note may be missing."""
    found = [x.partition("|") for x in lines(bank)]
    return tuple((a.strip(), b.strip()) for a, _, b in found if a.strip())


@cache
def patterns(bank: str) -> tuple[tuple[str, str], ...]:
    """(pattern, note): units split on the first bar, the others on the last."""
    found = [x.split("|", 1) if bank == "units" else x.rsplit("|", 1) for x in lines(bank) if "|" in x]
    return tuple((p.strip(), n.strip()) for p, n in found if p.strip() and compiles(p.strip()))


@cache
def confusables() -> tuple[tuple[str, str, str], ...]:
    """(a, b, note); each ordered pair once."""
    found: dict[tuple[str, str], str] = {}
    for x in lines("confusable"):
        a, b, *note = (p.strip() for p in x.split("|", 2))
        found.setdefault((a, b), note[0] if note else "")
    return tuple((a, b, n) for (a, b), n in found.items())


@cache
def abbreviations() -> tuple[tuple[tuple[str, str], ...], tuple[str, ...]]:
    """((short form, note), ...) not to be used, and upper-case tokens that may be."""
    found = lines("abbrev")
    at = found.index(WHITELIST_MARK)
    short = [x.partition("|") for x in found[:at]]
    return tuple((a.strip(), b.strip()) for a, _, b in short), tuple(x.upper() for x in found[at + 1 :])


@cache
def sentence_patterns() -> tuple[tuple[str, str, str, str, str], ...]:
    """(rule, pattern, note, sensitivity, severity) in order."""
    out, rule = [], ""
    for x in lines("fluency"):
        if x.startswith("[fl_") and x.endswith("]"):
            rule = x[1:-1]
            continue
        pattern, note, sensitivity, severity = (p.strip() for p in x.rsplit("|", 3))
        if compiles(pattern):
            out.append((rule, pattern, note, sensitivity or "normal", severity))
    return tuple(out)
