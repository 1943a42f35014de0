"""Text helpers as Column expressions. ``strip`` and regular expressions follow Unicode, as in Python."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import cache, reduce
from re import _constants as sre  # the parsed form of a pattern; there is no public one

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Invisible characters and their visible marks.
VISIBLE = {"\u3000": "␣(全角空格)", "\u00a0": "␣(不换行空格)", "\u200b": "·(零宽空格)", "\u200c": "·(零宽非连接)", "\u200d": "·(零宽连接)", "\ufeff": "·(BOM)", "\u000b": "⇩(垂直制表)"}


#: The characters that are white space in Unicode.
WHITE = "\t\n\u000b\f\r \u0085\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


#: The same as a literal of Spark's SQL.
SPACE_LITERAL = "'" + "".join(f"\\u{ord(c):04x}" for c in WHITE) + "'"


def strip(text: Column) -> Column:
    """Without white space at both ends, of any script."""
    return F.btrim(text, F.lit(WHITE))


def regex(pattern: str, ignore_case: bool = False) -> str:
    """A Python pattern for Spark: classes and word borders are Unicode's."""
    return ("(?iU)" if ignore_case else "(?U)") + pattern


def folded(text: Column) -> Column:
    """Lower case, with the two letters that a search without case takes for i and s."""
    return F.translate(F.lower(text), "ıſ", "is")


@cache
def all_needed(pattern: str) -> tuple[tuple[str, ...], ...]:
    """Sets of strings in lower case, of each of which every match of a pattern holds one at least, those of long strings first; none if nothing is known."""

    def best(found: list[set[str]]) -> set[str]:
        return max((f for f in found if f and all(f)), key=lambda f: min(map(len, f)), default=set())

    def of(items) -> set[str]:
        return best(every(items))

    def every(items) -> list[set[str]]:
        found, run = [], ""
        for op, value in [*items, (sre.AT, None)]:
            if op is sre.LITERAL:
                run += chr(value).lower()
                continue
            if op is sre.AT and value is not None:
                continue  # a border or an end has no characters
            found.append({run})
            run = ""
            if op is sre.SUBPATTERN:
                found.append(of(value[3]))
            elif op is sre.BRANCH:
                ways = [of(way) for way in value[1]]
                found.append(set().union(*ways) if all(ways) else set())
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and value[0]:
                found.append(of(value[2]))
        return found

    sets = {tuple(sorted(f)) for f in every(re._parser.parse(pattern)) if f and all(f)}
    return tuple(sorted(sets, key=lambda f: (-min(map(len, f)), len(f), f)))


def needed(pattern: str) -> tuple[str, ...]:
    """Strings in lower case of which every match of a pattern holds one at least, as long as can be found; none if nothing is known."""
    return next(iter(all_needed(pattern)), ())


@cache
def loose(pattern: str) -> str:
    """A pattern for folded texts that matches wherever ``pattern`` does: word borders at its ends are places beside no ASCII letter, others are not looked at.

    Unicode's word borders, tried at every character, are what makes a pattern slow.
    """
    short = re.sub(r"\(\?!(?:[^()]|\([^()]*\))*\)", "", pattern)
    if re.search(r"\(\?[^:]|\\[^bsd]|\{", short):
        return ""  # something else that is special, or a count of characters: one letter becomes two in lower case
    short = re.sub(r"^\\b([a-z]+)", lambda m: f"{m[1]}(?<![a-z].{{{len(m[1])}}})", short.lower())
    short = re.sub(r"\\b$", "(?![a-z])", short).replace("\\b", "")
    return short.replace("\\s", "[" + "".join(f"\\x{{{ord(c):x}}}" for c in WHITE) + "]").replace("\\d", "\\p{Nd}")


def may_match(text: Column, pattern: str) -> Column:
    """False only for folded texts in which a pattern can't match: plain searches are many times cheaper than a pattern, and one without word borders than one with them."""
    tests = [reduce(lambda a, b: a | b, (F.contains(text, F.lit(n)) for n in some)) for some in all_needed(pattern)]
    if loose(pattern):
        tests.append(text.rlike(loose(pattern)))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def wide_at_start(phrase: str) -> bool:
    """Whether a phrase begins with a Chinese character."""
    return "一" <= phrase[:1] <= "鿿"


def holds_any(text: Column, phrases: Sequence[str]) -> Column:
    """Whether a text holds one of some phrases: those that begin with a Chinese character are sought at such characters alone, in one pass."""
    wide = sorted(set(filter(wide_at_start, phrases)))
    tests = [F.contains(text, F.lit(p)) for p in sorted(set(phrases) - set(wide))]
    if wide:
        ways = (c + "(?:" + "|".join(re.escape(p[1:]) for p in wide if p[0] == c) + ")" for c in sorted({p[0] for p in wide}))
        tests.insert(0, text.rlike(f"(?=[一-鿿])(?:{'|'.join(ways)})"))
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def occurrences(text: Column, part: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: an expression named inside a lambda would be computed again for each element."""
    return F.get(F.transform(F.array(value), body), 0)


def runs(text: Column, k: int, holding: str = "") -> Column:
    """All runs of ``k`` characters, or those that hold one of a class: a pattern that looks ahead from each character finds them in one pass over the text."""
    some = f"(?=.{{0,{k - 1}}}[{holding}])" if holding else ""
    return F.regexp_extract_all(text, F.lit(rf"(?s)(?![\x{{DC00}}-\x{{DFFF}}]){some}(?=(.{{{k}}}))"), F.lit(1))


def clip(text: Column, n: int) -> Column:
    """Line breaks and tabs made visible, cut to ``n`` characters with an ellipsis."""
    flat = F.translate(F.replace(text, F.lit("\r"), F.lit(" ")), "\n\t", "⏎→")
    return F.when(F.length(flat) > n, F.concat(F.substring(flat, 1, n), F.lit("…"))).otherwise(flat)


def visualize(text: Column) -> Column:
    """Invisible characters as marks."""
    return reduce(lambda t, kv: F.replace(t, F.lit(kv[0]), F.lit(kv[1])), VISIBLE.items(), text)


def human_size(size: Column) -> Column:
    """Bytes as B, KB, MB or GB."""
    unit = lambda k, name: F.format_string(f"%.1f {name}", F.bround(size / (1 << k), 1))  # noqa: E731  ties go to the even digit
    return F.when(size < 1 << 10, F.format_string("%d B", size)).when(size < 1 << 20, unit(10, "KB")).when(size < 1 << 30, unit(20, "MB")).otherwise(unit(30, "GB"))


def kept(*hits: Column) -> Column:
    """The non-null ones of some structs, as an array."""
    return F.filter(F.array(*hits), lambda x: x.isNotNull())


def joined(parts: list[Column], by: str) -> Column:
    """Parts that are not null, joined."""
    return F.array_join(F.array(*parts), by)


def column_letter(col: Column) -> Column:
    """1 -> A, 27 -> AA, up to three letters."""
    letter = lambda n: F.char(F.lit(64) + n)
    low, rest = F.pmod(col - 1, F.lit(26)) + 1, F.floor((col - 1) / 26).cast("int")
    mid, high = F.pmod(rest - 1, F.lit(26)) + 1, F.floor((rest - 1) / 26).cast("int")
    return F.concat(F.when(high > 0, letter(high)).otherwise(""), F.when(rest > 0, letter(mid)).otherwise(""), letter(low))
