"""Sentence patterns: of each sentence, the first enabled pattern within the sensitivity is reported."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan import lexicon
from folioscan.config import Config
from folioscan.functions.text import clip, may_match, needed, regex, strip
from folioscan.model import HITS, hit

#: Sensitivities and their levels.
LEVELS = {"loose": 0, "normal": 1, "strict": 2}


def sentences(text: Column) -> Column:
    """Sentences of four characters or more."""
    return F.filter(F.transform(F.split(text, "[。！？；!?;]+"), strip), lambda s: F.length(s) >= 4)


def hits(text: Column, config: Config) -> Column:
    level = LEVELS.get(config.sensitivity, 1)
    live = [(r, p, n, sev) for r, p, n, sens, sev in lexicon.sentence_patterns() if LEVELS.get(sens, 1) <= level and config.on(r)]
    if not live:
        return F.array().cast(HITS)

    def first(s: Column, i: Column) -> Column:
        told = lambda p, n: F.concat(F.lit("疑似语句不通顺：命中「"), clip(F.regexp_extract(s, regex(p), 0), 40), F.lit(f"」，{n}"))
        return F.coalesce(*(F.when(may_match(s, p) & s.rlike(regex(p)), hit(r, i, told(p, n), s, config, sev or None)) for r, p, n, sev in live))

    found = F.filter(F.transform(sentences(text), first), lambda x: x.isNotNull())
    # a text that holds no string that some pattern needs has no sentence to look at
    some = reduce(lambda a, b: a | b, (F.contains(text, F.lit(n)) for n in sorted({n for _, p, _, _ in live for n in needed(p)}))) if all(needed(p) for _, p, _, _ in live) else F.lit(True)
    return F.when(some, found).otherwise(F.array().cast(HITS))


def check(units: DataFrame, config: Config | None = None) -> DataFrame:
    return units.withColumn("hits", hits(F.coalesce("text", F.lit("")), config or Config()))
