"""Wording rules on one text: banks of literals and patterns become arrays of findings.

Literals are searched for as they are. A pattern runs only over texts that hold one of the strings that it can't match without.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan import lexicon
from folioscan.config import Config
from folioscan.functions.text import folded, holds_any, may_match, needed, regex, strip, wide_at_start
from folioscan.model import HITS, hit

SUSPECT = "【疑似表述不当/用词不规范，仅供人工复核】"
BANK_ORDER = ("tn_colloquial", "tn_redundant", "tn_confusable", "tn_ambiguous", "tn_typo", "tn_en_typo", "tn_abbrev", "tn_units", "tn_grammar", "tn_vocab", "tn_asset_terms")


def _first(rule: str) -> int:
    return 1000 * BANK_ORDER.index(rule)


def literals(text: Column, rule: str, entries: Sequence[tuple[str, str]], config: Config, at: int = 0) -> Column:
    """One finding for each (phrase, detail) whose phrase is in the text."""
    bank = F.array(*(F.struct(F.lit(p).alias("p"), F.lit(d + SUSPECT).alias("d"), F.lit(_first(rule) + at + i).alias("i")) for i, (p, d) in enumerate(entries)))
    found = F.transform(F.filter(bank, lambda e: F.contains(text, e["p"])), lambda e: hit(rule, e["i"], e["d"], text, config))
    return F.when(holds_any(text, [p for p, _ in entries]), found).otherwise(F.array().cast(HITS))


def confusables(text: Column, config: Config) -> Column:
    rule, entries = "tn_confusable", lexicon.confusables()
    bank = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(n).alias("n"), F.lit(_first(rule) + i).alias("i")) for i, (a, b, n) in enumerate(entries)))
    seen = lambda e: F.array_join(F.filter(F.array(e["a"], e["b"]), lambda w: F.contains(text, w)), "、")
    some = F.filter(bank, lambda e: F.contains(text, e["a"]) | F.contains(text, e["b"]))
    found = F.transform(some, lambda e: hit(rule, e["i"], F.concat(F.lit("出现易混淆近义词「"), seen(e), F.lit("」"), e["n"], F.lit(SUSPECT)), text, config))
    return F.when(holds_any(text, [w for a, b, _ in entries for w in (a, b)]), found).otherwise(F.array().cast(HITS))


def _first_matches(text: Column, low: Column, patterns: Sequence[str]) -> Column:
    """The first match of each pattern as (m, i), i being its place in the bank; only of those that match."""
    found = [F.struct(F.when(may_match(low, p), F.regexp_extract(text, regex(p, True), 0)).alias("m"), F.lit(i).alias("i")) for i, p in enumerate(patterns)]
    parts = []
    for wide, own in groupby(range(len(patterns)), lambda i: all(map(wide_at_start, needed(patterns[i]))) and bool(needed(patterns[i]))):
        own = list(own)
        block = F.filter(F.array(*(found[i] for i in own)), lambda x: x["m"] != "")
        # most texts hold nothing that the patterns of a Chinese block need
        parts.append(F.when(holds_any(low, [n for i in own for n in needed(patterns[i])]), block).otherwise(F.array().cast("array<struct<m:string,i:int>>")) if wide else block)
    return F.concat(*parts)


def patterned(text: Column, low: Column, rule: str, entries: Sequence[tuple[str, str]], lead: str, config: Config, trim: bool = False) -> Column:
    """One finding for each (pattern, note) with the first match of the pattern, whatever its case; ``low`` is the folded text."""
    notes = F.array(*(F.lit(n) for _, n in entries))
    detail = lambda x: F.concat(F.lit(f"{lead}：命中「"), strip(x["m"]) if trim else x["m"], F.lit("」，"), F.get(notes, x["i"]), F.lit(SUSPECT))
    return F.transform(_first_matches(text, low, [p for p, _ in entries]), lambda x: hit(rule, x["i"] + _first(rule), detail(x), text, config))


def long_sentence(text: Column, config: Config) -> Column:
    rule, limit = "tn_ambiguous", int(config.param("tn_ambiguous", "max_sentence_len"))
    long = F.filter(F.transform(F.split(text, "[。！？；\n]"), strip), lambda s: F.length(s) > limit)
    detail = lambda s: F.concat(F.lit("疑似过长无标点长句（"), F.length(s).cast("string"), F.lit(f" 字，超过阈值 {limit} 字），建议适当断句以避免歧义{SUSPECT}"))
    return F.when(F.length(text) > limit, F.transform(F.slice(long, 1, 1), lambda s: hit(rule, _first(rule) + 900, detail(s), s, config))).otherwise(F.array().cast(HITS))


def misspelt(text: Column, low: Column, config: Config) -> Column:
    rule, entries = "tn_en_typo", lexicon.pairs("en_typo")
    bank = F.array(*(F.struct(F.lit(len(e)).alias("n"), F.lit(c).alias("c")) for e, c in entries))
    right = lambda x: F.concat(F.get(bank, x["i"])["c"], x["m"].substr(F.get(bank, x["i"])["n"] + 1, F.length(x["m"])))
    detail = lambda x: F.concat(F.lit("疑似英文拼写错误：「"), x["m"], F.lit("」应为「"), right(x), F.lit("」" + SUSPECT))
    return F.transform(_first_matches(text, low, [rf"\b{err}(?:ing|es|ed|ly|s|d)?\b" for err, _ in entries]), lambda x: hit(rule, x["i"] + _first(rule), detail(x), text, config))


def capitals(text: Column, config: Config) -> Column:
    """Tokens of two to five capitals that no list allows, in alphabetical order."""
    rule = "tn_abbrev"
    tokens = F.array_sort(F.array_except(F.array_distinct(F.regexp_extract_all(text, F.lit(regex(r"\b[A-Z]{2,5}\b")), F.lit(0))), F.array(*map(F.lit, lexicon.abbreviations()[1]))))
    return F.transform(tokens, lambda t, i: hit(rule, i + _first(rule) + 500, F.concat(F.lit("疑似自创 / 未定义缩写「"), t, F.lit("」，建议首次出现时给出全称" + SUSPECT)), text, config))


def mixed_money(text: Column, config: Config) -> Column:
    rule, wan, yi = "tn_units", F.contains(text, F.lit("万元")), F.contains(text, F.lit("亿元"))
    first = F.when(wan & text.rlike("(?<!万)元"), hit(rule, _first(rule) + 900, F.lit("同一处同时出现「万元」与「元」，数量单位表述不统一，建议统一为同一计量单位（如一律用“元”并注明金额）" + SUSPECT), text, config))
    second = F.when(wan & yi, hit(rule, _first(rule) + 901, F.lit("同一处同时出现「亿元」与「万元」，数量单位表述不统一，建议统一量级" + SUSPECT), text, config))
    return F.filter(F.array(first, second), lambda x: x.isNotNull())


def _noted(bank: str, lead: str, before: str, after: str) -> list[tuple[str, str]]:
    return [(p, f"{lead}「{p}」" + (f"{before}{n}{after}" if n else "")) for p, n in lexicon.pairs(bank)]


def hits(text: Column, low: Column, config: Config) -> Column:
    """All wording findings of a text, of which ``low`` is the folded form; rules that are off are not in the plan."""
    made = {
        "tn_colloquial": lambda: [literals(text, "tn_colloquial", _noted("colloquial", "出现疑似口语化 / 不规范表述", "，建议书面表达：", ""), config)],
        "tn_redundant": lambda: [literals(text, "tn_redundant", _noted("redundant", "出现疑似语义重复冗余表述", "（", "）"), config)],
        "tn_confusable": lambda: [confusables(text, config)],
        "tn_ambiguous": lambda: [literals(text, "tn_ambiguous", _noted("ambiguous", "出现易产生歧义 / 表意模糊词", "（", "）"), config), long_sentence(text, config)],
        "tn_typo": lambda: [literals(text, "tn_typo", [(e, f"疑似错别字：「{e}」可能为「{c}」的误写") for e, c in lexicon.pairs("typo")], config)],
        "tn_en_typo": lambda: [misspelt(text, low, config)],
        "tn_abbrev": lambda: [literals(text, "tn_abbrev", [(a, f"出现非正式简称「{a}」" + (f"（{n}）" if n else "")) for a, n in lexicon.abbreviations()[0]], config), capitals(text, config)],
        "tn_units": lambda: [F.when(text.rlike(regex(r"\d")), patterned(text, low, "tn_units", lexicon.patterns("units"), "数量 / 单位表述不规范", config, trim=True)).otherwise(F.array().cast(HITS)), mixed_money(text, config)],
        "tn_grammar": lambda: [patterned(text, low, "tn_grammar", lexicon.patterns("grammar"), "疑似语法错误", config)],
        "tn_vocab": lambda: [patterned(text, low, "tn_vocab", lexicon.patterns("vocab"), "疑似词汇搭配不当", config)],
        "tn_asset_terms": lambda: [patterned(text, low, "tn_asset_terms", lexicon.patterns("asset_terms"), "疑似资产评估术语表述不规范", config)],
    }
    parts = [p for rule in BANK_ORDER if config.on(rule) for p in made[rule]()]
    return F.concat(*(p.cast(HITS) for p in parts)) if parts else F.array().cast(HITS)


def check(units: DataFrame, config: Config | None = None) -> DataFrame:
    """``units`` with their wording findings in ``hits``; null texts have none."""
    text = F.coalesce("text", F.lit(""))
    return units.withColumn("_low", folded(text)).withColumn("hits", hits(text, F.col("_low"), config or Config())).drop("_low")
