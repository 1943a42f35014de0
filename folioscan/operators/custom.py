"""User rules and word banks.

Rules go into the plan as literals. Word banks of any size are found by ``operators.matcher``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.config import SEVERITY_LABELS
from folioscan.functions.text import clip, regex
from folioscan.lexicon import compiles
from folioscan.model import ISSUES
from folioscan.operators import matcher

RULE_HINT, ENTRY_HINT = "（自定义规则命中，仅供人工复核）", "（自定义词库命中，仅供人工复核）"
RULES = "gid string, gname string, scope string, g_enabled boolean, rid string, name string, enabled boolean, match_mode string, pattern string, severity string, tag string, suggestion string, ord int"
ENTRIES = "gid string, gname string, scope string, g_enabled boolean, eid string, keyword string, tag string, suggestion string, enabled boolean, ord int"


def _issue(row: DataFrame, key: Column, title: Column, severity: Column, detail: Column, suggestion: Column, kind: tuple[str, str]) -> DataFrame:
    return row.select(
        "doc_id", "doc_type", "unit_idx", F.col("ord"), key.alias("rule_key"), title.alias("rule_title"), severity.alias("severity"), "location", detail.alias("detail"), clip(F.col("text"), 120).alias("snippet"),
        suggestion.alias("suggestion"), F.lit("normal").alias("state"), F.lit(kind[0]).alias("category"), F.lit(kind[1]).alias("source"), F.col("gname").alias("group"), F.col("tag").alias("tag"),
    )


def _live(rows: list[dict]) -> list[dict]:
    return [r for r in rows if r.get("g_enabled", True) and r.get("enabled", True)]


def check_rules(units: DataFrame, rules: list[dict]) -> DataFrame:
    """Issues of user rules: a keyword is a substring, a regex is searched, case matters; an illegal regex matches nothing."""
    text, found = F.col("text"), []
    for n, r in enumerate(_live(rules)):
        pattern = r.get("pattern") or ""
        if not pattern or r.get("match_mode") == "regex" and not compiles(pattern):
            continue
        test = text.rlike(regex(pattern)) if r.get("match_mode") == "regex" else F.contains(text, F.lit(pattern))
        if r.get("scope", "all") != "all":
            test &= F.col("doc_type") == r["scope"]
        value = lambda k, other="", r=r: F.lit(r.get(k) if r.get(k) is not None else other)
        severity = r.get("severity") if r.get("severity") in SEVERITY_LABELS else "low"
        found.append(F.when(test, F.struct(value("gid").alias("gid"), value("gname").alias("gname"), value("rid").alias("rid"), value("name", "自定义规则").alias("name"), F.lit(pattern).alias("pattern"), F.lit(severity).alias("severity"), value("tag").alias("tag"), value("suggestion").alias("suggestion"), F.lit(r.get("ord", n)).alias("ord"))))
    if not found:
        return units.sparkSession.createDataFrame([], ISSUES)
    rows = units.where("text <> ''").select("doc_id", "doc_type", "unit_idx", "location", "text", F.inline_outer(F.filter(F.array(*found), lambda x: x.isNotNull()))).where("pattern is not null")
    detail = F.concat(F.lit("命中自定义规则「"), "name", F.lit("」：匹配「"), "pattern", F.lit("」" + RULE_HINT))
    return _issue(rows, F.concat_ws("_", F.lit("cust"), "gid", "rid"), F.col("name"), F.col("severity"), detail, F.col("suggestion"), ("custom_rule", "custom"))


def held_keywords(units: DataFrame, keywords: DataFrame) -> DataFrame:
    """doc_id, unit_idx, keyword: the distinct ``keyword`` of a bank that each text holds. Where millions of them are sought, findings are too many to say more of each."""
    found = matcher.held(units.where("text <> ''").select("doc_id", "unit_idx", "text"), "text", keywords, "keyword")
    return found if found is not None else units.sparkSession.createDataFrame([], "doc_id long, unit_idx int, keyword string")


def check_wordbank(units: DataFrame, entries: DataFrame) -> DataFrame:
    """Issues of word-bank entries, all low: a keyword is a substring."""
    live = entries.where("g_enabled and enabled and keyword <> ''").drop("g_enabled", "enabled")
    texts = units.where("text <> ''").select("doc_id", "doc_type", "unit_idx", "location", "text")
    rows = matcher.matches(texts, "text", live, "keyword", also=F.expr("scope = 'all' or scope = doc_type"))
    if rows is None:
        return units.sparkSession.createDataFrame([], ISSUES)
    detail = F.concat(F.lit("命中自定义词库「"), "gname", F.lit("」：匹配到「"), "keyword", F.lit("」" + ENTRY_HINT))
    return _issue(rows, F.concat_ws("_", F.lit("wb"), "gid", "eid"), F.col("keyword"), F.lit("low"), detail, F.col("suggestion"), ("wordbank", "wordbank"))
