"""Text units, issues and file results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.config import RULES, Config
from folioscan.functions.text import clip

UNITS = "doc_id long, doc_type string, unit_kind string, unit_idx int, location string, text string"
#: What a rule finds in one unit; ``ord`` orders findings inside the unit.
HITS = "array<struct<rule_key:string,ord:int,detail:string,snippet:string,severity:string>>"
ISSUES = "doc_id long, doc_type string, unit_idx int, ord int, rule_key string, rule_title string, severity string, location string, detail string, snippet string, suggestion string, state string, category string, source string, group string, tag string"


def hit(rule: str, at: Column | int, detail: Column, snippet: Column, config: Config, severity: str | None = None) -> Column:
    return F.struct(F.lit(rule).alias("rule_key"), (F.lit(at) if isinstance(at, int) else at).cast("int").alias("ord"), detail.alias("detail"), snippet.alias("snippet"), F.lit(severity or config.severity(rule)).alias("severity"))


def paragraph_location(page: Column, idx: Column, estimated: Column) -> Column:
    known = F.concat(F.lit("第 "), page.cast("string"), F.lit(" 页"), F.when(estimated, "（估算）").otherwise(""), F.lit(" · 第 "), idx.cast("string"), F.lit(" 段"))
    return F.coalesce(known, F.lit("页码无法自动识别，请人工核对"))


def sheet_location(sheet: Column, row: Column, col: Column) -> Column:
    return F.concat(sheet, F.lit("：第 "), row.cast("string"), F.lit(" 行，第 "), col.cast("string"), F.lit(" 列"))


def page_location(page: Column) -> Column:
    return F.concat(F.lit("第 "), page.cast("string"), F.lit(" 页"))


def told(found: DataFrame, *keys: str) -> DataFrame:
    """One row for each of the ``hits``, with the columns ``keys``.

    An outer generator and a filter behind it: before an inner one Spark puts a filter on the size of the array, which computes all findings twice.
    """
    return found.select(*keys, F.inline_outer("hits")).where("rule_key is not null")


def to_issues(found: DataFrame, section_ord: int = 0) -> DataFrame:
    """Issues of built-in rules. ``found``: doc_id, doc_type, unit_idx, location and hits (an array)."""
    flat = told(found, "doc_id", "doc_type", "unit_idx", "location")
    names = F.create_map(*(F.lit(x) for r in RULES.values() for x in (r.key, r.title)))
    advice = F.create_map(*(F.lit(x) for r in RULES.values() for x in (r.key, r.suggestion)))
    return flat.select(
        "doc_id", "doc_type", "unit_idx", (F.col("ord") + section_ord * 100_000).alias("ord"), "rule_key", F.element_at(names, F.col("rule_key")).alias("rule_title"), "severity", "location", "detail",
        clip(F.col("snippet"), 120).alias("snippet"), F.element_at(advice, F.col("rule_key")).alias("suggestion"), F.lit("normal").alias("state"), F.lit("").alias("category"), F.lit("builtin").alias("source"), F.lit("").alias("group"), F.lit("").alias("tag"),
    )
