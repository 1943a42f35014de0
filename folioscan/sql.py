"""The rules from SQL: views of what is checked, found and configured, and functions on texts.

Views are plans, not results: a query over ``issues`` runs only the scans and rules that it needs. Register staged frames where many queries follow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioscan.config import RULES, Config
from folioscan.functions.text import SPACE_LITERAL
from folioscan.plans import check as checks
from folioscan.plans import issues as views
from folioscan.plans import review, rules

#: SQL functions of one text each: name -> (parameters, type, body).
FUNCTIONS = {
    "folio_strip": ("t STRING", "STRING", f"btrim(t, {SPACE_LITERAL})"),
    "folio_bare": ("t STRING", "STRING", r"regexp_replace(coalesce(t, ''), r'(?U)[^\w]', '')"),
    "folio_clip": ("t STRING, n INT", "STRING", r"CASE WHEN length(t) > n THEN concat(left(translate(replace(t, '\r', ' '), '\n\t', '⏎→'), n), '…') ELSE translate(replace(t, '\r', ' '), '\n\t', '⏎→') END"),
    "folio_grounded": ("quote STRING, source STRING", "BOOLEAN", "CASE WHEN coalesce(quote, '') = '' OR coalesce(source, '') = '' THEN true ELSE folio_bare(quote) <> '' AND (contains(folio_bare(source), folio_bare(quote)) OR length(folio_bare(quote)) > 8 AND exists(transform(sequence(1, greatest(length(folio_bare(quote)) - 7, 1)), i -> substr(folio_bare(quote), i, 8)), r -> contains(folio_bare(source), r))) END"),
    "folio_weight": ("severity STRING", "INT", "CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"),
}


def rules_cfg(spark: SparkSession, config: Config | None = None) -> DataFrame:
    """(section, rule_key, rule_title, severity, suggestion, enabled) of the built-in rules."""
    config = config or Config()
    return spark.createDataFrame([(r.section, r.key, r.title, config.severity(r.key), r.suggestion, config.on(r.key)) for r in RULES.values()], "section string, rule_key string, rule_title string, severity string, suggestion string, enabled boolean")


def lexicon_rows(spark: SparkSession) -> DataFrame:
    """(bank, line_no, fmt, pattern, note, reason) of the built-in banks; reason is null for lines that are well formed."""
    return rules.check_lines(rules.bank_lines(spark)).select("bank", "line_no", "fmt", "pattern", "note", "reason")


def register(spark: SparkSession, units: DataFrame | str, issues: DataFrame | None = None, files: DataFrame | None = None, config: Config | None = None, own_rules: list[dict] | None = None) -> None:
    """Views ``units``, ``issues``, ``rules_cfg``, ``lexicon`` and, with ``files``, ``file_results``; and the functions.

    ``units`` may be the name of a view or table of one's own, with the columns of ``model.UNITS``; unless ``issues`` are given, the rules on texts run over it.
    """
    rows = spark.table(units) if isinstance(units, str) else units
    found = checks.text_issues(rows, config or Config(), own_rules) if issues is None else issues
    named = {"issues": found, "rules_cfg": rules_cfg(spark, config), "lexicon": lexicon_rows(spark)}
    if not isinstance(units, str) or units != "units":
        named["units"] = rows
    if files is not None:
        named["file_results"] = views.file_results(files, found, config)
    for name, frame in named.items():
        frame.createOrReplaceTempView(name)
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    spark.udf.register("folio_repair_json", review.repair_json)
