"""Hygiene of rules: validation, batch filters, a scan of all rules, entries and bank lines for invalid and repeated ones."""

from __future__ import annotations

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscan import lexicon
from folioscan.config import RULES, Config
from folioscan.functions.text import strip
from folioscan.operators import custom

#: Characters that are noise alone.
NOISE = (
    "的 了 是 在 和 与 或 及 为 以 于 之 其 而 且 但 也 就 都 很 把 被 对 从 向 往 由 因 当 这 那 此 你 我 他 她 它 们 一 不 有 无 上 下 中 内 外 前 后 时 年 月 日 等 并 若 如 则 即 按 据 依 随 应 须 需 可 能 会 要 请 让 用"
    " 各 每 某 本 该 既 亦 又 再 才 只 将 已 尚 多 少 数 几 何"
).split()
#: The format of each bank's lines.
FORMATS = {"colloquial": "kv", "redundant": "kv", "ambiguous": "kv", "typo": "pair", "en_typo": "pair", "confusable": "confusable", "units": "regex", "grammar": "regex", "vocab": "regex", "asset_terms": "regex", "abbrev": "abbrev"}
SHAPE = "source string, entity_id string, ord long, match_mode string, pattern string, suggestion string"


@F.pandas_udf(T.BooleanType())
def compiles(patterns: pd.Series) -> pd.Series:
    """Whether Python's ``re`` takes the pattern."""
    return patterns.map(lambda p: p is not None and lexicon.compiles(p)).astype(bool)


def _clean(name: str) -> Column:
    return strip(F.coalesce(name, F.lit("")))


def validate(items: DataFrame, existing: DataFrame, check_standard: bool = True) -> DataFrame:
    """``items`` with ``reason``: why a rule (or a word-bank entry: match_mode null) cannot be taken in, null if it can; the first reason counts.

    ``existing``: kind (pattern, suggestion or keyword), match_mode, value. Membership is tested by joins.
    """
    rows = items.withColumn("_p", _clean("pattern")).withColumn("_s", _clean("suggestion")).withColumn("_m", F.coalesce("match_mode", F.lit("")))
    standard = existing.where("kind = 'suggestion'").select(F.col("value").alias("_p"), F.lit(True).alias("_standard")).distinct()
    taken = existing.where("kind <> 'suggestion'").select(F.col("value").alias("_p"), F.when(F.col("kind") == "keyword", "").otherwise(F.coalesce("match_mode", F.lit("keyword"))).alias("_m"), F.lit(True).alias("_taken")).distinct()
    rows = rows.join(standard, "_p", "left").join(taken, ["_p", "_m"], "left")
    entry = F.col("_m") == ""
    word = lambda rule, own: F.when(entry, own).otherwise(rule)
    reason = (
        F.when(F.col("_p") == "", word("匹配式为空或全为空白字符", "关键词为空或全为空白字符"))
        .when(F.col("_s") == "", F.lit("建议替换字段为空"))
        .when(F.col("_p") == F.col("_s"), word("匹配式与建议替换完全相同，为无效规则", "关键词与建议替换完全相同，为无效词条"))
        .when(F.col("_p").isin(NOISE), word("匹配式为纯通用无意义单字，易大量误命中", "关键词为纯通用无意义单字，易大量误命中"))
        .when((F.col("_m") == "regex") & ~F.col("_ok"), F.lit("正则表达式无法编译"))
        .when(F.col("_standard") & (F.lit(check_standard) | ~entry), F.lit("标准正确术语不能作为匹配触发条件（标准术语只能放在建议替换栏）"))
        .when(F.col("_taken"), word("匹配式与模式和库内已有规则完全一致，重复规则拒绝入库", "关键词与库内已有词条重复，拒绝重复入库"))
    )
    return rows.withColumn("_ok", compiles("_p")).withColumn("reason", reason).drop("_p", "_s", "_m", "_ok", "_standard", "_taken")


def filter_batch(items: DataFrame, existing: DataFrame, known_ids: DataFrame | None = None, dedup: bool = False) -> DataFrame:
    """``items`` with reason and kept. Known ids pass as they are; with ``dedup`` a later item that repeats an accepted one is turned away too."""
    rows = validate(items, existing)
    if known_ids is not None:
        rows = rows.join(known_ids.select("entity_id", F.lit(True).alias("_known")).distinct(), "entity_id", "left").withColumn("reason", F.when(~F.coalesce("_known", F.lit(False)), F.col("reason"))).drop("_known")
    if dedup:
        same = W.partitionBy(F.coalesce("match_mode", F.lit("")), _clean("pattern"), F.col("reason").isNull()).orderBy("ord")
        again = F.when(F.col("match_mode").isNull(), "关键词与库内已有词条重复，拒绝重复入库").otherwise("匹配式与模式和库内已有规则完全一致，重复规则拒绝入库")
        rows = rows.withColumn("_n", F.row_number().over(same)).withColumn("reason", F.when(F.col("reason").isNull() & (F.col("_n") > 1), again).otherwise(F.col("reason"))).drop("_n")
    return rows.withColumn("kept", F.col("reason").isNull())


def existing_of(rules: DataFrame, entries: DataFrame) -> DataFrame:
    """(kind, match_mode, value) of stored patterns, suggestions and keywords."""
    of = lambda df, kind, mode, value: df.select(F.lit(kind).alias("kind"), mode.alias("match_mode"), _clean(value).alias("value"))
    none = F.lit(None).cast("string")
    parts = [of(rules, "pattern", F.coalesce("match_mode", F.lit("keyword")), "pattern"), of(rules, "suggestion", none, "suggestion"), of(entries, "keyword", none, "keyword"), of(entries, "suggestion", none, "suggestion")]
    whole = parts[0]
    for more in parts[1:]:
        whole = whole.unionByName(more)
    return whole.where("value <> ''").distinct()


def bank_lines(spark: SparkSession) -> DataFrame:
    """(bank, line_no, fmt, line) of all built-in banks; the whitelist of short forms is left out."""
    rows = []
    for bank, fmt in FORMATS.items():
        found = lexicon.lines(bank)
        found = found[: found.index(lexicon.WHITELIST_MARK)] if bank == "abbrev" else found
        rows += [(bank, n, fmt, line) for n, line in enumerate(found, 1)]
    return spark.createDataFrame(rows, "bank string, line_no int, fmt string, line string")


def check_lines(lines: DataFrame) -> DataFrame:
    """Bank lines with pattern, note and reason (null: well formed)."""
    bar, last = F.contains("line", F.lit("|")), F.col("fmt").isin("regex")
    head = F.when(last, F.regexp_extract("line", r"(?s)^(.*)\|", 1)).otherwise(F.substring_index("line", "|", 1))
    tail = F.when(last, F.substring_index("line", "|", -1)).otherwise(F.col("line").substr(F.instr("line", "|") + 1, F.length("line")))
    tail = F.when(F.col("fmt") == "confusable", F.substring_index(tail, "|", 1)).otherwise(tail)
    rows = lines.withColumn("pattern", strip(F.when(bar, head).otherwise(F.col("line")))).withColumn("note", strip(F.when(bar, tail).otherwise("")))
    rows = rows.withColumn("_ok", compiles("pattern"))
    fmt, none, same, missing = F.col("fmt"), F.col("pattern") == "", F.col("pattern") == F.col("note"), F.col("note") == ""
    reason = (
        F.when(~bar & fmt.isin("kv", "pair", "regex"), "词库行格式错误：缺少 | 分隔符")
        .when(~bar & (fmt == "confusable"), "词库行格式错误：需要「词A|词B」两列")
        .when((fmt == "kv") & none, "匹配内容为空").when((fmt == "kv") & same, "匹配内容与说明完全相同")
        .when((fmt == "pair") & none, "错误写法为空").when((fmt == "pair") & missing, "正确写法为空").when((fmt == "pair") & same, "错误写法与正确写法完全相同")
        .when((fmt == "confusable") & (none | missing), "易混淆词对中存在空项").when((fmt == "confusable") & same, "词A 与 词B 完全相同")
        .when((fmt == "regex") & none, "正则模式为空").when((fmt == "regex") & missing, "说明 / 建议为空").when((fmt == "regex") & same, "正则模式与说明完全相同").when((fmt == "regex") & ~F.col("_ok"), "正则表达式无法编译")
        .when((fmt == "abbrev") & none, "简称内容为空").when((fmt == "abbrev") & bar & same, "简称与说明完全相同")
    )
    return rows.withColumn("reason", reason).drop("_ok")


def scan(items: DataFrame, lines: DataFrame) -> DataFrame:
    """(source, entity_id, ord, pattern, category, reason, keep) of all items: invalid by the first reason, duplicate of an earlier item, or normal.

    ``items`` as in SHAPE, source rule or entry. Patterns of keyword rules count as earlier for entries; bank lines repeat within their bank.
    """
    rows = items.withColumn("_p", _clean("pattern")).withColumn("_s", _clean("suggestion"))
    standard = rows.where("_s <> ''").select(F.col("_s").alias("_p"), F.lit(True).alias("_standard")).distinct()
    rows = rows.join(standard, "_p", "left").withColumn("_ok", compiles("_p"))
    reason = (
        F.when(F.col("_p") == "", F.when(F.col("source") == "entry", "关键词为空或全为空白字符").otherwise("匹配式为空或全为空白字符"))
        .when(F.col("_s") == "", F.lit("建议替换字段为空"))
        .when(F.col("_p") == F.col("_s"), F.when(F.col("source") == "entry", "关键词与建议替换完全相同").otherwise("匹配式与建议替换完全相同"))
        .when(F.col("_p").isin(NOISE), F.when(F.col("source") == "entry", "关键词为纯通用无意义单字，易大量误命中").otherwise("匹配式为纯通用无意义单字，易大量误命中"))
        .when((F.col("match_mode") == "regex") & ~F.col("_ok"), F.lit("正则表达式无法编译"))
        .when(F.col("_standard") & (F.coalesce("match_mode", F.lit("")) != "regex"), F.lit("标准正确术语不能作为匹配触发条件（标准术语只能放在建议栏）"))
    )
    own = rows.withColumn("reason", reason).withColumn("_key", F.when(F.coalesce("match_mode", F.lit("keyword")) == "regex", "regex").otherwise("keyword"))
    own = own.select("source", "entity_id", "ord", F.col("_p").alias("pattern"), "_key", "reason", F.when(F.col("source") == "rule", 0).otherwise(1).alias("_first"))
    banks = check_lines(lines).select(F.lit("bank").alias("source"), F.concat_ws(":", "bank", "line_no").alias("entity_id"), F.col("line_no").cast("long").alias("ord"), F.coalesce("line", F.lit("")).alias("pattern"), F.concat(F.lit("bank:"), "bank").alias("_key"), "reason", F.lit(2).alias("_first"))
    every = own.unionByName(banks)
    place = F.row_number().over(W.partitionBy("_key", "pattern", F.col("reason").isNull()).orderBy("_first", "ord"))
    every = every.withColumn("_n", place)
    repeat = F.col("reason").isNull() & (F.col("_n") > 1)
    category = F.when(F.col("reason").isNotNull(), "invalid").when(repeat, "duplicate").otherwise("normal")
    return every.select("source", "entity_id", "ord", "pattern", category.alias("category"), F.coalesce("reason", F.when(repeat, "与前文条目重复").otherwise("")).alias("reason"), (category == "normal").alias("keep"))


def cleanable(scanned: DataFrame) -> DataFrame:
    """Items that may be removed: invalid or repeated, but no bank lines."""
    return scanned.where("source <> 'bank' and not keep")


def clean(items: DataFrame, scanned: DataFrame, ids: DataFrame) -> DataFrame:
    """``items`` without those of ``ids`` that may be removed."""
    gone = cleanable(scanned).join(ids.select("entity_id").distinct(), "entity_id", "left_semi")
    return items.join(gone.select("source", "entity_id"), ["source", "entity_id"], "left_anti")


def bank_sizes(spark: SparkSession) -> DataFrame:
    """(bank, live lines)."""
    return bank_lines(spark).groupBy("bank").agg(F.count("*").alias("entries"))


#: Names of import groups by kind of template.
IMPORT_NAME = "外部导入 · {} · "


def build_import(rules: DataFrame, entries: DataFrame, rule_ids: DataFrame, entry_ids: DataFrame, existing: DataFrame, category: str = "通用") -> DataFrame:
    """(kind, name, items): the selected rules as one group and the selected entries as another, those that ``filter_batch`` keeps; empty groups are left out.

    ``rules``: id, ord, name, match_mode, pattern, severity, tag, suggestion; ``entries``: id, ord, keyword, tag, suggestion. Accepted rules count as existing for
    entries. A selection is what somebody ticked in a list, so a group is one row.
    """
    own = rules.join(rule_ids.select("id").distinct(), "id", "left_semi")
    words = entries.join(entry_ids.select("id").distinct(), "id", "left_semi").withColumns({"match_mode": F.lit(None).cast("string"), "pattern": F.col("keyword"), "name": F.col("keyword"), "severity": F.lit("low")})
    shape = ["id", "ord", "name", "match_mode", "pattern", "severity", "tag", "suggestion"]
    kept_rules = filter_batch(own.select(*shape), existing, dedup=True).where("kept")
    taken = kept_rules.where("coalesce(match_mode, 'keyword') = 'keyword'").select(F.lit("keyword").alias("kind"), F.lit(None).cast("string").alias("match_mode"), _clean("pattern").alias("value"))
    kept_words = filter_batch(words.select(*shape), existing.select("kind", "match_mode", "value").union(taken), dedup=True).where("kept")
    every = kept_rules.withColumn("kind", F.lit("rule")).unionByName(kept_words.withColumn("kind", F.lit("entry")))
    groups = every.groupBy("kind").agg(F.array_sort(F.collect_list(F.struct("ord", *[c for c in shape if c != "ord"]))).alias("items"))
    return groups.select("kind", F.concat(F.lit(IMPORT_NAME.format(category)), F.size("items").cast("string"), F.lit(" 条")).alias("name"), "items")


def enabled_by_section(spark: SparkSession, config: Config) -> DataFrame:
    """(section, enabled, total) of the built-in rules."""
    rows = spark.createDataFrame([(r.section, config.on(r.key)) for r in RULES.values()], "section string, live boolean")
    return rows.groupBy("section").agg(F.count_if("live").alias("enabled"), F.count("*").alias("total"))


def hits_by_section(issues: DataFrame, config: Config) -> DataFrame:
    """(section, enabled, total, hit, enabled_hit, issues): the rules of each section, and those with issues."""
    rows = issues.sparkSession.createDataFrame([(r.key, r.section, config.on(r.key)) for r in RULES.values()], "rule_key string, section string, live boolean")
    found = issues.groupBy("rule_key").agg(F.count("*").alias("n"))
    return rows.join(found, "rule_key", "left").groupBy("section").agg(
        F.count_if("live").alias("enabled"), F.count("*").alias("total"), F.count("n").alias("hit"), F.count(F.when(F.col("live"), F.col("n"))).alias("enabled_hit"), F.coalesce(F.sum("n"), F.lit(0)).alias("issues")
    )


def load_groups(spark: SparkSession, path: str, kind: str = "rules") -> DataFrame:
    """Stored groups as the frames of ``operators.custom``; a file that is missing or broken has none. ``kind``: rules or entries."""
    rule = "id string, name string, enabled boolean, match_mode string, pattern string, severity string, tag string, suggestion string"
    entry = "id string, keyword string, tag string, suggestion string, enabled boolean"
    group = f"groups array<struct<id:string,name:string,scope:string,enabled:boolean,{kind}:array<struct<{(rule if kind == 'rules' else entry).replace(' string', ':string').replace(' boolean', ':boolean')}>>>>"
    try:
        read = spark.read.schema(group).option("multiLine", "true").json(path)
        found = read.select(F.posexplode("groups").alias("g", "x")).select("g", F.col("x.id").alias("gid"), F.col("x.name").alias("gname"), F.coalesce("x.scope", F.lit("all")).alias("scope"), F.coalesce("x.enabled", F.lit(True)).alias("g_enabled"), F.posexplode(f"x.{kind}").alias("n", "i"))
    except AnalysisException:  # no such file
        return spark.createDataFrame([], custom.RULES if kind == "rules" else custom.ENTRIES)
    order = (F.col("g") * (1 << 16) + F.col("n")).cast("int").alias("ord")
    live = F.coalesce("i.enabled", F.lit(True)).alias("enabled")
    if kind == "rules":
        return found.select("gid", "gname", "scope", "g_enabled", F.col("i.id").alias("rid"), "i.name", live, "i.match_mode", "i.pattern", "i.severity", "i.tag", "i.suggestion", order)
    return found.select("gid", "gname", "scope", "g_enabled", F.col("i.id").alias("eid"), "i.keyword", "i.tag", "i.suggestion", live, order)


def save_groups(rows: DataFrame, path: str, kind: str = "rules") -> None:
    """Write such a frame as one group a line, in the form that ``load_groups`` reads; Spark puts a finished folder in the place of the old one."""
    own = F.struct(F.col("ord"), F.col("rid" if kind == "rules" else "eid").alias("id"), *(c for c in (["name", "enabled", "match_mode", "pattern", "severity", "tag", "suggestion"] if kind == "rules" else ["keyword", "tag", "suggestion", "enabled"])))
    groups = rows.groupBy("gid", "gname", "scope", "g_enabled").agg(F.array_sort(F.collect_list(own)).alias(kind), F.min("ord").alias("o"))  # a user's own rules
    whole = groups.agg(F.array_sort(F.collect_list(F.struct("o", F.col("gid").alias("id"), F.col("gname").alias("name"), "scope", F.col("g_enabled").alias("enabled"), kind))).alias("groups"))
    whole.coalesce(1).write.mode("overwrite").json(path)
