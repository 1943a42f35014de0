"""Numbered paragraphs: lists that ordinary text breaks, and numbers typed by hand that repeat, skip, go back or mix styles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscan.config import Config
from folioscan.functions.text import clip, regex, strip
from folioscan.model import hit
from folioscan.operators.paragraphs import complete

#: Styles of typed numbers, their patterns in order of trial and labels; digits.
STYLES = [
    ("arabic_dot", r"^\s*(\d{1,3})\s*[.．]\s*(?![0-9])", "1. 形式"),
    ("arabic_pause", r"^\s*(\d{1,3})\s*[、]", "1、形式"),
    ("arabic_paren", r"^\s*[（(]\s*(\d{1,3})\s*[）)]", "（1）形式"),
    ("cn_pause", r"^\s*([一二三四五六七八九十百]{1,4})\s*[、]", "一、形式"),
    ("cn_article", r"^\s*第\s*([一二三四五六七八九十百零〇\d]{1,5})\s*条", "第一条 形式"),
]
CN_DIGITS = "〇一二三四五六七八九"


def number_value(text: Column) -> Column:
    """Digits, or a Chinese numeral up to ninety-nine; null for anything else."""
    digit = lambda t: F.when(F.length(t) == 1, F.nullif(F.instr(F.lit(CN_DIGITS), F.replace(t, F.lit("零"), F.lit("〇"))), F.lit(0)) - 1)
    left, right = F.substring_index(text, "十", 1), text.substr(F.instr(text, "十") + 1, F.length(text))
    tens, ones = F.when(left == "", 1).otherwise(digit(left)), F.when(right == "", 0).otherwise(digit(right))
    digits = F.translate(text, "０１２３４５６７８９", "0123456789")
    return F.when(digits.rlike("^[0-9]+$"), digits.cast("int")).when(F.contains(text, F.lit("十")), tens * 10 + ones).otherwise(digit(text))


def typed_numbers(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, unit_idx, text, style, value) of paragraphs that begin with a typed number; the first style that fits counts."""
    rows = complete(paragraphs).where("num_id is null").select("doc_id", "unit_idx", strip(F.coalesce("text", F.lit(""))).alias("text")).where("text <> ''")
    style = F.coalesce(*(F.when(F.col("text").rlike(regex(p)), F.struct(F.lit(s).alias("style"), F.lit(n).alias("n"), F.regexp_extract("text", regex(p), 1).alias("raw"))) for n, (s, p, _) in enumerate(STYLES)))
    found = rows.select("doc_id", "unit_idx", "text", F.explode(F.array_compact(F.array(style))).alias("s"))
    return found.select("doc_id", "unit_idx", "text", F.col("s.style").alias("style"), F.explode(F.array_compact(F.array(number_value(F.col("s.raw"))))).alias("value"))


def sequences(paragraphs: DataFrame, config: Config | None = None) -> DataFrame:
    """(doc_id, unit_idx, location, hits): numbers that don't follow the one before of their style, from three of a style on; a new start at 1 is fine."""
    config = config or Config()
    style = W.partitionBy("doc_id", "style")
    rows = typed_numbers(paragraphs).withColumn("n", F.count("*").over(style)).where("n >= 3")
    before = lambda c: F.lag(c).over(style.orderBy("unit_idx"))
    rows = rows.withColumn("v1", before("value")).withColumn("i1", before("unit_idx")).where("v1 is not null and value <> v1 + 1 and not (value = 1 and v1 >= 2)")
    kind = F.when(F.col("value") == F.col("v1"), "重复").when(F.col("value") < F.col("v1"), "倒序").otherwise("跳号")
    detail = F.concat(F.lit("手工序号"), kind, F.lit("：上一个序号为 "), F.col("v1").cast("string"), F.lit("（第 "), F.col("i1").cast("string"), F.lit(" 段），当前为 "), F.col("value").cast("string"), F.lit("，编号不连续"))
    return rows.select("doc_id", "unit_idx", F.concat(F.lit("第 "), F.col("unit_idx").cast("string"), F.lit(" 段")).alias("location"), F.array(hit("manual_number_sequence", 95, detail, clip(F.col("text"), 80), config)).alias("hits"))


def mixed_styles(paragraphs: DataFrame, config: Config | None = None) -> DataFrame:
    """(doc_id, unit_idx, location, hits): documents that use two arabic styles or more."""
    config = config or Config()
    arabic = [(s, label) for s, _, label in STYLES if s.startswith("arabic")]
    firsts = [F.min(F.when(F.col("style") == s, F.struct("unit_idx", "text"))).alias(s) for s, _ in arabic]
    docs = typed_numbers(paragraphs).groupBy("doc_id").agg(*firsts)
    used = F.filter(F.array(*(F.when(F.col(s).isNotNull(), F.lit(label)) for s, label in arabic)), lambda x: x.isNotNull())
    docs = docs.withColumn("used", used).where(F.size("used") >= 2)
    at = F.least(*(F.col(f"{s}.unit_idx") for s, _ in arabic))
    detail = F.concat(F.lit("文档中混用了 "), F.size("used").cast("string"), F.lit(" 种阿拉伯数字序号格式："), F.array_join("used", "、"))
    text = F.coalesce(*(F.col(f"{s}.text") for s, _ in arabic))
    return docs.select("doc_id", at.alias("unit_idx"), F.concat(F.lit("第 "), at.cast("string"), F.lit(" 段起")).alias("location"), F.array(hit("number_format_mixed", 96, detail, clip(text, 80), config)).alias("hits"))


def broken_lists(paragraphs: DataFrame, config: Config | None = None) -> DataFrame:
    """(doc_id, unit_idx, location, hits): of each automatic list, the first place where ordinary text stands between two of its paragraphs."""
    config = config or Config()
    rows = complete(paragraphs)
    plain = F.col("num_id").isNull() & (strip(F.coalesce("text", F.lit(""))) != "")
    doc = W.partitionBy("doc_id").orderBy("unit_idx")
    so_far = F.sum(F.when(plain, 1).otherwise(0)).over(doc.rowsBetween(W.unboundedPreceding, 0))
    # counts of ordinary paragraphs up to here tell whether any lie between two paragraphs of one list
    listed = rows.select("doc_id", "unit_idx", "num_id", so_far.alias("k")).where("num_id is not null")
    own = W.partitionBy("doc_id", "num_id").orderBy("unit_idx")
    gaps = listed.withColumn("prev", F.lag("unit_idx").over(own)).withColumn("k1", F.lag("k").over(own)).where("k > k1").withColumn("n", F.row_number().over(own)).where("n = 1")
    ordinary = rows.where(plain).select("doc_id", F.col("unit_idx").alias("mid"), "text")
    ordinary = ordinary.withColumn("k2", F.row_number().over(W.partitionBy("doc_id").orderBy("mid")))
    found = gaps.join(ordinary, (gaps["doc_id"] == ordinary["doc_id"]) & (gaps["k1"] + 1 == ordinary["k2"])).select(gaps["doc_id"], "unit_idx", "prev", "num_id", "mid", "text")
    detail = F.concat(F.lit("自动编号列表（numId="), "num_id", F.lit("）被第 "), F.col("mid").cast("string"), F.lit(" 段普通段落打断，存在编号重新计数风险"))
    place = F.concat(F.lit("第 "), F.col("prev").cast("string"), F.lit(" 段 → 第 "), F.col("unit_idx").cast("string"), F.lit(" 段"))
    return found.select("doc_id", "unit_idx", place.alias("location"), F.array(hit("numbering_break", 94, detail, clip(F.col("text"), 80), config)).alias("hits"))
