"""Rules on paragraphs and their order: spaces, punctuation, brackets, blank runs, pages.

Frames of paragraphs have doc_id, unit_idx (from 1), text, and where a source knows them: style, num_id, br_count, br_page (a page break inside)
and br_last_rendered. Order matters only within a document, so every window is partitioned by doc_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscan.config import Config
from folioscan.functions.text import clip, joined, kept, occurrences, regex, strip, visualize
from folioscan.model import HITS, hit, paragraph_location

#: Invisible characters, bracket pairs with their names, patterns of punctuation, lines and characters of a page.
INVALID = ["\u00a0", "\u200b", "\u200c", "\u200d", "\ufeff", "\u000b", "\u000c", "\u2028", "\u2029"]
PAIRS = [("（", "）", "全角圆括号"), ("(", ")", "半角圆括号"), ("【", "】", "方头括号"), ("《", "》", "书名号"), ("“", "”", "中文双引号"), ("‘", "’", "中文单引号"), ("[", "]", "半角方括号")]
CJK = "[\u4e00-\u9fff\u3400-\u4dbf]"
EN_PUNCT_IN_CJK = r"(?:(?<=[\u4e00-\u9fff])[,;:!?]|[,;:!?](?=[\u4e00-\u9fff])|(?<=[\u4e00-\u9fff])\.(?![0-9a-zA-Z])|(?<=[\u4e00-\u9fff])\((?=[^)]*[\u4e00-\u9fff])|(?<=[\u4e00-\u9fff])\))"
REPEATED = r"([，。；：！？、,;:!?])\1+"
PAGE_LINES, LINE_CHARS = 38, 36
OPTIONAL = {"style": "string", "num_id": "string", "br_count": "int", "br_page": "boolean", "br_last_rendered": "boolean"}


def complete(paragraphs: DataFrame) -> DataFrame:
    """With the columns that a source may leave out."""
    for name, kind in OPTIONAL.items():
        if name not in paragraphs.columns:
            paragraphs = paragraphs.withColumn(name, F.lit(None).cast(kind))
    return paragraphs


def line_count(text: Column) -> Column:
    """How many lines of a page a text takes."""
    flat = F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return occurrences(text, "\n") + 1 + F.when(flat > 0, F.floor((flat - 1) / LINE_CHARS)).otherwise(0)


def table_pages(paged: DataFrame, cells: DataFrame) -> DataFrame:
    """(doc_id, tbl, page, estimated) of tables: they come after all paragraphs, and take a line for each of up to 40 rows while pages are estimated.

    ``paged``: paragraphs with page and estimated; ``cells``: doc_id, tbl, row.
    """
    ends = paged.groupBy("doc_id").agg(F.max("page").alias("last"), F.bool_and("estimated").alias("estimated"), F.sum(line_count(F.coalesce("text", F.lit("")))).alias("lines"))
    taken = F.sum(F.least("rows", F.lit(40))).over(W.partitionBy("doc_id").orderBy("tbl").rowsBetween(W.unboundedPreceding, 0))
    rows = cells.groupBy("doc_id", "tbl").agg(F.max("row").alias("rows")).withColumn("taken", taken).join(ends, "doc_id", "left")
    known = F.coalesce("estimated", F.lit(True))
    page = F.when(known, 1 + F.floor((F.coalesce("lines", F.lit(0)) + F.col("taken")) / PAGE_LINES)).otherwise(F.col("last"))
    return rows.select("doc_id", "tbl", page.cast("int").alias("page"), known.alias("estimated"))


def pages(paragraphs: DataFrame) -> DataFrame:
    """``paragraphs`` with page and estimated: by line counts until the first explicit break, by page breaks from there on."""
    order = W.partitionBy("doc_id").orderBy("unit_idx")
    so_far = order.rowsBetween(W.unboundedPreceding, 0)
    text = F.coalesce("text", F.lit(""))
    lines = line_count(text)
    is_break = F.coalesce("br_page", F.lit(False)) | F.coalesce("br_last_rendered", F.lit(False))
    marked = paragraphs.withColumn("_broken", F.max(is_break).over(so_far))
    first = marked.withColumn("_lines", F.sum(F.when(~F.col("_broken"), lines).otherwise(0)).over(so_far)).withColumn("_first", F.col("_broken") & ~F.coalesce(F.lag("_broken").over(order), F.lit(False)))
    turned = F.sum(F.when(F.col("_first") | F.col("_broken") & F.coalesce("br_page", F.lit(False)), 1).otherwise(0)).over(so_far)
    return first.withColumn("page", (1 + F.floor(F.col("_lines") / PAGE_LINES) + turned).cast("int")).withColumn("estimated", ~F.col("_broken")).drop("_broken", "_lines", "_first")


def blank_runs(paragraphs: DataFrame) -> DataFrame:
    """``paragraphs`` with is_heading, blank and run: the place of a blank paragraph in its run of blank ones; blank headings end a run."""
    order = W.partitionBy("doc_id").orderBy("unit_idx")
    style = F.coalesce("style", F.lit(""))
    marked = paragraphs.withColumn("is_heading", F.contains(style, F.lit("Heading")) | F.contains(style, F.lit("标题"))).withColumn("blank", strip(F.coalesce("text", F.lit(""))) == "")
    ends = ~F.col("blank") | F.col("is_heading")
    island = F.sum(F.when(ends, 1).otherwise(0)).over(order.rowsBetween(W.unboundedPreceding, 0))
    counted = marked.withColumn("_island", island).withColumn("_in", F.when(~ends, 1).otherwise(0))
    run = F.sum("_in").over(W.partitionBy("doc_id", "_island").orderBy("unit_idx").rowsBetween(W.unboundedPreceding, 0))
    return counted.withColumn("run", F.when(ends, 0).otherwise(run).cast("int")).drop("_island", "_in")


def blank_hits(config: Config) -> Column:
    """Findings of blank paragraphs; needs the columns of ``blank_runs``."""
    most, text = int(config.param("empty_paragraph", "max_continuous")), F.coalesce("text", F.lit(""))
    empty = F.lit("")
    found = [
        F.when(F.col("is_heading") & F.col("blank"), hit("empty_heading", 0, F.concat(F.lit("标题样式「"), F.coalesce("style", empty), F.lit("」段落内容为空")), empty, config)) if config.on("empty_heading") else None,
        F.when(~F.col("is_heading") & F.col("blank") & (F.col("run") > most), hit("empty_paragraph", 1, F.concat(F.lit("存在连续 "), F.col("run").cast("string"), F.lit(f" 个空段落（阈值 {most}）")), empty, config)) if config.on("empty_paragraph") else None,
        F.when(~F.col("is_heading") & F.col("blank") & (text != ""), hit("blank_redundant_content", 2, F.lit("段落仅包含空白字符（看似空行实则含空格），属冗余内容"), visualize(text), config)) if config.on("blank_redundant_content") else None,
    ]
    found = [f for f in found if f is not None]
    return kept(*found) if found else F.array().cast(HITS)


def _count(n: Column) -> Column:
    return n.cast("string")


def text_hits(text: Column, br_count: Column, config: Config) -> Column:
    """Findings of one paragraph that is not blank, in the order of the rules."""
    found: list[Column] = []

    def add(rule: str, when: Column, detail: Column, snippet: Column) -> None:
        if config.on(rule):
            found.append(F.when(when, hit(rule, 10 + len(found), detail, snippet, config)))

    wide, short = "\u3000", clip(text, 100)
    inner = F.regexp_replace(text, f"^{wide}+|{wide}+$", "")
    add("full_width_space", F.contains(inner, F.lit(wide)), F.concat(F.lit("段落内含 "), _count(occurrences(text, wide)), F.lit(" 处全角空格（U+3000）")), visualize(text))
    lead, tail = (F.regexp_extract(text, p, 0) for p in ("^[ \\t\u3000\u00a0]+", "[ \\t\u3000\u00a0]+$"))
    add("leading_space", lead != "", F.concat(F.lit("段首存在 "), _count(F.length(lead)), F.lit(" 个手工缩进空白字符")), visualize(F.substring(text, 1, 40)))
    add("trailing_space", tail != "", F.concat(F.lit("段落末尾存在 "), _count(F.length(tail)), F.lit(" 个多余空白字符")), visualize(F.right(text, F.lit(40))))
    names = joined([F.when(F.contains(text, F.lit(c)), F.lit(f"U+{ord(c):04X}")) for c in INVALID], "、")
    add("invalid_whitespace", names != "", F.concat(F.lit("含不可见异常字符："), names), visualize(text))
    gap = F.regexp_extract(strip(text), " {2,}", 0)
    add("multi_space", F.length(gap) >= int(config.param("multi_space", "min_count")), F.concat(F.lit("存在 "), _count(F.length(gap)), F.lit(" 个连续半角空格")), short)
    marks = F.regexp_extract_all(text, F.lit(EN_PUNCT_IN_CJK), F.lit(0))
    add("punct_mix", text.rlike(CJK) & text.rlike(EN_PUNCT_IN_CJK), F.concat(F.lit("中文语境中使用英文标点："), F.array_join(F.array_sort(F.array_distinct(marks)), "、"), F.lit("（共 "), _count(F.size(marks)), F.lit(" 处）")), short)
    repeat = F.regexp_extract(text, REPEATED, 0)
    add("punct_repeat", repeat != "", F.concat(F.lit("出现连续重复标点「"), repeat, F.lit("」")), short)
    odd = F.coalesce(*(F.when(occurrences(text, a) != occurrences(text, b), F.concat(F.lit(f"{name} 数量不配对（左 "), _count(occurrences(text, a)), F.lit(" 个 / 右 "), _count(occurrences(text, b)), F.lit(" 个）"))) for a, b, name in PAIRS))
    add("bracket_unpaired", odd.isNotNull(), odd, short)
    most = int(config.param("manual_line_break", "max_breaks"))
    add("manual_line_break", br_count > most, F.concat(F.lit("同一段落内含 "), _count(br_count), F.lit(f" 个手动换行符（阈值 {most}）")), short)
    return kept(*found) if found else F.array().cast(HITS)


def check(paragraphs: DataFrame, config: Config | None = None) -> DataFrame:
    """``paragraphs`` with page, estimated, location and their findings in ``hits``."""
    config = config or Config()
    rows = blank_runs(pages(complete(paragraphs)))
    rows = rows.withColumn("location", paragraph_location(F.col("page"), F.col("unit_idx"), F.col("estimated")))
    return rows.withColumn("hits", F.when(F.col("blank"), blank_hits(config).cast(HITS)).otherwise(text_hits(F.col("text"), F.coalesce("br_count", F.lit(0)), config).cast(HITS)))


def tail_blank(paragraphs: DataFrame, config: Config | None = None, least: int = 3) -> DataFrame:
    """(doc_id, location, hits): documents that end in ``least`` blank paragraphs or more."""
    config = config or Config()
    blank = strip(F.coalesce("text", F.lit(""))) == ""
    tails = paragraphs.groupBy("doc_id").agg((F.max("unit_idx") - F.coalesce(F.max(F.when(~blank, F.col("unit_idx"))), F.lit(0))).alias("n")).where(F.col("n") >= least)
    n = F.col("n").cast("string")
    return tails.select("doc_id", F.concat(F.lit("文档结尾（末 "), n, F.lit(" 段）")).alias("location"), F.array(hit("blank_redundant_content", 90, F.concat(F.lit("文档末尾存在 "), n, F.lit(" 个连续空段落，属排版冗余")), F.lit(""), config)).alias("hits"))
